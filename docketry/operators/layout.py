"""Regions of pages: overlaps resolved, reading order with flows and captions, tables from boxes, pages put together.

A region or cell is (page_id, region_id or cell_id, x1, y1, x2, y2, ...). Work is joined and grouped by page; only the recursive
cut of a page's regions is Python, over the rows of one page at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.fold import folded
from docketry.operators.structure import area, inter, overlap
from docketry.session import settled, unbroadcast

_BOX = ("x1", "y1", "x2", "y2")
#: Which kinds of region win, and by how much boxes must agree to be one.
PRIORITY = {"table": 5, "chart": 4, "figure": 3, "equation": 3, "form_field": 3, "signature": 3, "title": 2, "list": 2, "caption": 2, "text": 1}
CONTAINED, SAME = 0.8, 0.9
#: Least gaps of a cut and the farthest caption, as shares of the page.
GAP_X, GAP_Y, CAPTION_SHARE = 0.02, 0.008, 0.12
NUMBER = r"^[-+(]?[$€£₹]?\s*[\d.,]+\s*%?\)?$"


def _side(df: DataFrame, p: str, *keep: str) -> DataFrame:
    return df.select("page_id", *(F.col(c).alias(p + c) for c in (*_BOX, *keep)))


# -- overlaps


def conflicts(regions: DataFrame) -> DataFrame:
    """(page_id, winner, loser): pairs of a page where the first takes the second's place if it is kept itself.

    A region of higher priority wins over one that lies in it; of equal priority, the surer of two that are nearly the same.
    """
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[F.col("type")], F.lit(1))
    r = regions.select("page_id", "region_id", *_BOX, rank.alias("rank"), "confidence")
    a, b = _side(r, "a_", "region_id", "rank", "confidence"), _side(r, "b_", "region_id", "rank", "confidence")
    meet = (F.col("a_x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("a_x2")) & (F.col("a_y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("a_y2"))
    j = a.join(unbroadcast(b), "page_id").filter(meet & (F.col("a_region_id") != F.col("b_region_id")))
    shared = inter("a_", "b_")
    above = (F.col("a_rank") > F.col("b_rank")) & (shared >= CONTAINED * area("b_"))
    surer = F.struct(-F.col("a_confidence"), F.col("a_region_id")) < F.struct(-F.col("b_confidence"), F.col("b_region_id"))
    same = (F.col("a_rank") == F.col("b_rank")) & surer & (shared >= SAME * (area("a_") + area("b_") - shared))
    return j.filter(above | same).select("page_id", F.col("a_region_id").alias("winner"), F.col("b_region_id").alias("loser"))


def without_overlaps(regions: DataFrame) -> DataFrame:
    """The regions that a pass in the order of priority and confidence would keep, decided in rounds of joins.

    A region is dropped once a kept one wins over it, and kept once all that win over it are dropped. Each round decides at least
    the first undecided region of every page; what is still open is carried on as a table.
    """
    edges = settled(conflicts(regions), "region-conflicts")
    lost, keys = None, ["page_id", "region_id"]
    open_edges = edges
    while not open_edges.isEmpty():
        # Winners that nothing open wins over are kept: what they win over is lost, and with it its own claims.
        beaten = open_edges.select("page_id", F.col("loser").alias("winner")).distinct()
        sure = open_edges.join(unbroadcast(beaten), ["page_id", "winner"], "left_anti")
        now = settled(sure.select("page_id", F.col("loser").alias("region_id")).distinct(), "regions-lost")
        lost = now if lost is None else lost.unionByName(now)
        rest = open_edges.join(unbroadcast(now.withColumnRenamed("region_id", "loser")), ["page_id", "loser"], "left_anti")
        open_edges = settled(rest.join(unbroadcast(now.withColumnRenamed("region_id", "winner")), ["page_id", "winner"], "left_anti"), "region-conflicts")
    return regions if lost is None else regions.join(unbroadcast(lost), keys, "left_anti")


# -- reading order


def _widest_gap(spans: list[tuple[float, float]]) -> tuple[float, float]:
    """The widest stretch between spans that none covers, and its middle."""
    best, end = (0.0, 0.0), None
    for lo, hi in sorted(spans):
        if end is not None and lo - end > best[0]:
            best = (lo - end, (lo + end) / 2)
        end = hi if end is None else max(end, hi)
    return best


def cut_order(boxes: list[tuple[float, float, float, float]], width: float, height: float) -> list[tuple[int, int, float]]:
    """(box, group, sureness) in reading order: a part is cut at its widest gap, relative to the page; what can't be cut reads in rows and is less sure."""
    out: list[tuple[int, int, float]] = []
    groups = 0
    todo = [(list(range(len(boxes))), 1.0)]
    while todo:
        part, sure = todo.pop()
        gaps = []
        for axis, least in ((1, GAP_Y * height), (0, GAP_X * width)):
            gap, at = _widest_gap([(boxes[i][axis], boxes[i][axis + 2]) for i in part])
            if len(part) > 1 and gap >= least:
                gaps.append((gap / (height if axis else width), axis, at, 1.0 if gap >= 2 * least else 0.8))
        if gaps:
            _, axis, at, weight = max(gaps, key=lambda g: (g[0], g[1]))
            before = [i for i in part if (boxes[i][axis] + boxes[i][axis + 2]) / 2 < at]
            after = [i for i in part if i not in set(before)]
            todo += [(after, min(sure, weight)), (before, min(sure, weight))]
            continue
        tall = sorted(boxes[i][3] - boxes[i][1] for i in part)
        row = max(1.0, tall[len(tall) // 2] / 2) if part else 1.0
        rows = sorted(part, key=lambda i: (round((boxes[i][1] + boxes[i][3]) / 2 / row), boxes[i][0], boxes[i][1], i))
        out += [(i, groups, sure if len(part) == 1 else min(sure, 0.6)) for i in rows]
        groups += bool(part)
    return out


def captions_of(regions: DataFrame) -> DataFrame:
    """(page_id, caption, parent, above): each caption with the nearest table, chart or figure that it overlaps by three tenths of the narrower one's width, near enough."""
    c = _side(regions.filter("type = 'caption'"), "c_", "region_id", "page_height")
    p = _side(regions.filter("type IN ('table', 'chart', 'figure')"), "p_", "region_id")
    gap = F.greatest(F.col("p_y1") - F.col("c_y2"), F.col("c_y1") - F.col("p_y2"), F.lit(0.0))
    wide = overlap("c_", "p_", "x1", "x2") >= 0.3 * F.least(F.col("c_x2") - F.col("c_x1"), F.col("p_x2") - F.col("p_x1"))
    j = c.join(p, "page_id").withColumn("gap", gap).filter(wide & (F.col("gap") <= CAPTION_SHARE * F.col("c_page_height")))
    best = j.groupBy("page_id", F.col("c_region_id").alias("caption")).agg(F.min(F.struct("gap", "p_region_id", (F.col("c_y1") < F.col("p_y1")).alias("above"), F.col("c_y1").alias("y"))).alias("b"))
    return best.select("page_id", "caption", F.col("b.p_region_id").alias("parent"), F.col("b.above").alias("above"), F.col("b.y").alias("y"))


def region_order(regions: DataFrame) -> DataFrame:
    """(page_id, region_id, flow, place, parent, sureness): headers, the cut order of the main flow with captions at their parents, footers; `place` from 0.

    Regions are (page_id, region_id, type, box, page_width, page_height).
    """
    attached = captions_of(regions)
    flow = F.when(F.col("type").isin("header", "footer"), F.col("type")).otherwise("main")
    d = regions.withColumn("flow", flow).join(attached.withColumnRenamed("caption", "region_id").drop("y"), ["page_id", "region_id"], "left")
    main = d.filter("flow = 'main' AND parent IS NULL").select("page_id", "region_id", *(F.col(c).cast("double").alias(c) for c in (*_BOX, "page_width", "page_height")))

    def run(rows: list[tuple]) -> list[tuple]:
        return [(rows[i][0], rows[i][1], k, sure) for k, (i, _, sure) in enumerate(cut_order([r[2:6] for r in rows], rows[0][6], rows[0][7]))]

    cut = folded(main, "page_id", ["region_id"], run, "page_id long, region_id long, at long, sureness double", ["page_id", "region_id", "at", "sureness"])
    # A caption stands right before or behind its parent, several by height.
    own = d.join(cut, ["page_id", "region_id"], "left")
    of = cut.select("page_id", F.col("region_id").alias("parent"), F.col("at").alias("p_at"), F.col("sureness").alias("p_sure"))
    d = own.join(of, ["page_id", "parent"], "left")
    order = Window.partitionBy("page_id").orderBy(
        F.when(F.col("flow") == "header", 0).when(F.col("flow") == "main", 1).otherwise(2), F.coalesce("at", "p_at"), F.when(F.col("parent").isNull(), 0).when(F.col("above"), -1).otherwise(1), "y1", "x1", "region_id"
    )
    return d.select("page_id", "region_id", "flow", (F.row_number().over(order) - 1).alias("place"), "parent", F.coalesce("sureness", "p_sure", F.lit(1.0)).alias("sureness"))


def order_agreement(ordered: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, n, inversions, tau): Kendall's tau of the reading order with rows from top to bottom, by counting the pairs that stand the other way round.

    Inversions are counted inside each page's array of ranks, so no pairs are made.
    """
    line = F.round(F.col("y1") / F.greatest(F.lit(1.0), 0.01 * F.col("page_height")))
    w = Window.partitionBy("page_id").orderBy(line, "x1", "region_id")
    ranks = regions.withColumn("by_rows", F.row_number().over(w)).join(ordered.select("page_id", "region_id", "place"), ["page_id", "region_id"])
    seq = F.transform(F.array_sort(F.collect_list(F.struct("place", "by_rows"))), lambda s: s["by_rows"])
    d = ranks.groupBy("page_id").agg(seq.alias("seq")).withColumn("n", F.size("seq"))
    later = F.transform("seq", lambda x, i: F.size(F.filter(F.slice("seq", i + 2, F.col("n")), lambda y: y < x)))
    d = d.withColumn("inversions", F.aggregate(later, F.lit(0), lambda a, x: a + x))
    return d.select("page_id", "n", "inversions", F.when(F.col("n") > 1, 1 - 4 * F.col("inversions") / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("tau"))


# -- tables from boxes


def clusters(spans: DataFrame, by: list[str], lo: str, hi: str, name: str) -> DataFrame:
    """Numbers the groups of intervals that overlap one another: a new one starts past the end of all before it."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    past = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn(name, F.sum(F.when(F.col(lo) > past, 1).otherwise(0)).over(w).cast("int"))


def spanning_cells(cells: DataFrame) -> DataFrame:
    """(page_id, cell_id, row, col, col_span, is_header, text) of a page's table from boxes of text (page_id, cell_id, box, text).

    Rows are clusters of the boxes' middle halves. Columns are clusters of intervals over the rows with most boxes. A box covers
    the columns that hold more than a quarter of its width or of which it has half, or the nearest one; over several, it spans them. Header
    rows are those above the first row with numbers in most of its columns but the first, if there is one; such rows hold no number.
    """
    mid = lambda lo, hi, s: F.col(lo) + s * (F.col(hi) - F.col(lo))
    d = clusters(cells.withColumns({"_t": mid("y1", "y2", 0.25), "_b": mid("y1", "y2", 0.75)}), ["page_id"], "_t", "_b", "row").drop("_t", "_b")
    counted = d.withColumn("_n", F.count("*").over(Window.partitionBy("page_id", "row")))
    full = counted.withColumn("_most", F.max("_n").over(Window.partitionBy("page_id"))).filter("_n = _most")
    cols = clusters(full.select("page_id", "x1", "x2"), ["page_id"], "x1", "x2", "col").groupBy("page_id", "col").agg(F.min("x1").alias("c1"), F.max("x2").alias("c2"))
    j = d.join(cols, "page_id")
    shared = F.greatest(F.least(F.col("x2"), F.col("c2")) - F.greatest(F.col("x1"), F.col("c1")), F.lit(0.0))
    held = (shared > 0) & ((shared > 0.25 * (F.col("x2") - F.col("x1"))) | (shared >= 0.5 * (F.col("c2") - F.col("c1"))))
    off = F.abs((F.col("x1") + F.col("x2")) / 2 - (F.col("c1") + F.col("c2")) / 2)
    placed = j.groupBy("page_id", "cell_id", "row", "text").agg(F.min(F.when(held, F.col("col"))).alias("first"), F.max(F.when(held, F.col("col"))).alias("last"), F.min_by("col", F.struct(off, "col")).alias("near"))
    placed = placed.select("page_id", "cell_id", "row", "text", F.coalesce("first", "near").alias("col"), (F.coalesce(F.col("last") - F.col("first"), F.lit(0)) + 1).alias("col_span"))
    number = F.trim("text").rlike(NUMBER)
    kinds = placed.groupBy("page_id", "row").agg(F.count_if(number & (F.col("col") > 0)).alias("numbers"), F.count_if(F.col("col") > 0).alias("values"), F.count_if(number).alias("any"))
    first = kinds.groupBy("page_id").agg(F.min(F.when((F.col("values") > 0) & (2 * F.col("numbers") > F.col("values")), F.col("row"))).alias("body"), F.min(F.when(F.col("any") > 0, F.col("row"))).alias("stop"))
    head = (F.col("row") < F.col("body")) & (F.col("row") < F.col("stop"))
    return placed.join(first, "page_id").select("page_id", "cell_id", "row", "col", "col_span", F.coalesce(head, F.lit(False)).alias("is_header"), "text")


# -- pages


def assembled(pages: DataFrame, **blocks: DataFrame) -> DataFrame:
    """(source_id, page_id, page_number, blocks, n_blocks, counts, status): all blocks of a page as one array in reading order.

    Pages are (source_id, page_id, page_number); each frame of `blocks` holds one type, named by its keyword, as (page_id,
    block_id, place, text, confidence, bbox array or null). A page without blocks stays, as 'blank'. Blocks of a type and place
    that tie are ordered by their names, and the places of a page become gapless.
    """
    typed = None
    for kind, df in blocks.items():
        one = df.select("page_id", F.lit(kind).alias("type"), F.col("block_id").cast("string").alias("block_id"), F.col("place").cast("double").alias("at"), "text", F.col("confidence").cast("double").alias("confidence"), F.col("bbox").cast("array<double>").alias("bbox"))
        typed = one if typed is None else typed.unionByName(one)
    item = F.struct("at", "type", "block_id", "text", "confidence", "bbox", F.when(F.col("bbox").isNull(), "not_located").alias("bbox_unavailable_reason"))
    rows = typed.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    d = pages.join(rows, "page_id", "left").withColumn("items", F.coalesce("items", F.array().cast(rows.schema["items"].dataType)))
    placed = F.transform("items", lambda b, i: F.struct(i.alias("reading_order_index"), *(b[c].alias(c) for c in ("type", "block_id", "text", "confidence", "bbox", "bbox_unavailable_reason"))))
    counts = F.create_map(*(x for k in blocks for x in (F.lit(k), F.aggregate("items", F.lit(0), _counter(k)))))
    return d.select("source_id", "page_id", "page_number", placed.alias("blocks"), F.size("items").alias("n_blocks"), counts.alias("counts"), F.when(F.size("items") == 0, "blank").otherwise("ok").alias("status"))


def _counter(kind: str):
    return lambda acc, b: acc + (b["type"] == kind).cast("int")


def documents(assembled_pages: DataFrame) -> DataFrame:
    """(source_id, pages, n_pages, n_blocks, confidence, markdown): the pages of each source in order as one nested document."""
    page = F.struct("page_number", "page_id", "status", "blocks")
    d = assembled_pages.groupBy("source_id").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.sum("n_blocks").alias("n_blocks"))
    blocks = F.flatten(F.transform("pages", lambda p: p["blocks"]))
    total = F.aggregate(blocks, F.lit(0.0), lambda a, b: a + F.coalesce(b["confidence"], F.lit(0.0)))
    line = lambda b: F.when(b["type"] == "title", F.concat(F.lit("# "), b["text"])).when(b["type"] == "equation", F.concat(F.lit("$"), b["text"], F.lit("$"))).otherwise(b["text"])
    return d.select("source_id", "pages", F.size("pages").alias("n_pages"), "n_blocks", F.when(F.col("n_blocks") > 0, total / F.col("n_blocks")).alias("confidence"), F.array_join(F.transform(blocks, line), "\n\n").alias("markdown"))


def broken_invariants(assembled_pages: DataFrame) -> DataFrame:
    """(page_id, faults) of pages that break a rule: gapless order, distinct blocks, confidence from 0 to 1, a box with area or a reason, counts that add up."""
    b = F.col("blocks")
    box = lambda x: F.coalesce((F.get(x, F.lit(2)) > F.get(x, F.lit(0))) & (F.get(x, F.lit(3)) > F.get(x, F.lit(1))), F.lit(False))
    rules = {
        "order": F.forall(F.transform(b, lambda x, i: x["reading_order_index"] == i), lambda ok: ok),
        "repeated_block": F.size(F.array_distinct(F.transform(b, lambda x: F.struct(x["type"], x["block_id"])))) == F.size(b),
        "confidence": F.forall(b, lambda x: x["confidence"].isNull() | x["confidence"].between(0, 1)),
        "location": F.forall(b, lambda x: F.when(x["bbox"].isNull(), x["bbox_unavailable_reason"].isNotNull()).otherwise(box(x["bbox"]))),
        "counts": F.aggregate(F.map_values("counts"), F.lit(0), lambda a, x: a + x) == F.col("n_blocks"),
    }
    faults: Column = F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in rules.items())))
    return assembled_pages.select("page_id", faults.alias("faults")).filter(F.size("faults") > 0)


def missing_outputs(assembled_pages: DataFrame, expected: DataFrame) -> DataFrame:
    """(page_id, type, expected, found) where a page holds fewer blocks of a type than its extractors gave: (page_id, type, n)."""
    found = assembled_pages.select("page_id", F.explode("counts").alias("type", "found"))
    d = expected.join(found, ["page_id", "type"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return d.filter("found < n").select("page_id", "type", F.col("n").alias("expected"), "found")
