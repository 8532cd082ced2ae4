"""Page structure: boxes, reading order, rows and tables, captions, coverage, equations, bars.

Relations between boxes are equi-joins on the page with range predicates. Recursive layout works on one page's boxes at a time
(a sorted fold per page); pages are bounded by their nature.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import numbers
from docketry.operators.fold import folded

#: Least shares and sizes of tables, gaps of captions and equations.
MIN_FILL, MIN_CONSISTENCY, MAX_WORDS, CAPTION_GAP = 0.5, 0.6, 12, 0.06
CAPTION = r"(?i)^\s*(fig(ure)?|chart|graph|diagram|image|plate|plot)\.?\s*\d+"
_BOX = ("x1", "y1", "x2", "y2")


def area(p: str = "") -> Column:
    x1, y1, x2, y2 = (F.col(p + c) for c in _BOX)
    return F.greatest(x2 - x1, F.lit(0)) * F.greatest(y2 - y1, F.lit(0))


def overlap(a: str, b: str, lo: str, hi: str) -> Column:
    return F.greatest(F.least(F.col(a + hi), F.col(b + hi)) - F.greatest(F.col(a + lo), F.col(b + lo)), F.lit(0))


def inter(a: str, b: str) -> Column:
    return overlap(a, b, "x1", "x2") * overlap(a, b, "y1", "y2")


def same_place(a: str, b: str) -> Column:
    """Vertical overlap of half, horizontal of 0.3, of the smaller box."""
    small = lambda lo, hi: F.least(F.col(a + hi) - F.col(a + lo), F.col(b + hi) - F.col(b + lo))
    return (overlap(a, b, "y1", "y2") >= 0.5 * small("y1", "y2")) & (overlap(a, b, "x1", "x2") >= 0.3 * small("x1", "x2"))


def center_inside(a: str, b: str) -> Column:
    return ((F.col(a + "x1") + F.col(a + "x2")) / 2).between(F.col(b + "x1"), F.col(b + "x2")) & ((F.col(a + "y1") + F.col(a + "y2")) / 2).between(F.col(b + "y1"), F.col(b + "y2"))


def rotated(x: Column, y: Column, rotation: int, width: Column, height: Column) -> tuple[Column, Column]:
    """A point of a page turned by a multiple of 90 degrees, on the upright page."""
    return {0: (x, y), 90: (height - y, x), 180: (width - x, height - y), 270: (y, width - x)}[rotation % 360]


def _pre(df: DataFrame, p: str, keep: tuple[str, ...]) -> DataFrame:
    return df.select("page_id", *(F.col(c).alias(p + c) for c in (*_BOX, *keep)))


def ocr_for_native(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """(page_id, span_id, ocr_text): the OCR lines in the place of each native span, in reading order, repeats dropped."""
    j = _pre(native, "n_", ("span_id",)).join(_pre(ocr, "o_", ("line_id", "text")), "page_id").filter(same_place("n_", "o_"))
    rows = F.array_sort(F.collect_set(F.struct(F.col("o_y1").alias("y"), F.col("o_x1").alias("x"), F.col("o_line_id").alias("id"), F.col("o_text").alias("t"))))
    return j.groupBy("page_id", F.col("n_span_id").alias("span_id")).agg(F.array_join(F.array_distinct(F.transform(rows, lambda r: r["t"])), " ").alias("ocr_text"))


def unconsumed(ocr: DataFrame, native: DataFrame) -> DataFrame:
    """OCR lines in no native span's place: an anti-join on the page with the place as its residue."""
    o, n = _pre(ocr, "o_", ("line_id", "text")), _pre(native, "n_", ("span_id",))
    used = o.join(n, "page_id").filter(same_place("o_", "n_")).select("page_id", "o_line_id").distinct()
    return o.join(used, ["page_id", "o_line_id"], "left_anti").select("page_id", F.col("o_line_id").alias("line_id"), F.col("o_text").alias("text"))


def nearest_captions(figures: DataFrame, texts: DataFrame, heights: DataFrame) -> DataFrame:
    """(page_id, figure_id, caption_id): the best text within the gap: labelled first, then below, then near, then id."""
    j = _pre(figures, "f_", ("figure_id",)).join(_pre(texts, "t_", ("block_id", "text")), "page_id").join(heights, "page_id")
    below, above = F.col("t_y1") - F.col("f_y2"), F.col("f_y1") - F.col("t_y2")
    gap = F.when(below >= 0, below).when(above >= 0, above)
    j = j.withColumn("gap", gap).filter((F.col("gap") <= CAPTION_GAP * F.col("height")) & (overlap("f_", "t_", "x1", "x2") > 0))
    w = Window.partitionBy("page_id", "f_figure_id").orderBy((~F.col("t_text").rlike(CAPTION)).cast("int"), (below < 0).cast("int"), "gap", "t_block_id")
    return j.withColumn("k", F.row_number().over(w)).filter("k = 1").select("page_id", F.col("f_figure_id").alias("figure_id"), F.col("t_block_id").alias("caption_id"))


def gap_groups(df: DataFrame, by: list[str], position: str, gap: float) -> DataFrame:
    """Numbers runs of neighbours whose distance is at most `gap` (rows, ticks, bars)."""
    w = Window.partitionBy(*by).orderBy(position)
    new = (F.col(position) - F.lag(position).over(w) > gap).cast("int")
    return df.withColumn("group", F.sum(F.coalesce(new, F.lit(0))).over(w))


def gap_cuts(df: DataFrame, by: list[str], lo: str, hi: str, least: float) -> DataFrame:
    """Cuts of a projection: places where an interval starts more than `least` past the end of all before it."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    end = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_e", end).filter(F.col(lo) - F.col("_e") >= least).select(*by, F.col("_e").alias("cut_from"), F.col(lo).alias("cut_to"))


def xy_cut(boxes: list[tuple[float, float, float, float]], page_width: float) -> list[int]:
    """Reading order by recursive cuts: columns before rows; a column gap is at least max(8, 1.5 % of the page)."""
    least = max(8.0, 0.015 * page_width)

    def parts(ids: list[int], lo: int, hi: int, gap: float) -> list[list[int]]:
        ids, out, end = sorted(ids, key=lambda i: (boxes[i][lo], i)), [], None
        for i in ids:
            if end is None or boxes[i][lo] - end >= gap:
                out.append([])
            out[-1].append(i)
            end = boxes[i][hi] if end is None else max(end, boxes[i][hi])
        return out

    def cut(ids: list[int]) -> list[int]:
        if len(ids) < 2:
            return ids
        for lo, hi, gap in ((0, 2, least), (1, 3, 0.5)):
            if len(found := parts(ids, lo, hi, gap)) > 1:
                return [k for p in found for k in cut(p)]
        return sorted(ids, key=lambda i: (boxes[i][1], boxes[i][0], i))

    return cut(list(range(len(boxes))))


#: Places of the page widths met last.
_PLACES: dict[float, list[float]] = {}


def _gutter_places(page_width: float) -> list[float]:
    if (found := _PLACES.get(page_width)) is None:
        if len(_PLACES) >= 64:
            _PLACES.clear()
        found = _PLACES[page_width] = sorted(np.linspace(0.3 * page_width, 0.7 * page_width, 81).tolist())
    return found


def find_gutter(boxes: list[tuple], page_width: float) -> float | None:
    """The middle of a vertical strip near the page's centre that at most a tenth of the boxes cross, with boxes on both sides.

    Boxes left and right of a place change only where an edge lies, so places are taken in stretches between edges, each with its place nearest to the centre.
    """
    if len(boxes) < 4 or not math.isfinite(page_width):
        return None
    places = _gutter_places(page_width)
    ends = sorted(bisect_left(places, b[2]) for b in boxes if b[2] == b[2])
    starts = sorted(bisect_right(places, b[0]) for b in boxes if b[0] == b[0])
    n, most, centre = len(boxes), max(1, 0.1 * len(boxes)), len(places) // 2
    cuts = sorted({0, len(places), *ends, *starts})
    best = None
    for lo, hi in zip(cuts, cuts[1:]):
        left, right = bisect_right(ends, lo), len(starts) - bisect_right(starts, lo)
        crossing = n - left - right
        if left >= 2 and right >= 2 and crossing <= most:
            x = places[min(max(centre, lo), hi - 1)]
            score = (crossing, abs(x - page_width / 2), x)
            best = min(best, score) if best else score
    return best[2] if best else None


def gutter_order(boxes: list[tuple], page_width: float, depth: int = 0) -> list[int]:
    """Reading order with spanning bands: boxes that cross the gutter part the page, each band reads left column first."""
    ids = list(range(len(boxes)))
    g = find_gutter(boxes, page_width) if depth < 2 else None
    if g is None:
        return sorted(ids, key=lambda i: (boxes[i][1], boxes[i][0], i))
    spans = [i for i in ids if boxes[i][0] < g < boxes[i][2]]
    crossing = set(spans)
    spans.sort(key=lambda i: boxes[i][1])
    out, rest = [], [i for i in ids if i not in crossing]
    for s in [*spans, None]:
        band, after = [], []
        for i in rest:
            (band if s is None or boxes[i][1] < boxes[s][1] else after).append(i)
        rest = after
        # What does not end left of the gutter is read on the right, so that each box is read once.
        for side in ([i for i in band if boxes[i][2] <= g], [i for i in band if not boxes[i][2] <= g]):
            out += [side[k] for k in gutter_order([boxes[i] for i in side], page_width, depth + 1)]
        out += [] if s is None else [s]
    return out


def reading_order(boxes: DataFrame, method: str = "xy_cut") -> DataFrame:
    """(page_id, box_id, reading_order_index) of boxes (page_id, box_id, x1..y2, page_width)."""
    order = {"xy_cut": xy_cut, "gutter": gutter_order}[method]

    def run(rows: list[tuple]) -> list[tuple]:
        return [(rows[i][0], rows[i][1], k) for k, i in enumerate(order([r[2:6] for r in rows], float(rows[0][6])))]

    return folded(boxes.select("page_id", "box_id", *_BOX, "page_width"), "page_id", ["box_id"], run, "page_id long, box_id long, reading_order_index int", ["page_id", "box_id", "reading_order_index"])


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of recognized words (page_id, block, par, line, word_no, text, conf, box): text in order, length-weighted confidence, joint box."""
    n = F.length("text")
    return words.groupBy("page_id", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda r: r["text"]), " ").alias("text"), (F.sum(F.col("conf") * n) / F.sum(n)).alias("conf"), *(f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), _BOX)))


def table_grid(lines: DataFrame, row_gap: float, col_gap: float) -> DataFrame:
    """Cells of a recognized table: rows by gaps of y, columns by gaps of x, both as runs of neighbours."""
    rows = gap_groups(lines, ["page_id"], "y1", row_gap).withColumnRenamed("group", "row")
    return gap_groups(rows, ["page_id"], "x1", col_gap).withColumnRenamed("group", "col")


def table_validity(cells: DataFrame) -> DataFrame:
    """Per table: null, or why it is none: too small, sparse, ragged rows, or sentences."""
    per_row = cells.groupBy("table_id", "row").agg(F.count("*").alias("n"), F.count_if(F.trim("text") != "").alias("filled"), F.max(F.size(F.split("text", r"\s+"))).alias("words"))
    d = per_row.groupBy("table_id").agg(F.count("*").alias("rows"), F.max("n").alias("cols"), F.sum("filled").alias("filled"), F.mode("filled").alias("usual"), F.collect_list("filled").alias("each"), F.max("words").alias("words"))
    same = F.size(F.filter("each", lambda x: x == F.col("usual"))) / F.col("rows")
    why = F.when((F.col("rows") < 2) | (F.col("cols") < 2), "too_small").when(F.col("filled") / (F.col("rows") * F.col("cols")) < MIN_FILL, "sparse").when(same < MIN_CONSISTENCY, "ragged").when(F.col("words") > MAX_WORDS, "sentences")
    return d.select("table_id", "rows", "cols", why.alias("reason"))


def review_reasons(confidence: Column, agreement: Column, garbage: Column, below: float = 0.8) -> Column:
    return F.array_compact(F.array(F.when(confidence < below, "low_confidence"), F.when(agreement < 0.6, "extractor_disagreement"), F.when(garbage > 0.1, "garbled_glyphs")))


def page_status(blocks: Column, ink: Column, ocr_failed: Column, coverage: Column) -> Column:
    return F.when((blocks == 0) & (ink == 0), "blank").when((blocks == 0) & ocr_failed, "unreadable").when(blocks == 0, "needs_ocr").when(coverage < 0.6, "partial").otherwise("ok")


def page_score(block_mean: Column, order_confidence: Column, cap: Column) -> Column:
    return F.least(block_mean, order_confidence, cap)


def continuations(tables: DataFrame) -> DataFrame:
    """(source_id, table_id, next_id): the last table of a page goes on in the first of the next, with as many columns, over the page break."""
    first = F.row_number().over(Window.partitionBy("source_id", "page").orderBy("y1")) == 1
    last = F.row_number().over(Window.partitionBy("source_id", "page").orderBy(F.desc("y1"))) == 1
    d = tables.withColumn("is_first", first).withColumn("is_last", last)
    a = d.filter("is_last AND y2 >= 0.75 * height").select("source_id", F.col("table_id"), "cols", (F.col("page") + 1).alias("page"))
    b = d.filter("is_first AND y1 <= 0.25 * height").select("source_id", F.col("table_id").alias("next_id"), "cols", "page")
    return a.join(b, ["source_id", "page", "cols"]).select("source_id", "table_id", "next_id")


def equation_groups(boxes: list[tuple], line_gap: float, x_gap: float) -> list[int]:
    """The group of each fragment: fragments near one another by height of the smaller are one equation (union-find)."""
    up = list(range(len(boxes)))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(boxes):
        for j in range(i):
            b = boxes[j]
            h = min(a[3] - a[1], b[3] - b[1])
            if max(a[1], b[1]) - min(a[3], b[3]) <= line_gap * h and max(a[0], b[0]) - min(a[2], b[2]) <= x_gap * h:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(boxes))]


def is_equation(text: Column, operators: str = "=+−×÷^<>≤≥≠≈∑∏∫√∂∇") -> Column:
    """An operator, at least 0.4 of mathematical characters, and fewer than three words of prose."""
    n = F.length(F.regexp_replace(text, r"\s", ""))
    share = F.length(F.regexp_replace(text, r"[^=+\-−×÷*/^<>≤≥≠≈∑∏∫√∞∂∇αβγδεθλμπσφωΔΣΠΩ()\[\]{},0-9]", "")) / n
    return (n > 0) & text.rlike(f"[{operators}]") & (share >= 0.4) & (F.regexp_count(text, F.lit(r"[A-Za-z]{3,}")) < 3)


def ink_coverage(page: np.ndarray, boxes: list[tuple], columns: int = 48, dark: int = 160, least: float = 0.004) -> tuple[float, list[tuple[int, int]]]:
    """Share of inked grid cells of a grey page that the boxes cover, and the uncovered cells (row, column)."""
    h, w = page.shape
    side = max(1, w // columns)
    rows, cols = -(-h // side), -(-w // side)
    padded = np.full((rows * side, cols * side), 255, page.dtype)
    padded[:h, :w] = page
    inked = (padded < dark).reshape(rows, side, cols, side).mean((1, 3)) > least
    seen = np.zeros_like(inked)
    for x1, y1, x2, y2 in boxes:
        seen[int(y1 // side) : int(-(-y2 // side)), int(x1 // side) : int(-(-x2 // side))] = True
    missed = inked & ~seen
    return (float((inked & seen).sum() / inked.sum()) if inked.any() else 1.0), [tuple(map(int, x)) for x in np.argwhere(missed)]


def otsu_threshold(grey: np.ndarray) -> int:
    hist = np.bincount(grey.ravel(), minlength=256).astype(float)
    w0, m0 = hist.cumsum(), (hist * np.arange(256)).cumsum()
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w0 * w1 * (m0 / w0 - (m0[-1] - m0) / w1) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def adaptive_binarize(grey: np.ndarray, window: int = 31, offset: int = 10) -> np.ndarray:
    """Dark where a pixel is `offset` below the mean of its window, by an integral image."""
    r = window // 2
    p = np.pad(grey.astype(float), r, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    mean = (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2
    return grey < mean - offset


def estimate_skew(dark: np.ndarray, most: float = 5.0, step: float = 0.5) -> float:
    """The angle in degrees whose shear gives the sharpest row profile."""
    y, x = np.nonzero(dark)
    best = (-1.0, 0.0)
    for a in np.arange(-most, most + step, step):
        rows = np.round(y - x * np.tan(np.radians(a))).astype(int)
        profile = np.bincount(rows - rows.min()) if len(rows) else np.zeros(1)
        best = max(best, (float((profile.astype(float) ** 2).sum()), float(a)), key=lambda v: (v[0], -abs(v[1])))
    return best[1]


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x1, y1, x2, y2, pixels) of the 4-connected components of a mask, by runs of rows."""
    up, runs, before = [], [], []

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(edges[::2], edges[1::2]):
            k = len(up)
            up.append(k)
            runs.append((int(a), y, int(b)))
            for c, d, j in before:
                if a < d and c < b:
                    p, q = find(j), find(k)
                    up[max(p, q)] = min(p, q)
            now.append((a, b, k))
        before = now
    out: dict[int, list[int]] = {}
    for k, (a, y, b) in enumerate(runs):
        v = out.setdefault(find(k), [a, y, b, y + 1, 0])
        v[0], v[1], v[2], v[3], v[4] = min(v[0], a), min(v[1], y), max(v[2], b), max(v[3], y + 1), v[4] + b - a
    return [tuple(v) for v in out.values()]


def read_bars(bars: list[tuple], ticks: list[tuple[float, float]], labels: list[tuple[str, float]]) -> list[dict]:
    """Values of vertical bars from axis ticks (y, value), categories from the nearest label (text, x); without two ticks only relative sizes."""
    fit = np.polyfit([y for y, _ in ticks], [v for _, v in ticks], 1) if len({y for y, _ in ticks}) >= 2 else None
    tallest = max((b[3] - b[1] for b in bars), default=1)
    out = []
    for b in sorted(bars):
        mid = (b[0] + b[2]) / 2
        out.append({"category": min(labels, key=lambda t: abs(t[1] - mid))[0] if labels else None, "value": float(np.polyval(fit, b[1])) if fit is not None else None, "relative_size": (b[3] - b[1]) / tallest})
    return out


def consensus(candidates: list[tuple[str, float, float]], least: float = 90.0) -> dict:
    """A vote on one block: (text, reliability, confidence); alike texts cluster greedily, weights add, the heaviest cluster wins."""
    from docketry.functions.text import indel_ratio

    clusters: list[list] = []
    for text, reliability, confidence in sorted(candidates, key=lambda c: (-c[1] * c[2], c[0])):
        home = next((c for c in clusters if indel_ratio(c[0], text) >= least), None)
        if home is None:
            clusters.append(home := [text, 0.0, 0])
        home[1] += reliability * confidence
        home[2] += 1
    top, total = max(clusters, key=lambda c: (c[1], c[0])), sum(c[1] for c in clusters)
    kind = "unanimous" if len(clusters) == 1 else "majority" if top[1] * 2 > total else "split"
    return {"text": top[0], "agreement": top[1] / total if total else 0.0, "verdict": kind, "escalate": kind == "split"}


def renormalized_confidence(parts: dict[str, tuple[Column, float]]) -> Column:
    """A weighted mean over the components that exist."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts.values()), F.lit(0.0))
    return top / sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))


def document_confidence(blocks: DataFrame, critical: tuple[str, ...] = ("table", "equation")) -> DataFrame:
    """0.7 x area-weighted mean + 0.3 x least of the critical kinds."""
    a = area()
    least = F.coalesce(F.min(F.when(F.col("type").isin(*critical), F.col("confidence"))), F.min("confidence"))
    return blocks.groupBy("source_id").agg((0.7 * F.sum(F.col("confidence") * a) / F.sum(a) + 0.3 * least).alias("confidence"))


def virtual_merge(pages: DataFrame) -> DataFrame:
    """Pages of several documents as one: running index, and a flag on each document's first page.

    Pages are numbered inside their document; only the table of page counts, one row a document, is summed in order.
    """
    counts = pages.groupBy("doc_order").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("doc_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = pages.withColumn("_k", F.row_number().over(Window.partitionBy("doc_order").orderBy("page")))
    d = inside.join(counts.select("doc_order", ahead.alias("_ahead")), "doc_order")
    return d.withColumn("merged_index", F.col("_ahead") + F.col("_k") - 1).withColumn("boundary_start", F.col("_k") == 1).drop("_k", "_ahead")


def fragment_runs(blocks: DataFrame, most: int = 2, least: int = 3) -> DataFrame:
    """Runs of at least three short fragments in reading order become one group: (page_id, ro, text)."""
    w = Window.partitionBy("page_id").orderBy("ro")
    short = F.length("text") <= most
    d = blocks.withColumn("short", short).withColumn("run", F.sum((short != F.coalesce(F.lag(short).over(w), ~short)).cast("int")).over(w))
    return d.withColumn("shredded", F.col("short") & (F.count("*").over(Window.partitionBy("page_id", "run")) >= least))


def axis_labels(labels: DataFrame) -> DataFrame:
    """Chart labels (text, bbox as x0, y0, x1, y1) ready for an axis (J12): one label a number, with its share of the box.

    A label is cut at its blanks, each piece with the stretch of the box that its characters take. Signs at the end of a piece
    that are no part of a number are tick marks and go with their stretch. If what is left of all pieces is numbers, each is a
    label; else the label stays whole.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,lo:int,hi:int>>").alias("out"))
    core = lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}\p{Sc}%)]+$", "")

    def step(acc, w):
        piece = F.struct(core(w).alias("text"), acc["at"].alias("lo"), (acc["at"] + F.length(core(w))).alias("hi"))
        return F.struct((acc["at"] + F.length(w) + 1).alias("at"), F.when(core(w) == "", acc["out"]).otherwise(F.array_append(acc["out"], piece)).alias("out"))

    cut = F.aggregate(F.split(F.trim("text"), r"\s+"), start, step, lambda acc: acc["out"])
    d = labels.withColumn("_cut", cut)
    left, width = F.get("bbox", F.lit(0)), (F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0))) / F.greatest(F.length(F.regexp_replace(F.trim("text"), r"\s+", " ")), F.lit(1))
    box = lambda p: F.array(left + width * p["lo"], F.get("bbox", F.lit(1)), left + width * p["hi"], F.get("bbox", F.lit(3)))
    numeric = (F.size("_cut") > 0) & F.forall("_cut", lambda p: numbers.chart_number(p["text"]).isNotNull())
    parts = F.transform("_cut", lambda p: F.struct(p["text"].alias("text"), box(p).alias("bbox")))
    d = d.withColumn("_p", F.explode(F.when(numeric, parts).otherwise(F.array(F.struct("text", "bbox")))))
    return d.withColumns({"text": F.col("_p.text"), "bbox": F.col("_p.bbox")}).drop("_p", "_cut")
