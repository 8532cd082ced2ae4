"""Queries of addresses and page layout; pages are made from orders, their regions from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import addresses
from docketry.operators import layout
from docketry.session import table

QUERIES, ORACLES = {}, {}


def _q(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_IPS = """WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS kind, (c_custkey * 7) % 256 AS a, (c_custkey * 13) % 256 AS b FROM customer),
d AS (SELECT *, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) AS closed FROM c)"""


def _ips(spark, sf_dir):
    k = F.col("c_custkey")
    a, b = (k * 7) % 256, (k * 13) % 256
    d = table(spark, sf_dir, "customer").select("c_custkey", (k % 9).alias("kind"), a.alias("a"), b.alias("b"))
    dotted = F.concat_ws(".", F.col("a").cast("string"), F.col("b").cast("string"), F.lit("7"), F.lit("9"))
    hexed = F.concat(F.hex(F.col("a") * 256 + F.col("b")), F.lit(":"), F.lit("709"))
    forms = (dotted, F.concat(F.lit("::ffff:"), dotted), F.concat(F.lit("[2002:"), hexed, F.lit("::1]")), F.concat(F.lit("64:FF9B::"), dotted), F.concat(F.lit("2001:0:"), hexed, F.lit("::")), F.concat(F.lit("2a00:1450:"), hexed, F.lit("::1")), F.concat(F.lit("fd00::"), hexed), F.concat(F.lit("2001:4:112::"), F.hex("a")), F.concat(dotted, F.lit(".1")))
    return d.select("c_custkey", F.element_at(F.array(*forms), (F.col("kind") + 1).cast("int")).alias("address"))


@_q(_IPS + " SELECT k AS c_custkey, CASE WHEN kind <= 3 THEN CASE WHEN closed THEN 'NON_GLOBAL_IP' END WHEN kind = 4 THEN 'TEREDO_IP' WHEN kind = 6 THEN 'NON_GLOBAL_IP' WHEN kind = 8 THEN 'NOT_AN_ADDRESS' END AS fault FROM d")
def address_classes(spark, sf_dir):
    """Dotted, mapped, 6to4, NAT64 and Teredo spellings of one address, public and local version 6 ones, and one part too many."""
    return _ips(spark, sf_dir).select("c_custkey", addresses.address_fault(F.col("address")).alias("fault"))


@_q(_IPS + """ SELECT k AS c_custkey, CASE WHEN kind IN (4, 5, 6, 7) THEN CASE WHEN kind = 5 THEN 'v6' END WHEN kind = 8 THEN NULL WHEN a = 10 AND b >= 128 THEN 'deep' WHEN a < 128 THEN 'low' WHEN a = 200 THEN 'exact' END AS label FROM d""")
def longest_networks(spark, sf_dir):
    """Each address with the smallest of a set of nested networks that holds it."""
    nets = table(spark, sf_dir, "region").limit(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("network"), F.lit(x).alias("label")) for n, x in (("0.0.0.0/1", "low"), ("10.128.0.0/9", "deep"), ("200.0.0.0/8", "exact"), ("2a00::/12", "v6"), ("not a network/8", "bad"))))).alias("n")).select("n.*")
    return addresses.matched_networks(_ips(spark, sf_dir), nets).select("c_custkey", "label")


def lines(spark, sf_dir):
    """(page_id, k, n, q, p): the line items of an order, numbered from 1, with their count, quantity and price."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"))
    w = Window.partitionBy("l_orderkey")
    return d.select(F.col("l_orderkey").cast("long").alias("page_id"), F.row_number().over(w.orderBy("l_linenumber")).cast("long").alias("k"), F.count("*").over(w).alias("n"), "q", "p")


_LINES = """WITH g AS (SELECT l_orderkey AS page_id, l_linenumber, max(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY ALL),
l AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY l_linenumber) AS k, count(*) OVER (PARTITION BY page_id) AS n, q, p FROM g)"""


def _regions(d, *made):
    """One region for each (id, type, confidence, x1, y1, x2, y2) of a line."""
    s = F.struct
    rows = F.array(*(s((F.col("k") * 10 + i).alias("region_id"), F.lit(t).alias("type"), F.lit(c).cast("double").alias("confidence"), *(x.cast("double").alias(n) for x, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True))) for i, t, c, box in made))
    return d.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*", F.lit(600.0).alias("page_width"), F.lit(4000.0).alias("page_height"))


@_q(_LINES + " SELECT page_id, k * 10 + i AS region_id FROM l, (SELECT unnest([0, 3, 4, 6]) AS i)")
def region_overlaps(spark, sf_dir):
    """A line's regions: a table with a text and a figure in it, which go; a text in that figure alone, which stays as the figure goes; of two texts in one place the surer; a title with a text in it, which goes."""
    at = lambda x1, y1, x2, y2: (F.lit(x1), F.col("k") * 200 + y1, F.lit(x2), F.col("k") * 200 + y2)
    return layout.without_overlaps(_regions(
        lines(spark, sf_dir), (0, "table", 0.9, at(0, 0, 300, 100)), (1, "text", 0.8, at(10, 10, 100, 30)), (2, "figure", 0.9, at(200, 20, 310, 105)), (3, "text", 0.7, at(290, 30, 310, 104)),
        (4, "text", 0.6, at(400, 0, 500, 100)), (5, "text", 0.5, at(400, 0, 500, 99)), (6, "title", 0.5, at(520, 0, 590, 20)), (7, "text", 0.9, at(525, 2, 585, 18)),
    )).select("page_id", "region_id")


_ORDERED = _LINES + """, r AS (
 SELECT page_id, 1 AS region_id, 'header' AS flow, 0 AS part, 0 AS a, 0.0 AS b, 0 AS y, 0 AS x, n FROM l WHERE k = 1
 UNION ALL SELECT page_id, k * 10, 'main', 1, k % 2, k, 100 + (k // 2) * 60, CASE WHEN k % 2 = 1 THEN 320 ELSE 20 END, n FROM l
 UNION ALL SELECT page_id, k * 10 + 1, 'main', 1, k % 2, k + 0.1, 100 + (k // 2) * 60 + 30, CASE WHEN k % 2 = 1 THEN 320 ELSE 20 END, n FROM l WHERE k % 3 = 0
 UNION ALL SELECT page_id, 2, 'footer', 2, 0, 0, 3900, 0, n FROM l WHERE k = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY part, a, b) - 1 AS place, row_number() OVER (PARTITION BY page_id ORDER BY round(y / 40.0), x, region_id) AS by_rows FROM r)"""


def ordered_pages(spark, sf_dir):
    """Pages of two columns: even lines left, odd ones right, each third one a figure with a caption below; a header and a footer."""
    d = lines(spark, sf_dir)
    k = F.col("k")
    x, y = F.when(k % 2 == 1, 320.0).otherwise(20.0), 100 + F.floor(k / 2) * 60
    body = _regions(d.withColumn("x", x).withColumn("y", y), (0, "body", 0.9, (F.col("x"), F.col("y"), F.col("x") + 250, F.col("y") + 25)), (1, "caption", 0.9, (F.col("x"), F.col("y") + 30, F.col("x") + 200, F.col("y") + 40)))
    body = body.withColumn("_k", F.floor(F.col("region_id") / 10)).filter("type = 'body' OR _k % 3 = 0").withColumn("type", F.when((F.col("type") == "body") & (F.col("_k") % 3 == 0), "figure").when(F.col("type") == "body", "text").otherwise(F.col("type"))).drop("_k")
    ends = d.filter("k = 1").withColumn("k", F.lit(0).cast("long"))
    whole = lambda y1, y2: tuple(map(F.lit, (0.0, y1, 600.0, y2)))
    return body.unionByName(_regions(ends, (1, "header", 1.0, whole(0.0, 40.0)), (2, "footer", 1.0, whole(3900.0, 3950.0))))


@_q(_ORDERED + " SELECT page_id, region_id, flow, place FROM o")
def region_order(spark, sf_dir):
    return layout.region_order(ordered_pages(spark, sf_dir)).select("page_id", "region_id", "flow", "place")


@_q(_ORDERED + ", i AS (SELECT a.page_id, count(*) FILTER (a.place < b.place AND a.by_rows > b.by_rows) AS inversions FROM o a JOIN o b USING (page_id) GROUP BY ALL) SELECT page_id, count(*) AS n, any_value(inversions) AS inversions, 1 - 4.0 * any_value(inversions) / (count(*) * (count(*) - 1)) AS tau FROM o JOIN i USING (page_id) GROUP BY page_id")
def order_agreement(spark, sf_dir):
    pages = ordered_pages(spark, sf_dir)
    return layout.order_agreement(layout.region_order(pages), pages)


@_q(
    _LINES
    + """ SELECT page_id, row::INT AS row, col::INT AS col, col_span::INT AS col_span, is_header, text FROM (
 SELECT page_id, 0 AS row, 1 AS col, 2 AS col_span, true AS is_header, 'Amounts' AS text FROM l WHERE k = 1
 UNION ALL SELECT page_id, 1, unnest([0, 1, 2]), 1, true, unnest(['Item', 'Qty', 'Price']) FROM l WHERE k = 1
 UNION ALL SELECT page_id, k + 1, unnest([0, 1, 2]), 1, false, unnest(['line ' || chr((96 + k)::INT), trunc(q)::INT::VARCHAR, trunc(p)::INT::VARCHAR]) FROM l)"""
)
def spanning_tables(spark, sf_dir):
    """A table of boxes per order: two header rows, the upper over two columns, and a row per line item, slightly askew."""
    k = F.col("k")
    box = lambda i, text, x1, x2, y: F.struct(F.lit(i).alias("i"), text.alias("text"), F.lit(float(x1)).alias("x1"), (y + i).cast("double").alias("y1"), F.lit(float(x2)).alias("x2"), (y + i + 18).cast("double").alias("y2"))
    d = lines(spark, sf_dir)
    rows = d.select("page_id", "k", F.explode(F.array(box(0, F.concat(F.lit("line "), F.chr(k + 96)), 10, 80, 60 + k * 25), box(1, F.col("q").cast("int").cast("string"), 110, 140, 60 + k * 25), box(2, F.col("p").cast("int").cast("string"), 200, 260, 60 + k * 25))).alias("b"))
    heads = d.filter("k = 1").select("page_id", F.lit(0).cast("long").alias("k"), F.explode(F.array(box(0, F.lit("Amounts"), 105, 265, F.lit(30)), box(1, F.lit("Item"), 10, 60, F.lit(55)), box(2, F.lit("Qty"), 108, 150, F.lit(55)), box(3, F.lit("Price"), 195, 255, F.lit(55)))).alias("b"))
    cells = rows.unionByName(heads).select("page_id", (F.col("k") * 10 + F.col("b.i")).alias("cell_id"), "b.text", "b.x1", "b.y1", "b.x2", "b.y2")
    return layout.spanning_cells(cells).drop("cell_id")


@_q(
    _LINES
    + """, b AS (SELECT page_id, 'title' AS type, 0.0 AS place, 'Order ' || page_id AS text FROM l WHERE k = 1 UNION ALL SELECT page_id, 'text', k, 'line ' || k FROM l WHERE k % 2 = 1 UNION ALL SELECT page_id, 'table', k, 'qty ' || trunc(q)::INT FROM l WHERE k % 2 = 0),
 p AS (SELECT page_id, count(*) AS n, string_agg(CASE WHEN type = 'title' THEN '# ' ELSE '' END || text, chr(10) || chr(10) ORDER BY place) AS md FROM b GROUP BY 1)
 SELECT o_custkey AS source_id, count(*)::INT AS n_pages, sum(coalesce(n, 0))::BIGINT AS n_blocks, coalesce(string_agg(md, chr(10) || chr(10) ORDER BY o_orderkey), '') AS markdown, true AS sound FROM orders LEFT JOIN p ON page_id = o_orderkey GROUP BY 1"""
)
def page_assembly(spark, sf_dir):
    """A customer's orders as a document of pages: titles, lines and tables of three extractors put in order, some pages blank."""
    d = lines(spark, sf_dir)
    box = F.array(F.lit(0.0), F.col("k") * 20.0, F.lit(100.0), F.col("k") * 20.0 + 10)
    block = lambda at, text, bbox: ["page_id", (F.col("k") * 1.0).alias("block_id"), at.alias("place"), text.alias("text"), F.lit(0.75).alias("confidence"), bbox.alias("bbox")]
    parts = {
        "title": d.filter("k = 1").select(*block(F.lit(0.0), F.concat(F.lit("Order "), F.col("page_id").cast("string")), F.lit(None))),
        "text": d.filter("k % 2 = 1").select(*block(F.col("k"), F.concat(F.lit("line "), F.col("k").cast("string")), box)),
        "table": d.filter("k % 2 = 0").select(*block(F.col("k"), F.concat(F.lit("qty "), F.col("q").cast("int").cast("string")), box)),
    }
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").cast("long").alias("page_id"), F.col("o_orderkey").alias("page_number"))
    pages = layout.assembled(o, **parts)
    bad = layout.broken_invariants(pages).join(o, "page_id").select("source_id").distinct().withColumn("sound", F.lit(False))
    return layout.documents(pages).join(bad, "source_id", "left").select("source_id", "n_pages", "n_blocks", "markdown", F.coalesce("sound", F.lit(True)).alias("sound"))
