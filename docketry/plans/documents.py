"""Queries of sources and page structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import numfmt, text
from docketry.operators import linking, structure
from docketry.sources import readers
from docketry.session import dealt, table

QUERIES, ORACLES = {}, {}


def _q(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _rows_only(f):
    QUERIES[f.__name__] = f
    return f


@_rows_only
def html_visible_lines(spark, sf_dir):
    return readers.html_lines(table(spark, sf_dir, "pages"))


@_q("""SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages) GROUP BY 1""")
def html_links(spark, sf_dir):
    return readers.html_links(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("links"))


@_q("""SELECT page_id, CASE page_id%5 WHEN 0 THEN 'SCHEME' WHEN 1 THEN 'CREDENTIALS_IN_URL' WHEN 2 THEN 'PRIVATE_ADDRESS' WHEN 3 THEN 'PORT' END AS refused FROM pages""")
def url_policy(spark, sf_dir):
    k = F.col("page_id") % 5
    rest = F.regexp_replace("url", r"^https?://", "")
    made = F.when(k == 0, F.concat(F.lit("ftp://"), rest)).when(k == 1, F.concat(F.lit("https://me:pw@"), rest)).when(k == 2, F.concat(F.lit("http://10.0."), (F.col("page_id") % 250).cast("string"), F.lit(".7/x"))).when(k == 3, F.regexp_replace("url", r"^(https?://[^/]+)", "$1:8081")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", readers.url_policy(made).alias("refused"))


@_q("SELECT page_id, 'text/html' AS html, CASE WHEN html LIKE '%<%' THEN 'message/rfc822' END AS mail, 'application/pdf' AS pdf, 'text/csv' AS csv, 'text/plain' AS plain, 'application/octet-stream' AS other FROM pages")
def mime_sniffing(spark, sf_dir):
    b = lambda s: s.cast("binary")
    m = lambda c, e: readers.detect_mime(c, F.lit(e))
    return table(spark, sf_dir, "pages").select(
        "page_id", m(b(F.col("html")), "html").alias("html"), m(b(F.concat(F.lit("From: a@b.c\nSubject: x\n\n"), F.col("html"))), "eml").alias("mail"), m(b(F.concat(F.lit("%PDF-1.7 "), F.col("url"))), "pdf").alias("pdf"), m(b(F.concat(F.lit("a,b\n"), F.col("url"))), "csv").alias("csv"), m(b(F.col("url")), "txt").alias("plain"), m(F.unhex(F.lit("00010203040506070809")), "bin").alias("other")
    )


@_q("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey%50>=20 THEN CASE WHEN l_discount<0.03 THEN 'native_text' ELSE 'mixed' END ELSE CASE WHEN l_discount>0.01 THEN 'image_only' WHEN l_partkey%50>0 THEN 'native_text' ELSE 'blank' END END AS page_class FROM lineitem")
def page_classes(spark, sf_dir):
    share = F.when((F.col("l_partkey") % 50 >= 20) & (F.col("l_discount") >= 0.03), 0.5).otherwise(F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", readers.classify_page(F.col("l_partkey") % 50, share, F.lit(False)).alias("page_class"))


@_q("""WITH p AS (SELECT l_orderkey AS source_id, CASE l_linenumber%3 WHEN 0 THEN 'scanned' ELSE 'native_text' END AS c FROM lineitem)
SELECT source_id, count(*) AS pages, CASE WHEN count(*) FILTER (c='native_text')=count(*) THEN 'native' WHEN count(*) FILTER (c='scanned')=count(*) THEN 'ocr' ELSE 'mixed' END AS route FROM p GROUP BY 1""")
def source_routes(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.when(F.col("l_linenumber") % 3 == 0, "scanned").otherwise("native_text").alias("page_class"))
    return readers.route(p).select("source_id", "pages", "route")


@_q("WITH v AS (SELECT l_orderkey AS source_id, (l_linenumber%2)*90 AS r, count(*) AS n FROM lineitem GROUP BY ALL) SELECT source_id, CASE WHEN max(n)*2>sum(n) THEN arg_max(r, n*1000-r) ELSE 0 END AS rotation FROM v GROUP BY 1")
def rotation_votes(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), ((F.col("l_linenumber") % 2) * 90).alias("rotation"))
    return readers.rotation_vote(u)


@_q("""SELECT doc_id, i-1 AS line_no, trim(l, ' ') AS text FROM (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS l, unnest(range(1, len(string_split_regex(text, '\r?\n'))+1)) AS i FROM documents) WHERE trim(l, ' ')<>''""")
def text_lines(spark, sf_dir):
    return readers.text_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


@_q("SELECT n_nationkey, unnest([0,1,2]) AS col, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS value FROM nation")
def csv_cells(spark, sf_dir):
    return readers.cells_of(table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])


@_q("SELECT s AS sheet, 0 AS r1, 4 AS r2, 0 AS c1, 2 AS c2, true AS header FROM (SELECT DISTINCT n_regionkey AS s FROM nation) UNION ALL SELECT s, 7, 9, 1, 2, false FROM (SELECT DISTINCT n_regionkey AS s FROM nation)")
def probable_tables(spark, sf_dir):
    grid = [(r, c, "name" if r == 0 else "1,200") for r in range(5) for c in range(3)] + [(r, c, "5") for r in range(7, 10) for c in (1, 2)] + [(12, 0, "alone")]
    cells = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in grid))
    return readers.probable_tables(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("sheet")).distinct().select("sheet", F.explode(cells).alias("c")).select("sheet", "c.*"))


@_q("SELECT o_orderkey, format('{:,.2f}', round(o_totalprice,2)) AS grouped, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate::DATE::VARCHAR || ' ok' AS literal FROM orders")
def number_formats(spark, sf_dir):
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("double")
    f = numfmt.format_number_udf
    return table(spark, sf_dir, "orders").select("o_orderkey", f(F.round("o_totalprice", 2), F.lit("#,##0.00")).alias("grouped"), f(serial, F.lit("yyyy-mm-dd")).alias("day"), f(serial, F.lit('yyyy\\-mm\\-dd" ok"')).alias("literal"))


@_q("SELECT event_id, least(greatest(value,0),100)::DOUBLE AS x, value<0.85 AS needs_review FROM events WHERE event_id%3<>0")
def registered_elements(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "  ").otherwise("seen").alias("text"), F.array("value", F.lit(0.0), F.lit(500.0), F.lit(9.0)).alias("bbox"), F.col("value").alias("confidence"))
    return readers.registered_elements(e, 100, 100).select("event_id", F.col("bbox")[0].alias("x"), "needs_review")


def boxes(spark, sf_dir):
    """Line items as boxes of an order's page in two columns."""
    n = F.col("l_linenumber")
    x = F.when(n % 2 == 0, 310.0).otherwise(10.0)
    y = F.floor(n / 2) * 40.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")).select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("box_id"), *(F.when(n > 0, v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), (x, y, x + 280, y + 30))), F.lit(600.0).alias("page_width"), "q")


@_q("WITH b AS (SELECT DISTINCT l_orderkey AS page_id, l_linenumber AS box_id FROM lineitem) SELECT page_id, box_id, (row_number() OVER (PARTITION BY page_id ORDER BY (box_id%2=0), box_id//2, box_id))-1 AS reading_order_index FROM b")
def xy_cut_order(spark, sf_dir):
    return structure.reading_order(boxes(spark, sf_dir))


@_rows_only
def gutter_order(spark, sf_dir):
    return structure.reading_order(boxes(spark, sf_dir), "gutter")


@_q("""WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS k, CASE WHEN l_linenumber%2=0 THEN 310 ELSE 10 END AS x, floor(l_linenumber/2)*40 AS y FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT page_id, k AS span_id, 'line ' || k AS ocr_text FROM b WHERE k%3<>0""")
def ocr_agreement_join(spark, sf_dir):
    b = boxes(spark, sf_dir)
    ocr = b.filter("box_id % 3 <> 0").withColumns({"line_id": F.col("box_id"), "text": F.concat(F.lit("line "), F.col("box_id").cast("string")), "x1": F.col("x1") + 5, "y1": F.col("y1") + 3})
    return structure.ocr_for_native(b.withColumnRenamed("box_id", "span_id"), ocr)


@_q("SELECT DISTINCT l_orderkey AS page_id, l_linenumber AS line_id, 't' AS text FROM lineitem WHERE l_linenumber%3=0")
def ocr_only_lines(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return structure.unconsumed(b.withColumns({"line_id": F.col("box_id"), "text": F.lit("t")}), b.filter("box_id % 3 <> 0").withColumnRenamed("box_id", "span_id"))


@_q("SELECT DISTINCT l_orderkey AS page_id, l_linenumber AS figure_id, l_linenumber*10+1 AS caption_id FROM lineitem")
def nearest_caption(spark, sf_dir):
    b = boxes(spark, sf_dir)
    at = lambda i, dy, t: b.select("page_id", (F.col("box_id") * 10 + i).alias("block_id"), "x1", (F.col("y2") + dy).alias("y1"), "x2", (F.col("y2") + dy + 2).alias("y2"), F.lit(t).alias("text"))
    texts = at(1, 4, "Figure 3: sales").unionByName(at(2, 1, "nearer but plain")).unionByName(at(3, 300, "Figure 9: far"))
    return structure.nearest_captions(b.withColumnRenamed("box_id", "figure_id"), texts, b.select("page_id", F.lit(150.0).alias("height")).distinct())


@_q("SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY e, event_id) AS grp FROM (SELECT event_id, user_id, epoch(ts) AS e, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts)) > 7200 THEN 1 ELSE 0 END AS new FROM events)")
def gap_grouping(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("e"))
    return structure.gap_groups(e, ["user_id"], "e", 7200.0).select("event_id", F.col("group").alias("grp"))


@_q("""WITH w AS (SELECT l_orderkey AS page_id, l_linenumber, l_returnflag AS t, l_discount AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
SELECT page_id, string_agg(t, ' ' ORDER BY k) AS text, round(avg(c),6) AS conf FROM w GROUP BY 1""")
def ocr_line_grouping(spark, sf_dir):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    w = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.lit(0).alias("block"), F.lit(0).alias("par"), F.lit(0).alias("line"), k.alias("word_no"), F.col("l_returnflag").alias("text"), F.col("l_discount").alias("conf"), *(F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return structure.ocr_lines(w).select("page_id", "text", F.round("conf", 6).alias("conf"))


@_q("SELECT o_orderkey AS table_id, CASE o_orderkey%4 WHEN 0 THEN 'too_small' WHEN 1 THEN 'sparse' WHEN 2 THEN 'sentences' END AS reason FROM orders")
def table_validity(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    cells = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r in range(3) for c in range(3)))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), k.alias("k"), F.explode(cells).alias("c")).select("table_id", "k", "c.*")
    t = F.when((F.col("k") == 1) & (F.col("col") > 0), "").when(F.col("k") == 2, F.lit("word " * 14)).otherwise("cell")
    return structure.table_validity(d.filter("NOT (k = 0 AND col > 0)").withColumn("text", t)).select("table_id", "reason")


@_q("SELECT o_orderkey, CASE WHEN o_orderkey%5=0 THEN ['low_confidence','garbled_glyphs'] WHEN o_orderkey%5=1 THEN ['extractor_disagreement'] ELSE [] END AS reasons, CASE o_orderkey%5 WHEN 0 THEN 'blank' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'needs_ocr' WHEN 3 THEN 'partial' ELSE 'ok' END AS status FROM orders")
def page_review(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    return table(spark, sf_dir, "orders").select("o_orderkey", structure.review_reasons(F.when(k == 0, 0.5).otherwise(0.9), F.when(k == 1, 0.3).otherwise(1.0), F.when(k == 0, 0.2).otherwise(0.0)).alias("reasons"), structure.page_status(F.when(k <= 2, 0).otherwise(4), F.when(k == 0, 0).otherwise(9), k == 1, F.when(k == 3, 0.4).otherwise(0.9)).alias("status"))


@_q("SELECT o_custkey AS source_id, a.o_orderkey AS table_id, b.o_orderkey AS next_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) a JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) b USING (o_custkey) WHERE b.p=a.p+1 AND a.o_orderkey%2=b.o_orderkey%2")
def table_continuations(spark, sf_dir):
    from pyspark.sql import Window

    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("table_id"), page.alias("page"), (F.col("o_orderkey") % 2).alias("cols"), F.lit(10.0).alias("y1"), F.lit(95.0).alias("y2"), F.lit(100.0).alias("height"))
    return structure.continuations(t)


@_q("SELECT o_orderkey, (CASE WHEN o_orderkey%2=0 THEN (0.6*0.9+0.3*0.5)/0.9 ELSE 0.9 END)::DOUBLE AS confidence FROM orders")
def renormalized_confidence(spark, sf_dir):
    b = F.when(F.col("o_orderkey") % 2 == 0, 0.5)
    return table(spark, sf_dir, "orders").select("o_orderkey", structure.renormalized_confidence({"a": (F.lit(0.9), 0.6), "b": (b, 0.3), "c": (F.lit(None).cast("double"), 0.1)}).alias("confidence"))


@_q("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey)-1 AS merged_index, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)=1 AS boundary_start FROM orders")
def virtual_merge(spark, sf_dir):
    return structure.virtual_merge(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_order"), F.col("o_orderkey").alias("page"))).select("o_orderkey", "merged_index", "boundary_start")


@_q("SELECT p_partkey, p_size%3=0 AS eq FROM part")
def equation_flags(spark, sf_dir):
    n = F.col("p_size").cast("string")
    t = F.when(F.col("p_size") % 3 == 0, F.concat(n, F.lit(" + x = (y - "), n, F.lit(")"))).otherwise(F.concat(F.lit("the total of "), n, F.lit(" = some words here")))
    return table(spark, sf_dir, "part").select("p_partkey", structure.is_equation(t).alias("eq"))


@_q("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS r, o_orderdate::DATE AS d, o_orderpriority AS p, o_orderkey%3 AS dom, o_orderkey%13=0 AS inj FROM orders),
 s AS (SELECT c.k AS id, a.k AS anchor_id, c.inj OR a.inj AS inj, CASE WHEN abs(a.d-c.d)<=30 THEN 0.05*(1-abs(a.d-c.d)/30) ELSE 0 END AS near, CASE WHEN a.dom=c.dom AND a.dom>0 THEN 0.1 ELSE 0 END AS dom, CASE WHEN a.p=c.p THEN 0.05 ELSE 0.05*9/11 END AS addr FROM o c JOIN o a ON a.r=c.r AND a.k%10=0 AND c.k%10<>0),
 t AS (SELECT id, anchor_id, round(CASE WHEN inj THEN least(0.5, 0.5+near+dom) ELSE 0.5+near+dom+addr END, 4) AS score FROM s)
SELECT id, arg_min(anchor_id, (-score*1e4)::BIGINT*100000000+anchor_id) AS anchor_id, max(score) AS score, 'supporting_document' AS relation FROM t GROUP BY id""")
def link_scores(spark, sf_dir):
    """Orders linked to every tenth one by customer, date, sender's domain and address lines, some of them flagged."""
    k = F.col("o_orderkey")
    lines = F.array(F.concat(F.array(*map(F.lit, ("north", "road", "block", "floor", "flat", "colony", "street", "lane", "sector"))), F.array(F.col("o_orderpriority"))))
    o = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.array(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("refs"), F.array().cast("array<string>").alias("entities"), F.array(F.col("o_orderdate").cast("date")).alias("dates"),
        F.when(k % 3 > 0, F.concat(F.lit("d"), (k % 3).cast("string"), F.lit(".example"))).alias("domain"), lines.alias("addresses"), F.lit(None).cast("string").alias("text"), (k % 13 == 0).alias("injected"),
    )
    return linking.suggest(o.filter("id % 10 <> 0"), o.filter("id % 10 = 0")).select("id", "anchor_id", "score", "relation")


@_q("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS r, o_orderdate::DATE AS d, o_orderkey%3=0 AS cut, translate(md5(o_custkey::VARCHAR), '0123456789', 'ghijklmnop') AS name FROM orders),
 t AS MATERIALIZED (SELECT k, regexp_replace(lower('Vendor: ' || CASE WHEN cut THEN name[2:] ELSE name END || chr(10) || 'sent on ' || d || chr(10) || '12 North Road, Block 7, House ' || r), '[^a-z0-9]+', ' ', 'g') AS x FROM o),
 g AS MATERIALIZED (SELECT k, x[i:i+2] AS g, count(*) AS n FROM (SELECT k, x, unnest(range(1, length(x) - 1)) AS i FROM t) GROUP BY ALL), l AS MATERIALIZED (SELECT k, sqrt(sum(n * n)) AS l FROM g GROUP BY 1),
 p AS MATERIALIZED (SELECT c.k AS id, a.k AS anchor_id, c.cut = a.cut AS same, abs(a.d - c.d) AS gap FROM o c JOIN o a ON a.r = c.r AND a.k % 10 = 0 AND c.k % 10 <> 0),
 pu AS MATERIALIZED (SELECT id, anchor_id, g, n, l FROM p JOIN g ON g.k = id JOIN l ON l.k = id),
 cos AS MATERIALIZED (SELECT id, anchor_id, round(sum(pu.n * v.n) / any_value(pu.l) / any_value(lv.l), 6) AS cosine FROM pu JOIN g v ON v.k = anchor_id AND v.g = pu.g JOIN l lv ON lv.k = anchor_id GROUP BY ALL),
 s AS (SELECT id, anchor_id, round(0.2 * CASE WHEN same THEN 1.0 ELSE 62.0/63 END + CASE WHEN gap <= 30 THEN 0.05 * (1 - gap / 30.0) ELSE 0 END + 0.1 + 0.05 + CASE WHEN cosine >= 0.6 THEN 0.1 * cosine ELSE 0 END, 4) AS score FROM p JOIN cos USING (id, anchor_id))
SELECT id, arg_min(anchor_id, (-score*1e4)::BIGINT*100000000+anchor_id) AS anchor_id, max(score) AS score, 'same_party' AS relation FROM s WHERE score>=0.35 GROUP BY id""")
def link_suggestions(spark, sf_dir):
    """Letters about orders without any reference, linked by features read from their texts: a vendor's name that some letters cut short, date, address, sender and the cosine of the texts."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    name = F.translate(F.md5(c), "0123456789", "ghijklmnop")
    letter = F.concat(F.lit("Vendor: "), F.when(k % 3 == 0, F.substring(name, 2, 99)).otherwise(name), F.lit("\nsent on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\n12 North Road, Block 7, House "), c)
    letters = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey").select(k.alias("id"), letter.alias("text"), F.concat(F.lit("post@d"), c, F.lit(".example")).alias("sender"))
    f = linking.features(letters)
    return linking.suggest(f.filter("id % 10 <> 0"), f.filter("id % 10 = 0")).select("id", "anchor_id", "score", "relation")


@_q("SELECT s_suppkey, s_name AS clean, 'file_' || s_suppkey || '.pdf' AS file, 'acme' || s_suppkey || '.com' AS domain, NULL::VARCHAR AS free, ['INV-2024-' || lpad(s_suppkey::VARCHAR,3,'0')] AS refs, '10.1.x.x' AS ip, 'Firefox' AS agent FROM supplier")
def text_helpers(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", text.strip_invisible(text.nfkc(F.concat(F.lit("​ "), F.col("s_name"), F.lit("  ")))).alias("clean"), text.sanitize_filename(F.concat(F.lit("../x\\file?"), k, F.lit(".pdf"))).alias("file"), text.mail_domain(F.concat(F.lit("Ann <ann@ACME"), k, F.lit(".com>"))).alias("domain"), text.mail_domain(F.lit("a@gmail.com")).alias("free"),
        text.references(F.concat(F.lit("see Invoice No: INV-2024-"), F.lpad(k, 3, "0"), F.lit(" please"))).alias("refs"), text.mask_ip(F.lit("10.1.22.33")).alias("ip"), text.agent_family(F.lit("Mozilla/5.0 Firefox/120")).alias("agent"),
    )
