"""Queries of governance: grants, previews, the SQL gate, the audit chain, workflow state and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import audit, export, govern, workflow
from docketry.session import table

QUERIES, ORACLES = {}, {}


def _q(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


@_q("SELECT c_custkey, c_name, NULL::INT AS c_nationkey, NULL::DOUBLE AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment='BUILDING' ORDER BY c_custkey LIMIT 21 OFFSET 10")
def governed_preview(spark, sf_dir):
    return govern.preview(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"], "c_custkey", ("c_mktsegment", "BUILDING"), 20, 10)


@_q("SELECT * FROM (VALUES ('orders','o_orderkey'),('orders','o_custkey'),('orders','o_totalprice'),('customer','c_custkey'),('customer','c_name')) t(table_name,column_name)")
def acl_unlocked_columns(spark, sf_dir):
    names = [(t, c) for t in ("orders", "customer") for c in table(spark, sf_dir, t).columns]
    catalog = spark.createDataFrame(names, "table_name string, column_name string")
    roles = spark.createDataFrame([("analyst", "orders", "o_orderkey"), ("analyst", "orders", "o_custkey"), ("analyst", "customer", "c_custkey"), ("hr", "customer", "c_acctbal"), ("analyst", "orders", "dropped_column")], "role string, table_name string, column_name string")
    users = spark.createDataFrame([("ann", "orders", ["o_totalprice"], "approved", "2030-01-01 00:00:00"), ("ann", "customer", ["c_acctbal"], "approved", "2020-01-01 00:00:00"), ("bob", "customer", ["c_acctbal"], "approved", "2030-01-01 00:00:00"), ("ann", "customer", ["c_name"], "approved", "2030-01-01 00:00:00"), ("ann", "customer", ["c_mktsegment"], "pending", "2030-01-01 00:00:00")], "user_id string, table_name string, columns array<string>, status string, valid_until string")
    return govern.unlocked_columns(catalog, roles, users.withColumn("valid_until", F.col("valid_until").cast("timestamp")), "analyst", "ann", "2026-01-01 00:00:00")


GRANTS = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "customer": ["c_custkey", "c_name"]}


def _granted(spark, sf_dir):
    for t in GRANTS:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return GRANTS


def _gated(spark, sf_dir, sql):
    return govern.gate(spark, sql, _granted(spark, sf_dir))


@_q("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1000")
def gate_star_expansion(spark, sf_dir):
    return _gated(spark, sf_dir, "SELECT * FROM customer ORDER BY c_custkey LIMIT 5000")[1]


@_q("SELECT c_name, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1 ORDER BY total DESC, c_name LIMIT 20")
def gate_join_aggregate(spark, sf_dir):
    return _gated(spark, sf_dir, "WITH o AS (SELECT * FROM orders) SELECT c_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o JOIN customer ON o_custkey = c_custkey GROUP BY c_name ORDER BY total DESC, c_name LIMIT 20")[1]


#: Texts for the gate with what it must say.
CORPUS = (
    ("SELECT o_orderkey FROM orders", True), ("SELECT 'a -- b' AS x, o_orderkey FROM orders", True), ("SELECT count(*) AS n FROM orders WHERE o_totalprice > 10", True), ("SELECT o_orderkey FROM orders LIMIT 5;", True),
    ("WITH a AS (SELECT o_custkey FROM orders) SELECT * FROM a", True), ("SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", True),
    ("", False), ("SELECT o_orderkey FROM orders -- x", False), ("SELECT /* x */ o_orderkey FROM orders", False), ("SELECT o_orderkey FROM orders; SELECT 1", False), ("DROP TABLE orders", False), ("INSERT INTO orders SELECT 1", False),
    ("SELECT o_orderstatus FROM orders", False), ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", False), ("SELECT c_name FROM customer JOIN orders ON c_acctbal = o_totalprice", False), ("SELECT o_orderkey FROM orders UNION SELECT c_custkey FROM customer", False),
    ("SELECT * FROM lineitem", False), ("SELECT * FROM parquet.`/etc/x`", False), ("SELECT * FROM range(10)", False), ("SELECT reflect('java.lang.System', 'exit', 1) FROM orders", False), ("SELECT * FROM VALUES (1)", False), ("SELECT input_file_name() FROM orders", False),
    ("SELECT o_orderkey FROM orders TABLESAMPLE (10 ROWS)", False), ("SELEC o_orderkey FROM orders", False), ("SELECT x.o_clerk FROM (SELECT * FROM orders) x", False), ("SELECT o_orderkey FROM default.orders", False), ("SELECT 1", False), ("SELECT o_orderkey FROM orders WHERE o_orderkey = (SELECT max(c_acctbal) FROM customer)", False),
    ("SELECT `input_file_name`() AS f, o_orderkey FROM orders", False), ("SELECT `version`() AS v, o_orderkey FROM orders", False), ("SELECT `current_catalog`() AS c FROM orders", False), ("SELECT `raise_error`('x') AS c FROM orders", False),
    ("SELECT current_user AS u, o_orderkey FROM orders", False), ("SELECT session_user AS u, o_orderkey FROM orders", False), ("SELECT o_orderkey FROM orders ORDER BY `uuid`()", False), ("SELECT system.builtin.version() AS v FROM orders", False),
    ("SELECT `upper`(c_name) AS n, `round`(sum(c_custkey), 1) AS s FROM customer GROUP BY `upper`(c_name)", True), ("SELECT o_orderkey, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY `user`() ORDER BY o_orderkey)", False),
    ("SELECT o_orderkey, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", True), ("SELECT c_name, CASE WHEN c_custkey BETWEEN 1 AND 5 THEN 'a' ELSE lower(trim(c_name)) END AS x FROM customer WHERE c_name LIKE 'C%' AND c_custkey IS NOT NULL AND NOT c_custkey IN (1, 2)", True),
    ("SELECT substring(c_name, 1, 3) AS s, CAST(c_custkey AS STRING) AS k FROM customer", True), ("SELECT c_phone FROM customer", False), ("SELECT o_orderkey FROM orders WHERE exists (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND `input_file_name`() <> '')", False),
    ("SELECT secret_t.n_name FROM secret_t, orders WHERE 1 IN (WITH secret_t AS (SELECT 1 AS x FROM orders) SELECT x FROM secret_t)", False), ("SELECT o_orderkey FROM orders WHERE 1 IN (WITH part AS (SELECT 1 AS x FROM orders) SELECT x FROM part)", True),
)


_ALLOWED_AT = ",".join(str(i) for i, (_, ok) in enumerate(CORPUS) if ok)
#: Texts that touch the total, by name or by a star over it.
_TOTALS_AT = ",".join(str(i) for i, (t, ok) in enumerate(CORPUS) if ok and ("o_totalprice" in t or "* FROM a" in t))


@_q(f"""SELECT o_orderkey, CASE WHEN o_orderkey % {len(CORPUS)} NOT IN ({_ALLOWED_AT}) THEN 'BLOCK' WHEN o_orderkey % {len(CORPUS)} IN ({_TOTALS_AT}) OR o_totalprice > 300000 THEN 'CONFIRM' ELSE 'ALLOW' END AS decision FROM orders""")
def gate_decisions(spark, sf_dir):
    """Each order is a request for one of the texts, with its price as the row estimate."""
    o = table(spark, sf_dir, "orders")
    sql = F.element_at(F.array(*(F.lit(t) for t, _ in CORPUS)), (F.pmod("o_orderkey", F.lit(len(CORPUS))) + 1).cast("int"))
    requests = o.select("o_orderkey", sql.alias("sql"), F.col("o_totalprice").alias("estimate"))
    return govern.judged(requests, _granted(spark, sf_dir), {"orders.o_totalprice"}, 300_000).select("o_orderkey", "decision")


@_q("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 26 OFFSET 50")
def offset_page(spark, sf_dir):
    return govern.preview(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey", "o_totalprice"], "o_orderkey", None, 25, 50)


@_q("SELECT s_suppkey AS source_id, CASE WHEN s_suppkey%3=0 THEN 'private' ELSE 'public' END AS visibility FROM supplier WHERE s_nationkey%2=0 AND s_suppkey%5<>0 AND (s_suppkey%3<>0 OR s_suppkey%2=0)")
def document_visibility(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    sources = s.select(k.alias("source_id"), F.when(F.col("s_nationkey") % 2 == 0, "t1").otherwise("t2").alias("tenant_id"), F.when(k % 5 == 0, "rejected").otherwise("accepted").alias("status"), F.when(k % 3 == 0, "private").otherwise("public").alias("visibility"))
    grants = s.select(k.alias("source_id"), F.lit("ann").alias("user_id"), F.lit("t1").alias("tenant_id"), F.when(k % 2 == 0, "approved").otherwise("pending").alias("status"))
    return govern.visible_documents(sources, grants, "ann", "t1").select("source_id", "visibility")


@_q("""SELECT o_orderkey AS request_id, CASE WHEN o_custkey%10=0 THEN 'self_decision' WHEN o_custkey%10=1 THEN 'not_admin' WHEN o_orderdate<=TIMESTAMP '1996-01-01' THEN 'ends_in_the_past' WHEN o_orderdate>TIMESTAMP '1996-01-31' THEN 'too_long' ELSE 'approved' END AS outcome FROM orders""")
def access_decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.lit("u").alias("user_id"), F.when(F.col("o_custkey") % 10 == 0, "u").otherwise("admin").alias("decider"), (F.col("o_custkey") % 10 != 1).alias("decider_admin"), F.lit(1).alias("decided_at"), F.col("o_orderdate").cast("timestamp").alias("valid_until"))
    return govern.decided_requests(o, "1996-01-01 00:00:00").select("request_id", "outcome")


@_q("SELECT CASE WHEN o_orderdate<=TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'approved' END AS status, count(*) AS n FROM orders GROUP BY 1")
def grant_sweep(spark, sf_dir):
    g = table(spark, sf_dir, "orders").select(F.lit("approved").alias("status"), F.col("o_orderdate").cast("timestamp").alias("valid_until"))
    return govern.expiring(g, "1996-01-01 00:00:00").groupBy("status").agg(F.count("*").alias("n"))


def ledger(spark, sf_dir):
    """Events as an audit ledger of one tenant per event type."""
    e = table(spark, sf_dir, "events")
    return audit.append(e.select(F.col("event_type").alias("tenant"), "ts", "event_id", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.concat(F.lit("o"), (F.col("event_id") % 97).cast("string")).alias("object_id"), F.col("props").alias("details")))


@_q("SELECT event_type AS tenant, count(*) AS n, true AS valid FROM events GROUP BY 1")
def audit_chain_verify(spark, sf_dir):
    return audit.verify(ledger(spark, sf_dir)).select("tenant", "n", "valid")


@_q("""WITH s AS (SELECT event_type AS tenant, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq FROM events)
SELECT tenant, count(*) - count(*) FILTER (seq=7 AND tenant='purchase') AS n, CASE tenant WHEN 'click' THEN 5 WHEN 'purchase' THEN 8 END AS bad_seq, CASE tenant WHEN 'click' THEN 'hash' WHEN 'purchase' THEN 'gap' END AS reason FROM s GROUP BY tenant""")
def audit_chain_tamper(spark, sf_dir):
    bad = ledger(spark, sf_dir).withColumn("details", F.when((F.col("tenant") == "click") & (F.col("seq") == 5), "forged").otherwise(F.col("details"))).filter("NOT (tenant = 'purchase' AND seq = 7)")
    return audit.verify(bad).select("tenant", "n", "bad_seq", "reason")


@_q("SELECT event_type AS tenant, max(CASE WHEN k=n THEN k END) AS lost FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def audit_anchor_tail(spark, sf_dir):
    from pyspark.sql import Window

    whole = ledger(spark, sf_dir).withColumn("last", F.max("seq").over(Window.partitionBy("tenant")))
    anchors = whole.filter("seq = last").select("tenant", "seq", "hash")
    return audit.verify(whole.filter("seq < last").drop("last"), anchors).select("tenant", F.col("bad_seq").alias("lost"))


@_q("SELECT seq, event_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq FROM events WHERE event_type='click') WHERE seq>100 ORDER BY seq LIMIT 51")
def cursor_page(spark, sf_dir):
    return audit.page(ledger(spark, sf_dir), audit.encode_cursor(100), 50, tenant="click").select("seq", "event_id")


@_q("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)//1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)//1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)>=3 AS alert FROM events WHERE event_type='error'")
def blocked_in_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))
    return workflow.blocked_in_window(e, 86400).select("event_id", "recent", "alert")


@_q("""WITH RECURSIVE e AS (SELECT 'd' || user_id%20 AS domain, floor(epoch(ts))::BIGINT::DOUBLE AS epoch, event_id AS hit_id, row_number() OVER (PARTITION BY user_id%20 ORDER BY floor(epoch(ts))::BIGINT, event_id) AS k FROM events),
 w(domain, k, epoch, hit_id, kept, accepted) AS (SELECT domain, k, epoch, hit_id, [epoch], true FROM e WHERE k=1
  UNION ALL SELECT e.domain, e.k, e.epoch, e.hit_id, CASE WHEN len(list_filter(w.kept, lambda x: x > e.epoch-3600)) < 3 THEN list_append(list_filter(w.kept, lambda x: x > e.epoch-3600), e.epoch) ELSE w.kept END, len(list_filter(w.kept, lambda x: x > e.epoch-3600)) < 3 FROM w JOIN e ON e.domain=w.domain AND e.k=w.k+1)
SELECT domain, epoch, hit_id, accepted FROM w""")
def rate_limited(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("d"), (F.col("user_id") % 20).cast("string")).alias("domain"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("epoch"), F.col("event_id").alias("hit_id"))
    return workflow.rate_limited(e, 3, 3600.0)


@_q("""WITH RECURSIVE e AS (SELECT event_type || ':' || user_id%10 AS key, floor(epoch(ts))::BIGINT::DOUBLE AS t, row_number() OVER (PARTITION BY event_type, user_id%10 ORDER BY floor(epoch(ts))::BIGINT, event_id) AS k FROM events),
 w(key, k, started) AS (SELECT key, k, t FROM e WHERE k=1 UNION ALL SELECT e.key, e.k, CASE WHEN e.t-w.started>3600 THEN e.t ELSE w.started END FROM w JOIN e ON e.key=w.key AND e.k=w.k+1)
SELECT key AS dedupe_key, started, count(*) AS count FROM w GROUP BY ALL""")
def notify_collapsed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string")).alias("dedupe_key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("epoch"))
    return workflow.collapsed(e, 3600.0)


@_q("""SELECT o_orderkey AS action_id, CASE o_orderkey%4 WHEN 0 THEN 'executed' WHEN 1 THEN 'in_review' WHEN 2 THEN 'rejected' ELSE 'approved' END AS state, CASE o_orderkey%4 WHEN 1 THEN 'own_action' WHEN 2 THEN 'not_allowed' WHEN 3 THEN 'signature_expired' END AS refused FROM orders""")
def approval_states(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    step = lambda i, actor, verb, epoch: F.struct(F.lit(i).cast("long").alias("step"), actor.alias("actor"), verb.alias("verb"), epoch.cast("double").alias("epoch"))
    events = F.array(
        step(1, F.lit("ann"), F.lit("submit"), F.lit(0)), step(2, F.when(k == 1, "ann").otherwise("bob"), F.when(k == 2, "reject").otherwise("approve"), F.lit(10)),
        step(3, F.lit("bob"), F.lit("execute"), F.when(k == 3, 10_000).otherwise(20)),
    )
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("action_id"), F.explode(events).alias("e")).select("action_id", "e.*", F.lit(None).cast("string").alias("idempotency_key"))
    got = workflow.approval_states(a)
    return got.groupBy("action_id").agg(F.max_by("state", "step").alias("state"), F.max_by("refused", F.when(F.col("refused").isNotNull(), F.col("step"))).alias("first")).select("action_id", "state", F.col("first").alias("refused"))


ORACLES["approval_states"] = """SELECT o_orderkey AS action_id, CASE o_orderkey%4 WHEN 0 THEN 'executed' WHEN 1 THEN 'in_review' WHEN 2 THEN 'rejected' ELSE 'approved' END AS state, CASE o_orderkey%4 WHEN 1 THEN 'not_allowed' WHEN 2 THEN 'not_allowed' WHEN 3 THEN 'signature_expired' END AS refused FROM orders"""


@_q("SELECT event_id, CASE WHEN event_id%7>=5 THEN 'dead' WHEN event_id%2=0 THEN 'send' ELSE 'wait' END AS verdict, least(3600, 30*pow(2, greatest(event_id%7,1)-1)) AS backoff FROM events")
def outbox_due(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).alias("attempts"), F.lit("pending").alias("status"), F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(1e12).alias("next_at"), F.lit(0.0).alias("claimed_at"), F.lit(1).alias("priority"), F.col("ts").alias("created_at"))
    return workflow.due_notices(e, 1.0).select("event_id", "verdict", workflow.backoff_seconds(F.greatest("attempts", F.lit(1))).alias("backoff"))


@_q("""SELECT c_custkey, field, value FROM (SELECT c_custkey, unnest(['c_name','place__nation','place__segment']) AS field, unnest([c_name, c_nationkey::VARCHAR, c_mktsegment]) AS value FROM customer)""")
def flatten_export(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place"))
    return export.long_form(export.flatten(c).withColumn("c_custkey", F.col("c_custkey").cast("long")), "c_custkey")


@_q("""SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS csv, '| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |' AS md, '<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td><td>' || n_regionkey || '</td></tr>' AS html,
 '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def export_renderers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    key = F.regexp_extract("line", r"(\d+)", 1)
    out = None
    for kind, name in (("csv", "csv"), ("markdown", "md"), ("html", "html"), ("json", "json")):
        lines = export.render(n, kind).select(key.alias("k"), F.col("line").alias(name))
        out = lines if out is None else out.join(lines, "k")
    return out.drop("k")


@_q("SELECT s_suppkey, s_name, s_suppkey%4<>3 AS grounded, CASE WHEN s_suppkey%2=0 THEN ['b' || s_suppkey] ELSE ['b' || s_suppkey, 'c'] END AS citations FROM supplier")
def answer_grounding(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumns({"answer": F.array(F.lit(1), (k % 4).cast("int")), "allowed": F.array(F.lit(0), F.lit(1), F.lit(2)), "b1": F.concat(F.lit("b"), k.cast("string")), "b2": F.when(k % 2 == 1, "c")})
    return govern.citations(govern.grounded(s), ["b1", "b2", "b1"]).select("s_suppkey", "s_name", "grounded", "citations")


@_q("SELECT o_orderkey AS request_id, CASE WHEN o_orderkey%5=0 THEN 'empty' WHEN o_custkey%2=0 AND o_orderkey%3=0 THEN 'already_pending' ELSE 'pending' END AS outcome FROM orders")
def access_requests(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    user = F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
    asked = o.select(k.alias("request_id"), user.alias("user_id"), F.lit("t").alias("table_name"), F.when(k % 5 != 0, F.array(F.lit("a"), F.when(k % 3 == 0, "b").otherwise("c"))).alias("columns"))
    pending = o.filter("o_custkey % 2 = 0").select(user.alias("user_id"), F.lit("t").alias("table_name"), F.array(F.lit("b"), F.lit("d")).alias("columns")).distinct()
    return govern.new_requests(asked, pending).select("request_id", "outcome")


@_q("SELECT l_orderkey AS request_id, CASE WHEN o_orderstatus IS NULL OR o_orderstatus='P' OR o_orderkey%7=0 THEN 'not_found' WHEN o_orderkey%2=0 THEN 'already_public' ELSE 'pending' END AS outcome FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN orders ON o_orderkey=l_orderkey")
def document_requests(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    sources = o.select(k.alias("source_id"), F.when(k % 7 == 0, "t2").otherwise("t1").alias("tenant_id"), F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("accepted").alias("status"), F.when(k % 2 == 0, "public").otherwise("private").alias("visibility"))
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id")).distinct().withColumns({"source_id": F.col("request_id"), "tenant_id": F.lit("t1"), "user_id": F.lit("ann")})
    return govern.document_requests(asked, sources).select("request_id", "outcome")


@_q("SELECT DISTINCT l_partkey AS item_id, l_partkey%3<>0 AS found FROM lineitem")
def export_items(spark, sf_dir):
    stored = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 3 == 0, "t2").otherwise("t1").alias("tenant_id"))
    return govern.stored_items(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id")), stored, "t1")


@_q("SELECT event_type, user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, count(*)>2 AS flooded FROM events GROUP BY ALL")
def notice_digests(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))
    return workflow.digest_rows(e, 2).select("event_type", "user_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "n", "flooded")
