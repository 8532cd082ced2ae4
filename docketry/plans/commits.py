"""Queries of audited storage, nested values and single-use approvals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docketry.functions import nested
from docketry.operators import store
from docketry.session import shared_folder, table
from docketry.streaming import singleuse

QUERIES, ORACLES = {}, {}


def _q(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@_q("""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN '[REDACTED:email]' END AS mail, '[redacted]' AS token, 'call [REDACTED:email] now' AS tag, CASE WHEN event_id % 2 = 0 THEN (user_id + 0.25)::DOUBLE END AS score, true AS score_is_text,
 CASE WHEN event_id % 3 <> 0 THEN value END AS value, CASE WHEN event_id % 5 = 0 THEN '{"n":' || user_id || '}' ELSE event_type END AS extra, true AS unlocked FROM events""")
def nested_redaction(spark, sf_dir):
    """Ragged JSON of each event, five levels deep: secret keys, mail addresses, numbers with fractions, a locked key, and a key that is a text here and an object there."""
    e = table(spark, sf_dir, "events")
    user, on = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x.org")), lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise("")
    s, k = F.lit, F.col("event_id")
    j = F.concat(
        s('{"event":{"who":{"user":{'), on(k % 4 != 0, s('"mail":"'), user, s('",')), s('"auth_token":"t1","tags":[{"name":"call '), user, s(' now"'), on(k % 2 == 0, s(',"score":'), F.col("user_id").cast("string"), s(".25")), s('}]}},"pin":7},'),
        on(k % 3 != 0, s('"value":'), F.col("value").cast("string"), s(",")), s('"extra":'), F.when(k % 5 == 0, F.concat(s('{"n":'), F.col("user_id").cast("string"), s("}"))).otherwise(F.concat(s('"'), F.col("event_type"), s('"'))), s("}"),
    )
    at = lambda p: F.get_json_object("j", p)
    d = nested.redacted_json(e.select("event_id", j.alias("j")), "j", "pin")
    return d.select(
        "event_id", at("$.event.who.user.mail").alias("mail"), at("$.event.who.user.auth_token").alias("token"), at("$.event.who.user.tags[0].name").alias("tag"), at("$.event.who.user.tags[0].score").cast("double").alias("score"),
        (~F.col("j").rlike('"(?:score|value)":[0-9]')).alias("score_is_text"), at("$.value").cast("double").alias("value"), at("$.extra").alias("extra"), (~F.col("j").contains('"pin"')).alias("unlocked"),
    )


def _store(spark, name: str) -> store.Store:
    return store.Store(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def _customers(spark, sf_dir, mark: str = ""):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(mark)).alias("name"), "c_mktsegment")


@_q("""SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 3 = 0 THEN '+' ELSE '' END AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 7 <> 0""")
def store_scan(spark, sf_dir):
    """Puts, an update of a third, a write whose audit fails, and deletions; then the newest versions of one of two kinds."""
    s = _store(spark, "store")
    s.put({"customer": _customers(spark, sf_dir), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")})
    s.put({"customer": _customers(spark, sf_dir, "+").filter("id % 3 = 0")})

    def refuses(_txn: int, _rows: dict[str, int]) -> None:
        raise OSError("the ledger takes no event")

    try:
        s.put({"customer": _customers(spark, sf_dir, "!")}, refuses)
    except OSError:
        pass
    s.put({}, deleted={"customer": _customers(spark, sf_dir).filter("id % 7 = 0")})
    return s.scan("customer").select("id", "name", F.col("c_mktsegment").alias("segment"))


@_q("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0")
def store_undo(spark, sf_dir):
    """Three steps of which the last fails: updates, new ids and deletions of the first two are taken back."""
    s = _store(spark, "undo")
    all_, first = _customers(spark, sf_dir, "*"), _customers(spark, sf_dir).filter("id % 2 = 0")
    s.put({"customer": first})

    def fails(_s: store.Store) -> int:
        raise RuntimeError("the third step")

    try:
        store.steps(s, [lambda x: x.put({"customer": all_.filter("id % 3 = 0")}), lambda x: x.put({"customer": all_.filter("id % 6 = 1")}, deleted={"customer": first.filter("id % 4 = 0")}), fails])
    except RuntimeError:
        pass
    return s.scan("customer").select("id", "name", F.col("c_mktsegment").alias("segment"))


_TTL_S = 3600.0
_USES = f"""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, lag(event_type) OVER w AS p, lag(epoch_us(ts) / 1e6) OVER w AS pt
 FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id::VARCHAR AS request_key, event_id AS step, CASE WHEN event_type = 'view' THEN 'opened' WHEN p IS DISTINCT FROM 'view' OR t - pt > 2 * {_TTL_S} THEN 'no_approval' WHEN t - pt > {_TTL_S} THEN 'expired' ELSE 'used' END AS verdict FROM e"""


def _actions(events):
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    kept = events.filter(F.col("event_type").isin("view", "purchase"))
    return kept.select(F.col("user_id").cast("string").alias("request_key"), F.col("event_id").alias("step"), epoch.alias("epoch"), F.when(F.col("event_type") == "view", "approve").otherwise("use").alias("action"))


@_q(_USES)
def single_use_decisions(spark, sf_dir):
    """A view opens an approval of its user, a purchase uses it."""
    return singleuse.decisions(_actions(table(spark, sf_dir, "events")), _TTL_S).select("request_key", "step", "verdict")


@_q(_USES)
def single_use_stream(spark, sf_dir):
    """The same as a stream over the events, its state in RocksDB, its results a table."""
    spark = spark.newSession()
    singleuse.with_state_store(spark)
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = f"{shared_folder(spark)}/single-use-{uuid.uuid4().hex}"
    found = singleuse.decided(_actions(events), _TTL_S)
    found.writeStream.format("parquet").option("checkpointLocation", f"{at}/mark").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(singleuse.RESULT).parquet(f"{at}/out").select("request_key", "step", "verdict")
