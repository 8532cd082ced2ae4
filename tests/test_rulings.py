"""Signatures, rulings, readings and exports on documented cases."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from docketry.functions import numbers, security
from docketry.operators import audit, export, govern


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 65, b"\0\xff" * 40])
def test_signatures_are_hmac(spark, key):
    texts = ["", "a|b", "ü" * 200, None]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(security.signed(F.col("t"), key).alias("s")).collect()]
    assert got == [hmac.new(key, t.encode(), "sha256").hexdigest() if t is not None else None for t in texts]


def test_a_checkpoint_without_its_key(spark):
    rows = spark.createDataFrame([("t", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(1, 9)], "tenant string, seq long, hash string")
    points = audit.signed_checkpoints(rows, b"k", 2)
    assert [r.fault for r in audit.checkpoint_faults(rows, points, b"k").collect()] == [None] * 4
    assert {r.fault for r in audit.checkpoint_faults(rows, points, b"other").collect()} == {"signature"}
    assert {r.fault for r in audit.checkpoint_faults(rows.limit(0), points.withColumn("signature", F.lit(None).cast("string")), b"k").collect()} == {"signature"}
    assert {r.fault for r in audit.checkpoint_faults(rows.limit(0), points, b"k").collect()} == {"lost"}


def test_a_refused_decision_decides_nothing(spark):
    rows = [(1, "ann", "ann", True, 1, "2024-01-02"), (1, "ann", "bob", False, 2, "2024-01-02"), (1, "ann", "bob", True, 3, "2023-01-01"), (1, "ann", "bob", True, 4, None), (1, "ann", "bob", True, 5, "2024-01-02"), (1, "ann", "cid", True, 6, "2024-01-02"), (1, "ann", "ann", True, 7, "2024-01-02"), (2, None, "bob", None, 1, "2024-01-02"), (None, "ann", "bob", True, 1, "2024-01-02")]
    d = spark.createDataFrame(rows, "request_id long, user_id string, decider string, decider_admin boolean, decided_at int, valid_until string").withColumn("valid_until", F.col("valid_until").cast("timestamp"))
    got = {(r.request_id, r.decided_at): r.outcome for r in govern.decided_requests(d, "2024-01-01 00:00:00").collect()}
    assert got == {(1, 1): "self_decision", (1, 2): "not_admin", (1, 3): "ends_in_the_past", (1, 4): "no_end", (1, 5): "approved", (1, 6): "already_decided", (1, 7): "self_decision", (2, 1): "not_admin", (None, 1): "approved"}


def test_grants(spark):
    d = spark.createDataFrame([(1, "ann", "t", ["b", "a"], "bob", "approved", "2024-02-01"), (2, "ann", "t", ["a"], "bob", "rejected", None)], "request_id long, user_id string, table_name string, columns array<string>, decider string, outcome string, valid_until string").withColumn("valid_until", F.col("valid_until").cast("timestamp"))
    g = govern.signed_grants(d, b"k")
    state = lambda x, now="2024-01-15 00:00:00", key=b"k": [r.state for r in govern.grant_states(x, key, now).collect()]
    assert state(g) == ["valid"] and state(g, "2024-02-01 00:00:00") == ["expired"] and state(g, key=b"z") == ["forged"] and state(g.withColumn("revoked", F.lit(True))) == ["revoked"]
    assert state(g.withColumn("columns", F.array(F.lit("a"), F.lit("b")))) == ["valid"] and state(g.withColumn("user_id", F.lit("eve"))) == ["forged"]
    assert state(g.withColumn("valid_until", F.lit(None).cast("timestamp"))) == ["forged"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("1.234,56", [1234.56]), ("1,234.56", [1234.56]), ("1,234", [1.234, 1234.0]), ("1.234", [1.234, 1234.0]), ("1.234.567", [1234567.0]), ("12,34,567", [1234567.0]), ("1 234 567 in", [1234567.0]), ("3 bn", [3.0, 3e9]), ("2,5 mn", [2.5, 25.0, 2.5e6, 2.5e7]),
        ("4 lakhs", [4.0, 4e5]), ("7%", [0.07, 7.0]), ("1'234.5", [1234.5]), ("8 boxes", [8.0]), ("none", []), ("", []), (None, None), ("1,2,3.4.5", []),
    ],
)
def test_number_readings(spark, text, want):
    assert spark.range(1).select(numbers.number_readings(F.lit(text).cast("string")).alias("x")).first().x == want


def test_plain_numbers(spark):
    cases = {"0.125": "0.12", "0.135": "0.14", "-0.005": "0", "100": "100", "1e12": "1000000000000", "-2.50": "-2.5", "1200.00": "1200", None: None}
    d = spark.createDataFrame([(k,) for k in cases], "k string").select("k", numbers.plain(F.col("k").cast("decimal(30,10)")).alias("x"))
    assert {r.k: r.x for r in d.collect()} == cases
    assert spark.range(1).select(numbers.plain(F.lit(1200.4), 0).alias("x")).first().x == "1200"


def test_tables_of_ragged_rows(spark):
    d = spark.createDataFrame([(1, '[{"b":1,"a":null},{},{"c":[1,2],"b":"x"}]'), (2, "[]"), (3, None), (4, "no list"), (5, '{"a":1}')], "id long, rows string")
    got = sorted((r.id, r.row, r.place, r.column, r.value) for r in export.row_tables(d, "id", "rows").collect() if r.id < 4)
    assert got == [(1, i, p, c, v) for i, vs in enumerate((("1", "", ""), ("", "", ""), ("x", "", "[1,2]"))) for p, (c, v) in enumerate(zip("bac", vs))]


def test_evidence_goes_at_any_depth(spark):
    d = spark.createDataFrame([(1, ("x", (2, "e")), [("p", "q")], "e"), (2, None, None, None)], "id long, a struct<k:string,in:struct<n:int,evidence:string>>, l array<struct<excerpt:string,t:string>>, evidence string")
    out = export.without_evidence(d)
    assert out.schema.simpleString() == "struct<id:bigint,a:struct<k:string,in:struct<n:int>>,l:array<struct<t:string>>>"
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, ("x", (2,)), [("q",)]), (2, None, None)]


def test_exports_take_the_first_rows_and_can_be_checked(spark):
    d = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "concat('a', id, '@b.co') as mail", "'s' as locked").repartition(7)
    out = export.prepared(d, ["locked"], ["mail"], 10, "k")
    assert sorted(r.k for r in out.collect()) == list(range(10)) and out.columns == ["k", "mail"] and export.prepared(d, [], [], None).count() == 1000
    lines = export.render(d, "csv")
    same, other, none = (export.content_digest(x).first() for x in (lines.repartition(3), lines.filter("line <> '7,a1@b.co,s'").unionByName(lines.limit(1)), lines.limit(0)))
    assert export.content_digest(lines).first() == same and same.n_lines == 1000 and same.digest != other.digest and none.n_lines == 0 and len(none.digest) == 64
