"""Audited writes, undo, nested rewriting and single-use approvals."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.functions import nested
from docketry.operators import store as st
from docketry.streaming import singleuse


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}/store"


def rows_of(df):
    return sorted(map(tuple, df.select("id", "v").collect())) if df is not None else []


def test_commits_are_whole_or_nothing(spark, root):
    s, log = st.Store(spark, root), []
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert s.scan("x") is None and s.put({"x": first, "y": first.limit(1)}, lambda t, n: log.append((t, n))) == 1
    assert log == [(1, {"x": 2, "y": 1})]

    def failing(_txn, _n):
        raise OSError("ledger is down")

    with pytest.raises(OSError, match="ledger"):
        s.put({"x": spark.createDataFrame([(1, "bad"), (9, "bad")], "id long, v string")}, failing)
    assert rows_of(s.scan("x")) == [(1, "a"), (2, "b")] and s.last() == 1
    # A write that is killed before its commit: its folder is there, and no scan sees it.
    spark.createDataFrame([(7, "ghost", False, 2)], "id long, v string, _deleted boolean, _txn long").write.parquet(f"{root}/data/kind=x/txn=000000000002-dead-0")
    assert rows_of(s.scan("x")) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="no such row"):
        s.put({"x": first, "z": spark.range(1).select("id", F.raise_error(F.lit("no such row")).alias("v"))})
    assert rows_of(s.scan("x")) == [(1, "a"), (2, "b")] and s.scan("z") is None
    s.put({"x": spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string")})
    assert rows_of(s.scan("x")) == [(1, "a"), (2, "B"), (3, "c")] and rows_of(s.scan("x", 1)) == [(1, "a"), (2, "b")]
    assert all("kind=y" in f for f in s.scan("y").inputFiles())


def test_two_writers_of_a_number(spark, root, monkeypatch):
    a, b = st.Store(spark, root), st.Store(spark, root)
    one = spark.createDataFrame([(1, "a")], "id long, v string")
    monkeypatch.setattr(b, "last", lambda: 0)
    a.put({"x": one})
    with pytest.raises(st.Conflict):
        b.put({"x": spark.createDataFrame([(1, "late")], "id long, v string")})
    assert rows_of(a.scan("x")) == [(1, "a")]


def test_undo_restores_rows(spark, root):
    s = st.Store(spark, root)
    make = lambda rows: spark.createDataFrame(rows, "id long, v string")
    s.put({"link": make([(1, "a"), (2, None)])})
    before = rows_of(s.scan("link"))

    def failing(_store):
        raise RuntimeError("third step")

    with pytest.raises(RuntimeError, match="third"):
        st.steps(s, [lambda x: x.put({"link": make([(2, "z"), (3, "new")])}), lambda x: x.put({"link": make([(3, "newer"), (4, "more")]), "case": make([(1, "c")])}), failing])
    assert rows_of(s.scan("link")) == before and rows_of(s.scan("case")) == []
    s.compact("link")
    assert rows_of(s.scan("link")) == before
    txn = st.publish_sources(s, make([(5, "doc")]), make([(5, "ok")]))
    assert {r.kind for r in s.manifests().filter(F.col("txn") == txn).collect()} == {"source_document", "confidence_validation", "sources"}


def deep(depth, leaf):
    return leaf if depth == 0 else {"k": deep(depth - 1, leaf), "list": [deep(depth - 1, leaf)]}


def test_nested_values(spark):
    raw = [
        {"user": {"mail": "ann@x.org", "Api_Key": "s3", "spend": 1.5}, "items": [{"note": "card 4111 1111 1111 1111", "n": 2}, None], "locked": 1},
        {"user": {"mail": None, "session_token": {"inner": 1}}, "items": [], "other": "plain", "locked": {"x": 2}},
        {"items": "not a list"}, {}, None,
    ]
    df = spark.createDataFrame([(i, json.dumps(r) if r is not None else None) for i, r in enumerate(raw)] + [(9, "{broken")], "id int, j string")
    got = {r.id: json.loads(r.j) if r.j else None for r in nested.redacted_json(df, "j", "LOCKED").collect()}
    assert got[0]["user"] == {"mail": "[REDACTED:email]", "Api_Key": "[redacted]", "spend": "1.5"} and "locked" not in got[0]
    assert "[REDACTED:payment_card:…1111]" in json.dumps(got[0]["items"], ensure_ascii=False)
    assert got[1]["user"] == {"session_token": "[redacted]"} and got[1]["other"] == "plain" and got[9] is None and got[4] is None
    typed = spark.createDataFrame([(1, {"a": {"text": "x", "b": [{"text": "y", "no": "z"}]}})], "id int, v struct<a:struct<text:string,b:array<struct<text:string,no:string>>>>")
    assert nested.collected_text(typed, "v", ("text",)).first().texts == ["x", "y"]
    assert nested.collected_text(typed, "v", ("text",), depth=2).first().texts == ["x"]
    maps = spark.createDataFrame([(1, {"token": "abc", "b": "ann@x.org"})], "id int, m map<string,string>")
    assert nested.audit_safe(maps, "m").first().m == {"token": "[redacted]", "b": "[REDACTED:email]"}
    assert nested.without_keys(typed, "v", "b", "text").first().v is not None
    shallow = nested.audit_safe(typed, "v", depth=1).first().v
    assert shallow.a == nested.TOO_DEEP


def test_second_use_is_refused_across_batches_and_a_restart(spark, tmp_path):
    singleuse.with_state_store(spark)
    rows = [("a", 1, 10.0, "approve"), ("a", 2, 20.0, "use"), ("b", 1, 10.0, "use"), ("a", 3, 30.0, "use"), ("a", 2, 20.0, "use"), ("b", 2, 40.0, "approve"), ("b", 3, 180.0, "use"), ("a", 4, 60.0, "approve"), ("a", 5, 61.0, "approve"), ("a", 6, 62.0, "use"), ("a", 7, 63.0, "use")]
    schema = "request_key string, step long, epoch double, action string"
    src, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))

    def run():
        stream = singleuse.decided(spark.readStream.schema(schema).parquet(src), 100.0)
        stream.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for part in (rows[:3], rows[3:7], rows[7:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        run()
    got = sorted(map(tuple, spark.read.parquet(out).select("request_key", "step", "verdict").collect()))
    want = sorted(map(tuple, singleuse.decisions(spark.createDataFrame(rows, schema), 100.0).select("request_key", "step", "verdict").collect()))
    assert got == want and ("a", 3, "no_approval") in got and ("b", 3, "expired") in got and ("a", 7, "no_approval") in got
