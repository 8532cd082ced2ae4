"""What lets queries grow: how often a text is read, what is joined with what, and that whole results come of it."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from docketry.functions import dates
from docketry.operators import layout, linking, reasoning, report, structure
from docketry.plans import pages, scalars
from docketry.session import settled

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dates_are_read_once(spark):
    q = scalars.dates_in_text(spark, SF)
    assert plan_of(q).count("regexp_extract_all") == 1
    t = F.col("t")
    texts = ["", None, "Invoice date: 3 May 2024; due date 2024-06-12 not 31.02.2024 from 2024-05-06 to 2024-05-03", "Q3 2024", "FY2024 on 1/2/2024", "4/13/2024 – 1.1.1989", "March 2024", "in 2019", "no date"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    for order in ("DMY", "MDY"):
        each = {"found": dates.find_dates(t, order), "checks": dates.date_checks(t, order), "period": dates.find_period(t, order), "labelled": dates.labelled_dates(t, order), "linked": dates.linker_dates(t)}
        for row in d.select("i", dates.all_readings(t, order).alias("all"), *(c.alias(n) for n, c in each.items())).collect():
            assert row["all"].asDict() == {n: row[n] for n in each}, (order, texts[row["i"]])


def test_overlaps_broadcast_nothing(spark):
    q = pages.region_overlaps(spark, SF)
    assert "Broadcast" not in q._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in layout.conflicts(spark.createDataFrame([(1, 1, "text", 0.5, 0.0, 0.0, 1.0, 1.0)], "page_id long, region_id long, type string, confidence double, x1 double, y1 double, x2 double, y2 double"))._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_hot_groups_meet_few_facts(spark):
    rows = [(s, i, None, "m") for i, s in enumerate(sorted([*range(40), *range(0, 40, 3)]) * 2)] + [(None, 999, None, "m"), (7, None, None, "m")]
    d = spark.createDataFrame(rows, "source_id long, fact_id long, subject string, metric string")
    late = lambda x: (x is None, x or 0)
    facts = [r for r in rows if r[0] is not None]
    every = sorted(((a[0], *late(a[1]), b[0], *late(b[1])) for a in facts for b in facts if a[0] < b[0]))
    for most in (1, 5, 20):
        got = reasoning.unnamed_pairs(d, most).collect()
        assert sorted((r.a_source_id, *late(r.a_fact_id), r.b_source_id, *late(r.b_fact_id)) for r in got) == every[:most]
        assert {r.group_pairs for r in got} == {len(every)}
    # Ranks are limits that Spark applies before it brings a group together.
    assert reasoning.unnamed_pairs(d, 20)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_relatedness_by_blocks(spark, monkeypatch):
    rows = [(i % 31 or None, f"s{i % 13}" if i % 3 else None, f"m{i * i % 17}", "2024-01-01" if i % 5 == 0 else None, "EUR" if i % 31 % 4 == 0 else None) for i in range(140)]
    d = spark.createDataFrame(rows, "source_id long, subject string, metric string, period_start string, currency string")
    held = {}
    for s, *values in rows:
        for k, v in enumerate(values):
            if s is not None and v is not None:
                held.setdefault(s, set()).add((k, v))
    want = {(a, b): len({k for k, _ in held[a] & held[b]}) / 4 for a in held for b in held if a < b and held[a] & held[b]}
    for name, n in (("BLOCK_SOURCES", 4), ("VALUES", 3), ("PAIR_ROWS", 2)):
        monkeypatch.setattr(reasoning, name, n)
    q = reasoning.relatedness(d)
    assert {(r.a_source, r.b_source): r.score for r in q.collect()} == want
    assert reasoning.relatedness(d.filter("false")).count() == 0
    # Pairs are made inside a task: none of them is shuffled.
    assert "MapInArrow" in q._jdf.queryExecution().executedPlan().toString()


def test_gutters_are_found_by_edges():
    page = [(10.0, 40.0 * i, 290.0, 40.0 * i + 30) for i in range(200)] + [(310.0, 40.0 * i, 590.0, 40.0 * i + 30) for i in range(200)] + [(10.0, 4000.0, 590.0, 4030.0)]
    began = time.process_time()
    for _ in range(20):
        assert structure.find_gutter(page, 600.0) == 300.0
    assert time.process_time() - began < 0.5  # counting all boxes at each of 81 places took over a second
    order = structure.gutter_order(page, 600.0)
    assert order == [*range(100), *range(200, 300), 400, *range(100, 200), *range(300, 400)]
    # A box without width on the gutter is read once, one without an edge too.
    odd = [*[(10.0, 40.0 * i, 290.0, 40.0 * i + 30) for i in range(3)], *[(310.0, 40.0 * i, 590.0, 40.0 * i + 30) for i in range(3)], (300.0, 200.0, 300.0, 210.0), (float("nan"), 50.0, float("nan"), 60.0)]
    assert sorted(structure.gutter_order(odd, 600.0)) == list(range(len(odd)))


def test_cosines_broadcast_nothing(spark):
    # As Parquet they are small enough to broadcast.
    texts = settled(spark.createDataFrame([(1, "abcd"), (2, "bcde"), (3, "xyz")], "id long, text string"), "test-texts")
    pairs = settled(spark.createDataFrame([(1, 2), (1, 3)], "id long, anchor_id long"), "test-pairs")
    counts = report.trigram_counts(texts)
    q = report.with_cosine(pairs, counts, counts, "id", "anchor_id")
    assert "Broadcast" not in q._jdf.queryExecution().executedPlan().toString()
    assert {(r.anchor_id, r.cosine) for r in q.collect()} == {(2, 0.5), (3, None)}
    names = settled(spark.createDataFrame([(0, "acme trading"), (1, "acme tradings")], "side int, name string"), "test-names")
    assert "Broadcast" not in linking.close_names(names)._jdf.queryExecution().executedPlan().toString()
