"""Labels of axes, notices and JSON-safe values on documented cases."""

from decimal import Decimal

from pyspark.sql import functions as F

from docketry.functions import security
from docketry.operators import structure, views


def test_axis_labels(spark):
    d = spark.createDataFrame([(1, "20 -", [0.0, 0.0, 40.0, 10.0]), (2, "2021 2022", [0.0, 5.0, 90.0, 15.0]), (3, "Net -", [0.0, 0.0, 9.0, 9.0]), (4, None, None), (5, "", [0.0, 0.0, 1.0, 1.0])], "id int, text string, bbox array<double>")
    got = sorted((r.id, r.text, r.bbox) for r in structure.axis_labels(d).collect() if r.text)
    assert got == [(1, "20", [0.0, 0.0, 20.0, 10.0]), (2, "2021", [0.0, 5.0, 40.0, 15.0]), (2, "2022", [50.0, 5.0, 90.0, 15.0]), (3, "Net -", [0.0, 0.0, 9.0, 9.0])]
    assert structure.axis_labels(d).count() == 6


def test_notices_and_json_values(spark):
    d = spark.createDataFrame([("Bearer abc.def  mail ann@x.org\npassword: hunter2 from 10.1.2.3 no 123456789012 id ab-123456789", Decimal("1.50"), b"abc"), (None, None, None)], "t string, d decimal(9,2), b binary")
    got = [r.x for r in d.select(security.sanitize_notice(F.col("t")).alias("x")).collect()]
    assert got == ["[token] mail [email] password=[redacted] from 10.1.2.x no [number] id ab-123456789", ""]
    assert len(spark.range(1).select(security.sanitize_notice(F.repeat(F.lit("ab "), F.lit(300)), 50).alias("x")).first().x) == 50
    assert [tuple(r) for r in views.json_safe(d).select("d", "b").collect()] == [("1.50", "<3 bytes>"), (None, None)]
