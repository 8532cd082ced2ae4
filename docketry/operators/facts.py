"""Fact extraction from located lines, verification and accounting.

A line is (source_id, page, ro, line_no, text). Lines flow through projections and one window per source: the subject and the
period of a fact are the nearest preceding statements of them in its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import dates, numbers, security, text

ORDER = ("page", "ro", "line_no")
#: Penalties on a fact's confidence.
PENALTIES = {"approx": 0.85, "locale": 0.90, "inherited": 0.95, "range": 0.50}


def carry_forward(lines: DataFrame, columns: list[str], by: str = "source_id") -> DataFrame:
    """Each column filled from the nearest preceding line of the source that states it."""
    w = Window.partitionBy(by).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({f"{c}_ctx": F.last(c, ignorenulls=True).over(w) for c in columns})


def with_optional(lines: DataFrame) -> DataFrame:
    """Lines with the columns that they may lack: header and siblings of a table's cell, label and raw_value given apart, locked, masked."""
    kinds = {"header": "string", "siblings": "int", "label": "string", "raw_value": "string", "locked": "boolean", "masked": "boolean"}
    return lines.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in lines.columns})


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Label, value and context of each line; lines that look like instructions are quarantined, locked and masked ones left out.

    A line may bring its label and raw value, as cells of tables do; else its text is parted.
    """
    d = unlocked(with_optional(lines)).withColumn("lv", text.split_label_value(F.col("text")))
    d = d.withColumn("mark", F.when(F.col("label").isNull(), F.col("lv.mark")).otherwise("cell")).withColumn("label", F.coalesce("label", "lv.label")).withColumn("raw_value", F.coalesce("raw_value", "lv.value"))
    d = d.withColumn("quarantined", F.size(security.injection_hits(F.col("text"))) > 0)
    d = d.withColumn("subject", F.when(text.is_subject_label(F.col("label")) & ~F.col("quarantined"), text.normalize_subject(F.col("raw_value"))))
    period = F.lower("label").rlike("period|month of|for the (?:month|quarter|year)")
    d = d.withColumn("p", F.when(period & ~F.col("quarantined"), dates.find_period(F.col("raw_value"))))
    return carry_forward(d.withColumn("period_start", F.col("p.start")).withColumn("period_end", F.col("p.end")), ["subject", "period_start", "period_end"]).drop("lv", "p")


def fact_worthy(label: Column, v: Column, header: Column, siblings: Column, mark: Column, subject: Column) -> Column:
    """A label that names a measure, and one sign that its value is meant: a currency, unit or percent of its own; a period in label or header; a header
    that names a measure; no other value in its row; a colon; or a subject that was named before.
    """
    own = v["currency"].isNotNull() | (v["mark"] != "") | v["unit"].isNotNull() | v["percent"]
    periodic = lambda c: dates.find_period(c)["start"].isNotNull()
    signs = (own, periodic(label), periodic(header), text.label_names_measure(header), siblings == 1, mark == "colon", subject.isNotNull() & (mark != "cell"))
    meant = F.lit(False)
    for sign in signs:
        meant |= F.coalesce(sign, F.lit(False))
    return text.label_ok(label) & text.label_names_measure(label) & v["value"].isNotNull() & meant


def candidates(lines: DataFrame) -> DataFrame:
    """One row per line with a reason: accepted, or why it is no fact."""
    d = parsed_lines(lines).withColumn("v", numbers.parse_value(F.col("raw_value")))
    worthy = fact_worthy(F.col("label"), F.col("v"), F.col("header"), F.col("siblings"), F.col("mark"), F.col("subject_ctx"))
    reason = (
        F.when(F.col("quarantined"), "injected")
        .when(F.col("label").isNull(), "no_label")
        .when(text.is_subject_label(F.col("label")) | (F.col("subject").isNotNull()), "context")
        .when(text.label_is_identifier(F.col("label")) | text.label_is_sensitive(F.col("label")), "identifier")
        .when(F.col("v").isNull(), "not_a_value")
        .when(~worthy, "not_a_measure")
        .otherwise("accepted")
    )
    return d.withColumn("reason", reason)


def facts(lines: DataFrame, synonyms: dict[str, str] | None = None, categories: dict[str, str] | None = None) -> DataFrame:
    """Accepted candidates as facts, one per id; the id hashes source, place, metric, value and label.

    What a header says beside frequency, basis and dates is part of the metric. A currency may come from a code in label or
    header, a frequency or basis from value, label or header, in this order. `categories` maps metrics to categories.
    """
    d = candidates(lines).filter("reason = 'accepted'")
    d = d.withColumn("metric", text.canonical_metric(F.trim(F.concat_ws(" ", "label", text.header_leftover(F.col("header"), numbers.CODES))), synonyms))
    penalty = lambda cond, name: F.when(cond, PENALTIES[name]).otherwise(1.0)
    v, codes = F.col("v"), numbers.codes_in(F.concat_ws(" ", "label", "header"))
    category = F.create_map(*(F.lit(x) for kv in categories.items() for x in kv))[F.col("metric")] if categories else F.lit(None).cast("string")
    basis = text.basis_of(F.col("label"))
    out = d.select(
        "source_id", *ORDER, "label", "raw_value",
        F.col("subject_ctx").alias("subject"), "metric", v.value.alias("value"), numbers.context_currency(v.currency, v.mark, ~v.percent & v.unit.isNull(), codes).alias("currency"), v.unit.alias("unit"), category.alias("category"),
        F.coalesce(text.frequency_of(F.col("raw_value")), text.frequency_of(F.col("label")), text.frequency_of(F.col("header"))).alias("frequency"),
        F.when((basis == "unknown") & F.col("header").isNotNull(), text.basis_of(F.col("header"))).otherwise(basis).alias("basis"), F.col("period_start_ctx").alias("period_start"), F.col("period_end_ctx").alias("period_end"),
        F.round(penalty(v.approx, "approx") * penalty(v.assumed, "locale") * penalty(F.col("subject_ctx").isNotNull() & F.col("subject").isNull(), "inherited") * penalty(v.is_range, "range"), 4).alias("confidence"),
        F.col("text").alias("excerpt"),
    )
    keyed = out.withColumn("fact_id", F.substring(F.sha2(F.concat_ws("|", "source_id", "page", "ro", "line_no", "metric", "raw_value", "label"), 256), 1, 32))
    return keyed.dropDuplicates(["fact_id"])


def accounting(lines: DataFrame) -> DataFrame:
    """Per source: lines, accepted and skipped by reason; accepted and skips sum to lines."""
    c = candidates(lines)
    count = lambda r: F.count_if(F.col("reason") == r).alias(r)
    return c.groupBy("source_id").agg(F.count("*").alias("n_lines"), *map(count, ("accepted", "injected", "no_label", "context", "identifier", "not_a_value", "not_a_measure")))


def unlocked(lines: DataFrame) -> DataFrame:
    """Lines that may become facts: locked and masked ones are left out."""
    return lines.filter(~F.coalesce("locked", F.lit(False)) & ~F.coalesce("masked", F.lit(False)))


def with_block_confidence(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Facts with a confidence of at most those of their block and of its validation: (source_id, page, ro, line_no, confidence, validation); unknown ones don't count."""
    b = blocks.select("source_id", *ORDER, F.least("confidence", "validation").alias("_most"))
    return found.join(b, ["source_id", *ORDER], "left").withColumn("confidence", F.least("confidence", "_most")).drop("_most")


def verify(found: DataFrame, blocks: DataFrame, case_sources: DataFrame | None = None, fuzzy: float = 95.0) -> DataFrame:
    """Facts with a verdict: source in the case, block exists, holds the excerpt and the raw value, period in order.

    An excerpt is held if the block has it, or has all its parts between pipes, or, from eight characters on, a stretch that is
    at least `fuzzy` percent like it. Only rows that fail the plain tests reach the fuzzy one, which needs Python.
    """
    b = blocks.select("source_id", *ORDER, F.col("text").alias("block_text"))
    d = found.join(b, ["source_id", *ORDER], "left")
    if case_sources is not None:
        d = d.join(case_sources.select("source_id").distinct().withColumn("_in_case", F.lit(True)), "source_id", "left")
    else:
        d = d.withColumn("_in_case", F.lit(True))
    parts = F.filter(F.transform(F.split("excerpt", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.col("block_text").contains(F.col("excerpt")) | ((F.size(parts) > 1) & F.forall(parts, lambda x: F.col("block_text").contains(x)))
    d = d.withColumn("_held", F.coalesce(plain, F.lit(False)))
    near = ~F.col("_held") & F.col("block_text").isNotNull() & (F.length("excerpt") >= 8)
    unsure = d.filter(near).withColumn("_held", text.partial_ratio("excerpt", "block_text") >= fuzzy)
    d = d.filter(F.coalesce(~near, F.lit(True))).unionByName(unsure)
    verdict = (
        F.when(F.col("_in_case").isNull(), "NOT_IN_CASE")
        .when(F.col("block_text").isNull(), "EVIDENCE_MISSING")
        .when(~F.col("_held"), "EVIDENCE_UNVERIFIED")
        .when(~F.col("block_text").contains(F.col("raw_value")), "VALUE_NOT_IN_EVIDENCE")
        .when(F.col("period_start") > F.col("period_end"), "PERIOD_ORDER")
        .otherwise("verified")
    )
    return d.withColumn("verdict", verdict).drop("block_text", "_in_case", "_held")


def table_candidates(cells: DataFrame) -> DataFrame:
    """Value cells with their column header and row label: (table_id, row, col, col_span, is_header, raw_text).

    Header cells cover `col_span` columns; the join is an equi-join on (table_id, col) and (table_id, row).
    """
    heads = cells.filter("is_header").select("table_id", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("col"), F.col("raw_text").alias("header"))
    names = cells.filter("NOT is_header AND col = 0").select("table_id", "row", F.col("raw_text").alias("row_label"))
    return cells.filter("NOT is_header AND col > 0").join(heads, ["table_id", "col"], "left").join(names, ["table_id", "row"], "left").select("table_id", "row", "col", "row_label", "header", "raw_text")
