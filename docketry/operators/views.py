"""What a reader of results asks of them: filters, merged pages, boxes, totals for charts (P1-P6, P8), and values a JSON text can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def of_type(blocks: DataFrame, *types: str) -> DataFrame:
    return blocks.filter(F.col("type").isin(*types))


def distinct_values(events: DataFrame, column: str) -> DataFrame:
    """The values of a column that occur, sorted; null is none."""
    return events.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def merged_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of several documents as one list, by document, page and reading order."""
    return blocks.orderBy("source_id", "page", "ro")


def of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Comparisons, rejections or findings of the asked pairs of documents, given in any order."""
    low, high = F.least("a_source_id", "b_source_id"), F.greatest("a_source_id", "b_source_id")
    asked = pairs.select(low.alias("_low"), high.alias("_high")).distinct()
    return rows.withColumn("_low", low).withColumn("_high", high).join(asked, ["_low", "_high"], "left_semi").drop("_low", "_high")


def stacked_totals(series: DataFrame) -> DataFrame:
    """Per category of a stacked bar chart: the total of its series, and how many there are."""
    return series.groupBy("category").agg(F.sum("value").alias("total"), F.countDistinct("series").alias("series"))


def evidence_boxes(evidence: DataFrame) -> DataFrame:
    """Per page: the boxes of evidence that may be shown, in order; restricted evidence and rows without a box are left out."""
    shown = evidence.filter(~F.coalesce("restricted", F.lit(False)) & F.col("bbox").isNotNull())
    return shown.groupBy("source_id", "page").agg(F.array_sort(F.collect_list("bbox")).alias("boxes"))


def of_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources.select("source_id").distinct(), "source_id", "left_semi")


def json_safe(rows: DataFrame) -> DataFrame:
    """Decimals, dates and times as text and bytes as their number, '<n bytes>'; other columns as they are."""

    def safe(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>"))
        elif isinstance(f.dataType, (T.DecimalType, T.DateType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return c.alias(f.name)

    return rows.select(*map(safe, rows.schema.fields))
