"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

The mix is a sequence of slots. Slot i is a point of a golden-ratio sequence, mapped through the cumulative weights of the
sources, so that every stretch of the mix holds the sources in near their shares. The r-th slot of a source takes the r-th
block of that source: its documents in a seeded shuffle, laid end to end and cut into blocks of equal token counts (a source
that is used more than once starts over). A source's last slot is cut so that its taken tokens are its rounded target.

Null texts have size 0 and are never taken; a null source is a source of its own, sorted last; repeated rows are separate
documents, laid one after another in the shuffle as one summed row; rows without an id are told apart by their texts; empty
tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import WORD_PATTERN, boxed, settled

WEIGHTS, SHARE, MOST_REUSE, BLOCK_TOKENS = (5, 2, 1), 1.5, 2, 256
#: Sources up to which the per-source table is broadcast (about 100 bytes a row); beyond, the join shuffles.
BROADCAST_SOURCES = 100_000
#: Points i * _STEP mod _POINTS, a golden-ratio sequence in integers; least number of interval cells by which points find their source; slots ranked together.
_POINTS, _STEP, _CELLS, _CHUNK = 2147483647, 1327217884, 4096, 65536


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the shuffle key of each document; the last table that is made from texts."""
    return documents.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))))).alias("h"),
    )


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, reuse: int = MOST_REUSE) -> DataFrame:
    """Per source: source_size and target tokens.

    Targets are proportional to weight and stop at `reuse` times the source's size, the excess going to the others by weight:
    in the order of size/weight, a source is capped while its cap is at most its share of what is left.
    The windows run over one row per source.
    """
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cap = F.col("source_size") * F.lit(float(reuse))
    total = F.sum(F.col("source_size").cast("double")).over(whole) * share
    at = per.withColumn("weight", w.cast("double")).withColumn("ratio", cap / F.col("weight"))
    at = at.withColumn("level", (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    at = at.withColumn("capped", F.col("ratio") <= F.col("level")).withColumn("total", total)
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    spent = F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(whole), F.lit(0.0))
    target = F.when(F.col("capped"), cap).otherwise((F.col("total") - spent) / free * F.col("weight"))
    return at.select("source", "source_size", target.alias("target"))


def with_quotas(targets: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """Adds each source's blocks per pass, whole passes, tokens of the last pass, slots, and its interval of [0, 1)."""
    take = F.round("target").cast("long")
    t = targets.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    t = t.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(take / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", take - F.col("passes") * F.col("source_size"))
    t = t.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("all_slots", F.sum("slots").over(Window.partitionBy())).withColumn("upto", F.sum("slots").over(upto))
    return t.withColumn("lo", (F.col("upto") - F.col("slots")) / F.col("all_slots")).withColumn("hi", F.col("upto") / F.col("all_slots"))


def schedule(quotas: DataFrame, size: int = BLOCK_TOKENS) -> DataFrame:
    """position, source, rank, epoch, block, tokens: the slots of the mix.

    `quotas` is a settled table with one row per source. Points are ranked per source inside chunks of consecutive slots and
    offset by the counts of earlier chunks, so a dominant source is ranked by many tasks. The few slots that a source is short
    of after all points (the sequence's discrepancy) follow at the end; points beyond its quota fall away.
    """
    spark = quotas.sparkSession
    n, sources = (x or 0 for x in quotas.agg(F.max("all_slots"), F.count("*")).first())
    # As many cells as sources at least, so that a cell holds about two of them.
    n_cells = max(_CELLS, sources)
    slots = spark.range(n).select(F.col("id").alias("position"), (F.pmod(F.pmod(F.col("id"), F.lit(_POINTS)) * _STEP, F.lit(_POINTS)) / F.lit(float(_POINTS))).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * n_cells))
    held = quotas.filter("slots > 0").select("source", "source_size", "blocks", "passes", "rest", "slots", "lo", "hi")
    cells = held.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * n_cells), F.floor(F.col("hi") * n_cells))).alias("cell"))
    placed = slots.join(cells, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("position", "source", F.floor(F.col("position") / _CHUNK).alias("chunk"))
    counts = placed.groupBy("source", "chunk").count()
    earlier = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), "count").withColumn("offset", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    inside = placed.withColumn("nth", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("position")))
    ranked = inside.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).select("position", "source", (F.col("offset") + F.col("nth") - 1).alias("rank"))
    got = counts.groupBy(F.col("source").alias("s")).agg(F.sum("count").alias("got"))
    late = held.select("source", "slots").join(got, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    late = late.select(F.lit(n).cast("long").alias("position"), "source", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    every = ranked.unionByName(late)
    out = every.join(held.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).filter("rank < slots")
    block = F.pmod("rank", "blocks")
    length = F.least(F.lit(size), F.col("source_size") - block * size)
    epoch = F.floor(F.col("rank") / F.col("blocks"))
    last = F.least(length, F.col("rest") - block * size)
    return out.select("position", "source", "rank", epoch.alias("epoch"), block.alias("block"), F.when(epoch < F.col("passes"), length).otherwise(last).alias("tokens"))


def laid_out(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h, start (token offset of the document in its source's shuffle) and copy, a number for each of equal rows.

    The shuffle order is the hashed id; its first three digits cut a source into up to 4096 stretches that are summed apart.
    Equal rows are one row with a count until their offsets are known, so a row that is repeated without end is no long stretch.
    """
    docs = docs.groupBy("source", "h", "doc_id", "size").agg(F.count("*").alias("copies")).withColumn("stretch", F.substring("h", 1, 3)).withColumn("all", F.col("size") * F.col("copies"))
    sums = docs.groupBy("source", "stretch").agg(F.sum("all").alias("sum"))
    ahead = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("offset"))
    order = Window.partitionBy("source", "stretch").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = docs.withColumn("within", F.sum("all").over(order) - F.col("all")).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t")))
    each = inside.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select("doc_id", "source", "size", "h", (F.col("offset") + F.col("within") + F.col("copy") * F.col("size")).alias("start"), "copy")


def mix(documents: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of `documents`."""
    docs = settled(sized(documents), "mix-sizes")
    quotas = settled(with_quotas(source_targets(docs), block).coalesce(1), "mix-quotas")
    small = quotas.count() <= BROADCAST_SOURCES
    per = quotas.select(F.col("source").alias("s"), "source_size", "target")
    placed = laid_out(docs).join(F.broadcast(per) if small else per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    spans = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    slots = schedule(quotas, block).groupBy("source", "block").agg(F.collect_list("tokens").alias("cuts")).select(F.col("source").alias("s"), F.col("block").alias("b"), "cuts")
    joined = spans.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    a = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    z = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    piece = F.aggregate(F.coalesce("cuts", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda acc, cut: acc + F.greatest(F.least(z, cut) - a, F.lit(0)))
    return joined.groupBy("doc_id", "source", "size", "source_size", "target", "h", "start", "copy").agg(F.coalesce(F.sum(piece), F.lit(0)).alias("taken")).drop("h", "start", "copy")


def mixed_rows(documents: DataFrame) -> DataFrame:
    """The rows of `documents`, each repeated as often as the mix takes its text, rounded; texts without words stay once."""
    ratio = mix(documents).groupBy("doc_id").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("ratio"))
    times = ratio.select(F.col("doc_id").alias("id"), F.coalesce(F.round("ratio"), F.lit(1.0)).cast("int").alias("times"))
    found = boxed(documents, mixed=F.col("doc_id")).join(times, F.col("mixed").eqNullSafe(F.col("id"))).filter("times > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


#: The contract of the query over DuckDB; the shuffle and the targets as above, tokens taken by arithmetic instead of slots.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5,2,1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM per),
r AS (SELECT *, source_size * 2.0::DOUBLE / weight AS ratio, 1.5 * (SELECT sum(source_size) FROM per)::DOUBLE AS total FROM w),
l AS (SELECT *, (total - coalesce(sum(source_size * 2.0::DOUBLE) OVER b, 0)) / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER b, 0)) AS level FROM r
  WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT (any_value(total) - coalesce(sum(source_size * 2.0::DOUBLE) FILTER (ratio <= level), 0)) / sum(weight) FILTER (ratio > level) AS one FROM l),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN source_size * 2.0::DOUBLE ELSE one * weight END AS target FROM l, f),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  (greatest(0, least(size, round(target)::BIGINT - start)) + greatest(0, least(size, round(target)::BIGINT - source_size - start)))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source"""
