"""Filter interaction audit: what a set of filters removes in each order, from one CUBE over their failure flags.

Documents are reduced to counts per part and combination of flags. A CUBE over part and flags then has, for each subset of
filters, the row in which all its flags are false: the documents that survive the subset. A step of an order joins the
survivors of the filters before it with those of the filters up to it, and all its counts are differences of survivors. No
order looks at a document again, and what the orders need has 2^filters rows a part.

Texts move as digests only. A text that is identical to one of a smaller id is found from one row per distinct text and
part, so a hot text is summed before it moves. A null text is an empty one; a null lang is the part ''. A row without an id
has no smaller id, is no one's smaller id and has no labels. Rows that repeat an id are counted each; one is labelled if any
label row of its id says so. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import settled

#: What is counted of survivors.
_MEASURES = ("n", "good", "toxic")


def default_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions by letter: too short, repetitive, shouted, of code or markup. `E`, copies, comes from `with_copies`."""
    size, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": size < 200,
        "B": F.lit(100) * distinct < F.lit(50) * size,
        "C": F.lit(100) * capitals > F.lit(3) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(documents: DataFrame) -> DataFrame:
    """doc_id, part, text digest and the flags A to D of each document; the last table that is made from texts."""
    text = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = text.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    flags = default_filters(F.col("text"), F.col("words"))
    return words.select("doc_id", "part", F.sha2("text", 256).alias("digest"), *(c.alias(n) for n, c in flags.items()))


def with_labels(flags: DataFrame, labels: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Per doc_id, part, digest and flags: n rows, and how many of them are labelled good and toxic."""
    rows = flags.groupBy("doc_id", "part", "digest", *names).agg(F.count("*").alias("n"))
    # Rows without an id get a key of their own each, so that they don't meet in one task.
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), "digest")))
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("string").alias("key"))
    said = said.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    of = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), F.col("n")).otherwise(F.lit(0)).cast("long")
    return rows.join(said, "key", "left").select("doc_id", "part", "digest", *names, "n", of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def with_copies(rows: DataFrame, names: tuple[str, ...], copies: str) -> DataFrame:
    """Counts per part and flags with the flag `copies`: the document has the text of a smaller id.

    `rows` has one row per doc_id, part, text and flags. They are summed per text, part and flags, the ones of the smallest id
    there beside them; the smallest id of all parts of a text then tells whether these are originals.
    """
    packed = rows.withColumn("first", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", *_MEASURES)))
    groups = packed.groupBy("digest", "part", *names).agg(
        F.min("first").alias("first"), *(F.sum(m).alias(m) for m in _MEASURES), *(F.sum(F.when(F.col("doc_id").isNull(), F.col(m)).otherwise(0)).alias(f"bare_{m}") for m in _MEASURES)
    )
    groups = settled(groups, "audit-texts")
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    joined = groups.join(least, "digest")
    original = F.coalesce(F.col("first.doc_id") == F.col("least"), F.lit(False))
    kept = {m: F.col(f"bare_{m}") + F.when(original, F.col(f"first.{m}")).otherwise(F.lit(0)) for m in _MEASURES}
    split = joined.select("part", *names, F.explode(F.array(
        F.struct(F.lit(False).alias(copies), *(v.alias(m) for m, v in kept.items())),
        F.struct(F.lit(True).alias(copies), *((F.col(m) - v).alias(m) for m, v in kept.items())),
    )).alias("half")).select("part", *names, "half.*")
    return split.filter(F.col("n") > 0).groupBy("part", *names, copies).agg(*(F.sum(m).alias(m) for m in _MEASURES))


def survivors(cells: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """part, subset and the measures of the documents that pass all filters of the subset, from the CUBE's rows whose selected flags are all false."""
    cube = cells.cube("part", *names).agg(*(F.sum(m).alias(m) for m in _MEASURES), F.grouping("part").alias("no_part"), *(F.grouping(n).alias(f"out_{n}") for n in names))
    passing = F.col("no_part") == 0
    for n in names:
        passing &= (F.col(f"out_{n}") == 1) | ~F.col(n)
    subset = F.concat_ws("", *(F.when(F.col(f"out_{n}") == 0, F.lit(n)) for n in names))
    return cube.filter(passing).select("part", subset.alias("subset"), *_MEASURES)


def steps(names: tuple[str, ...]) -> Column:
    """An array of all steps of all orders: filter_order, step, filter, and the subsets that stand before and after it."""
    key = lambda taken: "".join(n for n in names if n in taken)
    rows = [("".join(p), i + 1, p[i], key(p[:i]), key(p[: i + 1])) for p in permutations(names) for i in range(len(names))]
    fields = ("filter_order", "step", "filter", "before", "after")
    return F.array(*(F.struct(*(F.lit(v).alias(f) for f, v in zip(fields, row, strict=True))) for row in rows))


def interactions(cells: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The audit of every order and step per part, from counts per part and flags."""
    alive = settled(survivors(cells, names), "audit-survivors")
    every = "".join(names)
    grid = alive.filter(F.col("subset") == "").select("part", F.col("n").alias("all_n"), F.explode(steps(names)).alias("s")).select("part", "all_n", "s.*")
    others = F.replace(F.lit(every), F.col("filter"), F.lit(""))
    grid = grid.withColumn("others", others).withColumn("alone", F.col("filter")).withColumn("whole", F.lit(every))
    for place in ("before", "after", "others", "alone", "whole"):
        side = alive.select("part", F.col("subset").alias(place), *(F.col(m).alias(f"{place}_{m}") for m in _MEASURES))
        grid = grid.join(side, ["part", place], "left").fillna(0, [f"{place}_{m}" for m in _MEASURES])
    lost = lambda m: F.col(f"before_{m}") - F.col(f"after_{m}")
    out = grid.select(
        "part", "filter_order", "step", "filter", F.col("after_n").alias("kept"), lost("n").alias("removed"), (F.col("all_n") - F.col("alone_n") - lost("n")).alias("redundant"),
        (F.col("others_n") - F.col("whole_n")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for the five filters."""
    plain = ("A", "B", "C", "D")
    cells = with_copies(with_labels(flagged(documents), labels, plain), plain, "E")
    return interactions(settled(cells, "audit-cells"), (*plain, "E"))


#: Every order over every combination of flags, in DuckDB: a document falls at the first step whose filter it fails.
ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
flags AS (
  SELECT doc_id, part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(least < doc_id, false)} AS f FROM words),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cells AS (SELECT part, f.A AS a, f.B AS b, f.C AS c, f.D AS d, f.E AS e, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM flags LEFT JOIN said USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
failed AS (SELECT *, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails FROM cells),
placed AS (SELECT *, coalesce(list_min(list_transform(fails, lambda x: instr(o, x))), 6) AS falls FROM failed, orders),
steps AS (
  SELECT part, o AS filter_order, step, o[step] AS letter, sum(n) FILTER (falls > step) AS kept, sum(n) FILTER (falls = step) AS removed, sum(n) FILTER (list_contains(fails, o[step]) AND falls < step) AS redundant,
    sum(n) FILTER (fails = [o[step]]) AS unique_fails, sum(good) FILTER (falls = step) AS good_lost, sum(toxic) FILTER (falls = step) AS toxic_lost
  FROM placed, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, o, step)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps"""
