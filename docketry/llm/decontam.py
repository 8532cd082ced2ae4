"""Benchmark decontamination: size-partitioned MinHash containment search; DataFrame functions only.

Test items are short and documents long, so the measure is containment: the share of an item's word shingles that a document
has. Items are partitioned by the size of their shingle sets; each partition fixes how many minimum hashes (a bottom-k MinHash
sketch under one shared hash) an item shows: so many that any document with the asked containment must share one. Documents
are matched on these minima alone, which yields candidate pairs; each candidate is then verified by exact containment over
the document's whole shingle set. Pairs are rows of numbers throughout: no array of items hangs on a document.

Words are runs of non-white-space, lower-cased; shingles are five words, or all words of a shorter item or text. Documents are
also cut into shingles of the lengths below five that items have, so an item of any length is found inside a text. Null or empty
texts have no shingles and match nothing. Null ids never match. Rows of one id are one item or document with the shingles of
all its texts; there is one result row per id and item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import settled

WORDS, CONTAINMENT = 5, 0.8
#: Rows up to which a table of (hash, id) pairs or ids is broadcast, some 50 MB; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_SPACE = " \t\n\x0b\f\r"


def with_shingles(df: DataFrame, *keep: str, words: int = WORDS, shorter: tuple[int, ...] = ()) -> DataFrame:
    """The kept columns and `shingles`, 64-bit hashes of the word shingles of `text` with repeats, of the rows with any word.

    Tokens are a column of their own, read by position, and no filter on the result may follow: an expression that is inlined
    into the lambda is evaluated for each element. A shorter text has one shingle of all its words, as hashing passes over the
    missing ones. `shorter` adds the shingles of these lengths.
    """
    bare = F.btrim(F.lower("text"), F.lit(_SPACE))
    tokens = df.filter(bare != "").select(*keep, F.split(bare, r"[\x20\x09-\x0D]+").alias("tokens"))
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("tokens") - n, F.lit(0))), lambda i: F.xxhash64(*(F.get("tokens", i + k) for k in range(n))))
    each = F.concat(cut(words), *map(cut, shorter)) if shorter else cut(words)
    return tokens.select(*keep, each.alias("shingles"))


def short_lengths(benchmark: DataFrame, words: int = WORDS) -> tuple[int, ...]:
    """The numbers of words below `words` that texts of items have; at most `words` - 1 values."""
    bare = F.btrim(F.lower("text"), F.lit(_SPACE))
    n = benchmark.filter(bare != "").select(F.size(F.split(bare, r"[\x20\x09-\x0D]+")).alias("n")).filter(F.col("n") < words)
    return tuple(sorted(r.n for r in n.distinct().collect()))


def distinct_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, h): the distinct shingles of each item; texts of one id are one item."""
    return with_shingles(benchmark.filter(F.col("item_id").isNotNull()), "item_id").select("item_id", F.explode("shingles").alias("h")).distinct()


def item_sketches(shingles: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """item_id, n, sketch from distinct (item_id, h): partitions are powers of two of n, and a partition's largest n sets the sketch length."""
    sets = shingles.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hashes")).withColumn("n", F.size("hashes").cast("long"))
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    return sets.select("item_id", "n", F.slice("hashes", F.lit(1), (F.floor(top * (1 - containment) + 1e-9) + 1).cast("int")).alias("sketch"))


def _bounded(df: DataFrame) -> DataFrame:
    """A table of numbers, broadcast where a count shows it is small, else left to a shuffle join, whose hot keys adaptive execution splits."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def leaks(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment for each pair at or above the asked containment."""
    shingles = settled(distinct_shingles(benchmark), "leak-shingles")
    items = settled(item_sketches(shingles, containment), "leak-items")
    texts = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    minima = items.select("item_id", F.explode("sketch").alias("h"))
    shorter = short_lengths(benchmark)
    shown = with_shingles(texts, "doc_id", shorter=shorter).select("doc_id", F.explode_outer("shingles").alias("h"))
    candidates = settled(shown.join(_bounded(minima), "h").select("doc_id", "item_id").distinct(), "leak-candidates")
    # Of a candidate document only the shingles of candidate items stay, each once for its item.
    again = with_shingles(texts.join(_bounded(candidates.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id", shorter=shorter).select("doc_id", F.explode(F.array_distinct("shingles")).alias("h"))
    met = again.join(_bounded(shingles), "h").join(_bounded(candidates), ["doc_id", "item_id"], "left_semi")
    found = met.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_found"))
    pairs = found.join(_bounded(items.select("item_id", F.col("n").alias("n_shingles"))), "item_id").withColumn("containment", F.col("n_found") / F.col("n_shingles"))
    return pairs.filter(F.col("containment") >= containment).select("doc_id", "item_id", "n_shingles", "n_found", "containment")


def without_leaks(documents: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of `documents` that contain no benchmark item; rows without an id stay."""
    bad = leaks(documents, benchmark, containment).select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti").select(*documents.columns)


#: Brute force over DuckDB: every shingle of every document against every item.
ORACLE = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') FROM benchmark WHERE item_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
  UNION SELECT kind, id, array_to_string(w[i:i+n-1], ' ') FROM (
    SELECT kind, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT len(w) AS n FROM words WHERE kind = 'b' AND len(w) BETWEEN 1 AND 4) WHERE kind = 'd' AND len(w) >= n)),
items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'b')
SELECT d.id AS doc_id, item_id, any_value(n) AS n_shingles, count(*) AS n_found, count(*) / any_value(n) AS containment
FROM shingles d JOIN items USING (s) WHERE d.kind = 'd' GROUP BY d.id, item_id HAVING count(*) / any_value(n) >= 0.8"""
