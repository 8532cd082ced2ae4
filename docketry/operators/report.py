"""Report aggregates over parsed blocks, warnings, tables, series and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as tx
from docketry.functions.words import bound
from docketry.session import unbroadcast

#: The highest score that a document with a warning can have.
CAPS = {"UNUSABLE_TEXT_LAYER": 0.5, "OCR_FAILED": 0.7, "CONFIDENCE_NOT_CROSS_CHECKED": 0.85, "OCR_UNAVAILABLE": 0.85, "PAGES_UNREAD": 0.5}


def source_summary(blocks: DataFrame, review_below: float = 0.8) -> DataFrame:
    count = lambda c, v: F.count_if(F.col(c) == v)
    return blocks.groupBy("source_id").agg(
        F.count("*").alias("blocks"), *(count("type", t).alias(f"n_{t}") for t in ("text", "table", "chart")), count("method", "ocr").alias("n_ocr"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.avg("agreement"), 6).alias("mean_agreement"), F.count_if(F.col("confidence") < review_below).alias("needs_review"), F.count_if(F.col("agreement").isNull()).alias("unverified"),
    )


def parse_scores(blocks: DataFrame, warnings: DataFrame, places: int = 4) -> DataFrame:
    """Mean block confidence, capped by the lowest cap among the document's warnings."""
    cap = F.create_map(*(F.lit(x) for kv in CAPS.items() for x in kv))[F.col("code")]
    caps = warnings.groupBy("source_id").agg(F.min(cap).alias("cap"))
    means = blocks.groupBy("source_id").agg(F.avg("confidence").alias("mean"), F.count("*").alias("blocks"))
    return means.join(caps, "source_id", "left").select("source_id", F.round(F.least("mean", "cap"), places).alias("score"), "blocks")


def union_parse(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("documents"), F.sum("blocks").alias("blocks"), F.round(F.sum(F.col("score") * F.col("blocks")) / F.sum("blocks"), 4).alias("score"))


def warning_counts(warnings: DataFrame) -> DataFrame:
    """Per code, most frequent first: count, documents and the first message."""
    return warnings.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("documents"), F.min_by("message", "source_id").alias("first_message")).orderBy(F.desc("n"), "code")


def platform_metrics(blocks: DataFrame, review_below: float = 0.8) -> DataFrame:
    one = blocks.agg(F.count("*").cast("double").alias("blocks"), F.countDistinct("source_id").cast("double").alias("sources"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.count_if(F.col("confidence") < review_below).cast("double").alias("needs_review"))
    one = one.withColumn("blocks_per_source", F.round(F.col("blocks") / F.col("sources"), 6))
    return one.unpivot([], one.columns, "metric", "value")


def batch_status(items: DataFrame) -> DataFrame:
    """Status and whole percent of each batch from its items' states."""
    n = lambda s: F.count_if(F.col("state") == s)
    d = items.groupBy("batch_id").agg(F.count("*").alias("total"), n("completed").alias("done"), n("failed").alias("failed"), n("running").alias("running"))
    status = F.when(F.col("running") > 0, "running").when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "partial").otherwise("completed")
    return d.select("batch_id", "total", "done", "failed", F.floor(100.0 * (F.col("total") - F.col("running")) / F.col("total")).alias("progress_percent"), status.alias("status"))


def topic_similarity(texts: DataFrame, least: float = 0.0) -> DataFrame:
    """Jaccard of content words for all pairs that share one and reach `least`: a join on the word, so unrelated pairs are never made.

    With `least` above 0 pairs come from each text's rarest words alone: two of n and m words that reach it share at least
    `least` x n of the first one's, so one of them is among its n - ceil(`least` x n) + 1 rarest. Common words then make no pairs.
    """
    words = texts.select("id", tx.content_words(F.col("text")).alias("w")).select("id", F.size("w").alias("n"), F.explode("w").alias("word"))
    if least > 0:
        return _close_topics(words, least)
    a, b = words.select(F.col("id").alias("a_id"), F.col("n").alias("a_n"), "word"), words.select(F.col("id").alias("b_id"), F.col("n").alias("b_n"), "word")
    both = a.join(b, "word").filter("a_id < b_id").groupBy("a_id", "b_id", "a_n", "b_n").agg(F.count("*").alias("k"))
    return both.select("a_id", "b_id", F.round(F.col("k") / (F.col("a_n") + F.col("b_n") - F.col("k")), 6).alias("jaccard"))


def _close_topics(words: DataFrame, least: float) -> DataFrame:
    """The pairs of `topic_similarity` at or above a threshold: candidates by their rarest words, then whole word sets."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("texts", "word"))
    ranked = words.join(words.groupBy("word").agg(F.count("*").alias("texts")), "word").withColumn("place", place)
    front = ranked.filter(F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).select("id", "n", "word")
    a, b = (front.select(F.col("id").alias(f"{s}_id"), F.col("n").alias(f"{s}_n"), "word") for s in "ab")
    sized = (F.col("a_n") >= least * F.col("b_n") - 1e-9) & (F.col("b_n") >= least * F.col("a_n") - 1e-9)
    pairs = a.join(b, "word").filter("a_id < b_id").filter(sized).select("a_id", "b_id").distinct()
    sets = words.groupBy("id").agg(F.collect_list("word").alias("w"))
    whole = pairs.join(sets.select(F.col("id").alias("a_id"), F.col("w").alias("a_w")), "a_id").join(sets.select(F.col("id").alias("b_id"), F.col("w").alias("b_w")), "b_id")
    both = F.size(F.array_intersect("a_w", "b_w"))
    return whole.select("a_id", "b_id", F.round(both / (F.size("a_w") + F.size("b_w") - both), 6).alias("jaccard")).filter(F.col("jaccard") >= least)


def guess_type(texts: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """The label with the largest share of its phrases in the text; the first listed wins ties; null without any."""
    low = F.lower("text")
    shares = [F.struct((reduce(lambda x, y: x + y, (low.contains(p).cast("int") for p in phrases)) / len(phrases)).alias("share"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (label, phrases) in enumerate(rules.items())]
    top = texts.select("id", F.array_max(F.array(*shares)).alias("t"))
    return top.select("id", F.when(F.col("t.share") > 0, F.col("t.label")).alias("guess"), F.col("t.share").alias("share"))


def axis_fit(points: DataFrame) -> DataFrame:
    """Least squares per source with at least two values on each axis."""
    d = points.groupBy("source_id").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"))
    return d.filter("nx >= 2 AND ny >= 2").drop("nx", "ny")


def describe_series(points: DataFrame) -> DataFrame:
    """Per chart: the categories of the largest and the smallest value (the first category wins ties) and the change from first to last, of the first value's size; null values are no points, and nothing changes by a share of zero."""
    points = points.filter("value IS NOT NULL")
    first, last = F.min_by("value", "category"), F.max_by("value", "category")
    top, low = F.min(F.struct((-F.col("value")).alias("v"), "category")), F.min(F.struct("value", "category"))
    return points.groupBy("chart_id").agg(top["category"].alias("top"), low["category"].alias("low"), F.round(F.try_divide(last - first, F.abs(first)) * 100, 4).alias("change_percent"))


def weighted_mean(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    return df.groupBy(key).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 4).alias("weighted"))


def table_arithmetic(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per table: line items whose quantity x rate is the amount, and the total row against the sum of items (or of subtotals)."""
    item, total, sub = (F.col("kind") == k for k in ("item", "total", "subtotal"))
    parts = F.when(F.count_if(sub) > 0, F.sum(F.when(sub, F.col("amount")))).otherwise(F.sum(F.when(item, F.col("amount"))))
    stated = F.max(F.when(total, F.col("amount")))
    return rows.groupBy("table_id").agg(
        F.count_if(item).alias("line_items"), F.round(stated, 2).alias("total"), (F.abs(stated - parts) <= tolerance + 1e-6 * F.abs(parts)).alias("total_ok"), F.coalesce(F.min(F.when(item, F.abs(F.col("qty") * F.col("rate") - F.col("amount")) <= tolerance + 1e-9 * F.abs(F.col("amount")))), F.lit(True)).alias("items_ok")
    )


def subtotal_segments(rows: DataFrame) -> DataFrame:
    """Each subtotal row against the sum of the items since the subtotal before it."""
    w = Window.partitionBy("table_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    seg = rows.withColumn("segment", F.coalesce(F.sum((F.col("kind") == "subtotal").cast("int")).over(w), F.lit(0)))
    return seg.groupBy("table_id", "segment").agg(F.max(F.when(F.col("kind") == "subtotal", F.col("amount"))).alias("stated"), F.sum(F.when(F.col("kind") == "item", F.col("amount"))).alias("parts"))


#: Fixed value: what counts as a word of a question or passage.
PASSAGE_WORD = r"[a-z0-9][a-z0-9.%$-]*"


def passage_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({PASSAGE_WORD})"), F.lit(1))


def retrieve(passages: DataFrame, question: DataFrame, k: int) -> DataFrame:
    """Top k passages (id, source_id, text, boost) by hits / sqrt(words) x boost, then id; equal texts of a source count once; only scores above 0.

    `question` is one row with the query's words; they go into the plan as a set. A passage's words are read once, for hits and length.
    """
    asked = sorted({w for r in question.limit(1).collect() for w in r.q or ()})
    if not asked:
        return passages.select("id", F.lit(0.0).alias("score")).limit(0)
    counts = bound(passage_words(F.col("text")), lambda t: F.struct(F.size(F.filter(t, lambda x: x.isin(*asked))).alias("hits"), F.size(t).alias("words")))
    d = passages.withColumn("c", counts).filter("c.hits > 0")
    scored = d.withColumn("score", F.col("c.hits") / F.sqrt(F.greatest(F.col("c.words"), F.lit(1))) * F.col("boost"))
    best = scored.groupBy("source_id", F.sha2("text", 256).alias("same")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("id"))).alias("b"))
    return best.select(F.col("b.id").alias("id"), (-F.col("b.s")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _trigrams(texts: DataFrame) -> DataFrame:
    return texts.filter(F.length("text") >= 3).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substr("text", i, F.lit(3)))).alias("g")).groupBy("id", "g").agg(F.count("*").alias("n"))


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(id, g, n, l): counts of a text's character trigrams beside their norm; texts under three characters have no row."""
    counted = _trigrams(texts)
    return counted.join(unbroadcast(counted.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l"))), "id")


def _products(pairs: DataFrame, a_counts: DataFrame, b_counts: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Given distinct pairs of ids with the cosine of their counts, from 0 up: one row a pair and trigram of its first text meets the second's counts, so a pair costs the length of a text."""
    a = a_counts.select(F.col("id").alias(a_id), "g", F.col("n").alias("_n"), F.col("l").alias("_l"))
    b = b_counts.select(F.col("id").alias(b_id), "g", F.col("n").alias("_m"), F.col("l").alias("_k"))
    met = unbroadcast(pairs.select(a_id, b_id)).join(a, a_id).join(unbroadcast(b), [b_id, "g"])
    dot = met.groupBy(a_id, b_id).agg(F.sum(F.col("_n") * F.col("_m")).alias("_dot"), F.first("_l").alias("_l"), F.first("_k").alias("_k"))
    return dot.select(a_id, b_id, F.round(F.col("_dot") / F.col("_l") / F.col("_k"), 6).alias("cosine"))


def with_cosine(pairs: DataFrame, a_counts: DataFrame, b_counts: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Given distinct pairs with the cosine of their trigrams; null where the texts share none or have none."""
    return pairs.join(unbroadcast(_products(pairs, a_counts, b_counts, a_id, b_id)), [a_id, b_id], "left")


def trigram_cosine(texts: DataFrame, least: float = 0.0) -> DataFrame:
    """Cosine of character-trigram counts for pairs that share a trigram and reach `least`, as a sparse product by a join on the trigram.

    Trigrams of a text are put in one order, rarest first. The part after a place has a norm; where that is below `least` of the
    whole, two texts whose first common trigram lies there can't reach it. So pairs are made from the parts before that place
    only, which leaves out the commonest trigrams, and each is then computed in full.
    """
    grams = trigram_counts(texts)
    square = F.col("n") * F.col("n")
    spread = grams.join(grams.groupBy("g").agg(F.count("*").alias("texts")), "g")
    rest = F.sum(square).over(Window.partitionBy("id").orderBy(F.desc("texts"), F.desc("g")).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(square).over(Window.partitionBy("id"))
    # The norm of this trigram and all commoner ones: below the bound, it can't be the first common one.
    front = spread.withColumn("keep", F.sqrt(rest / whole) >= least - 1e-9).filter("keep").select("id", "g")
    pairs = front.withColumnRenamed("id", "a_id").join(front.withColumnRenamed("id", "b_id"), "g").filter("a_id < b_id").select("a_id", "b_id").distinct()
    return _products(pairs, grams, grams, "a_id", "b_id").filter(F.col("cosine") >= least)


def first_of_equal(rows: DataFrame, content: str, key: str) -> DataFrame:
    """The row with the smallest key of each content, told apart by SHA-256; rows of one content meet in one aggregate, so copies cost no window."""
    ids = rows.groupBy(F.sha2(content, 256).alias("_content")).agg(F.min(key).alias("_first"))
    return rows.withColumn("_same", F.sha2(content, 256)).join(ids, F.col("_same").eqNullSafe(F.col("_content")) & (F.col(key) == F.col("_first"))).select(*rows.columns)


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k").orderBy("conv_id", "turn")


def table_confidence(cells: DataFrame) -> DataFrame:
    """Per table: the mean confidence of its cells that hold text; null without any."""
    return cells.groupBy("table_id").agg(F.avg(F.when(F.trim("raw_text") != "", F.col("confidence"))).alias("confidence"))


def batch_summary(batches: DataFrame, documents: DataFrame, blocks: DataFrame, review_below: float = 0.8, places: int = 4) -> DataFrame:
    """One row per batch (batch_id, name): documents by state, pages, blocks, mean confidence, blocks to review."""
    per = blocks.groupBy("source_id").agg(F.count("*").alias("blocks"), F.sum("confidence").alias("total"), F.count_if(F.col("confidence") < review_below).alias("review"), F.countDistinct("page").alias("pages"))
    rows = documents.select("batch_id", "source_id", "state").join(per, "source_id", "left").groupBy("batch_id").agg(
        F.count("*").alias("documents"), F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "failed").alias("failed"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"),
        F.round(F.sum("total") / F.sum("blocks"), places).alias("mean_confidence"), F.coalesce(F.sum("review"), F.lit(0)).alias("needs_review"),
    )
    zero = {c: 0 for c in ("documents", "completed", "failed", "pages", "blocks", "needs_review")}
    return batches.select("batch_id", "name").join(rows, "batch_id", "left").fillna(zero)


def search_batches(batches: DataFrame, documents: DataFrame, query: str) -> DataFrame:
    """Batches whose id or any filename holds the query, whatever its case."""
    named = documents.filter(F.contains(F.lower("filename"), F.lit(query.lower()))).select("batch_id").distinct().withColumn("hit", F.lit(True))
    return batches.join(named, "batch_id", "left").filter(F.coalesce("hit", F.lit(False)) | F.contains(F.lower(F.col("batch_id").cast("string")), F.lit(query.lower()))).drop("hit")


def warnings_by_document(warnings: DataFrame, most: int | None = 200) -> DataFrame:
    """(code, source_id, n) of a union of documents, in order; `most` is the list's own length: the rest is one row (TRUNCATED, null, how many)."""
    rows = warnings.groupBy("code", "source_id").agg(F.count("*").alias("n"))
    if most is None:
        return rows.orderBy("code", "source_id")
    shown = rows.orderBy("code", "source_id").limit(most)
    left = rows.agg((F.count("*") - most).alias("n")).filter("n > 0").select(F.lit("TRUNCATED").alias("code"), F.lit(None).cast(rows.schema["source_id"].dataType).alias("source_id"), "n")
    return shown.unionByName(left)


def throughput(documents: DataFrame) -> DataFrame:
    """One row: documents, pages, mean seconds per document, pages per second of all documents' seconds: (started, finished in seconds, pages)."""
    s = F.col("finished") - F.col("started")
    return documents.agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.round(F.avg(s), 4).alias("seconds"), F.round(F.try_divide(F.sum("pages"), F.sum(s)), 4).alias("pages_per_second"))
