"""The queries of this subpackage: opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import centroids, decontam, filteraudit, htmltree, langid, maxscore, mixing, neardup, ngramlm, quality, sharding, toxicity, tsmedia


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn_dictionaries(docs))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.main_text(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(sharding.shard_table(_table(spark, sf_dir, "documents")))


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsmedia.media_digest(tsmedia.with_media(_table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score_documents(_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(_table(spark, sf_dir, "embeddings")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(_table(spark, sf_dir, "embeddings"))


_QUERIES = (
    op1_language_id, op2_mixing, op3_main_text, op4_toxicity, op5_sharding, op6_transport_streams, op7_quality, op8_ngram_lm, op9_near_duplicates, op10_decontamination,
    op11_centroid_clusters, op12_filter_audit, op13_top_k,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE, "op10_decontamination": decontam.ORACLE, "op11_centroid_clusters": centroids.ORACLE, "op12_filter_audit": filteraudit.ORACLE, "op13_top_k": maxscore.ORACLE}
