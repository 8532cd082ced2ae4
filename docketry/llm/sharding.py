"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash; pass two shuffles each bucket with
Fisher-Yates and writes it. The place of a record in the whole shuffle is its bucket's offset plus its place in the bucket;
shards are dealt round robin along that order, so their counts differ by one at most (law `rows`) and slots are gapless.

Null ids and null texts are records like any other. Rows that agree in id and text are interchangeable; where more than
HOT_ROWS of them, or HOT_BYTES, share a key, they are numbered and scattered by their numbers too, so no bucket holds them all.
An empty table gives an empty result. The same rows give the same shards on each run, whatever their order or partitioning. Columns whose
names clash with the added ones are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import boxed, settled, shared_folder

SHARDS, SEED, BUCKET_BYTES = 16, 17, 16_000_000
#: Buckets up to which the table of offsets (24 bytes a row) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000
#: Rows of one key that stay together, and their bytes.
HOT_ROWS, HOT_BYTES = 1_000, BUCKET_BYTES // 4
_ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "position")


def text_size(column: str = "text") -> Column:
    return (F.coalesce(F.octet_length(column), F.lit(0)) + 1).cast("long")


def text_crc(column: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(column), F.lit("")).cast("binary")).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: the lengths of its texts and blobs, 16 for each other column."""
    return sum((F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(0) for f in df.schema.fields), F.lit(16 * len(df.columns))).cast("long")


def scattered(keyed: DataFrame) -> DataFrame:
    """`keyed` (row, key, bytes) with the key changed for the rows of a hot key: groups of them that hold at most HOT_ROWS rows and
    HOT_BYTES (one row at least) get keys of their own.

    Rows of a hot key are numbered by partition and place in it, through the counts of the partitions; which of the equal rows
    gets which number doesn't show. How many stay together follows from the key's widest row, so it is the same in any order.
    """
    together = F.greatest(F.lit(1), F.least(F.lit(HOT_ROWS), F.floor(F.lit(HOT_BYTES) / F.max("bytes")))).cast("long")
    hot = settled(keyed.groupBy("key").agg(F.count("*").alias("rows"), together.alias("together")).filter("rows > together").select("key", "together"), "shard-keys")
    found = hot.count()
    if not found:
        return keyed
    hot = F.broadcast(hot) if found <= BROADCAST_BUCKETS else hot
    # Settled, so that the counts and the numbers see the same partitions.
    part = settled(keyed.join(hot, "key").withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "shard-hot")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = part.groupBy("key", "part").agg(F.count("*").alias("n")).select("key", "part", before.alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("key", "part").orderBy("nth")) - 1
    spread = part.join(places, ["key", "part"]).withColumn("number", number).select("row", F.xxhash64("key", F.floor(F.col("number") / F.col("together"))).alias("key"), "bytes")
    return keyed.join(hot, "key", "left_anti").select("row", "key", "bytes").unionByName(spread)


def external_shuffle(records: DataFrame, key: list[str], seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of `records` with `position`, their place in a uniform shuffle; whole rows move.

    `key` names the columns that identify a row. Small passes over the key and the row's bytes find hot keys and count bytes and
    rows per bucket; then rows move once. A bucket holds about `bucket_bytes`.
    """
    hashed = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key), F.lit(seed))
    keyed = scattered(boxed(records, key=hashed, bytes=row_bytes(records)))
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bucketed = keyed.select("row", "key", F.pmod("key", F.lit(buckets)).alias("bucket"))
    counts = bucketed.groupBy("bucket").count()
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset"))
    rows = bucketed.join(F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets, "bucket")

    def fisher_yates(bucket: pa.Table) -> pa.Table:
        whole, of = bucket.column("row").combine_chunks(), bucket.column("key").to_numpy()
        if not bucket.num_rows:
            return pa.table([whole, pa.array([], pa.int64())], names=["row", "position"])
        # Rows with one key are put in the order of the columns that identify them.
        by = pa.table([pa.array(of), *(whole.field(c) for c in key)], names=[str(i) for i in range(len(key) + 1)])
        sorted_rows = pc.sort_indices(by, [(c, "ascending") for c in by.column_names]).to_numpy()
        place = np.arange(len(of))
        np.random.Generator(np.random.PCG64([seed, bucket.column("bucket")[0].as_py()])).shuffle(place)
        return pa.table([whole.take(pa.array(sorted_rows[place])), pa.array(np.arange(len(of)) + bucket.column("offset")[0].as_py())], names=["row", "position"])

    moved = rows.groupBy("bucket").applyInArrow(fisher_yates, T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("position", T.LongType())]))
    return moved.select("row.*", "position")


def sharded(records: DataFrame, key: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds law, shard, slot and grown_shard (null under this law) to each row of `records`."""
    out = external_shuffle(records.drop(*_ADDED[2:]), key, seed)
    return out.select(
        *(out[f"`{c}`"] for c in out.columns if c != "position"),
        F.lit("rows").alias("law"),
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_documents(documents: DataFrame) -> DataFrame:
    """Whole rows of `documents`, moved with their texts, with size, text_crc32 and the shard columns."""
    whole = documents.drop(*_ADDED).withColumns({"size": text_size(), "text_crc32": text_crc()})
    return sharded(whole, ["doc_id", "text_crc32"])


def write_shards(shuffled: DataFrame, path: str) -> DataFrame:
    """Writes the shuffled rows as one folder per shard, in runs ordered by slot (a task's bucket adds one to each shard), and reads them back."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path)


def shard_digest(written: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the shard columns of shards that were written; sizes and checks are taken from the texts read back."""
    return written.select("doc_id", text_size().alias("size"), text_crc().alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def shard_table(documents: DataFrame, path: str | None = None) -> DataFrame:
    """`documents` through the whole job: shuffled, written to `path` (a new folder of the shared one without), read back."""
    path = path or f"{shared_folder(documents.sparkSession)}/shards-{uuid.uuid4().hex}"
    return write_shards(sharded_documents(documents), path)
