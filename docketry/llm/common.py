"""What the operators of this subpackage share: splits, sizes, bounded samples, tables in the shared folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Where a local session names no shared folder (tests, a single machine).
LOCAL_SHARED = "/tmp/checkpoints/docketry"
#: Rows that a sample for fitting may hold, whatever the size of its table.
SAMPLE_ROWS = 20_000


def id_remainder(mod: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `mod`; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def held_out(mod: int, remainder: int, column: str = "doc_id") -> Column:
    """True where the row is kept from learning; a row without an id is never learned from."""
    return F.coalesce(id_remainder(mod, column) == remainder, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only a local session may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def settled(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back: lineage is cut, no executor holds the only copy.

    The table stays until the shared folder is cleaned, as the returned frame is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def bounded_sample(df: DataFrame, key: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` rows of `df`, the same ones on each run: those whose hashed key is smallest.

    Large tables are thinned by a hash threshold first, so that the final order-and-limit sees about 1.2 x `rows` rows.
    Only samples for fitting a model may pass here.
    """
    total = df.count()
    h = F.xxhash64(key.cast("string"), F.lit(20011))
    if total > 2 * rows:
        df = df.filter(F.pmod(h, F.lit(1 << 30)) < F.lit(int((1 << 30) * (1.2 * rows / total)) + 1))
    return df.orderBy(h, key).limit(rows)


def slice_lengths(batch: pa.RecordBatch, rows: int, most_bytes: int) -> Iterator[int]:
    """Lengths of consecutive slices of `batch`: at most `rows` rows and `most_bytes` of texts and blobs each, one row at least."""
    texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    ends = np.cumsum(sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64)))
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right")) - at
        yield (n := min(rows, max(1, fits), batch.num_rows - at))
        at += n


def by_batch(df: DataFrame, work, schema: str, rows: int = 1000, most_bytes: int | None = None) -> DataFrame:
    """mapInArrow with `work(batch) -> dict of columns` on slices of at most `rows` rows, and of `most_bytes` where given, so that memory doesn't follow the batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n in slice_lengths(batch, rows, most_bytes) if most_bytes else (rows for _ in range(0, batch.num_rows, rows)):
                yield work(batch.slice(at, n))
                at += n

    return df.mapInArrow(run, schema)


def hash_words(words: np.ndarray) -> np.ndarray:
    """A 64-bit mix (splitmix64's finaliser) of 64-bit words."""
    with np.errstate(over="ignore"):
        z = words + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def hashed_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in each process; nothing is kept, as a cache of a large vocabulary costs more than it saves."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def boxed(df: DataFrame, **added: Column) -> DataFrame:
    """The rows of `df` whole in one struct column `row` beside the added columns, so that no name of theirs can clash with one of ours."""
    return df.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in added.items()))
