"""Integer vectors: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest component in magnitude; squared distances and products of two vectors of up to 4,096 components then fit in a long.
LARGEST = 1 << 24


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds neither null nor NaN nor an infinity."""
    each = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(each, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as double; an error names a component beyond LARGEST, for which results would not fit in a long."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    too_large = F.exists(scaled, lambda v: F.abs(v) > F.lit(LARGEST))
    return F.when(too_large, F.raise_error(F.lit(f"a vector component beyond {LARGEST}/{scale} in magnitude")).cast("array<long>")).otherwise(scaled)


def integer_vectors(df: DataFrame, scale: int, vector: str = "embedding", key: str = "vec_id", dims: int | None = None) -> DataFrame:
    """(vec_id, q) of the usable rows: finite vectors, of exactly `dims` components if given. All other columns are dropped."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").alias("vec_id"), v.alias("v")).filter(finite(F.col("v")))
    rows = rows.filter(F.size("v") == dims) if dims is not None else rows
    return rows.select("vec_id", integers(F.col("v"), scale).alias("q"))


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column of vectors of `dims` components as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def from_blobs(column, kind, width: int) -> np.ndarray:
    """An Arrow binary column of equally long rows as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)
