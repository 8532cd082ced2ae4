"""Centroid clustering with block-norm screening.

Vectors are integers. Each is stored with a code: for each segment of its components the sum over sqrt(length) and the norm of
what the segment's mean leaves. By the Cauchy-Schwarz inequality the squared distance of two codes is at most that of their
vectors, so a centroid whose code is farther away than the exact distance of the centroid with the nearest code can't win.
Only the centroids that this leaves receive exact distances, in integers; ties go to the smaller number.

A round is one pass over the stored table: each task sums its vectors by cluster, and one row a task, cluster and component
goes through a shuffle. The driver sees centroids only, `k` x `dims` numbers.

Rows whose vector is null, has another length or holds a null, NaN or infinity are left out. Repeated rows are separate
vectors. A row without an id is never among the first centroids unless ids run out; rows with equal ids are told apart by
their components there. With fewer than `k` vectors each is a centroid. Empty tables give empty results; extra columns are
ignored. A component beyond 2^24 after scaling is an error, as distances could leave the range of a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import settled
from docketry.llm.vectors import from_blobs, integer_vectors, matrix

DIMS, CLUSTERS, ROUNDS, SCALE, SEGMENTS = 64, 16, 3, 64, 8
#: Vectors screened together.
_ROWS = 4096


def block_code(vectors: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The compressed vectors: per segment its sum over sqrt(length), and the norm of its deviations from its mean."""
    parts = vectors.reshape(len(vectors), segments, -1).astype(np.float64)
    sums = parts.sum(2) / np.sqrt(parts.shape[2])
    rest = np.maximum((parts * parts).sum(2) - sums * sums, 0)
    return np.concatenate([sums, np.sqrt(rest)], 1)


def nearest(vectors: np.ndarray, codes: np.ndarray, centroids: np.ndarray, centroid_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each vector its nearest centroid and exact squared distance, and how many exact distances it took in all."""

    def exact(rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        gap = vectors[rows] - centroids[chosen]
        return np.einsum("ij,ij->i", gap, gap)

    size, other = (codes * codes).sum(1)[:, None], (centroid_codes * centroid_codes).sum(1)
    bound = size + other - 2 * (codes @ centroid_codes.T)
    bound -= 1e-9 * (size + other) + 1e-6  # more than what rounding can add to a bound
    rows = np.arange(len(vectors))
    first = bound.argmin(1)
    best = exact(rows, first)
    cluster = first.copy()
    bound[rows, first] = np.inf
    left_rows, left = np.nonzero(bound <= best[:, None])
    for c in range(len(centroids)):
        mine = left_rows[left == c]
        d = exact(mine, np.full(len(mine), c))
        wins = (d < best[mine]) | ((d == best[mine]) & (c < cluster[mine]))
        best[mine[wins]], cluster[mine[wins]] = d[wins], c
    return cluster, best, len(vectors) + len(left_rows)


def coded(vectors: DataFrame, dims: int, segments: int) -> DataFrame:
    """(vec_id, vector, code): the integer vectors and their compressed forms as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = matrix(b.column("q"), dims)
            blobs = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (q.astype(np.int32), block_code(q, segments))]
            yield pa.record_batch([b.column("vec_id").cast(pa.int64()), *blobs], ["vec_id", "vector", "code"])

    return vectors.mapInArrow(run, "vec_id long, vector binary, code binary")


def first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    """The vectors of the `k` smallest hashes of '1:<vec_id>', in the order of the hashes."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [r.q for r in vectors.orderBy(h.asc_nulls_last(), "q").limit(k).collect()]


def _screened(b: pa.RecordBatch, centroids: np.ndarray, segments: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    codes = block_code(centroids, segments)
    for at in range(0, b.num_rows, _ROWS):
        part = b.slice(at, _ROWS)
        vectors = from_blobs(part.column("vector"), np.int32, centroids.shape[1]).astype(np.int64)
        cluster, distance, _ = nearest(vectors, from_blobs(part.column("code"), np.float64, codes.shape[1]), centroids, codes)
        yield part, vectors, cluster, distance


def moved(table: DataFrame, centroids: np.ndarray, segments: int) -> np.ndarray:
    """The centroids after one round: floors of the exact means of their vectors; empty ones stay."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for _, vectors, cluster, _ in _screened(b, centroids, segments):
                counts += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    sums[c] += vectors[cluster == c].sum(0)
        held = np.nonzero(counts)[0]
        yield pa.record_batch(
            [pa.array(np.repeat(held, dims)), pa.array(np.tile(np.arange(dims), len(held))), pa.array(sums[held].ravel()), pa.array(np.repeat(counts[held], dims))],
            ["cluster", "dim", "total", "n"],
        )

    parts = table.mapInArrow(run, "cluster long, dim long, total long, n long")
    out = centroids.copy()
    for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def assigned(table: DataFrame, centroids: np.ndarray, segments: int) -> DataFrame:
    """vec_id, cluster, distance of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, cluster, distance in _screened(b, centroids, segments):
                yield pa.record_batch([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, segments: int = SEGMENTS, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector after `rounds` rounds, as a settled table, and the centroids."""
    vectors = integer_vectors(df, scale, vector, key, dims)
    table = settled(coded(vectors, dims, segments), "centroid-vectors")
    centroids = np.array(first_centroids(vectors, k), np.int64).reshape(-1, dims)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(table, centroids, segments)
    return settled(assigned(table, centroids, segments), "centroid-clusters"), centroids


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    """cluster, centroid and centroid_sha256 of each centroid."""
    rows = [(i, c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    return spark.createDataFrame(rows, "cluster int, centroid array<long>, centroid_sha256 string")


def with_inertia(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the distance summed over each cluster and over all, and the centroid's digest; the joined side has a row a centroid."""
    per = clustered.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = per.agg(F.sum("cluster_inertia")).first()[0]
    about = per.join(centroid_table(clustered.sparkSession, centroids).drop("centroid"), "cluster").withColumn("inertia", F.lit(total).cast("long"))
    return clustered.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS) -> str:
    """Every distance of every round, in DuckDB."""
    usable = "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dims} AND {usable} = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS cluster, q AS c FROM kept QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT r, vec_id, q, cluster, d FROM (SELECT r, vec_id, q, cluster, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i]))) AS BIGINT) AS d FROM kept, c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)"
        )
        if i < rounds:
            steps.append(
                f"m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY cluster, i) GROUP BY cluster), "
                f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"
            )
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(cluster AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE = _oracle()
