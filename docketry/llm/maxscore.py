"""Exact top-k search by MaxScore over signed components.

A component of a vector is a posting of one of two terms: its dimension's positive or its negative side. A query's component
gives positive contributions on the side of its own sign, bounded by its value times the side's largest value in a shard, and
negative ones on the other. Terms are ordered by their bounds; those at the end whose bounds together stay below the query's
k-th best score so far are non-essential: a vector that is in no essential posting list can't be among the best. Essential
postings are traversed; the other components are probed for the vectors met, in the order of their bounds and only while
what is known plus what is left can still reach the k-th best score. All scores are exact integers.

A shard is up to SHARD_ROWS vectors of one task, which builds its postings once for a block of queries; a task keeps the best
of its shards and hands on at most k rows a query, and one window a query merges the tasks. The queries come in blocks of
about QUERY_BLOCK rows, each broadcast for a pass of its own, so what is broadcast doesn't grow. A first bound on the k-th
score comes from a bounded sample of the vectors; it only saves work.

Vectors that are null or hold a null, NaN or infinity take no part, as query or candidate. Components that the shorter of two
vectors lacks count as 0, so vectors of any length are candidates. Rows with equal ids are different rows: each is a query and
leaves out only itself. A row without an id is a candidate, after all others of its score, and never a query. Empty tables
give empty results; extra columns are ignored. A component beyond 2^24 after scaling is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import settled, shared_folder
from docketry.llm.vectors import integer_vectors

TOP, SCALE, EVERY = 5, 256, 50
#: Vectors whose postings are built together; queries of a pass; vectors from which first bounds come.
SHARD_ROWS, QUERY_BLOCK, SAMPLE = 8192, 8192, 2048
#: Components probed between two tests of what can still be reached.
_PROBES = 8


def padded(rows: list, width: int) -> np.ndarray:
    """Vectors of any length up to `width` as a matrix, lacking components 0."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Shard:
    """Postings of some vectors: for each dimension and sign the places of its vectors, the absolute values, and their largest."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, no_id: np.ndarray, rows: np.ndarray):
        self.vectors, self.ids, self.no_id, self.rows = vectors, ids, no_id, rows
        self.lists: list[tuple[tuple[np.ndarray, np.ndarray], ...]] = []
        self.largest = np.zeros((vectors.shape[1], 2), np.int64)
        for d in range(vectors.shape[1]):
            sides = []
            for side, column in enumerate((vectors[:, d], -vectors[:, d])):
                docs = np.nonzero(column > 0)[0]
                sides.append((docs, column[docs]))
                self.largest[d, side] = column[docs].max(initial=0)
            self.lists.append(tuple(sides))

    def search(self, query: np.ndarray, own: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the vectors, but the query's own, that reach `floor` (None: all)."""
        weight = np.abs(query[: self.vectors.shape[1]])
        side = (query[: self.vectors.shape[1]] < 0).astype(int)
        bounds = weight * self.largest[np.arange(len(weight)), side]
        order = np.argsort(-bounds, kind="stable")
        rest = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], [0]])  # what the terms from a place on can add
        everything = floor is None or floor <= 0
        essential = 0 if everything else int(np.argmax(rest < floor))
        if everything:
            docs, score = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        else:
            total, met = np.zeros(len(self.vectors), np.int64), np.zeros(len(self.vectors), bool)
            for d in order[:essential]:
                at, values = self.lists[d][side[d]]
                total[at] += weight[d] * values
                met[at] = True
            docs = np.nonzero(met & (total + rest[essential] >= floor))[0]
            score = total[docs]
        # The other components while the bound holds: of non-essential terms whole, of essential ones what lowers the score.
        for start in range(0, len(order), _PROBES):
            dims = order[start : start + _PROBES]
            known = np.arange(start, start + len(dims)) < essential
            part = self.vectors[np.ix_(docs, dims)] * query[dims]
            score = score + np.where(known, np.minimum(part, 0), part).sum(1)
            if floor is not None:
                keep = score + rest[max(essential, start + len(dims))] >= floor
                docs, score = docs[keep], score[keep]
        keep = self.rows[docs] != own
        return docs[keep], score[keep]


class Best:
    """The best rows of one query so far: by score, then id with rows without one last."""

    def __init__(self, k: int, floor: int | None):
        self.k, self.floor, self.found = k, floor, (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))

    def add(self, shard: Shard, docs: np.ndarray, score: np.ndarray) -> None:
        if not len(docs):
            return
        score, none, ids = (np.concatenate(x) for x in zip(self.found, (score, shard.no_id[docs], shard.ids[docs]), strict=True))
        first = np.lexsort((ids, none, -score))[: self.k]
        self.found = score[first], none[first], ids[first]
        if len(first) == self.k:
            self.floor = max(int(score[first[-1]]), self.floor if self.floor is not None else int(score[first[-1]]))


def _shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Shard]:
    for b in batches:
        for at in range(0, b.num_rows, SHARD_ROWS):
            part = b.slice(at, SHARD_ROWS)
            ids = part.column("vec_id")
            yield Shard(padded(part.column("q").to_numpy(zero_copy_only=False), width), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("row").to_numpy())


def _first_floors(queries: DataFrame, sample: list, width: int, k: int) -> DataFrame:
    """Adds `floor`, the k-th best score among the sampled vectors other than the query, null where there are fewer."""
    schema = "row long, vec_id long, q array<long>, floor long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, rows = padded([r.q for r in sample], width), np.array([r.row for r in sample], np.int64)
        for b in batches:
            floors = []
            for row, q in zip(b.column("row").to_pylist(), b.column("q").to_numpy(zero_copy_only=False)):
                scores = vectors[:, : len(q)] @ np.asarray(q, np.int64)
                scores = scores[rows != row]
                floors.append(int(np.partition(scores, -k)[-k]) if len(scores) >= k else None)
            yield pa.record_batch([*b.columns, pa.array(floors, pa.int64())], ["row", "vec_id", "q", "floor"])

    return queries.select("row", "vec_id", "q").mapInArrow(run, schema)


def _pass(table: DataFrame, queries: list, width: int, k: int) -> DataFrame:
    """query_row, query_id, vec_id, score: of each query of a block the best rows of each task."""
    sent = table.sparkSession.sparkContext.broadcast([(r.row, r.vec_id, np.array(r.q, np.int64), r.floor) for r in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(row, i, np.pad(q, (0, width - len(q))), Best(k, floor)) for row, i, q, floor in sent.value]
        for shard in _shards(batches, width):
            for row, _, q, best in asked:
                best.add(shard, *shard.search(q, row, best.floor))
        out: dict[str, list] = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        for row, i, _, best in asked:
            for score, none, v in zip(*(x.tolist() for x in best.found), strict=True):
                for name, value in zip(out, (row, i, None if none else v, score), strict=True):
                    out[name].append(value)
        yield pa.record_batch({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return table.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")


def top_k(df: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id is divisible by `every` the `k` other rows of the largest integer inner products."""
    spark = df.sparkSession
    table = settled(integer_vectors(df, scale, vector, key).withColumn("row", F.monotonically_increasing_id()), "search-vectors")
    about = table.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("asked")).first()
    width, blocks = about.width, -(-about.asked // QUERY_BLOCK)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = table.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "q").collect()
    asked = _first_floors(table.filter(F.pmod("vec_id", F.lit(every)) == 0), sample, width, k)
    asked = settled(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), "search-queries", ("block",))
    path = f"{shared_folder(spark)}/search-best-{uuid.uuid4().hex}"
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    for block in range(blocks):
        found = _pass(table, asked.filter(F.col("block") == block).collect(), width, k)
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


#: Every product of every query, in DuckDB.
ORACLE = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (SELECT a.r AS r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.r <> b.r WHERE a.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank, vec_id, score FROM pairs QUALIFY rank <= {TOP}"""
