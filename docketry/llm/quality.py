"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees over binned features learns one lookup table per feature and one per chosen pair of
features; a document's score is the logistic of the sum of the table cells that its bins select.

Features come from the whole text alone. A null text counts as empty; an empty text gets a score as any other.
Repeated rows get equal scores; columns besides doc_id and text are ignored and never read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import SAMPLE_ROWS, bounded_sample, by_batch, held_out

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "upper_share", "symbol_share", "digit_share", "space_share", "mark_share",
    "pipes_per_word", "distinct_share", "top_share", "repeat_share", "log_lines", "same_line_share", "stops_per_word", "packed_share",
)
_SYMBOLS = np.frombuffer(b"#$%&*@^~=+<>\\_{}[]", dtype=np.uint8)


def features(text: str | None, packer) -> list[float]:
    """The feature vector of a whole text; `packer` compresses bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.lower().split()
    w = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x]
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    counts = Counter(words)
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        n / w,
        upper / max(upper + lower, 1),
        float(hist[_SYMBOLS].sum()) / n,
        float(hist[48:58].sum()) / n,
        float(hist[32] + hist[9:14].sum()) / n,
        float(hist[33] + hist[63]) / w,
        float(hist[124]) / w,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(len(lines), 1),
        float(hist[46] + hist[44]) / w,
        len(packer(raw)) / n,
    ]


def _packer():
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress


def _matrix(texts: list[str | None]) -> np.ndarray:
    pack = _packer()
    return np.array([features(t, pack) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


class AdditiveModel:
    """Lookup tables over quantile bins, fitted by cyclic boosting."""

    def __init__(self, bins: int = 32, rounds: int = 60, pair_rounds: int = 20, pairs: int = 6, rate: float = 0.15, leaf: float = 1.0):
        self.bins, self.rounds, self.pair_rounds, self.pairs, self.rate, self.leaf = bins, rounds, pair_rounds, pairs, rate, leaf
        self.base, self.edges, self.tables, self.pair_tables = 0.0, [], [], {}

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def _step(self, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        """A tree of at most three leaves over one feature's bins: the two best cuts, one after the other."""
        cuts = [0, len(grad)]
        for _ in range(2):
            best = (1e-9, None)
            for a, b in zip(cuts, cuts[1:]):
                g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
                if b - a < 2:
                    continue
                left_g, left_h, right_g, right_h = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
                gain = left_g**2 / (left_h + self.leaf) + right_g**2 / (right_h + self.leaf) - g[-1] ** 2 / (h[-1] + self.leaf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), a + k + 1)
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.empty(len(grad))
        for a, b in zip(cuts, cuts[1:]):
            out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + self.leaf)
        return out

    def _quadrants(self, grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
        """One cut on each axis of a pair's grid: the gain and the table of the four leaves."""
        g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
        gr, gc, gt, hr, hc, ht = g[:-1, -1:], g[-1:, :-1], g[-1, -1], h[:-1, -1:], h[-1:, :-1], h[-1, -1]
        gq, hq = g[:-1, :-1], h[:-1, :-1]
        parts = ((gq, hq), (gr - gq, hr - hq), (gc - gq, hc - hq), (gt - gr - gc + gq, ht - hr - hc + hq))
        gain = sum(a**2 / (b + self.leaf) for a, b in parts) - gt**2 / (ht + self.leaf)
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        out = np.empty_like(grad)
        for rows, cols, (a, b) in ((slice(0, i + 1), slice(0, j + 1), parts[0]), (slice(0, i + 1), slice(j + 1, None), parts[1]), (slice(i + 1, None), slice(0, j + 1), parts[2]), (slice(i + 1, None), slice(j + 1, None), parts[3])):
            out[rows, cols] = a[i, j] / (b[i, j] + self.leaf)
        return float(gain[i, j]), out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, d = x.shape if x.size else (0, len(FEATURES))
        p = (float(y.sum()) + 0.5) / (n + 1)
        self.base = float(np.log(p / (1 - p)))
        if n == 0 or y.min() == y.max():
            self.edges, self.tables = [np.zeros(0)] * d, [np.zeros(1)] * d
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        b = self._binned(x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        raw = np.full(n, self.base)

        def residual() -> tuple[np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-raw))
            return y - q, q * (1 - q)

        for _ in range(self.rounds):
            for j, t in enumerate(self.tables):
                g, h = residual()
                step = self.rate * self._step(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)))
                t += step
                raw += step[b[:, j]]
        g, h = residual()
        gains = []
        for i in range(d):
            for j in range(i + 1, d):
                shape = (len(self.tables[i]), len(self.tables[j]))
                if min(shape) > 1:
                    cell = b[:, i] * shape[1] + b[:, j]
                    size = shape[0] * shape[1]
                    gains.append((self._quadrants(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape))[0], i, j))
        for _, i, j in sorted(gains, reverse=True)[: self.pairs]:
            self.pair_tables[i, j] = np.zeros((len(self.tables[i]), len(self.tables[j])))
        for _ in range(self.pair_rounds):
            for (i, j), t in self.pair_tables.items():
                g, h = residual()
                cell = b[:, i] * t.shape[1] + b[:, j]
                step = self.rate * self._quadrants(np.bincount(cell, g, t.size).reshape(t.shape), np.bincount(cell, h, t.size).reshape(t.shape))[1]
                t += step
                raw += step[b[:, i], b[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        raw = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            raw += t[b[:, j]]
        for (i, j), t in self.pair_tables.items():
            raw += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-raw))


def fit_quality(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """A model from at most `rows` labelled documents that are not held out (crc32 of the id mod 3 is not 1).

    The labels are sampled first, so only their ids (at most `rows`) are broadcast and only their documents are featurised
    on the executors; the driver gets feature vectors, no texts. Labels without a document, without an id or null are ignored; of an id with several texts the smallest is learned from.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(3, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = bounded_sample(known, F.col("doc_id"), rows)
    docs = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column("text").to_pylist())
        return pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = by_batch(docs, vectors, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id")
    return AdditiveModel().fit(np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES)), (got["quality"].to_numpy() == 1).astype(float))


def score_quality(documents: DataFrame, model: AdditiveModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `documents`; nothing but doc_id and text is read."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(_matrix(batch.column("text").to_pylist()))
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return by_batch(documents.select("doc_id", held_out(3, 1).alias("held_out"), "text"), work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: AdditiveModel, threshold: float = 0.5) -> DataFrame:
    """The rows of `documents` that the model accepts, with all their columns; a filter in one pass, without a join."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part.filter(pa.array(model.score(_matrix(part.column("text").to_pylist())) >= threshold))

    return documents.mapInArrow(run, documents.schema)
