"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Documents are labelled, words are not: a word or word beginning is labelled toxic inside a toxic document if toxic documents
hold it far more often than clean ones of the same number of distinct words (a likelihood-ratio test), so the field learns from
labelled words. Of a word's known forms (the word, its beginnings) the one with most evidence is its feature. States are clean and toxic;
potentials are one weight per known word, a bias, and transitions. Words more than REACH words from any known word carry
constant potentials; the chain is cut there with the state clean, so long texts cost one look-up a word.
Forward-backward marginals give spans with character offsets, and aggregate to a document score by a fitted logistic.

Executors read the sample: they count forms, cut pieces of words near known ones, and gather the evidence of each document. The
driver gets the chosen features, distinct pieces as numbers, and two numbers a document, never a text. Chains are batched by
padded cells, so one long toxic text costs its own length and not that of its neighbours.

A null or empty text has no words and gets the score of a text without known words. Repeated rows get equal scores. With no
labels the score is 0.5 for all. Columns besides doc_id and text are not read for a score. Of an id with several texts the
smallest is learned from, and any toxic label makes it toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import bounded_sample, by_batch, held_out, settled

#: Most labelled documents of each class that fitting reads.
TOXIC_ROWS, CLEAN_ROWS = 3_000, 6_000
REACH, LEAST_DOCS, LEAST_EVIDENCE, LEAST_RATIO = 2, 3, 15.0, 8.0
#: Words of a training piece of a segment; padded words of a batch of chains; distinct forms that a counting task holds; words that a reader remembers.
PIECE, CELLS, COUNTED, REMEMBERED = 16, 32_768, 200_000, 100_000
#: Lengths of the word beginnings that can be features.
STEMS = range(4, 9)
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|_-~`…“”«»¡¿/\\"
#: Digits and signs that stand for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_RUN = re.compile(r"(.)\1{2,}")
_WORD = re.compile(r"\S+")


def normal(word: str) -> str:
    """The form of a word that is looked up: bare, lower-case, with stand-ins replaced and long letter runs shortened."""
    bare = word.strip(_STRIP).lower()
    if not bare.isalpha():
        bare = bare.translate(_LEET)
    return _RUN.sub(r"\1", bare)


def forms(bare: str) -> list[str]:
    """The feature names of a normal form: itself, and its beginnings with a star."""
    return [bare, *(f"{bare[:k]}*" for k in STEMS if k < len(bare))]


@dataclass
class ToxicField:
    """The field's parameters: feature weights, bias, log transitions [from, to], and the document logistic."""

    words: dict[str, float] = field(default_factory=dict)
    #: Evidence for each feature, by which a word's form is chosen.
    order: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Weights of the document logistic: evidence, evidence per 100 words, constant.
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def marginals(self, weights: np.ndarray, lengths: np.ndarray, shares: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over padded segments: P(toxic) per word, expected moves of all segments (with `shares` only), log partition.

        Segments start and end next to clean words. `weights`: segments x words; padding follows each segment's length.
        `shares`: how many times each segment counts in the moves.
        """
        s, m = weights.shape
        live = np.arange(m)[None, :] < lengths[:, None]
        on = np.where(live, weights + self.bias, 0.0)
        t = self.moves
        # f and b hold log sums for the states clean and toxic; beyond a segment's end b stays the step back to a clean word.
        f, b = np.zeros((s, m, 2)), np.zeros((s, m, 2))
        f[:, 0] = t[0]
        f[:, 0, 1] += on[:, 0]
        for k in range(1, m):
            f[:, k] = np.logaddexp(f[:, k - 1, 0, None] + t[0], f[:, k - 1, 1, None] + t[1])
            f[:, k, 1] += on[:, k]
        b[:, m - 1] = t[:, 0]
        for k in range(m - 2, -1, -1):
            ahead = np.logaddexp(t[None, :, 0] + b[:, k + 1, 0, None], t[None, :, 1] + (on[:, k + 1] + b[:, k + 1, 1])[:, None])
            b[:, k] = np.where(live[:, k + 1, None], ahead, t[:, 0])
        z = np.logaddexp(f[:, 0, 0] + b[:, 0, 0], f[:, 0, 1] + b[:, 0, 1])
        p = np.exp(np.where(live, f[:, :, 1] + b[:, :, 1] - z[:, None], -np.inf))
        inner = np.zeros((2, 2))
        if shares is not None:
            for u in (0, 1):
                for v in (0, 1):
                    step = f[:, :-1, u] + t[u, v] + (on[:, 1:] if v else 0.0) + b[:, 1:, v] - z[:, None]
                    inner[u, v] = (np.exp(np.where(live[:, 1:], step, -np.inf)) * shares[:, None]).sum()
            first, last = p[:, 0], p[np.arange(s), lengths - 1]
            inner += [[(shares * (2 - first - last)).sum(), (shares * first).sum()], [(shares * last).sum(), 0.0]]
        return p, inner, z

    def document_score(self, found: np.ndarray) -> np.ndarray:
        """`found`: rows of (evidence, words)."""
        return 1 / (1 + np.exp(-(document_features(found) @ self.document)))


def document_features(found: np.ndarray) -> np.ndarray:
    e, n = found.reshape(-1, 2).T
    return np.stack([np.log1p(e), np.log1p(100 * e / (n + 20)), np.ones(len(e))], axis=1)


class Reader:
    """Turns texts into padded segments of words near known ones; keeps a bounded cache of word forms."""

    def __init__(self, words: dict[str, float], order: dict[str, float], most: int = REMEMBERED):
        self.words, self.order, self.hot, self.seen, self.most = words, order, {}, set(), most

    def segments(self, text: str) -> list[list[tuple[int, float]]]:
        """Lists of (word number, weight) for each stretch within REACH of a known word."""
        raw = text.split()
        have = set(raw)
        for w in have.difference(self.seen):
            if known := [f for f in forms(normal(w)) if f in self.order]:
                self.hot[w] = max(known, key=lambda f: (self.order[f], len(f)))
        if len(self.seen) > self.most:
            self.seen, self.hot = set(), {w: f for w, f in self.hot.items() if w in have}
        self.seen |= have
        if have.isdisjoint(self.hot):
            return []
        out: list[list[tuple[int, float]]] = []
        upto = -1
        for i, w in enumerate(raw):
            if w in self.hot:
                a, z = max(i - REACH, 0), min(i + REACH, len(raw) - 1)
                if a > upto + 1 or not out:
                    out.append([])
                    upto = a - 1
                out[-1] += [(k, self.words.get(self.hot.get(raw[k], ""), 0.0)) for k in range(upto + 1, z + 1)]
                upto = max(upto, z)
        return out


def _padded(segments: list[list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in segments])
    w = np.zeros((len(segments), int(lengths.max())))
    for row, s in zip(w, segments):
        row[: len(s)] = [x for _, x in s]
    return w, lengths


def forms_of(text: str) -> tuple[set[str], int]:
    """The forms of a text and the number of its distinct words."""
    words = {b for b in map(normal, set(text.split())) if b}
    return {f for b in words for f in forms(b)}, len(words)


def chosen(names: list[str], toxic: np.ndarray, clean: np.ndarray, read: tuple[int, int]) -> dict[str, tuple[float, float]]:
    """Features that mark toxic documents: name -> (log rate ratio, evidence), a G-test of documents (toxic, clean) against distinct words read."""
    if not names:
        return {}
    share = read[0] / sum(read)
    k1, k0, both = toxic.astype(float), clean.astype(float), (toxic + clean).astype(float)
    ratio = (k1 / read[0]) / ((k0 + 0.5) / read[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (k1 * np.log(k1 / (both * share)) + np.where(k0 > 0, k0 * np.log(k0 / (both * (1 - share))), 0.0))
    good = (k1 >= LEAST_DOCS) & (ratio >= LEAST_RATIO) & (g >= LEAST_EVIDENCE)
    return {names[i]: (float(np.log(ratio[i])), float(g[i])) for i in np.flatnonzero(good)}


def pieces_of(reader: Reader, text: str, toxic: bool) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """(feature numbers, labels) of stretches near known words; `reader` has number + 1 for a weight, so -1 is an unknown word, and a known word is toxic inside a toxic document."""
    out = []
    for seg in reader.segments(text):
        for at in range(0, len(seg), PIECE):
            ids = tuple(int(x) - 1 for _, x in seg[at : at + PIECE])
            out.append((ids, tuple(int(toxic and i >= 0) for i in ids)))
    return out


def fit_chain(model: ToxicField, names: list[str], start: list[float], pieces: list[tuple[tuple[int, ...], tuple[int, ...]]], part: np.ndarray, steps: int = 80, rate: float = 0.5, decay: float = 1e-3) -> None:
    """Sets weights, bias and moves by maximum conditional likelihood with adaptive gradient steps; piece i counts `part[i]` times."""
    theta = np.array(start)
    model.moves = np.array([[0.0, -1.0], [-0.5, 0.0]])
    if pieces:
        lengths = np.array([len(r) for r, _ in pieces])
        m = int(lengths.max())
        ids, y = np.full((len(pieces), m), -1), np.zeros((len(pieces), m))
        for i, (r, t) in enumerate(pieces):
            ids[i, : len(r)], y[i, : len(t)] = r, t
        known = ids >= 0
        steps_y = np.concatenate([np.zeros((len(pieces), 1)), y, np.zeros((len(pieces), 1))], axis=1).astype(int)
        steps_live = np.arange(m + 1)[None, :] <= lengths[:, None]
        seen_moves = np.zeros((2, 2))
        np.add.at(seen_moves, (steps_y[:, :-1][steps_live], steps_y[:, 1:][steps_live]), np.broadcast_to(part[:, None], steps_live.shape)[steps_live])
        sums = [np.full(len(theta), 1e-6), 1e-6, np.full((2, 2), 1e-6)]
        n = part.sum()
        for _ in range(steps):
            p, moves, _ = model.marginals(np.where(known, theta[ids], 0.0), lengths, part)
            diff = (y - p) * part[:, None]
            grads = [np.bincount(ids[known], diff[known], len(theta)) / n - decay * theta, float(diff.sum()) / n - decay * model.bias, (seen_moves - moves) / n - decay * model.moves]
            for i, g in enumerate(grads):
                sums[i] = sums[i] + np.square(g)
            theta = theta + rate * grads[0] / np.sqrt(sums[0])
            model.bias += float(rate * grads[1] / np.sqrt(sums[1]))
            model.moves = model.moves + rate * grads[2] / np.sqrt(sums[2])
            model.moves[0, 0] = 0.0
    model.words = dict(zip(names, theta.tolist()))


def fit_document(model: ToxicField, found: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> None:
    """Sets the document logistic from rows of (evidence, words); document i counts `share[i]` times."""
    x, yy, w = document_features(found), toxic.astype(float), np.array([1.0, 0.0, -2.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (share * q * (1 - q) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (share * (yy - q)) - 0.05 * w)
    model.document = w


def numbered(model: ToxicField, names: list[str]) -> Reader:
    return Reader({w: float(i + 1) for i, w in enumerate(names)}, model.order)


def evidence(model: ToxicField, reader: Reader, texts: list[str | None]) -> list[tuple[float, int, list[tuple[int, float]]]]:
    """Per text: -log P(word is not toxic) summed over words, the number of words, and (word number, marginal) of words more likely toxic than not."""
    segs, owner, counts = [], [], [len((t or "").split()) for t in texts]
    for d, text in enumerate(texts):
        for s in reader.segments(text or ""):
            segs.append(s)
            owner.append(d)
    total, marked = np.zeros(len(texts)), [[] for _ in texts]
    order = sorted(range(len(segs)), key=lambda i: len(segs[i]))
    at = 0
    while at < len(order):
        # As many chains as fit CELLS when padded to the longest of them, one at least.
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(segs[order[to]]) <= CELLS:
            to += 1
        part = [segs[i] for i in order[at:to]]
        p, _, _ = model.marginals(*_padded(part))
        for i, s, row in zip(order[at:to], part, p):
            row = row[: len(s)]
            total[owner[i]] += float(-np.log1p(-np.minimum(row, 1 - 1e-9)).sum())
            marked[owner[i]] += [(s[k][0], float(row[k])) for k in np.flatnonzero(row > 0.5)]
        at = to
    return list(zip(total.tolist(), counts, marked))


def spans_of(text: str, marked: list[tuple[int, float]]) -> list[dict]:
    """Runs of neighbouring toxic words as character offsets [start, end) with their greatest marginal."""
    at, out, before = dict(marked), [], None
    for i, m in enumerate(_WORD.finditer(text)):
        if i in at:
            if before == i - 1:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], at[i])
            else:
                out.append({"start": m.start(), "end": m.end(), "p": at[i]})
            before = i
    return out


def learn(documents: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> ToxicField:
    """A field from at most `toxic_rows` and `clean_rows` labelled documents that are not held out (crc32 of the id mod 4 is not 2).

    Each counts as many times as its class has labelled rows for one picked, so scores keep the true share of toxic documents.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = bounded_sample(known.filter("toxic = 1"), F.col("doc_id"), toxic_rows).unionByName(bounded_sample(known.filter("toxic <> 1"), F.col("doc_id"), clean_rows))
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter(F.col("text").isNotNull())
    sample = settled(rows.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"), F.min("text").alias("text")), "toxic-sample")
    total = known.agg(F.count_if(F.col("toxic") != 1), F.count_if(F.col("toxic") == 1)).first()
    shares = tuple(max(1.0, (n or 0) / most) for n, most in zip(total, (clean_rows, toxic_rows)))
    return fit_field(sample, shares)


def fit_field(sample: DataFrame, shares: tuple[float, float] = (1.0, 1.0)) -> ToxicField:
    """A field from a settled sample (toxic boolean, text); `shares`: the labelled documents that each clean and each toxic one stands for."""
    model = ToxicField()
    classes = sample.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    if not classes[0] or not classes[1]:
        return model

    def count(batches) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen), pa.string()), pa.array([a for a, _ in seen.values()], pa.int64()), pa.array([b for _, b in seen.values()], pa.int64())], names=["form", "toxic", "clean"])

        # The empty form counts distinct words read.
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for y, text in zip(batch.column("toxic"), batch.column("text")):
                side, (names, n) = 1 - int(y.as_py()), forms_of(text.as_py())
                for f in names:
                    seen.setdefault(f, [0, 0])[side] += 1
                seen.setdefault("", [0, 0])[side] += n
                if len(seen) > COUNTED:
                    yield rows()
                    seen = {}
        yield rows()

    counts = settled(sample.select("toxic", "text").mapInArrow(count, "form string, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter((F.col("toxic") >= LEAST_DOCS) | (F.col("form") == "")), "toxic-forms")
    read = tuple(1 + x for x in (counts.filter("form = ''").select("toxic", "clean").first() or (0, 0)))
    ratio = (F.col("toxic") / read[0]) / ((F.col("clean") + 0.5) / read[1])
    marked = counts.filter((F.col("form") != "") & (ratio >= LEAST_RATIO)).toPandas().sort_values("form")
    found = chosen(marked["form"].tolist(), marked["toxic"].to_numpy(), marked["clean"].to_numpy(), read)
    names = sorted(found)
    model.order = {w: found[w][1] for w in names}

    def cut(batches) -> Iterator[pa.RecordBatch]:
        reader, seen = numbered(model, names), Counter()
        for batch in batches:
            for y, text in zip(batch.column("toxic"), batch.column("text")):
                seen.update((*piece, y.as_py()) for piece in (pieces_of(reader, text.as_py(), y.as_py()) if names else ()))
        ids, labels = ([list(k[i]) for k in seen] for i in (0, 1))
        yield pa.record_batch([pa.array(ids, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int8())), pa.array([n * shares[int(y)] for (_, _, y), n in seen.items()], pa.float64())], names=["ids", "labels", "share"])

    pieces = sample.select("toxic", "text").mapInArrow(cut, "ids array<int>, labels array<tinyint>, share double").groupBy("ids", "labels").agg(F.sum("share").alias("share")).orderBy("ids", "labels").collect()
    fit_chain(model, names, [found[w][0] for w in names], [(tuple(r.ids), tuple(r.labels)) for r in pieces], np.array([r.share for r in pieces]))

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = evidence(model, Reader(model.words, model.order), batch.column("text").to_pylist())
        return pa.record_batch([batch.column("toxic"), pa.array([e for e, _, _ in got], pa.float64()), pa.array([n for _, n, _ in got], pa.int64())], names=["toxic", "e", "n"])

    docs = by_batch(sample.select("toxic", "text"), weigh, "toxic boolean, e double, n long").toPandas().sort_values(["toxic", "e", "n"])
    toxic = docs["toxic"].to_numpy(dtype=bool)
    fit_document(model, docs[["e", "n"]].to_numpy(dtype=float), toxic, np.where(toxic, shares[1], shares[0]))
    return model


def score_toxicity(documents: DataFrame, model: ToxicField, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (start, end, p) for each row."""
    readers: list[Reader] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not readers:
            readers.append(Reader(model.words, model.order))
        texts = batch.column("text").to_pylist()
        got = evidence(model, readers[0], texts)
        score = model.document_score(np.array([(e, n) for e, n, _ in got], dtype=np.float64))
        spans = [spans_of(t, m) if m else [] for t, (_, _, m) in zip(texts, got)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, kind)], names=["doc_id", "held_out", "score", "predicted", "spans"])

    return by_batch(documents.select("doc_id", held_out(4, 2).alias("held_out"), "text"), work, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:long,end:long,p:double>>", rows=300)
