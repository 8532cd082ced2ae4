"""Language identification by compression: the language whose dictionary packs a text into the fewest bytes.

Each language has a zstandard raw-content dictionary cut from its training texts. A text is cut into blocks, each block is
packed with each dictionary, and the sizes are summed over the whole text; blocks keep a long text from being explained by
itself. A narrow margin marks the decision as rejected (column `accepted`), the smallest size is still reported.

A null text, or one without a letter (a character of a Unicode letter category), is `und` with score 0. Ties go to the first language in code-point order.
Columns besides doc_id, text and (for learning) lang are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import by_batch, held_out, settled

DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 96_000, 4_000, 6
#: Follows each block; packs to the same few bytes anywhere, and keeps zstandard from storing short blocks as they are.
CARRIER = bytes(256)
#: Documents a language gives to its dictionary, and bytes of a block of a text that can't give all.
TEXTS, PIECE_BYTES = 256, 500
#: Bits by which the best language must beat the next to be accepted.
MARGIN_BITS = 24.0
#: Nats of evidence per packed bit; below ln 2 because sizes are rounded to bytes and blocks are not independent.
TEMPERATURE = 0.05
#: Word signs other than ASCII digits: letters, and numbers such as superscripts that are none.
_LIKE_LETTER = re.compile(r"[^\W0-9_]")


def byte_shares(sizes: list[int], most: int) -> list[int]:
    """Bytes that each text gives: all of it, or a share that is equal for all longer texts, so that `most` is reached but not passed."""
    shares, left = [0] * len(sizes), most
    for rank, i in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        shares[i] = min(sizes[i], left // (len(sizes) - rank))
        left -= shares[i]
    return shares


def pieces_of(raw: bytes, share: int, seed: int) -> bytes:
    """The whole text, or blocks of it that a seeded draw picks from all over, in their order, `share` bytes in all."""
    if len(raw) <= share:
        return raw
    blocks = range(0, len(raw), max(1, min(PIECE_BYTES, share)))
    out, left = [], share
    for at in np.random.default_rng([seed, 40013]).permutation(len(blocks)):
        out.append((at, raw[blocks[at] : min(blocks[at] + blocks.step, blocks[at] + left)]))
        left -= len(out[-1][1])
        if left <= 0:
            break
    return b"".join(x for _, x in sorted(out))


def learn_dictionaries(documents: DataFrame, texts: int = TEXTS) -> dict[str, bytes]:
    """lang -> raw dictionary, from at most `texts` documents a language that are not held out (crc32 of the id mod 4 is not 2).

    A first pass counts the languages; a hash threshold per language, broadcast with one row a language as the dictionaries are
    later, then thins the rows, so what is sorted is bounded by languages x texts. Whole texts are read; the driver gets
    DICTIONARY_BYTES a language.
    """
    usable = documents.filter(~held_out(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # By id and text, so that the several texts of an id are told apart and each run picks the same ones.
    h = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(40013))
    share = usable.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.least(F.lit(1.0), F.lit(2.0 * texts + 64) / F.col("n")).alias("share"))
    thin = usable.select("doc_id", "lang", "text", h.alias("h")).join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    first = thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).filter(F.col("k") <= texts)
    first = settled(first.select("lang", "k", "text"), "lang-texts")

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [len(t.as_py().lower().encode("utf-8", "replace")) for t in batch.column("text")]
        return pa.record_batch([batch.column("lang"), batch.column("k"), pa.array(sizes, pa.int64())], names=["lang", "k", "size"])

    sized: dict[str, list[tuple[int, int]]] = {}
    for r in by_batch(first, measure, "lang string, k int, size long").collect():
        sized.setdefault(r["lang"], []).append((r["k"], r["size"]))
    shares = {(lang, k): n for lang, of in sized.items() for (k, _), n in zip(sorted(of), byte_shares([x for _, x in sorted(of)], DICTIONARY_BYTES - len(of)))}

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [pieces_of(t.as_py().lower().encode("utf-8", "replace"), shares[lang, k], k) for lang, k, t in zip(batch.column("lang").to_pylist(), batch.column("k").to_pylist(), batch.column("text"))]
        return pa.record_batch([batch.column("lang"), batch.column("k"), pa.array(got, pa.binary())], names=["lang", "k", "text"])

    rows = by_batch(first, cut, "lang string, k int, text binary").collect()
    out: dict[str, bytes] = {}
    for lang in sorted({r["lang"] for r in rows}):
        pieces = [bytes(r["text"]) for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: -r["k"])]
        raw = b"\n".join(pieces)[-DICTIONARY_BYTES:]
        if raw.strip():
            out[lang] = raw
    return out


class Packers:
    """The compressors of all languages, with digested dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.langs = sorted(dictionaries)
        self.pack = []
        for lang in self.langs:
            d = z.ZstdCompressionDict(dictionaries[lang].rjust(8, b" "), dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.pack.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False).compress)

    def sizes(self, text: str) -> np.ndarray:
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK_BYTES] + CARRIER for i in range(0, len(raw), BLOCK_BYTES)]
        return np.array([sum(len(pack(b)) for b in blocks) for pack in self.pack], dtype=np.float64)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LIKE_LETTER.finditer(text))


def decide(text: str | None, packers: Packers) -> tuple[str, float, bool]:
    """(language, score, accepted)."""
    if text is None or not packers.langs or not has_letter(text):
        return "und", 0.0, False
    sizes = packers.sizes(text) * 8
    best = int(np.argmin(sizes))
    weight = np.exp(-(sizes - sizes[best]) * TEMPERATURE)
    others = np.delete(sizes, best)
    return packers.langs[best], float(1 / weight.sum()), bool(not len(others) or others.min() - sizes[best] >= MARGIN_BITS)


def identify(documents: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for each row. The dictionaries, languages x 96 kB, are broadcast once an executor."""
    made: list[Packers] = []
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Packers(shared.value))
        got = [decide(t, made[0]) for t in batch.column("text").to_pylist()]
        lang, score, sure = zip(*got) if got else ((), (), ())
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return by_batch(documents.select("doc_id", held_out(4, 2).alias("held_out"), "text"), work, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
