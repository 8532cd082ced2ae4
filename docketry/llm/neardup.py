"""MinHash near-duplicates by tensored banding, verified exactly.

A document's set is its distinct five-word shingles. Two collections of SIDE small bands (WIDTH minimum hashes each) are made
from 2 x SIDE x WIDTH hashes; table keys are all pairs of a band of one collection with a band of the other, SIDE x SIDE tables
of 2 x WIDTH hashes from about the square root of the hashes that independent tables would take.

 1. Equal sets collapse into a class, represented by its smallest id (pre-aggregated, so a huge class is one row).
 2. In each table bucket every member is compared with the bucket's smallest id, and tied if their signatures agree in at
    least LOOSE of the places. Members that are not meet again in sub-buckets, one for each further band, then for each
    further two bands, then in the same sub-buckets without their smallest id; who is still left after the last round is
    tied unfiltered. So no unrelated small id parts two members. Ties give loose groups by connected components.
 3. Loose groups are packed by weight into bags of at most BAG_SHINGLES shingles; a group larger than that is cut into blocks
    of half a bag, and every pair of blocks shares a bag. In a bag, an inverted index over the rarest shingles with exact size
    and position bounds finds every pair at or above the threshold without comparing all pairs; each is confirmed on the full
    sets. Pairs that are already connected are skipped, so a bag returns a spanning set of confirmed links.
 4. Components of the links give each class its component.

Words are A-Z lower-cased runs of non-white-space. Texts of fewer words have the whole sequence as their shingle; null, empty
or blank texts have an empty set and are linked with nothing. Rows without an id are returned unlinked, with a null component
and kept. Rows of one id are one document: its links are those of any of its texts, each row keeps its own n_shingles.
Shingles are told apart by 64-bit hashes, sets by two of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import by_batch, hash_words, hashed_words, settled
from docketry.llm.graph import components

WORDS, PERCENT = 5, 85
SIDE, WIDTH, LOOSE = 7, 2, 0.35
#: Rounds of comparing a bucket's members with its smallest id, and after how many of them buckets are split by a further band.
STAR_ROUNDS, SPLITS = 7, 2
#: Most shingles of a bag: 8 bytes each, and some ten arrays of them while the bag is linked.
BAG_SHINGLES = 600_000
#: Tried pairs of a bag that are remembered; forgetting them costs repeated work, never a link.
TRIED_PAIRS = 200_000
#: Ids (8 bytes each) up to which the members of loose groups are broadcast to pick their texts; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_MULTIPLIERS = hash_words(np.arange(1, 2 * SIDE * WIDTH + 1, dtype=np.uint64)) | np.uint64(1)
_MIX = np.uint64(0x100000001B3)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = hashed_words(w)
    n = len(h)
    k = min(words, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - k + 1, np.uint64(k))
        for i in range(k):
            acc = hash_words(acc * _MIX + h[i : n - k + 1 + i])
    return np.unique(acc)


def minima(s: np.ndarray) -> np.ndarray:
    """The minimum hashes of a non-empty set."""
    with np.errstate(over="ignore"):
        return np.array([(s * m ^ (m >> np.uint64(7))).min() for m in _MULTIPLIERS], dtype=np.uint64)


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, c1, c2 (identity of the set), u, v (the two band collections), sig (a byte of each minimum hash)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text"):
            s = shingles(text.as_py())
            if not len(s):
                rows.append((0, 0, 0, None, None, None))
                continue
            m = minima(s)
            bands = m.reshape(2 * SIDE, WIDTH)
            with np.errstate(over="ignore"):
                band = hash_words(bands[:, 0])
                for i in range(1, WIDTH):
                    band = hash_words(band * _MIX + bands[:, i])
                c1, c2 = hash_words(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(hash_words(s ^ np.uint64(0x5851F42D4C957F2D)))
            band = band.view(np.int64)
            rows.append((len(s), int(c1.view(np.int64)), int(c2.view(np.int64)), band[:SIDE], band[SIDE:], (m >> np.uint64(24)).astype(np.uint8).view(np.int8)))
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int8()))
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_shingles", "c1", "c2", "u", "v", "sig"])

    return by_batch(documents.select("doc_id", "text"), work, "doc_id long, n_shingles long, c1 long, c2 long, u array<long>, v array<long>, sig array<tinyint>", rows=200)


def loose_ties(classes: DataFrame) -> DataFrame:
    """(a, b): ties that connect, in each table bucket, members whose signatures agree in at least LOOSE of the places.

    Only those that a round rejects enter the next one, so later rounds are small. A pair at 0.85 that a smaller id has parted
    agrees in none or one of the 12 further bands, and so misses the sub-buckets, with probability 7e-6.
    """
    tables = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    key = F.transform(tables, lambda t: F.struct(F.xxhash64(F.element_at("u", (F.floor(t / SIDE) + 1).cast("int")), F.element_at("v", (F.pmod(t, F.lit(SIDE)) + 1).cast("int")), t).alias("key"), t.alias("t")))
    left = classes.select("rep", F.explode(key).alias("k")).select("rep", "k.key", "k.t", F.lit(-1).alias("band"))
    sig = classes.select("rep", "sig")
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    ties = None
    for turn in range(STAR_ROUNDS + 1):
        buckets = left.groupBy("key").agg(F.min("rep").alias("b"), F.count("*").alias("members")).filter("members > 1").select("key", "b")
        met = settled(left.join(buckets, "key").filter("rep <> b").select(F.col("rep").alias("a"), "b", "key", "t", "band"), "dup-met")
        if turn and met.isEmpty():
            break
        pairs = met.select("a", "b").distinct()
        if turn == STAR_ROUNDS:
            ties = ties.unionByName(pairs)
            break
        both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
        judged = settled(both.select("a", "b", (agree >= LOOSE * 2 * SIDE * WIDTH).alias("tied")), "dup-judged")
        found = judged.filter("tied").select("a", "b")
        ties = found if ties is None else ties.unionByName(found)
        left = met.join(judged.filter("NOT tied").select("a", "b"), ["a", "b"]).select(F.col("a").alias("rep"), "key", "t", "band")
        if turn < SPLITS:
            # The table's own bands are equal in the whole bucket; bands go up, so that two give one sub-bucket.
            more = F.filter(F.sequence(F.lit(0), F.lit(2 * SIDE - 1)), lambda i: (i > F.col("band")) & (i != F.floor(F.col("t") / SIDE)) & (i != F.pmod("t", F.lit(SIDE)) + SIDE))
            bands = classes.select("rep", F.concat("u", "v").alias("bands"))
            split = left.join(bands, "rep").select("rep", "key", "t", "bands", F.explode(more).alias("band"))
            left = split.select("rep", F.xxhash64("key", "band", F.element_at("bands", F.col("band") + 1)).alias("key"), "t", "band")
    return ties


class Forest:
    """Union-find over list positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_links(sets: list[np.ndarray], blocks: list[int] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Confirmed links between positions of `sets` that connect all that any links at or above the threshold connect.

    `blocks`: with two kinds, only pairs across them are looked for. Each set's shingles are put in one global order, rarest
    first. The first common shingle of a pair at positions p, q bounds the overlap by min(n-p, m-q), so sets are indexed only
    up to the position where the bound can still be met, and pairs beyond it are passed over unseen.
    """
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    token = rank[inverse]
    shared = counts[inverse] > 1
    order = np.lexsort((token, owner))
    owner, token, shared = owner[order], token[order], shared[order]
    start = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(token)) - start[owner]
    prefix = sizes - -(-percent * sizes // 100) + 1
    keep = shared & (place < prefix[owner])
    ranked = [token[a:b] for a, b in zip(start, start[1:])]
    t, d, p = token[keep], owner[keep], place[keep]
    order = np.lexsort((d, t))
    t, d, p = t[order], d[order], p[order]
    cuts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]])) if len(t) else np.zeros(1, int)
    forest, seen, out = Forest(len(sets)), set(), []
    side = np.array(blocks if blocks is not None else [0] * len(sets))
    across = len(set(side.tolist())) > 1
    whole = 100 + percent

    def confirm(x: int, y: int) -> None:
        x, y = (x, y) if x < y else (y, x)
        if (pair := x * len(sets) + y) in seen or (across and side[x] == side[y]):
            return
        if len(seen) >= TRIED_PAIRS:
            seen.clear()
        seen.add(pair)
        common = len(np.intersect1d(ranked[x], ranked[y], assume_unique=True))
        if common * whole >= percent * int(sizes[x] + sizes[y]) and forest.join(x, y):
            out.append((x, y))

    for a, b in zip(cuts, cuts[1:]):
        if b - a < 2:
            continue
        docs, at = d[a:b], p[a:b]
        left = sizes[docs] - at
        hub = int(np.argmin(at))
        for x in range(len(docs)):
            if x != hub and forest.find(int(docs[x])) != forest.find(int(docs[hub])) and min(left[x], left[hub]) * whole >= percent * (sizes[docs[x]] + sizes[docs[hub]]):
                confirm(int(docs[x]), int(docs[hub]))
        roots = np.array([forest.find(int(x)) for x in docs])
        if len(docs) == 2 or (roots == roots[0]).all():
            continue
        values, n = np.unique(roots, return_counts=True)
        main = values[int(np.argmax(n))]
        for x in np.flatnonzero(roots != main):
            near = np.minimum(left, left[x]) * whole >= percent * (sizes[docs] + sizes[docs[x]])
            for y in np.flatnonzero(near & (roots != roots[x])):
                if forest.find(int(docs[x])) != forest.find(int(docs[y])):
                    confirm(int(docs[x]), int(docs[y]))
    return out


def in_bags(members: DataFrame) -> DataFrame:
    """rep, block, bag for each of `members` (rep, component, n_shingles, total): no bag has more than BAG_SHINGLES shingles, but for sets that are larger themselves.

    Small groups are dealt to lanes by hash and cut there by their running weight; block i of a large group goes into the bags
    of its pairs (i, j).
    """
    half = BAG_SHINGLES // 2
    small = members.filter(F.col("total") <= half)
    groups = small.select("component", "total").distinct()
    lanes = max(1, -(-int(groups.agg(F.sum("total")).first()[0] or 0) // (64 * half)))
    lane = F.pmod(F.xxhash64("component", F.lit(3)), F.lit(lanes))
    ahead = Window.partitionBy("lane").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    cut = groups.withColumn("lane", lane).withColumn("cut", F.floor(F.coalesce(F.sum("total").over(ahead), F.lit(0)) / half))
    whole = small.join(cut.select("component", F.xxhash64("lane", "cut", F.lit(1)).alias("bag")), "component").select("rep", F.lit(0).alias("block"), "bag")
    blocks = F.ceil(F.col("total") / (0.8 * half))
    large = members.filter(F.col("total") > half).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.xxhash64("component", F.least(F.col("block"), j), F.greatest(F.col("block"), j), F.lit(2)))
    return whole.unionByName(large.select("rep", "block", F.explode(pairs).alias("bag")))


def confirmed_links(documents: DataFrame, classes: DataFrame, groups: DataFrame, repeats: bool = True) -> DataFrame:
    """(a, b): confirmed links that span the true components inside each loose group (node, component).

    `repeats`: whether an id may occur in several rows, whose equal sets then collapse before they are dealt to bags.
    """
    members = groups.select(F.col("node").alias("rep"), "component").join(classes.groupBy("rep").agg(F.sum("n_shingles").alias("n_shingles")), "rep")
    sizes = members.groupBy("component").agg(F.sum("n_shingles").alias("total"))
    members = settled(members.join(sizes, "component"), "dup-members")
    placed = in_bags(members)
    picked = members.select(F.col("rep").alias("doc_id"))
    texts = documents.select("doc_id", "text").join(F.broadcast(picked) if picked.count() <= BROADCAST_IDS else picked, "doc_id", "left_semi")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), pa.array([shingles(x.as_py()).tobytes() for x in batch.column("text")], pa.binary())], names=["rep", "set"])

    def link(bag: pa.Table) -> pa.Table:
        rows = sorted(zip(bag.column("rep").to_pylist(), bag.column("block").to_pylist(), range(bag.num_rows)))
        sets = bag.column("set").combine_chunks() if bag.num_rows else []
        got = spanning_links([np.frombuffer(sets[i].as_buffer(), np.uint64) for _, _, i in rows], [b for _, b, _ in rows])
        # Texts of one id are one node, whose links to itself say nothing.
        return pa.table([pa.array([rows[x][0] for x, _ in got], pa.int64()), pa.array([rows[y][0] for _, y in got], pa.int64())], names=["a", "b"])

    sets = by_batch(texts, cut, "rep long, set binary", rows=200)
    if repeats:
        sets = sets.dropDuplicates(["rep", "set"])
    return sets.join(placed, "rep").select("rep", "set", "block", "bag").groupBy("bag").applyInArrow(link, "a long, b long").filter("a <> b")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `documents`."""
    rows = settled(signatures(documents), "dup-signatures")
    whole = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = settled(whole.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "u", "v", "sig"))), "dup-classes")
    # An id with several texts ties the classes of all of them.
    key = F.struct("c1", "c2")
    several = whole.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).filter("low <> high").select("doc_id")
    shared = settled(whole.join(several, "doc_id").join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).filter("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "dup-shared")
    groups = components(loose_ties(classes), "dup-groups")
    repeats = not whole.groupBy("doc_id").count().filter("count > 1").isEmpty()
    found = components(settled(confirmed_links(documents, classes, groups, repeats).unionByName(shared), "dup-links"), "dup-components")
    named = classes.select("c1", "c2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    linked = whole.select("doc_id", "n_shingles", "c1", "c2").join(named, ["c1", "c2"]).select("doc_id", "n_shingles", "component_id")
    # Rows without shingles or id never meet a key.
    alone = rows.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """The rows of `documents` without those whose component has a smaller id; one row of a repeated id stays as many times as it is given."""
    gone = near_duplicates(documents).filter("NOT kept").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
