"""Operators 11 to 13 against their brute force in DuckDB, on hostile rows and with several blocks, shards and segments."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from docketry.llm import centroids, decontam, filteraudit, langid, maxscore

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, q string, code string, score double, rank int, row long"


def brute(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return Counter(con.sql(sql).fetchall())


def rows_of(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def hostile(spark):
    """Random vectors, a third of them equal, repeated rows and ids, rows without id, unusable vectors, other lengths."""
    rng = np.random.default_rng(5)
    v = lambda scale=0.3: [float(x) for x in rng.normal(0, scale, 64)]
    hot = v()
    rows = [(i, hot if i % 3 == 0 else v()) for i in range(400)] + [(500 + i, v(3.0)) for i in range(20)]
    rows += [rows[50], rows[50], (50, v()), (None, v()), (None, hot), (None, None), (700, None), (750, [float("nan"), *v()[1:]]), (800, [*v()[1:], float("inf")])]
    rows += [(850, [None, *v()[1:]]), (900, v()[:10]), (950, []), (1000, [0.0] * 64), (-50, [-x for x in hot]), (1050, v() + v())]
    return spark.createDataFrame([(*r, 1, 2, "q", "c", 0.5, 3, 4) for r in rows], VECTORS).repartition(5)


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_centroids_against_all_distances(spark, hostile):
    got = rows_of(centroids.with_inertia(*centroids.cluster(hostile)), CLUSTER)
    assert got == brute(centroids.ORACLE, embeddings=hostile) and sum(got.values()) == 400 + 20 + 3 + 2 + 2
    few = hostile.filter("vec_id between 1 and 5")
    assert rows_of(centroids.with_inertia(*centroids.cluster(few)), CLUSTER) == brute(centroids.ORACLE, embeddings=few)
    table, none = centroids.cluster(hostile.limit(0))
    assert len(none) == 0 and centroids.with_inertia(table, none).count() == 0
    other = rows_of(centroids.cluster(hostile, k=3, rounds=2, scale=8, segments=16)[0], ("vec_id", "cluster", "distance"))
    want = brute(centroids._oracle(3, 2, 8), embeddings=hostile)
    assert other == Counter({k: n for k, n in ((x[:3], m) for x, m in want.items())})


def test_screening_loses_no_centroid():
    rng = np.random.default_rng(1)
    centre = rng.integers(-40, 40, (16, 64))
    centre[9] = centre[4]
    vectors = np.concatenate([centre[rng.integers(0, 16, 900)] + rng.integers(-4, 5, (900, 64)), centre, np.zeros((2, 64), int), rng.integers(-(1 << 24), 1 << 24, (50, 64))])
    cluster, distance, exact = centroids.nearest(vectors, centroids.block_code(vectors), centre, centroids.block_code(centre))
    every = ((vectors[:, None, :] - centre) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert exact < 0.25 * every.size


@pytest.mark.parametrize("bad", [float(1 << 20), -float(1 << 20)])
def test_components_out_of_range_are_an_error(spark, bad):
    rows = spark.createDataFrame([(1, [bad] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<float>")
    for run in (lambda: centroids.cluster(rows), lambda: maxscore.top_k(rows)):
        with pytest.raises(Exception, match="beyond"):
            run()


def test_top_k_against_all_products(spark, hostile, monkeypatch):
    cols = ("query_id", "rank", "vec_id", "score")
    want = brute(maxscore.ORACLE, embeddings=hostile)
    assert rows_of(maxscore.top_k(hostile), cols) == want
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 37)
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 3)
    monkeypatch.setattr(maxscore, "SAMPLE", 20)
    assert rows_of(maxscore.top_k(hostile), cols) == want
    few = hostile.filter("vec_id in (0, 50, 51)")
    assert rows_of(maxscore.top_k(few), cols) == brute(maxscore.ORACLE, embeddings=few)
    assert maxscore.top_k(hostile.limit(0)).count() == 0 and maxscore.top_k(hostile.filter("vec_id = 51")).count() == 0


def test_essential_lists_save_work():
    rng = np.random.default_rng(3)
    sparse = rng.integers(1, 200, (3000, 64)) * (rng.random((3000, 64)) < 0.1)
    shard = maxscore.Shard(sparse, np.arange(3000), np.zeros(3000, bool), np.arange(3000))
    scores = sparse @ sparse[7]
    floor = int(np.sort(np.delete(scores, 7))[-5])
    docs, score = shard.search(sparse[7], 7, floor)
    assert (score == scores[docs]).all() and set(docs) == set(np.nonzero(scores >= floor)[0]) - {7}
    assert len(shard.search(sparse[7], 7, None)[0]) == 2999 and len(shard.search(sparse[7], 7, 1 << 40)[0]) == 0


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT_SQL = f"SELECT {', '.join(AUDIT)} FROM ({filteraudit.ORACLE})"


def test_audit_against_every_order(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", " \n\t", "short", "short", long, long + " #", "AB " * 300, "ab " * 300, "ÄÖÜ é " * 100, "a # b", "x" * 60_000, " ".join(f"v{i}" for i in range(200)), "short"]
    rows = [(i, t, ["en", None, "de", ""][i % 4], 1, "d", 2) for i, t in enumerate(texts * 3)]
    rows += [(None, "short", "en", 1, "d", 2), (None, long, "fr", 1, "d", 2), rows[4], rows[4], (4, "another", "en", 1, "d", 2), (-1, "short", "de", 1, "d", 2), (-1, "short", "en", 1, "d", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, digest string, kept int").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 40, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (5, None, None), (-1, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(filteraudit.audit(docs, labels), AUDIT)
    assert got == brute(AUDIT_SQL, documents=docs, labels=labels) and len(got) == 4 * 600
    assert filteraudit.audit(docs.limit(0), labels).count() == 0
    assert rows_of(filteraudit.audit(docs, labels.limit(0)), AUDIT) == brute(AUDIT_SQL, documents=docs, labels=labels.limit(0))


def test_audit_of_other_filters(spark):
    cells = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", True, True, 2, 0, 2), ("p", False, False, 4, 4, 0)], "part string, x boolean, y boolean, n long, good long, toxic long")
    got = {(r.filter_order, r.step): r for r in filteraudit.interactions(cells, ("x", "y")).collect()}
    assert (got["xy", 1].removed, got["xy", 1].kept, got["xy", 2].removed, got["xy", 2].redundant) == (5, 4, 0, 2)
    assert (got["yx", 1].removed, got["yx", 2].removed, got["yx", 2].redundant, got["yx", 2].unique_fails, got["yx", 1].toxic_lost) == (2, 3, 2, 3, 2)
    assert got["xy", 1].shapley == 8 and got["xy", 2].shapley == 2


def test_short_items_inside_long_documents(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "Quick brown fox"), (3, "quick fox"), (4, "word " * 40 + "alone"), (5, None), (6, "a b c d e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "ALONE"), (3, "b c d e f"), (4, "fox quick"), (5, "")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontam.leaks(docs, items).collect())
    assert got == {(1, 1, 1, 1): 1, (2, 1, 1, 1): 1, (4, 2, 1, 1): 1, (6, 3, 1, 1): 1}
    assert got == brute(f"SELECT doc_id, item_id, n_shingles, n_found FROM ({decontam.ORACLE})", documents=docs, benchmark=items)
    assert decontam.short_lengths(items) == (1, 2, 3) and decontam.without_leaks(docs, items).count() == 2


def test_dictionaries_do_not_depend_on_partitions(spark):
    rows = [(next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2), f"text number {i} of one id " + " ".join(f"w{(i * k) % 97}" for k in range(30)), "en") for i in range(900)] + [(i, f"another {i}", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = [langid.learn_dictionaries(docs.repartition(n, *by)) for n, by in ((1, ()), (3, ()), (5, ("text",)))]
    assert made[0] == made[1] == made[2] and len(made[0]["en"]) > 1000
