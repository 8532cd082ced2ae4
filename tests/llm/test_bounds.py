"""What the operators promise at their edges: recall, probabilities, memory, damaged inputs, ids with several texts, clashing columns."""

import resource
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from docketry.llm import common, decontam, graph, htmltree, langid, mixing, neardup, ngramlm, quality, sharding, toxicity, tsmedia


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_recall_of_planted_near_copies(spark):
    """Every link of 1,500 planted groups, compared in full inside each group; groups share no word."""
    rng = np.random.default_rng(21)
    texts, groups = {}, []
    for g in range(1500):
        n = int(rng.integers(40, 220))
        base, ids = [f"g{g}w{k}" for k in rng.integers(0, n, n)], []
        for _ in range(3):
            w = list(base)
            # Two or three edits of a text this long land on both sides of the threshold.
            for _ in range(int(rng.integers(0, 2 + n // 45))):
                w[int(rng.integers(0, n))] = f"e{rng.integers(0, 10**9)}"
            ids.append(len(texts))
            texts[len(texts)] = " ".join(w)
        groups.append(ids)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    links = near = found = 0
    for ids in groups:
        sets = {i: shingle_set(texts[i]) for i in ids}
        joined = set()
        for a in ids:
            for b in ids:
                if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    links += 1
                    near += sets[a] != sets[b]
                    found += got[a] == got[b]
                    joined |= {a, b}
        assert all(got[i] == i for i in ids if i not in joined)
    assert near > 800 and found / links >= 0.999, (found, links)


def test_ids_with_several_texts_and_texts_without_words(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (3, a), (8, b), (9, None), (2, ""), (2, " "), (7, "alone in here"), (7, "alone in here"), (None, a)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert len(got) == len(rows) and by == {5: 3, 3: 3, 8: 3, 9: 9, 2: 2, 7: 7, None: None}
    assert Counter(r.kept for r in got) == {True: 7, False: 3}


def test_bags_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BAG_SHINGLES", 1000)
    rng = np.random.default_rng(22)
    rows = [(100 * g + i, g, int(rng.integers(5, 60))) for g in range(60) for i in range(int(rng.integers(2, 9)))] + [(10**6 + i, 999, 50) for i in range(90)]
    total = Counter()
    for _, g, n in rows:
        total[g] += n
    members = spark.createDataFrame([(r, g, n, total[g]) for r, g, n in rows], "rep long, component long, n_shingles long, total long")
    placed = neardup.in_bags(members).collect()
    weight, size = Counter(), {r: n for r, _, n in rows}
    for p in placed:
        weight[p.bag] += size[p.rep]
    # Blocks of a large group are dealt by hash, so with eight members each they are only about even.
    assert max(weight.values()) <= 1600 and len(weight) < 140
    bags = {}
    for p in placed:
        bags.setdefault(p.rep, set()).add(p.bag)
    for g in range(60):
        assert len({frozenset(bags[r]) for r, of, _ in rows if of == g}) == 1
    assert all(bags[a] & bags[b] for a, g, _ in rows if g == 999 for b, h, _ in rows if h == 999)


def test_hubs_are_broadcast(spark):
    star = [(0, i) for i in range(1, 400)] + [(1000, i) for i in range(1001, 1300)] + [(5000 - i, 5000) for i in range(1, 200)] + [(399, 1000)]
    edges = spark.createDataFrame(star, "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {n: 0 if n < 1300 else 4801 for e in star for n in e}


def trained(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    return d, held, [words(t) for i, t in rows if not held[i]]


def test_next_word_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(23)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 30).clip(1, 300))) for i in range(3000)]
    d, held, train = trained(spark, rows)
    model = common.settled(ngramlm.gather(d, 4), "t").collect()
    filt = ngramlm.LogFilter(b"".join(bytes(r["filter"]) for r in sorted(model)), [len(r["filter"]) for r in sorted(model)])
    vocabulary = sorted({x for w in train for x in w}) + [ngramlm.END]
    n = sum(len(w) + 1 for w in train)
    assert sum(r.tokens for r in model) == n and sum(r.words for r in model) == len(vocabulary)
    z, h, start = n + 0.5 * (len(vocabulary) + 1), common.hashed_words(vocabulary), common.hashed_words([ngramlm.START])[0]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    score = lambda seq: np.array(ngramlm.score_rows(None or [0] * len(seq), [False] * len(seq), np.concatenate(seq), np.array([len(s) for s in seq]), start, filt.counts, z, *none).column("score"))
    # After the start and after 40 words: 1 on average; a false digit of one count can move one context's sum.
    sums = [(10 ** score([np.array([x]) for x in h])).sum()]
    for before in common.hashed_words([f"w{i}".encode() for i in range(1, 41)]):
        sums.append((10 ** (score([np.array([before, x]) for x in h]) - score([np.array([before])])[0])).sum())
    assert abs(np.mean(sums) - 1) < 0.02 and np.abs(np.array(sums) - 1).max() < 0.2 and np.median(np.abs(np.array(sums) - 1)) < 0.03


def test_opening_words_are_pairs(spark):
    d, _, train = trained(spark, [(i, f"open{i % 3}") for i in range(6000)])
    got = {r.text: r.score for r in ngramlm.score_documents(d).join(d, "doc_id").select("text", "score").distinct().collect()}
    n, z = Counter(x for w in train for x in w), 2 * len(train) + 0.5 * 5
    p = lambda pair, word, before: (pair + ngramlm.PRIOR * (word + 0.5) / z) / (before + ngramlm.PRIOR)
    for text, s in got.items():
        c = n[text.encode()]
        assert abs(10**s / (p(c, c, len(train)) * p(c, len(train), c)) - 1) < 0.04
    assert len(got) == 3 and 0.85 < sum(10**s for s in got.values()) < 1


def test_score_against_exact_counts(spark):
    rng = np.random.default_rng(24)
    rows = [(i, " ".join(f"v{x}" for x in rng.zipf(1.4, int(rng.integers(0, 80))).clip(1, 5000))) for i in range(1500)]
    d, _, train = trained(spark, rows)
    uni, pairs = Counter(), Counter()
    for w in train:
        run = [ngramlm.START, *w, ngramlm.END]
        uni.update(run)
        pairs.update(zip(run, run[1:]))
    n, v = sum(uni.values()) - uni[ngramlm.START], len(uni) - 1
    z = n + 0.5 * (v + 1)
    got = {r.doc_id: r for r in ngramlm.score_documents(d).collect()}
    off = []
    for i, t in rows:
        run = [ngramlm.START, *words(t), ngramlm.END]
        want = sum(np.log10((pairs[a, b] + ngramlm.PRIOR * (uni[b] + 0.5) / z) / (uni[a] + ngramlm.PRIOR)) for a, b in zip(run, run[1:]))
        off.append((got[i].score - want) / (len(run) - 1))
    assert np.abs(off).mean() < 0.01 and np.abs(off).max() < 0.12


def test_a_long_toxic_text_costs_its_own_length():
    model = toxicity.ToxicField(words={"zorg": 9.0}, order={"zorg": 50.0}, moves=np.array([[0.0, -1.0], [-0.5, 0.0]]))
    texts = ["you zorg " * 10_000] + [f"a calm line with one zorg in it {i}" for i in range(999)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = toxicity.evidence(model, toxicity.Reader(model.words, model.order), texts)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    alone = [toxicity.evidence(model, toxicity.Reader(model.words, model.order), [t])[0] for t in texts[:3]]
    assert np.allclose([x[0] for x in got[:3]], [x[0] for x in alone]) and len(got[0][2]) >= 10_000 and np.isfinite([x[0] for x in got]).all()


def test_moves_stay_finite_beside_padding():
    model = toxicity.ToxicField(bias=800.0, moves=np.zeros((2, 2)))
    p, moves, z = model.marginals(np.full((2, 40), 50.0), np.array([1, 40]), np.ones(2))
    assert np.isfinite(moves).all() and np.isfinite(z).all() and np.isclose(moves.sum(), 2 + 41) and p[0, 1:].sum() == 0


def test_language_by_brute_force_and_without_letters(spark):
    import zstandard as z

    rng = np.random.default_rng(25)
    line = lambda lang: " ".join(f"{lang}{x}" for x in rng.integers(0, 50, 60))
    rows = [(i, line("ab" if i % 2 else "cd"), "xx" if i % 2 else "yy") for i in range(80)]
    rows += [(100, "² ½ Ⅷ 12", "xx"), (101, "12 + 13", None), (102, "é" * 9000, None), (103, "", "xx"), (104, None, "xx"), (105, rows[0][1] + " " + rows[1][1], None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dictionaries = langid.learn_dictionaries(d)
    got = {r.doc_id: r for r in langid.identify(d, dictionaries).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (100, 101, 103, 104)) and got[102].lang_pred != "und"
    for i, text, _ in rows[:20] + rows[-1:]:
        raw, size = text.lower().encode(), {}
        for lang, dictionary in dictionaries.items():
            pack = z.ZstdCompressor(level=langid.LEVEL, dict_data=z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False)
            size[lang] = sum(len(pack.compress(raw[k : k + langid.BLOCK_BYTES] + langid.CARRIER)) for k in range(0, len(raw), langid.BLOCK_BYTES))
        assert abs(size[got[i].lang_pred] - min(size.values())) <= 4
    assert langid.decide("tie", langid.Packers({"b": b"same words here", "a": b"same words here"}))[0] == "a"


def packet(pid, counter, body, start=False, adaptation=b""):
    field = bytes([len(adaptation)]) + adaptation if adaptation else b""
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if adaptation else 0x10) | counter & 15])
    return (head + field + body).ljust(188, b"\xff")


def test_streams_of_other_writers():
    payload = bytes(range(256)) * 40
    stored = tsmedia.write_stream(payload)
    parts = [stored[i : i + 188] for i in range(0, len(stored), 188)]
    # A packet that is sent twice is read once.
    twice = tsmedia.read_stream(b"".join(parts[:6] + [parts[5]] + parts[6:]))
    assert twice.payload == payload and twice.continuity_errors == 0
    # A jump of the counter that the stream announces is no error.
    jump = bytearray(parts[-1])
    jump[3], jump[5] = jump[3] & 0xF0 | (jump[3] + 5) & 15, jump[5] | 0x80
    assert tsmedia.read_stream(b"".join([*parts[:-1], bytes(jump)])).continuity_errors == 0
    # A program table of many packets: 60 programs before the one whose map follows.
    body = b"".join(bytes([0, 0, 0xE0 | 0x1F, 0xF0]) for _ in range(60)) + bytes([0, 1, 0xE1, 0x00])
    section = b"\0" + tsmedia._section(0, 1, body)
    tables = [packet(0, k, section[at : at + 184], k == 0) for k, at in enumerate(range(0, len(section), 184))]
    long = tsmedia.read_stream(b"".join(tables + parts[1:]))
    assert len(tables) == 2 and long.payload == payload and long.table_errors == 0


def test_no_bytes_make_the_reader_fail():
    rng = np.random.default_rng(26)
    stored = tsmedia.write_stream(bytes(range(256)) * 300)
    for turn in range(600):
        raw = bytearray(stored[: int(rng.integers(1, len(stored)))])
        for _ in range(int(rng.integers(1, 60))):
            at = int(rng.integers(0, min(len(raw), 3000 if turn % 2 else len(raw))))
            raw[at] = int(rng.integers(0, 256))
        got = tsmedia.read_stream(bytes(raw))
        assert isinstance(tsmedia.describe(got), str) and got.units >= len(got.access)
    oversized = packet(0, 0, b"", True, b"\0" * 183)[:188]
    no_streams = packet(0, 0, b"\0" + tsmedia._section(0, 1, bytes([0, 1, 0xE1, 0x00])), True) + packet(0x100, 0, b"\0" + tsmedia._section(2, 1, bytes([0xE1, 1, 0xF0, 0])), True)
    assert tsmedia.read_stream(bytes([0x47, 0x40, 0, 0x30, 255]) + b"\0" * 183).pmt_pid is None and tsmedia.read_stream(oversized).pmt_pid is None
    assert tsmedia.read_stream(no_streams).data_pid is None


def test_deep_pages_are_read_in_linear_time():
    import time

    for page in ("<span>" * 30_000 + "</b>" * 30_000, "<span>" * 30_000 + "<div></div>" * 30_000, "<li><ul>" + "<span>" * 30_000 + "<li></li>" * 30_000):
        began = time.perf_counter()
        htmltree.parse(page)
        assert time.perf_counter() - began < 8


def test_repeated_pages_have_equal_texts(spark):
    page = "<body><article><h1>One title</h1><p>A long enough paragraph of the story, with commas, and with an end.</p></article></body>"
    d = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, page + "<div>" * 3000)], "page_id long, url string, html string")
    got = htmltree.main_text(d).collect()
    assert len(got) == 3 and len({r.text for r in got}) == 1 and got[0].text


CLASHES = "row key bytes bucket offset position nth part number mixed id times mix_id mix_times mix_copy _key _bucket _offset h start copy cuts s b law shard slot grown_shard text_crc32 Size"


def test_columns_that_clash_with_ours(spark):
    extra = CLASHES.split()
    rows = [(i, f"word{i} " * (i + 1), "ab"[i % 2], *[str(i)] * len(extra)) for i in range(30)]
    d = spark.createDataFrame(rows, ["doc_id", "text", "source", *extra])
    mixed = mixing.mixed_rows(d)
    assert mixed.columns == d.columns and mixed.count() > 0 and all(r.key == str(r.doc_id) for r in mixed.collect())
    done = sharding.sharded_documents(d).collect()
    assert len(done) == 30 and all(r._key == r.bucket == r.row == str(r.doc_id) and isinstance(r.slot, int) for r in done)
    assert neardup.without_near_duplicates(d).columns == decontam.without_leaks(d, d.limit(0).withColumnRenamed("doc_id", "item_id")).columns == d.columns
    assert ngramlm.score_documents(d).count() == quality.score_quality(d, quality.AdditiveModel().fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).count() == 30


@pytest.mark.parametrize("null_id", [True, False])
def test_rows_without_end_that_are_equal(spark, monkeypatch, null_id):
    monkeypatch.setattr(sharding, "HOT_ROWS", 50)
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1)
    rows = [(None if null_id else 7, "the same row", "a")] * 700 + [(100 + i, f"other {i}", "b") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    key = sharding.F.xxhash64("doc_id", "text")
    spread = sharding.scattered(common.boxed(d, key=key, bytes=sharding.row_bytes(d)))
    groups = [r["count"] for r in spread.groupBy("key").count().collect()]
    assert max(groups) == 50 and sum(groups) == 1000 and groups.count(50) == 14
    digest = lambda x: Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in x.collect())
    assert digest(sharding.sharded_documents(d)) == digest(sharding.sharded_documents(d.repartition(3)))
    got = mixing.mix(d, 8).collect()
    assert len(got) == 1000 and abs(sum(r.taken for r in got if r.source == "a") - got[0].target if got[0].source == "a" else 0) <= 1
    assert all(r.taken <= 2 * r["size"] for r in got)


def test_heavy_rows_that_are_equal(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_BYTES", 50_000)
    rows = [(7, "x" * 20_000)] * 40 + [(8, "y" * 70_000)] * 3 + [(100 + i, f"other {i}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spread = sharding.scattered(common.boxed(d, key=sharding.F.xxhash64("doc_id", "text"), bytes=sharding.row_bytes(d)))
    sizes = sorted(r["n"] for r in spread.groupBy("key").agg({"bytes": "sum"}).toDF("key", "n").collect())
    assert len(sizes) == 20 + 3 + 60 and sizes[-4] <= 50_000 < sizes[-3]
    digest = lambda x: Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in x.collect())
    assert digest(sharding.sharded_documents(d)) == digest(sharding.sharded_documents(d.repartition(3)))


def test_slices_by_bytes():
    lengths = [5, 0, 900, 3, 3, 3, 2000, 1, None]
    batch = pa.record_batch([pa.array(["é" * (n // 2) + "a" * (n % 2) if n is not None else None for n in lengths]), pa.array(range(9))], names=["text", "n"])
    assert list(common.slice_lengths(batch, 3, 1000)) == [3, 3, 1, 2]
    assert list(common.slice_lengths(batch, 100, 10)) == [2, 1, 3, 1, 2] and list(common.slice_lengths(batch.slice(0, 0), 3, 10)) == []
    assert list(common.slice_lengths(batch.slice(6), 100, 10)) == [1, 2]


def test_an_id_with_very_many_texts(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    d = spark.createDataFrame([(1, text(i)) for i in range(400)] + [(1, text(0))] * 200 + [(2, text(399)), (3, text(1000))], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(d).collect())
    assert got == {(1, 1, True): 600, (2, 1, False): 1, (3, 3, True): 1}


def test_very_many_sources(spark):
    d = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', 40) as text", "cast(id as string) as source")
    got = mixing.mix(d, 16).agg({"taken": "sum", "target": "sum", "*": "count"}).first()
    assert got["count(1)"] == 6000 and abs(got["sum(taken)"] - got["sum(target)"]) < 6000


def test_items_and_documents_with_several_texts(spark):
    line = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    bench = [(1, line("p", 14)), (1, line("q", 14)), (2, line("r", 12)), (3, "two words"), (None, line("p", 14)), (4, None), (5, line("p", 14))]
    docs = [(1, line("p", 14)), (2, line("p", 14) + " and " + line("q", 14)), (3, line("p", 14)), (3, line("q", 14)), (4, line("r", 12).upper()), (4, line("r", 12)), (5, "two words"), (None, line("r", 12)), (6, None)]
    b, d = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda rows: sorted((int(r[0]), int(r[1]), int(r[2]), int(r[3]), round(r[4], 9)) for r in rows)
    con, bp, dp = duckdb.connect(), b.toPandas(), d.toPandas()
    con.register("bp", bp), con.register("dp", dp)
    con.sql("CREATE VIEW benchmark AS SELECT item_id::BIGINT AS item_id, text FROM bp; CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM dp")
    want = key(con.sql(f"SELECT doc_id, item_id, n_shingles, n_found, containment FROM ({decontam.ORACLE})").fetchall())
    assert key(decontam.leaks(d, b).collect()) == want and (1, 5, 10, 10, 1.0) in want and (2, 1, 20, 20, 1.0) in want and not [w for w in want if w[:2] == (1, 1)]


def test_scores_are_sums_of_table_cells():
    rng = np.random.default_rng(27)
    x = rng.random((800, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.1, 800) > 0.8).astype(float)
    model = quality.AdditiveModel().fit(x, y)
    for row, got in zip(x[:40], model.score(x[:40])):
        cell = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        raw = model.base + sum(t[c] for t, c in zip(model.tables, cell)) + sum(t[cell[i], cell[j]] for (i, j), t in model.pair_tables.items())
        assert np.isclose(got, 1 / (1 + np.exp(-raw)))


def test_only_local_sessions_may_go_without_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.shared_folder(Session)
    Session.sparkContext.master = "local[4]"
    assert common.shared_folder(Session) == common.LOCAL_SHARED
