"""Each operator on hostile rows: nulls anywhere, empty and very long texts, ties, repeats, empty tables, clashing extra columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docketry.llm import decontam, graph, htmltree, langid, mixing, neardup, ngramlm, quality, sharding, toxicity, tsmedia

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, position long, h string"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [
    None, "", "   \n\t ", "a", "One two three four five.", "One two three four five.", "ONE two three four five.", LONG, "x" * 50_000,
    "the quick brown fox jumps over the lazy dog again and again", "the quick brown fox jumps over the lazy dog again and again", "über die brücke läuft 2 mal   der hund", "你好",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], ["b", "a", None][i % 3], 1, 0.5, 7, 3, "h") for i, t in enumerate(TEXTS)]
    rows += [(None, "a row without an id but with words", None, None, None, None, None, None, None), rows[9], rows[9]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_language(docs, none):
    learned = langid.learn_dictionaries(docs)
    got = langid.identify(docs, learned).collect()
    assert len(got) == docs.count() and set(learned) <= {"en", "de"}
    for r in got:
        assert r.lang_pred in {*learned, "und"} and 0 <= r.score <= 1
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[0] == by[1] == by[2] == "und"
    assert langid.learn_dictionaries(none) == {} and langid.identify(none, learned).count() == 0
    assert langid.decide("words", langid.Packers({}))[0] == "und"


def test_dictionaries_are_filled_from_whole_texts(spark):
    rng = np.random.default_rng(12)
    few = [(i, "masthead in a foreign tongue " * 20 + " ".join(f"w{x}" for x in rng.integers(0, 9999, 4000)), "xx") for i in range(30)]
    many = [(i, f"short text {i}", "yy") for i in range(100, 140)]
    got = langid.learn_dictionaries(spark.createDataFrame(few + many, "doc_id long, text string, lang string"))
    assert 0.99 * langid.DICTIONARY_BYTES <= len(got["xx"]) <= langid.DICTIONARY_BYTES
    assert got["xx"].count(b"masthead") < 0.1 * len(got["xx"]) / 29 and got["yy"].count(b"short text") > 20
    assert langid.byte_shares([5, 100, 50], 60) == [5, 28, 27]
    raw = bytes(range(256)) * 8
    assert len(langid.pieces_of(raw, 700, 1)) == 700 and langid.pieces_of(raw, 5000, 1) == raw


def test_language_held_out_accuracy(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(d, langid.learn_dictionaries(d)).filter("held_out").join(d.select("doc_id", "lang"), "doc_id").filter("lang is not null")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.93


def test_mixing_against_targets(docs, none, spark):
    got = mixing.mix(docs, 4).collect()
    assert len(got) == docs.count() and mixing.mix(none).count() == 0
    sizes = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and (r["size"] or r.taken == 0)
        sizes[r.source] += r["size"]
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == sizes[r.source]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    # Brute-force targets by repeated resharing.
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        if not over:
            want |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        free -= over
    assert all(abs(want[s] - target[s]) < 1e-6 * max(1, want[s]) for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), 4).collect()))


def test_schedule_is_low_discrepancy(spark):
    docs = spark.createDataFrame([(i, "w " * 40, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    quotas = mixing.settled(mixing.with_quotas(mixing.source_targets(mixing.sized(docs)), 16), "t")
    rows = sorted((r.position, r.source) for r in mixing.schedule(quotas, 16).collect())
    share = {r.source: r.slots / r.all_slots for r in quotas.collect()}
    n = Counter()
    for i, (_, s) in enumerate(rows, 1):
        n[s] += 1
        assert abs(n[s] - i * share[s]) < 6
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_main_text(spark):
    filler = "Long enough to be the story of a page, with commas, and more than one sentence. It goes on here."
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B&nbsp;title</h1><p>{filler}<p>Second\n  <b>para</b>graph&#33; {filler}<script>var a='<p>no</p>';</script></article><form><label>Name</label></form><div class=comments><p>I, a reader, disagree with this. Strongly.</p></div><footer>&copy; 2020</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<<>&& <p"), (5, "u", "<p>" * 3000), (None, None, page)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in htmltree.main_text(d).collect()}
    assert got[1].text == f"A & B title\n{filler}\nSecond paragraph! {filler}" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[None].text == got[1].text
    assert htmltree.main_text(d.limit(0)).count() == 0


def test_tree_marginals_are_exact():
    page = htmltree.parse("<div><p>a</p><div><b>c</b></div></div>")
    x = htmltree.matrix(page)
    rng = np.random.default_rng(0)
    model = htmltree.TreeModel(rng.normal(size=len(htmltree.FEATURES)), rng.normal(size=(2, 2, 2)))
    n, u = len(page.nodes), x @ model.weights
    total, ones = 0.0, np.zeros(n)
    for bits in range(2**n):
        s = [(bits >> i) & 1 for i in range(n)]
        w = np.exp(sum(u[i] * s[i] for i in range(n)) + sum(model.edges[int(v.tag in htmltree._BLOCK)][s[v.parent], s[i]] for i, v in enumerate(page.nodes) if i))
        total += w
        ones += w * np.array(s)
    assert np.allclose(model.marginals(page, x @ model.weights)[0], ones / total) and np.allclose(model.potentials(page), x @ model.weights)


def test_toxicity(spark, docs, none, labels):
    clean, bad = "the river runs past the old mill and the farm", "you utter zorgblat and your friends the zorgblat gang"
    model = toxicity.fit_field(spark.createDataFrame([(True, bad)] * 20 + [(False, clean)] * 60, "toxic boolean, text string"))
    assert "zorgblat" in model.words
    d = spark.createDataFrame([(1, "Hello, ZORGBLAT!! zorgblat"), (2, clean), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, model).collect()}
    assert got[1].predicted == 1 and got[1].spans[0].start == 7 and got[1].spans[0].end == 26
    assert got[2].predicted == got[3].predicted == got[4].predicted == 0
    fitted = toxicity.learn(docs, labels)
    assert toxicity.score_toxicity(docs, fitted).count() == docs.count() and toxicity.score_toxicity(none, fitted).count() == 0
    assert toxicity.learn(none, labels).words == {}


def test_class_caps_keep_the_share_of_toxic_documents(spark):
    rng = np.random.default_rng(13)
    text = lambda y: " ".join([f"w{x}" for x in rng.integers(0, 300, 12)] + ["zorgblat"] * bool(y or rng.random() < 0.1))
    toxic = {i: int(i % 10 == 0) for i in range(3000)}
    d = spark.createDataFrame([(i, text(y)) for i, y in toxic.items()], "doc_id long, text string")
    l = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    score = lambda model: {r.doc_id: r.score for r in toxicity.score_toxicity(d, model).collect()}
    whole, capped = score(toxicity.learn(d, l)), score(toxicity.learn(d, l, 100, 200))
    share = sum(toxic.values()) / len(toxic)
    assert abs(np.mean(list(whole.values())) - share) < 0.03 and abs(np.mean(list(capped.values())) - share) < 0.03


def test_field_marginals_are_exact():
    rng = np.random.default_rng(1)
    model = toxicity.ToxicField(bias=0.3, moves=rng.normal(size=(2, 2)))
    w, m = rng.normal(size=(1, 4)), 3
    total, ones = 0.0, np.zeros(4)
    for bits in range(2**m):
        s = [0, *((bits >> i) & 1 for i in range(m)), 0]
        v = np.exp(sum((w[0, i] + model.bias) * s[i + 1] for i in range(m)) + sum(model.moves[a, b] for a, b in zip(s, s[1:])))
        total += v
        ones[:m] += v * np.array(s[1:-1])
    assert np.allclose(model.marginals(w, np.array([m]))[0][0], ones / total)


def test_sharding(docs, none):
    whole = sharding.sharded_documents(docs)
    got = sharding.shard_digest(sharding.shard_table(docs)).collect()
    n = docs.count()
    assert len(got) == n and sharding.sharded_documents(none).count() == 0 and sharding.shard_table(none).count() == 0
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))
    assert max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(16)) <= 1
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert by[i]["size"] == len(raw) + 1 and by[i].text_crc32 == zlib.crc32(raw) and by[i].grown_shard is None
    key = lambda rows: sorted((str(r.doc_id), r.shard, r.slot) for r in rows)
    assert key(got) == key(sharding.sharded_documents(docs.repartition(5)).collect())
    assert sorted(r.text or "" for r in whole.collect()) == sorted(r.text or "" for r in docs.collect())


def test_shuffle_over_many_buckets(spark):
    d = spark.range(2000).selectExpr("id as doc_id", "cast(id as string) as text")
    got = [r.doc_id for r in sharding.external_shuffle(d, ["doc_id"], bucket_bytes=1000).orderBy("position").collect()]
    assert sorted(got) == list(range(2000)) and abs(np.corrcoef(got, np.arange(2000))[0, 1]) < 0.1


def test_streams(docs, none):
    got = tsmedia.media_digest(tsmedia.with_media(docs))
    by = {r.doc_id: r for r in got.collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_bytes % 188 == 0 and "continuity_errors=0" in r.feature
    assert by[4].media_sha256 == by[5].media_sha256 and len(by[7].access_points) == -(-by[7].payload_bytes // tsmedia.UNIT_BYTES)
    assert tsmedia.media_digest(tsmedia.with_media(none)).count() == 0


def test_stream_damage_is_counted():
    payload = bytes(range(256)) * 300
    stored = tsmedia.write_stream(payload)
    whole = tsmedia.read_stream(stored)
    assert whole.payload == payload and whole.stamps == [0, 3600, 7200] and [p for _, p in whole.access] == whole.stamps
    lost = tsmedia.read_stream(stored[: 188 * 9] + stored[188 * 10 :])
    assert lost.continuity_errors == 1 and lost.payload != payload
    assert tsmedia.read_stream(b"").packets == 0 and tsmedia.read_stream(b"x" * 400).sync_errors == 2
    torn = bytearray(stored)
    torn[10] ^= 1
    got = tsmedia.read_stream(bytes(torn))
    assert got.table_errors == 1 and got.pmt_pid is None and got.payload == b""


def test_quality(spark, docs, none, labels, sf):
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.score_quality(none, model).count() == 0 and quality.keep_good(docs, model).columns == docs.columns
    empty = quality.fit_quality(none, labels)
    assert {round(r.score, 6) for r in quality.score_quality(docs, empty).collect()} == {0.5}
    d, l = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.score_quality(d, quality.fit_quality(d, l)).filter("held_out").join(l, "doc_id").filter("quality is not null")
    assert held.filter("quality = predicted").count() / held.count() > 0.9


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel().fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and (0, 1) in model.pair_tables


def test_language_model(docs, none, spark):
    got = ngramlm.score_documents(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows) and ngramlm.score_documents(none).count() == 0
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter()
    for r in rows:
        if not held(r.doc_id):
            counts.update([*words(r.text), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for r in rows:
        w = [*words(r.text), b"\n"]
        want[r.doc_id].append((len(w), sum(x in counts for x in w), sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    for r in got:
        tokens, known, base = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, held(r.doc_id)) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert np.isfinite(r.score) and r.score < 0


def test_log_filter_counts():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = rng.zipf(1.6, 20_000).clip(1, 10**6)
    raw = ngramlm.build_segment(keys, counts)
    filt = ngramlm.LogFilter(raw, [len(raw)])
    got = filt.counts(keys)
    assert np.median(np.abs(np.log(got / counts))) < 0.05 and (got >= counts / 1.3).all()
    common = counts > 20
    assert np.median(np.abs(np.log(got[common] / counts[common]))) < 0.02
    absent = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    assert (filt.counts(absent) > 0).mean() < 0.03


def test_language_model_keeps_every_count_beyond_the_broadcast_bound(spark, docs, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"r{x}" for x in rng.integers(0, 4000, 60))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).repartition(3)
    key = lambda got: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect())
    want = key(ngramlm.score_documents(d))
    monkeypatch.setattr(ngramlm, "FILTER_BYTES", 2000)
    monkeypatch.setattr(ngramlm, "ASK_TOKENS", 1500)
    assert key(ngramlm.score_documents(d)) == want
    assert ngramlm.score_documents(d.limit(0)).count() == 0


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def test_near_duplicates_against_brute_force(spark, docs, none):
    rng = np.random.default_rng(4)
    texts = {}
    for g in range(12):
        base = [f"w{g}x{k}" for k in rng.integers(0, 400, int(rng.integers(6, 150)))]
        for _ in range(int(rng.integers(1, 14))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"e{rng.integers(0, 10**6)}"
            texts[len(texts)] = " ".join(w)
    texts |= {len(texts) + i: t for i, t in enumerate(TEXTS)}
    want, sets = brute_components(texts)
    d = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, component string")
    got = {r.doc_id: r for r in neardup.near_duplicates(d).collect()}
    assert {i: got[i].component_id for i in texts} == want
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in texts)
    more = neardup.near_duplicates(docs).collect()
    assert len(more) == docs.count() and [r.kept for r in more if r.doc_id is None] == [True]
    assert neardup.near_duplicates(none).count() == 0 and neardup.without_near_duplicates(docs).columns == docs.columns


@pytest.mark.parametrize("carriers", [1, 12])
def test_low_ids_in_every_bucket_part_no_pair(spark, carriers):
    rng = np.random.default_rng(8)
    width, side = neardup.WIDTH, neardup.SIDE
    draw = lambda n: rng.integers(0, 2**62, n)
    u, v, sig = draw(side), draw(side), rng.integers(-128, 128, 2 * side * width)
    rows = []
    for t in range(side * side * carriers):
        i, j = t // carriers // side, t // carriers % side
        cu, cv, cs = draw(side), draw(side), (sig + 1 + rng.integers(0, 255, len(sig)) + 128) % 256 - 128
        cu[i], cv[j] = u[i], v[j]
        for at in (i * width, (side + j) * width):
            cs[at : at + width] = sig[at : at + width]
        rows.append((t, cu.tolist(), cv.tolist(), cs.tolist()))
    for k in (1_000_000, 1_000_001):
        nu, nv, ns = u.copy(), v.copy(), sig.copy()
        if k % 2:
            nu[0], nv[3], ns[0], ns[side * width + 6] = 1, 1, (ns[0] + 129) % 256 - 128, (ns[side * width + 6] + 129) % 256 - 128
        rows.append((k, nu.tolist(), nv.tolist(), ns.tolist()))
    classes = spark.createDataFrame(rows, "rep long, u array<long>, v array<long>, sig array<tinyint>")
    got = {r.node: r.component for r in graph.components(neardup.loose_ties(classes)).collect()}
    assert got.get(1_000_000, -1) == got.get(1_000_001, -2)


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BAG_SHINGLES", 600)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, 120))] = f"e{rng.integers(0, 30)}"
        texts[i] = " ".join(w)
    want, _ = brute_components(texts)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    up = list(range(500))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}


def test_decontamination(spark, docs, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, ""), (None, item), (1, item)], "item_id long, text string")
    d = spark.createDataFrame([(1, LONG + " " + item.upper() + " " + LONG), (2, "alpha beta gamma delta epsilon zeta"), (3, "a Short  Item"), (4, "short item"), (5, None), (None, item)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontam.leaks(d, bench).collect())
    assert got == [(1, 1, 8, 8), (3, 2, 1, 1), (4, 2, 1, 1)]  # an item of two words is found inside a longer text
    assert sorted(str(r.doc_id) for r in decontam.without_leaks(d, bench).collect()) == ["2", "5", "None"]
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.without_leaks(docs, bench).columns == docs.columns


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    names, rows = d.columns, d
    for _, stage in p.STAGES[:3]:
        after = p.settled(stage(spark, rows, sf), "t")
        assert after.columns == names and after.join(rows, "doc_id", "left_anti").count() == 0
        rows = after
    assert rows.count() < d.count() and p.near_dedup(spark, rows, sf).count() == rows.count()
    assert decontam.leaks(rows, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    texts = {r.doc_id: r.text for r in rows.collect()}
    comp, _ = brute_components(texts)
    assert all(comp[i] == i for i in texts)
    # The mix: each document as often as a plain walk through the shuffled sources takes its text.
    mixed = p.settled(p.mix_sources(spark, rows, sf), "t")
    assert mixed.columns == names
    want = plain_mix([(r.doc_id, r.source, r.text) for r in rows.collect()])
    assert Counter(r.doc_id for r in mixed.collect()) == +Counter(want)
    # The shards: all rows, counts at most one apart, slots without a gap.
    got = p.shard(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in got) == +Counter(want)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def plain_mix(rows):
    """doc -> copies, by brute force: targets by resharing, then tokens from the start of each source's shuffle."""
    size = {i: len(words(t)) for i, _, t in rows}
    total, sources = Counter(), defaultdict(list)
    for i, s, _ in rows:
        total[s] += size[i]
        sources[s].append(i)
    order = sorted([s for s in sources if s is not None]) + [None] * (None in sources)
    weight, cap, left, free, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {s: 2.0 * total[s] for s in order}, 1.5 * sum(size.values()), set(order), {}
    while over := {s for s in free if left / sum(weight[x] for x in free) * weight[s] > cap[s]}:
        target |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        free -= over
    target |= {s: left / sum(weight[x] for x in free) * weight[s] for s in free}
    out = {}
    for s in order:
        at, take = 0, round(target[s])
        for i in sorted(sources[s], key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()):
            took = sum(max(0, min(size[i], take - k * total[s] - at)) for k in (0, 1))
            out[i] = int(took / size[i] + 0.5) if size[i] else 1
            at += size[i]
    return out


def test_pipeline_on_hostile_tables(spark, docs, none, labels):
    import corpus_pipeline as p

    tables = {"labels": labels, "benchmark": spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string")}
    old, p._table = p._table, lambda spark, sf_dir, name: tables[name]
    try:
        for start in (docs, none):
            rows = start
            for k, (name, stage) in enumerate(p.STAGES):
                before, rows = rows, p.settled(stage(spark, rows, ""), "hostile")
                assert rows.columns == start.columns if k < 4 else {"shard", "slot", "law"} <= set(rows.columns)
                assert before.count() or not rows.count()
    finally:
        p._table = old
