"""Page layout and addresses against brute force."""

import ipaddress
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.functions import addresses
from docketry.operators import layout
from docketry.sources import readers

REGION = "page_id long, region_id long, type string, confidence double, x1 double, y1 double, x2 double, y2 double, page_width double, page_height double"


def random_regions(seed, pages=12, most=14):
    rng = np.random.default_rng(seed)
    kinds = ["table", "chart", "figure", "text", "text", "title", "caption", "header", "footer", "odd"]
    out = []
    for p in range(pages):
        for i in range(int(rng.integers(1, most))):
            x, y = rng.integers(0, 400, 2)
            w, h = rng.integers(20, 260, 2)
            if out and i and rng.random() < 0.3:  # a near copy of the one before
                x, y, w, h = out[-1][4], out[-1][5], out[-1][6] - out[-1][4], out[-1][7] - out[-1][5] - 1
            out.append((p, i, str(rng.choice(kinds)), float(rng.integers(1, 4)) / 4, float(x), float(y), float(x + w), float(y + h), 700.0, 800.0))
    return out


def common(a, b):
    return max(0, min(a[6], b[6]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[5], b[5]))


def size(a):
    return max(0, a[6] - a[4]) * max(0, a[7] - a[5])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_against_the_sequential_rule(spark, seed):
    rows = random_regions(seed)
    rank = lambda r: layout.PRIORITY.get(r[2], 1)
    want = set()
    for p in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-rank(r), -r[3], r[1])):
            held = lambda k, r=r: (rank(k) > rank(r) and common(k, r) >= 0.8 * size(r)) or (rank(k) == rank(r) and common(k, r) >= 0.9 * (size(k) + size(r) - common(k, r)))
            if not any(held(k) for k in kept):
                kept.append(r)
        want |= {(p, r[1]) for r in kept}
    got = layout.without_overlaps(spark.createDataFrame(rows, REGION).repartition(4))
    assert {(r.page_id, r.region_id) for r in got.collect()} == want and len(want) < len(rows)
    none = spark.createDataFrame([], REGION)
    assert layout.without_overlaps(none).count() == 0 and layout.region_order(none).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_order_is_whole_and_its_agreement_counted(spark, seed):
    rows = random_regions(seed)
    df = spark.createDataFrame(rows, REGION).repartition(4)
    ordered = layout.region_order(df)
    by_page, caption = {}, {}
    for r in ordered.collect():
        by_page.setdefault(r.page_id, {})[r.region_id] = r.place
        if r.parent is not None:
            caption[r.page_id, r.region_id] = r.parent
    kind, box = {(r[0], r[1]): r[2] for r in rows}, {(r[0], r[1]): r for r in rows}
    for p, places in by_page.items():
        assert sorted(places.values()) == list(range(len([r for r in rows if r[0] == p])))
        flows = [{"header": 0, "footer": 2}.get(kind[p, i], 1) for i, _ in sorted(places.items(), key=lambda x: x[1])]
        assert flows == sorted(flows)
    for (p, c), parent in caption.items():
        between = {i for i, at in by_page[p].items() if min(by_page[p][c], by_page[p][parent]) < at < max(by_page[p][c], by_page[p][parent])}
        assert kind[p, c] == "caption" and all(caption.get((p, i)) == parent for i in between)
        assert (by_page[p][c] < by_page[p][parent]) == (box[p, c][5] < box[p, parent][5])
    for r in layout.order_agreement(ordered, df).collect():
        mine = sorted((x for x in rows if x[0] == r.page_id), key=lambda x: (math.floor(x[5] / 8 + 0.5), x[4], x[1]))
        seq = [by_page[r.page_id][x[1]] for x in mine]
        bad = sum(a > b for i, a in enumerate(seq) for b in seq[i + 1 :])
        n = len(seq)
        assert (r.n, r.inversions) == (n, bad) and r.tau == pytest.approx(1 - 4 * bad / (n * (n - 1)) if n > 1 else 1.0)


def test_cuts():
    two = [(0, 0, 100, 20), (300, 0, 400, 20), (0, 30, 100, 50), (300, 30, 400, 50)]
    assert [i for i, _, _ in layout.cut_order(two, 400, 100)] == [0, 2, 1, 3]
    mixed = [(0, 0, 10, 10), (5, 5, 20, 20)]
    assert [(i, s) for i, _, s in layout.cut_order(mixed, 100, 100)] == [(0, 0.6), (1, 0.6)]
    assert layout.cut_order([], 1, 1) == []


def test_spans_and_headers(spark):
    rows = [("Year", 0, 0, 40, 10), ("Assets and debts", 60, 0, 260, 10), ("Cash", 60, 20, 100, 30), ("Loans", 160, 21, 210, 31), ("2023", 0, 40, 40, 50), ("1,200", 60, 41, 110, 51), ("(7)", 170, 40, 200, 50), ("2024", 0, 60, 40, 70), ("900", 60, 60, 100, 70), ("5 %", 165, 61, 200, 71)]
    cells = spark.createDataFrame([(1, i, float(a), float(b), float(c), float(d), t) for i, (t, a, b, c, d) in enumerate(rows)], "page_id int, cell_id int, x1 double, y1 double, x2 double, y2 double, text string")
    got = {r.text: (r.row, r.col, r.col_span, r.is_header) for r in layout.spanning_cells(cells).collect()}
    assert got["Assets and debts"] == (0, 1, 2, True) and got["Year"] == (0, 0, 1, True) and got["Loans"] == (1, 2, 1, True)
    assert got["2023"] == (2, 0, 1, False) and got["(7)"] == (2, 2, 1, False) and got["5 %"] == (3, 2, 1, False)


def test_assembly_faults(spark):
    pages = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "source_id long, page_id long, page_number long")
    block = "page_id long, block_id long, place long, text string, confidence double, bbox array<double>"
    text = spark.createDataFrame([(10, 1, 5, "b", 0.5, [0.0, 0.0, 1.0, 1.0]), (10, 2, 1, "a", 1.0, None), (20, 1, 0, "c", 1.5, [3.0, 0.0, 1.0, 1.0]), (20, 1, 2, "c again", 0.5, None), (99, 1, 0, "of no page", 1.0, None)], block)
    title = spark.createDataFrame([(10, 1, 0, "T", 0.9, None)], block)
    got = layout.assembled(pages, text=text, title=title)
    by = {r.page_id: r for r in got.collect()}
    assert [(b.type, b.text, b.reading_order_index) for b in by[10].blocks] == [("title", "T", 0), ("text", "a", 1), ("text", "b", 2)] and by[10].counts == {"text": 2, "title": 1}
    assert by[11].status == "blank" and by[11].n_blocks == 0 and by[10].blocks[1].bbox_unavailable_reason == "not_located"
    assert {r.page_id: r.faults for r in layout.broken_invariants(got).collect()} == {20: ["repeated_block", "confidence", "location"]}
    docs = {r.source_id: r for r in layout.documents(got).collect()}
    assert docs[1].markdown == "# T\n\na\n\nb" and docs[1].n_pages == 2 and docs[1].confidence == pytest.approx(0.8)
    want = spark.createDataFrame([(10, "text", 3), (10, "title", 1), (11, "table", 1)], "page_id long, type string, n int")
    assert {tuple(r) for r in layout.missing_outputs(got, want).collect()} == {(10, "text", 3, 2), (11, "table", 1, 0)}


def test_addresses_against_the_standard_library(spark):
    rng = np.random.default_rng(8)
    four = [str(ipaddress.IPv4Address(int(x))) for x in rng.integers(0, 1 << 32, 300)]
    nets = [ipaddress.ip_network(n) for n in (*addresses.CLOSED, *addresses.OPEN)]
    four += [str(n[k]) for n in nets for k in (0, -1)] + [str(n.network_address - 1) for n in nets if int(n.network_address)]
    six = [str(ipaddress.IPv6Address(int.from_bytes(rng.bytes(16)))) for _ in range(200)] + [ipaddress.IPv6Address(int.from_bytes(rng.bytes(16))).exploded for _ in range(20)]
    six += [f"{p}{a}" for p in ("::ffff:", "64:ff9b::") for a in four[:40] if ":" not in a] + ["2002:0808:0808::1", "2002:0a00:0001::", "2001:0:1::", "::", "::1", "1::", "FE80::1%eth0", "[::1]", "1:2:3:4:5:6:7:8"]
    bad = ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.x", ":::", "1::2::3", "1:2:3:4:5:6:7", "12345::", "g::1", "1:2:3:4:5:6:7:8:9", "::1.2.3", "host.example", "1:2:3:4:5:6:7::8:9", ":1:2:3:4:5:6:7"]
    df = spark.createDataFrame([(t,) for t in four + six + bad] + [(None,)], "t string").select("t", addresses.address_fault(F.col("t")).alias("fault"), addresses.address_hex(F.col("t")).alias("h"))
    for r in df.collect():
        if r.t is None or r.t in bad:
            assert r.h is None and r.fault == "NOT_AN_ADDRESS", r
            continue
        ip = ipaddress.ip_address(r.t.strip("[]").split("%")[0])
        assert int(r.h, 16) == int(ip) and len(r.h) == ip.max_prefixlen // 4, r
        if ip.version == 6:
            inner = ip.ipv4_mapped or ip.sixtofour or (ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF) if ip in ipaddress.ip_network("64:ff9b::/96") else None)
            if inner is None and ip.teredo:
                assert r.fault == "TEREDO_IP"
                continue
            ip = inner or ip
        closed = max((n.prefixlen, n not in [ipaddress.ip_network(o) for o in addresses.OPEN]) for n in [*nets, ipaddress.ip_network("0.0.0.0/0"), ipaddress.ip_network("::/0")] if n.version == ip.version and ip in n)
        assert (r.fault == "NON_GLOBAL_IP") == (closed[1] and closed[0] > 0), (r, ip)


def test_hosts_of_urls(spark):
    urls = {"http://8.8.8.8/x": None, "https://example.org/": None, "http://127.1/": "NO_HOST", "http://0x7f.1/": "NO_HOST", "http://2130706433/": "PRIVATE_ADDRESS", "http://[::1]/": "PRIVATE_ADDRESS", "http://[::ffff:10.0.0.1]/": "PRIVATE_ADDRESS", "http://intranet/": "PRIVATE_ADDRESS", "ftp://8.8.8.8/": "SCHEME", "https://[2a00:1450::1]/": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", readers.url_policy(F.col("u")).alias("why"))
    assert {r.u: r.why for r in df.collect()} == urls
