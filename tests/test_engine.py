"""The engine's operators on documented examples, and each query with an oracle against DuckDB."""

import io
import zipfile
from email.message import EmailMessage

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketry import catalog
from docketry.functions import checksums, dates, numbers, numfmt, security, text
from docketry.operators import audit, export, govern, linking, report, structure, workflow
from docketry.sources import readers, sheets
from docketry.streaming import stateful

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return "NULL"
    if isinstance(v, (np.ndarray, list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.6g}" if abs(v) < 1e15 else str(int(v))
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, sf, duck, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted("|".join(map(norm, r)) for r in d[cols].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_registry_needs_no_session():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize(
    "raw,locale,value",
    [("1,234.50", "en", 1234.5), ("(1,234.50)", "en", -1234.5), ("1,00,000", "en", 100000), ("12,34,56", "en", None), ("1.234,50 €", "eu", 1234.5), ("-5 %", "en", -5), ("3 lakh", "en", 300000), ("5m", "en", None), ("10-20", "en", None), ("USD 1,000 monthly", "en", 1000), ("12 monkeys", "en", None), ("", "en", None), ("approx. 7 kg", "en", 7)],
)
def test_parse_value(spark, raw, locale, value):
    got = one(spark, numbers.parse_value(F.lit(raw), locale))
    assert (float(got.value) if got is not None and got.value is not None else None) == value


def test_value_details(spark):
    v = one(spark, numbers.parse_value(F.lit("about $ 10-20")))
    assert v.approx and v.is_range and v.currency is None and v.value is None
    assert one(spark, numbers.validator_number(F.lit("12.5-"))) == -12.5
    assert one(spark, numbers.number_readings(F.lit("5% and 2k"))) == [0.05, 2.0, 5.0, 2000.0]
    assert one(spark, numbers.chart_number(F.lit("$1.5M"))) == 1.5e6
    assert one(spark, numbers.column_index(F.lit("AB"))) == 27


@pytest.mark.parametrize("raw,want", [("2024-02-30", None), ("3/4/24", "2024-04-03"), ("13/4/2024", "2024-04-13"), ("4/13/2024", "2024-04-13"), ("5th March 2024", "2024-03-05"), ("Mar 5, 2024", "2024-03-05"), ("soon", None)])
def test_parse_date(spark, raw, want):
    got = one(spark, dates.parse_date(F.lit(raw)))
    assert (str(got.date) if got else None) == want


def test_dates_in_text(spark):
    f = lambda t: [(str(d.date), d.ambiguous) for d in one(spark, dates.find_dates(F.lit(t)))]
    assert f("from 2024-01-05, then 1 Feb 2024 and Sept 9th, 2021") == [("2024-01-05", False), ("2024-02-01", False), ("2021-09-09", False)]
    assert f("1/2/2024/5 and v1.2.2024.7") == [] and f("31/02/2024") == [] and f("") == [] and f("2.4.24") == [("2024-04-02", True)]
    assert one(spark, dates.find_dates(F.lit(None).cast("string"))) is None
    c = one(spark, dates.date_checks(F.lit("2024-03-01 to 2024-02-01, 4/13/2024, 30.02.2024")))
    assert (c.valid, c.invalid, c.ambiguous, c.unordered) == (3, ["30.02.2024"], ["4/13/2024"], ["2024-03-01 to 2024-02-01"])
    a, b = (F.array(*(F.lit(x).cast("date") for x in xs)) for xs in (["2024-01-01", "2024-05-01"], ["2024-04-21"]))
    assert one(spark, dates.least_gap(a, b)) == 10


def test_periods(spark):
    p = lambda s: one(spark, dates.find_period(F.lit(s)))
    assert (str(p("2024-01-05 to 2024-02-01").end), p("2024-03-01 to 2024-02-01").rule, p("FY2024").start) == ("2024-02-01", "period_invalid_order", None)
    assert str(p("Q1 2024").end) == "2024-03-31" and str(p("February 2024").end) == "2024-02-29" and p("nothing") is None


def test_checksums(spark):
    assert one(spark, checksums.luhn_valid(F.lit("4111 1111 1111 1111"))) and not one(spark, checksums.luhn_valid(F.lit("4111 1111 1111 1112")))
    assert one(spark, checksums.iban_valid(F.lit("GB82 WEST 1234 5698 7654 32"))) and not one(spark, checksums.iban_valid(F.lit("GB82 WEST 1234 5698 7654 33")))
    ok = [d for d in range(10) if one(spark, checksums.verhoeff_valid(F.lit(f"23412341234{d}")))]
    assert ok == [6]
    assert one(spark, checksums.gstin_valid(F.lit("27AAPFU0939F1ZV"))) and not one(spark, checksums.gstin_valid(F.lit("27AAPFU0939F1ZW")))


def test_text(spark):
    assert text.indel_ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13) and text.partial_ratio_of("abc", "xxabcxx") == 100 and text.indel_ratio("", "") == 100
    assert one(spark, text.agreement(F.lit("a b"), F.lit("ab"))) == 1 and one(spark, text.agreement(F.lit("x"), F.lit(""))) == 0
    assert one(spark, text.normalize_subject(F.lit("Doe, John"))) == "john doe" and one(spark, text.canonical_metric(F.lit("Net worth"))) == "net worth"
    assert one(spark, text.casefold(F.lit("Straße"))) == "strasse" and one(spark, text.nfkc(F.lit("ﬁ²"))) == "fi2"
    assert one(spark, text.dominant_script(F.lit("привет hi"))) == "cyrillic"


def test_security(spark):
    m = one(spark, security.mask_sensitive(F.lit("a@b.co 4111 1111 1111 1111 and 123-45-6789")))
    assert m == "[REDACTED:email] [REDACTED:payment_card:…1111] and [REDACTED:ssn]"
    assert one(spark, security.mask_sensitive(F.lit("4111 1111 1111 1112 and 2341 2341 2346 or GB82WEST12345698765432"))) == "4111 1111 1111 1112 and [REDACTED:aadhaar:…2346] or [REDACTED:iban]"
    link = export.signed_link("e1", "ann", b"k", now=1000)
    assert export.link_valid(link, "ann", b"k", now=1100) and not export.link_valid(link, "bob", b"k", now=1100) and not export.link_valid(link, "ann", b"k", now=5000)


@pytest.mark.parametrize(
    "value,code,want",
    [(1234567.891, "#,##0.00", "1,234,567.89"), (0.256, "0%", "26%"), (-5.5, "0.00;(0.00)", "(5.50)"), (1234567, r"[>=10000000]##\,##\,##\,##0;[>=100000]##\,##\,##0;##,##0", "12,34,567"), (45000, "yyyy-mm-dd", "2023-03-15"), (0.75, "h:mm AM/PM", "6:00 PM"), (12, '"No. "0', "No. 12"), (12345, "0.00E+00", "1.23E+04"), (2.5, "# ?/?", "2 1/2"), (1234567, '0.0,,"M"', "1.2M"), (1.5, "[h]:mm", "36:00"), ("x", '@" kg"', "x kg"), (0, '0;-0;"-"', "-"), (True, None, "TRUE")],
)
def test_number_formats(value, code, want):
    assert numfmt.format_value(value, code) == want


def test_gate_corpus_agrees(spark, sf):
    from docketry.plans.governance import CORPUS, _gated

    assert [_gated(spark, sf, s)[0].ok for s, _ in CORPUS] == [ok for _, ok in CORPUS]
    verdict, df = _gated(spark, sf, "SELECT c_name FROM customer LIMIT 7")
    assert verdict.limit == 7 and verdict.columns == ["customer.c_name"] and df.count() == 7
    assert govern.decide(verdict, 20_000, set()) == "CONFIRM" and govern.decide(verdict, 5, {"c_name"}) == "CONFIRM" and govern.decide(verdict, None, set()) == "ALLOW"
    rows, more = govern.run_capped(df, 5)
    assert len(rows) == 5 and more


def test_names_of_inner_scopes_open_no_table(spark, sf):
    from docketry.plans.governance import _gated

    spark.sql("DROP TABLE IF EXISTS secret_t")
    spark.range(1).selectExpr("42 AS x", "1 AS k").write.saveAsTable("secret_t")
    try:
        verdict, df = _gated(spark, sf, "SELECT secret_t.x FROM secret_t, orders WHERE 1 IN (WITH secret_t AS (SELECT 1 AS y FROM orders) SELECT y FROM secret_t)")
        assert not verdict.ok and df is None
    finally:
        spark.sql("DROP TABLE secret_t")
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("v")]
    verdict, df = _gated(spark, sf, "SELECT o_orderkey FROM orders WHERE 1 IN (WITH part AS (SELECT 1 AS x FROM orders) SELECT x FROM part)")
    assert verdict.ok and df.count() > 0


def test_pair_limit_keeps_the_first_pairs(spark):
    from docketry.operators import reasoning

    rng = np.random.default_rng(31)
    rows = [(f"s{i % 3}", "m", f"d{rng.integers(0, 4)}", int(i), 1.0) for i in range(120)]
    f = spark.createDataFrame(rows, "subject string, metric string, source_id string, fact_id int, value double")
    order = ["a_source_id", "a_fact_id", "b_source_id", "b_fact_id"]
    every = reasoning.pairs(f, None).toPandas()
    got = reasoning.pairs(f, 7).toPandas()
    for s, part in every.groupby("subject"):
        mine = got[got.subject == s].sort_values(order)
        assert mine[order].values.tolist() == part.sort_values(order)[order].head(7).values.tolist() and set(mine.group_pairs) == {len(part)}


def test_trigram_threshold_loses_no_pair(spark):
    rng = np.random.default_rng(32)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    t = spark.createDataFrame([(i, " ".join(rng.choice(words, 4))) for i in range(80)] + [(200, None), (201, "ab"), (202, "")], "id int, text string")
    every = {(r.a_id, r.b_id): r.cosine for r in report.trigram_cosine(t).collect()}
    got = {(r.a_id, r.b_id): r.cosine for r in report.trigram_cosine(t, 0.7).collect()}
    assert got == {k: v for k, v in every.items() if v >= 0.7} and 0 < len(got) < len(every)


def test_evidence_in_parts_and_nearly(spark):
    from docketry.operators import facts

    found = [("a", 1, 0, i, e, v) for i, (e, v) in enumerate([("Rent: 500", "500"), ("Rent | 500", "500"), ("Rent total: 50O per month", "500"), ("Rant", "5"), ("gone", "1")])]
    f = spark.createDataFrame(found, "source_id string, page int, ro int, line_no int, excerpt string, raw_value string").withColumns({"period_start": F.lit(None).cast("date"), "period_end": F.lit(None).cast("date")})
    b = spark.createDataFrame([("a", 1, 0, 0, "Rent: 500"), ("a", 1, 0, 1, "500 is the Rent"), ("a", 1, 0, 2, "The Rent total: 500 per month"), ("a", 1, 0, 3, "Rent 5")], "source_id string, page int, ro int, line_no int, text string")
    v = lambda cases: [r.verdict for r in facts.verify(f, b, cases).orderBy("line_no").collect()]
    assert v(None) == ["verified", "verified", "verified", "EVIDENCE_UNVERIFIED", "EVIDENCE_MISSING"]
    assert set(v(spark.createDataFrame([("z",)], "source_id string"))) == {"NOT_IN_CASE"}


def test_workflow_folds():
    assert workflow.accept_times([0, 1, 2, 9, 11], 2, 10)[0] == [True, True, False, False, True]
    assert workflow.anchor_starts([0, 200, 300, 301, 500], 300) == [0, 0, 0, 301, 301]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(f"d{i % 3}", 1000.0 + i * 7 % 50, i) for i in range(60)]
    schema = "domain string, epoch double, hit_id long"
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[1]), schema)
    df.coalesce(1).write.parquet(str(tmp_path / "hits"))
    got = stateful.drained(stateful.rate_limited(stateful.events_stream(spark, str(tmp_path / "hits"), df.schema), 2, 10.0), "hits_out")
    key = lambda d: sorted(map(tuple, d.select("domain", "hit_id", "accepted").collect()))
    assert key(got) == key(workflow.rate_limited(df, 2, 10.0))
    notes = df.withColumnRenamed("domain", "dedupe_key").select("dedupe_key", "epoch")
    notes.coalesce(1).write.parquet(str(tmp_path / "notes"))
    out = stateful.drained(stateful.collapsed(stateful.events_stream(spark, str(tmp_path / "notes"), notes.schema), 12.0), "notes_out", "update")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, workflow.collapsed(notes, 12.0).collect()))
    acts = spark.createDataFrame([(1, 1, "a", "submit", 1000.0), (1, 2, "b", "approve", 1001.0), (1, 3, "b", "execute", 1002.0)], "action_id long, step long, actor string, verb string, epoch double")
    acts.coalesce(1).write.parquet(str(tmp_path / "acts"))
    states = stateful.drained(stateful.approvals(stateful.events_stream(spark, str(tmp_path / "acts"), acts.schema)), "acts_out").orderBy("step").collect()
    assert [r.state for r in states] == ["in_review", "approved", "executed"]
    # State ends: a later file moves the watermark past an old key's window.
    for i, (key, epoch) in enumerate([("old", 1000.0), ("new", 100_000.0), ("new", 100_001.0)]):
        spark.createDataFrame([(key, epoch, i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "long"))
    q = stateful.rate_limited(stateful.events_stream(spark, str(tmp_path / "long"), df.schema), 2, 10.0, "10 seconds").writeStream.outputMode("append").format("memory").queryName("long_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1
    sent = []
    notices = spark.createDataFrame([("a", 0), ("a", 1), ("b", 9)], "dedupe_key string, attempts int")
    notices_file = tmp_path / "sent"
    notices_file.mkdir()
    stateful.outbox_sink(lambda r, at=str(notices_file): open(f"{at}/{r['dedupe_key']}", "a").close())(notices, 0)
    assert sorted(p.name for p in notices_file.iterdir()) == ["a"] and not sent
    ts = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id*60) AS ts, 'u' AS user_id FROM range(5)")
    ts.coalesce(1).write.parquet(str(tmp_path / "ts"))
    alerts = stateful.windowed_alerts(stateful.events_stream(spark, str(tmp_path / "ts"), ts.schema))
    assert stateful.drained(alerts, "alerts_out", "complete").count() > 0


def test_ledger_cursor(spark, sf):
    assert audit.decode_cursor(audit.encode_cursor(41)) == 41 and audit.decode_cursor(None) == 0
    runs = spark.createDataFrame([("t", 1, True), ("t", 2, False), ("t", 3, True)], "tenant string, run int, valid boolean")
    assert [r.state for r in audit.latched(runs).orderBy("run").collect()] == ["valid", "invalid", "invalid"]


def workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="r1"/><sheet name="Secret" state="hidden" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>12.5</v></c></row><row r="2" hidden="1"><c r="B2"><f>B1*2</f></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="C1" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark):
    mail = EmailMessage()
    mail["From"], mail["To"], mail["Subject"] = "a@b.c", "d@e.f", "Hi"
    mail.set_content("the body")
    mail.add_attachment(b"PDF", maintype="application", subtype="pdf", filename="x.pdf")
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("../up.txt", "x")
    files = spark.createDataFrame([("a.xlsx", bytearray(workbook())), ("b.xlsx", bytearray(workbook())), ("m.eml", bytearray(mail.as_bytes())), ("z.zip", bytearray(evil.getvalue())), ("e.txt", bytearray()), ("p.pdf", bytearray(b"%PDF-1.4 /Encrypt"))], "path string, content binary")
    got = {r.path: r for r in readers.intake(files).collect()}
    assert got["a.xlsx"].kind == "xlsx" and got["a.xlsx"].parts == 2 and got["a.xlsx"].status == "accepted"
    assert got["z.zip"].reason == "PATH_TRAVERSAL" and got["e.txt"].reason == "EMPTY" and got["p.pdf"].reason == "ENCRYPTED" and got["m.eml"].mime == "message/rfc822"
    cells = {(r.sheet, r.ref): r for r in sheets.workbook_cells(files.filter("path = 'a.xlsx'")).collect()}
    assert cells["Data", "A1"].raw == "name" and cells["Data", "B2"].formula == "B1*2" and cells["Data", "B2"].hidden and cells["Secret", "C1"].raw == "x"
    parts = readers.mails(files.filter("path = 'm.eml'")).orderBy("part").collect()
    assert parts[0].text.startswith("From: a@b.c") and parts[0].text.endswith("the body") and (parts[1].filename, bytes(parts[1].content)) == ("x.pdf", b"PDF")
    assert readers.visible("<head><title>t</title></head><p hidden>no</p><p>a <b>b</b><div style='display:none'>x</div><a href=/z>c</a>") == (["a b", "c"], ["/z"])


def test_images_and_layout():
    grey = np.full((120, 200), 240, np.uint8)
    grey[20:40, 10:60] = 20
    grey[80:100, 100:180] = 30
    t = structure.otsu_threshold(grey)
    assert 20 < t < 240 and len(structure.components(grey < 128)) == 2
    share, missed = structure.ink_coverage(grey, [(0, 0, 100, 60)], columns=20)
    assert 0.2 < share < 0.6 and missed
    assert structure.adaptive_binarize(grey)[30, 12] or structure.adaptive_binarize(grey).any()
    assert abs(structure.estimate_skew(grey < 128)) <= 0.5
    assert structure.xy_cut([(0, 0, 40, 10), (60, 0, 100, 10), (0, 20, 40, 30)], 100) == [0, 2, 1]
    two = [(0, y, 45, y + 8) for y in (20, 30, 40)] + [(55, y, 100, y + 8) for y in (20, 30, 40)] + [(0, 0, 100, 10)]
    assert structure.gutter_order(two, 100) == [6, 0, 1, 2, 3, 4, 5]
    assert structure.equation_groups([(0, 0, 10, 10), (12, 0, 20, 10), (0, 100, 10, 110)], 0.8, 6) == [0, 0, 2]
    bars = structure.read_bars([(10, 50, 20, 100), (30, 0, 40, 100)], [(100, 0), (0, 200)], [("a", 15), ("b", 35)])
    assert [(b["category"], round(b["value"])) for b in bars] == [("a", 100), ("b", 200)]
    vote = structure.consensus([("total 100", 0.9, 0.9), ("total 100", 0.5, 0.8), ("tofal 1OO", 0.2, 0.5)])
    assert vote["text"] == "total 100" and vote["verdict"] == "majority" and not vote["escalate"]


def test_small_frames(spark):
    lines = spark.createDataFrame([("s", i, t) for i, t in enumerate("a bb ccc d e f gg".split())], "page_id string, ro int, text string")
    assert [r.shredded for r in structure.fragment_runs(lines).orderBy("ro").collect()] == [False, False, False, True, True, True, True]
    rows = spark.createDataFrame([("t", 1, "item", 10.0), ("t", 2, "item", 20.0), ("t", 3, "subtotal", 30.0), ("t", 4, "item", 5.0), ("t", 5, "subtotal", 5.0)], "table_id string, row int, kind string, amount double")
    assert [(r.stated, r.parts) for r in report.subtotal_segments(rows).orderBy("segment").collect()] == [(30.0, 30.0), (5.0, 5.0)]
    cuts = structure.gap_cuts(spark.createDataFrame([("p", 0, 10), ("p", 2, 30), ("p", 40, 50)], "page_id string, lo int, hi int"), ["page_id"], "lo", "hi", 5).collect()
    assert [(c.cut_from, c.cut_to) for c in cuts] == [(30, 40)]
    links = spark.createDataFrame([(1, 1, "approve"), (1, 2, "reject"), (1, 3, "approve")], "link_id int, step int, decision string")
    assert [r.status for r in linking.decisions(links).orderBy("step").collect()] == ["verified", "rejected", "rejected"]
    with pytest.raises(ValueError):
        export.render(links, "pdf")
