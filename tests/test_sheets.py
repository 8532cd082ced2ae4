"""Workbooks, delimited files and tables on grids."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.plans.grids import workbook
from docketry.sources import sheets


def files(spark, *named):
    return spark.createDataFrame([(n, bytearray(c)) for n, c in named], "path string, content binary")


def test_workbook_with_everything(spark):
    """A shared text, a formula without a value, a number format, a hidden row and column, a merged range, a hidden sheet; and files that are no workbooks."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" r:id="a"/><sheet name="Secret" state="hidden" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><r Id="a" Target="worksheets/one.xml"/><r Id="b" Target="/xl/worksheets/two.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Item</t></si><si><r><t>Mer</t></r><r><t>ged</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="E1"><v>5</v></c><c r="F1" t="s"><v>1</v></c></row><row r="2"><c r="D2"><f>B2*C2</f></c></row><row r="3" hidden="1"><c r="C3" s="1"><v>0.256</v></c><c r="AB3" t="b"><v>1</v></c></row>'
        z.writestr("xl/worksheets/one.xml", f'<worksheet {main}><cols><col min="5" max="5" hidden="1"/></cols><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="F1:G2"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/two.xml", f"<worksheet {main}><sheetData/></worksheet>")
    got = sheets.workbook_cells(files(spark, ("b.xlsx", buf.getvalue()), ("x.xlsx", b"no zip"), ("y.xlsx", b"")))
    by = {r.ref: r for r in got.collect()}
    assert set(by) == {"A1", "E1", "F1", "G1", "F2", "G2", "D2", "C3", "AB3"}
    assert by["A1"].raw == "Item" and by["G2"].raw == "Merged" and by["G2"].merged and not by["F1"].merged
    assert by["D2"].formula == "B2*C2" and by["D2"].raw is None and by["D2"].warning == "FORMULA_NOT_CACHED"
    assert by["E1"].hidden and by["C3"].hidden and by["C3"].number_format == "0.0%" and not by["A1"].hidden and by["AB3"].col == 27
    cut = sheets.workbook_cells(files(spark, ("b.xlsx", buf.getvalue())), most=2).orderBy("row", "col").collect()
    assert [(r.ref, r.warning) for r in cut] == [("A1", None), ("E1", "CELLS_TRUNCATED")]


def test_columns_have_letters(spark):
    refs = spark.range(0, 16384).select(F.col("id").cast("int").alias("i"), sheets.column_name(F.col("id")).alias("n")).collect()
    assert [refs[i].n for i in (0, 25, 26, 51, 52, 701, 702, 703, 16383)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "AAB", "XFD"]
    assert all(sheets._place(f"{r.n}1") == (0, r.i) for r in refs)


def test_delimited_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_bytes("Name;Amount\nÄrger;10,5\nZoë €;7\n".encode("cp1252"))
    (tmp_path / "deep" / "b.tsv").write_bytes(b"a\tb\n1\t\n")
    (tmp_path / "c.csv").write_bytes('﻿x,y\n"two\nlines, and ""marks""",z\n\nlast\n'.encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "other.bin").write_bytes(b"a,b")
    got = {(r.path.rsplit("/", 1)[1], r.ref): r.value for r in sheets.delimited_cells(spark, str(tmp_path)).collect()}
    assert got["a.csv", "A2"] == "Ärger" and got["a.csv", "B2"] == "10,5" and got["a.csv", "A3"] == "Zoë €"
    assert {k: v for k, v in got.items() if k[0] == "b.tsv"} == {("b.tsv", "A1"): "a", ("b.tsv", "B1"): "b", ("b.tsv", "A2"): "1"}
    assert got["c.csv", "A1"] == "x" and got["c.csv", "A2"] == 'two\nlines, and "marks"' and got["c.csv", "B2"] == "z" and "last" in got.values()
    assert not any(k[0] in ("empty.csv", "other.bin") for k in got)
    (tmp_path / "none").mkdir()
    assert sheets.delimited_cells(spark, str(tmp_path / "none")).count() == 0


def brute_islands(cells):
    """Cut at empty rows and columns until nothing changes."""
    def cut(part, axis):
        out, last = [], None
        for v in sorted({c[axis] for c in part}):
            if last is None or v != last + 1:
                out.append(set())
            out[-1] |= {c for c in part if c[axis] == v}
            last = v
        return out

    parts = [set(cells)]
    while True:
        new = [q for p in parts for b in cut(p, 0) for q in cut(b, 1)]
        if len(new) == len(parts):
            return {frozenset(p) for p in new}
        parts = new


@pytest.mark.parametrize("seed", range(3))
def test_islands_against_cutting(spark, seed):
    rng = np.random.default_rng(seed)
    cells = {(s, r, c) for s in range(4) for r, c in rng.integers(0, 9, (14 + 4 * s, 2)).tolist()}
    got = sheets.islands(spark.createDataFrame(sorted(cells), "s int, row int, col int"), ["s"]).collect()
    for s in range(4):
        parts = {}
        for r in got:
            if r.s == s:
                parts.setdefault(r.part, set()).add((r.row, r.col))
        assert {frozenset(p) for p in parts.values()} == brute_islands({(r, c) for t, r, c in cells if t == s})


def test_tables_and_blocks(spark):
    book = workbook({"S": [("A1", "k"), ("B1", "v"), ("D1", "1"), ("E1", "2"), ("A2", "x"), ("B2", "7"), ("D2", "3"), ("E2", "4"), ("A4", "alone")]})
    cells = sheets.workbook_cells(files(spark, ("s.xlsx", book)))
    found = sheets.probable_tables(cells, ["path"])
    assert {(r.range, r.has_header) for r in found.collect()} == {("A1:B2", True), ("D1:E2", False)}
    blocks = {(r.range, r.row, r.col): (r.header, r.value, r.is_header) for r in sheets.table_blocks(cells, found, ["path"]).collect()}
    assert blocks["A1:B2", 1, 1] == ("v", "7", False) and blocks["A1:B2", 0, 0] == ("k", "k", True) and blocks["D1:E2", 0, 0] == (None, "1", False)
