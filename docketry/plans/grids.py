"""Queries of workbooks, delimited files and tables on grids; the files are made from the tables, in the shared folder."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from docketry.session import shared_folder, table
from docketry.sources import sheets

QUERIES, ORACLES = {}, {}


def _q(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _xml(kind: str, inner: str) -> str:
    return f'<{kind} xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{inner}</{kind}>'


def workbook(grids: dict[str, list[tuple[str, str]]], merged: tuple[str, ...] = (), hidden_columns: str = "", hidden_sheets: tuple[str, ...] = ()) -> bytes:
    """A workbook whose sheets hold (reference, text) cells row by row."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}"{" state=" + chr(34) + "hidden" + chr(34) if n in hidden_sheets else ""}/>' for i, n in enumerate(grids, 1))
        z.writestr("xl/workbook.xml", _xml("workbook", f"<sheets>{names}</sheets>"))
        for i, cells in enumerate(grids.values(), 1):
            rows: dict[str, list[str]] = {}
            for ref, text in cells:
                rows.setdefault(ref.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), []).append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(text)}</t></is></c>')
            data = "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in rows.items())
            ranges = f"<mergeCells>{''.join(f'<mergeCell ref={chr(34)}{m}{chr(34)}/>' for m in merged)}</mergeCells>" if merged else ""
            z.writestr(f"xl/worksheets/sheet{i}.xml", _xml("worksheet", f"{hidden_columns}<sheetData>{data}</sheetData>{ranges}"))
    return buf.getvalue()


def nation_books(spark, sf_dir):
    """One workbook a nation: a sheet with its suppliers under a merged title and beside them a table of segments, and a hidden sheet."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("s").alias("kind"), F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("k")).select(F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind"), "k", F.col("c_mktsegment").alias("name"))

    def make(f: pd.DataFrame) -> pd.DataFrame:
        left, right = (f[f.kind == x].sort_values(["k", "name"] if x == "s" else ["name"]) for x in "sc")
        lines: dict[int, list[tuple[str, str]]] = {1: [("A1", "Suppliers")], 2: [("A2", "key"), ("B2", "name"), ("C2", "note")]}
        for i, r in enumerate(left.itertuples(), 3):
            lines[i] = [(f"A{i}", str(r.k)), (f"B{i}", r.name), (f"C{i}", "x")]
        for i, r in enumerate(right.itertuples(), 2):
            lines.setdefault(i, []).extend([(f"E{i}", r.name), (f"F{i}", str(r.k))])
        book = workbook({"Data": [c for i in sorted(lines) for c in lines[i]], "Secret": [("B2", "a"), ("C2", "1"), ("B3", "b"), ("C3", "2")]}, ("A1:C1",), '<cols><col min="3" max="3" hidden="1"/></cols>', ("Secret",))
        return pd.DataFrame([(f"nation-{f.nation.iloc[0]}.xlsx", book)], columns=["path", "content"])

    return s.unionByName(c).groupBy("nation").applyInPandas(make, "path string, content binary")


_BOOKS = """WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_name) AS i FROM supplier),
c AS (SELECT n, name, k, row_number() OVER (PARTITION BY n ORDER BY name) AS i FROM (SELECT c_nationkey AS n, c_mktsegment AS name, count(*) AS k FROM customer GROUP BY ALL)),
nations AS (SELECT n FROM s UNION SELECT n FROM c)"""


@_q(
    _BOOKS
    + """ SELECT 'nation-' || n || '.xlsx' AS path, sheet, ref, value, hidden FROM (
 SELECT n, 'Data' AS sheet, unnest(['A1','B1','C1','A2','B2','C2']) AS ref, unnest(['Suppliers','Suppliers','Suppliers','key','name','note']) AS value, unnest([false,false,true,false,false,true]) AS hidden FROM nations
 UNION ALL SELECT n, 'Data', unnest(['A','B','C']) || (i+2), unnest([k::VARCHAR, name, 'x']), unnest([false,false,true]) FROM s
 UNION ALL SELECT n, 'Data', unnest(['E','F']) || (i+1), unnest([name, k::VARCHAR]), false FROM c
 UNION ALL SELECT n, 'Secret', unnest(['B2','C2','B3','C3','A1','B1','C1']), unnest(['a','1','b','2',NULL,NULL,NULL]), true FROM nations) WHERE value IS NOT NULL"""
)
def workbook_cells(spark, sf_dir):
    """Every cell of the workbooks: the title fills its merged range, the third column and the second sheet are hidden."""
    return sheets.workbook_cells(nation_books(spark, sf_dir)).select("path", "sheet", "ref", F.col("raw").alias("value"), "hidden")


@_q(
    _BOOKS
    + """ SELECT 'nation-' || n || '.xlsx' AS path, sheet, range, has_header FROM (
 SELECT n, 'Data' AS sheet, 'A1:C' || (coalesce((SELECT max(i) FROM s WHERE s.n = nations.n), 0) + 2) AS range, true AS has_header FROM nations
 UNION ALL SELECT n, 'Data', 'E2:F' || (max(i) + 1), false FROM c GROUP BY n HAVING max(i) > 1 UNION ALL SELECT n, 'Secret', 'B2:C3', false FROM nations)"""
)
def sheet_tables(spark, sf_dir):
    """Two tables side by side on each first sheet, one on the hidden sheet."""
    return sheets.probable_tables(sheets.workbook_cells(nation_books(spark, sf_dir)), ["path", "sheet"]).select("path", "sheet", "range", "has_header")


@_q(
    _BOOKS
    + """ SELECT 'nation-' || n || '.xlsx' AS path, row::INT AS row, header, value FROM (
 SELECT n, 0 AS row, 'Suppliers' AS header, 'Suppliers' AS value FROM nations, range(3) UNION ALL SELECT n, 1, 'Suppliers', unnest(['key','name','note']) FROM nations UNION ALL SELECT n, i+1, 'Suppliers', unnest([k::VARCHAR, name, 'x']) FROM s)"""
)
def sheet_blocks(spark, sf_dir):
    """The cells of the tables with a header, each under its column's header."""
    by = ["path", "sheet"]
    cells = sheets.workbook_cells(nation_books(spark, sf_dir))
    return sheets.table_blocks(cells, sheets.probable_tables(cells, by).filter("has_header"), by).select("path", "row", "header", "value")


_DELIMITED = """WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS g, c_name || CASE WHEN c_custkey % 4 = 1 THEN ' Ärger; "é"' WHEN c_custkey % 4 = 2 THEN ' a|b' ELSE '' END AS name, c_mktsegment AS seg, c_acctbal AS bal FROM customer)"""


@_q(_DELIMITED + " SELECT * FROM (SELECT 'c' || k AS key, unnest([0,1,2,3])::INT AS col, unnest(['c' || k, name, seg, CASE WHEN k % 5 = 0 THEN NULL ELSE 'n' || k % 7 END]) AS value FROM c) WHERE value IS NOT NULL")
def delimited_cells(spark, sf_dir):
    """Customers written as four kinds of delimited files, in two encodings, with quoted values and empty cells, read as one table of cells."""
    k = F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 4 == 1, ' Ärger; "é"').when(k % 4 == 2, " a|b").otherwise(""))
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("key"), name.alias("name"), F.col("c_mktsegment").alias("seg"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("n"), (k % 7).cast("string"))).alias("flag"), (k % 4).alias("g"))
    at = f"{shared_folder(spark)}/delimited-{uuid.uuid4().hex}"
    for g, (mark, encoding) in enumerate(((",", "UTF-8"), (";", "ISO-8859-1"), ("\t", "UTF-8"), ("|", "UTF-8"))):
        rows.filter(F.col("g") == g).drop("g").write.csv(f"{at}/{g}", sep=mark, encoding=encoding, quote='"', escape='"', emptyValue="")
    cells = sheets.delimited_cells(spark, at)
    keys = cells.filter("col = 0").select("path", "row", F.col("value").alias("key"))
    return cells.join(keys, ["path", "row"]).select("key", "col", "value")
