"""Workbooks and delimited files as cells, and tables found on their grids.

A workbook is taken apart into one row a sheet, which are dealt out and parsed side by side, each as a stream of XML. Merged
ranges, hidden columns and tables are joins and windows over cells. Delimited files are grouped by encoding and delimiter and
read by Spark's own reader with each group's options.
"""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.session import settled

_SHEET = "path string, sheet_no int, sheet string, sheet_hidden boolean, body binary, shared array<string>, formats array<string>"
_PIECE = "path string, sheet_no int, sheet string, sheet_hidden boolean, kind string, row int, col int, row2 int, col2 int, row_hidden boolean, raw string, type string, formula string, number_format string"
#: Cells handed on together.
_ROWS = 20_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Delimiters in the order in which ties are decided.
DELIMITERS = (",", ";", "\t", "|")


# -- references


def column_name(index: Column) -> Column:
    """'A' for 0, 'AA' for 26: the letters of a column."""
    letter = lambda n: F.chr(F.lit(65) + n)
    one, two, three = index, F.floor(index / 26) - 1, F.floor((index - 26) / 676) - 1
    last = letter(F.pmod(one, F.lit(26)))
    return F.when(index < 26, last).when(index < 702, F.concat(letter(two), last)).otherwise(F.concat(letter(three), letter(F.pmod(two, F.lit(26))), last))


def reference(row: Column, col: Column) -> Column:
    """'B3' for row 2 and column 1."""
    return F.concat(column_name(col), (row + 1).cast("string"))


def range_reference(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.concat(reference(r1, c1), F.lit(":"), reference(r2, c2))


def _place(ref: str) -> tuple[int, int]:
    """(row, column) of 'B3', from 0."""
    letters = ref.rstrip("0123456789")
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(ref[len(letters) :]) - 1, col - 1


# -- workbooks


def _texts(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _sheets_of(content: bytes) -> Iterator[tuple]:
    """(number, name, hidden, sheet XML compressed, shared texts, number format by style) of each sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        root = lambda name: ET.fromstring(z.read(name)) if name in names else None
        shared, styles, links = root("xl/sharedStrings.xml"), root("xl/styles.xml"), root("xl/_rels/workbook.xml.rels")
        texts = [_texts(s) for s in shared] if shared is not None else []
        codes = {f.get("numFmtId"): f.get("formatCode") for f in styles.iter(f"{_MAIN}numFmt")} if styles is not None else {}
        forms = styles.find(f"{_MAIN}cellXfs") if styles is not None else None
        formats = [codes.get(x.get("numFmtId")) for x in forms] if forms is not None else []
        target = {r.get("Id"): r.get("Target") for r in links} if links is not None else {}
        for i, s in enumerate(root("xl/workbook.xml").find(f"{_MAIN}sheets"), 1):
            where = target.get(s.get(_LINK), f"worksheets/sheet{i}.xml")
            member = where.lstrip("/") if where.startswith("/") else posixpath.normpath(f"xl/{where}")
            yield i, s.get("name"), s.get("state", "visible") != "visible", zlib.compress(z.read(member), 1), texts, formats


def workbook_sheets(files: DataFrame) -> DataFrame:
    """Workbook files (path, content) as rows of one sheet each; a file that is no workbook gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows = [(path, *s) for s in _sheets_of(bytes(content))]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, AttributeError, TypeError):
                    continue
                for r in rows:
                    yield pd.DataFrame([r], columns=["path", "sheet_no", "sheet", "sheet_hidden", "body", "shared", "formats"])

    return files.select("path", "content").mapInPandas(run, _SHEET)


def _pieces(body: bytes, shared: list[str], formats: list[str]) -> Iterator[tuple]:
    """(kind, row, col, row2, col2, row_hidden, raw, type, formula, number_format): cells in their order, hidden column ranges, merged ranges."""
    hidden = False
    for event, e in ET.iterparse(io.BytesIO(zlib.decompress(body)), ("start", "end")):
        tag = e.tag.removeprefix(_MAIN)
        if event == "start":
            if tag == "row":
                hidden = e.get("hidden") in ("1", "true")
            continue
        if tag == "col" and e.get("hidden") in ("1", "true"):
            yield "columns", None, int(e.get("min")) - 1, None, int(e.get("max")) - 1, None, None, None, None, None
        elif tag == "mergeCell":
            first, _, last = e.get("ref").partition(":")
            yield "merge", *_place(first), *_place(last or first), None, None, None, None, None
        elif tag == "c" and e.get("r"):
            kind, value, formula = e.get("t", "n"), e.find(f"{_MAIN}v"), e.find(f"{_MAIN}f")
            raw = _texts(e) if kind == "inlineStr" else value.text if value is not None else None
            raw = shared[int(raw)] if kind == "s" and raw is not None else raw
            if raw is not None or formula is not None:
                style = int(e.get("s", 0))
                yield "cell", *_place(e.get("r")), None, None, hidden, raw, kind, formula.text if formula is not None else None, formats[style] if style < len(formats) else None
        elif tag == "row":
            e.clear()


def sheet_pieces(sheets: DataFrame) -> DataFrame:
    """Cells, merged ranges and hidden column ranges of sheets, as rows; a sheet is read as a stream and handed on in slices."""
    names = [f.name for f in T._parse_datatype_string(_PIECE).fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in f.itertuples(index=False):
                held: list[tuple] = []
                for piece in _pieces(bytes(s.body), list(s.shared), list(s.formats)):
                    held.append((s.path, s.sheet_no, s.sheet, s.sheet_hidden, *piece))
                    if len(held) == _ROWS:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return sheets.repartition("path", "sheet_no").mapInPandas(run, _PIECE)


def workbook_cells(files: DataFrame, most: int | None = None) -> DataFrame:
    """Workbook files as cells: (path, sheet_no, sheet, row, col, ref, raw, type, formula, number_format, hidden, merged, warning).

    Each cell of a merged range has the value of its first. `hidden` is true for cells of hidden sheets, rows and columns. A
    formula without a stored value has a warning and no value. `most` keeps the first cells of a sheet in reading order and
    marks the last one kept; None keeps all.
    """
    key = ["path", "sheet_no"]
    # Parsing is paid once: three readers follow.
    pieces = settled(sheet_pieces(workbook_sheets(files)), "sheet-pieces")
    cells = pieces.filter("kind = 'cell'").drop("kind", "row2", "col2").withColumn("merged", F.lit(False))
    ranges = pieces.filter("kind = 'merge'").select(*key, F.col("row").alias("r1"), F.col("col").alias("c1"), "row2", "col2")
    # A range becomes its cells but the first; those take the first one's value, if it has any.
    covered = ranges.withColumn("row", F.explode(F.sequence("r1", "row2"))).withColumn("col", F.explode(F.sequence("c1", "col2"))).filter("row > r1 OR col > c1")
    first = cells.withColumnRenamed("row", "r1").withColumnRenamed("col", "c1").withColumn("merged", F.lit(True))
    spread = covered.join(first, [*key, "r1", "c1"]).select(*cells.columns)
    both = cells.join(covered.select(*key, "row", "col"), [*key, "row", "col"], "left_anti").select(*cells.columns).unionByName(spread)
    columns = pieces.filter("kind = 'columns'").groupBy(*key).agg(F.collect_list(F.struct("col", "col2")).alias("off"))
    d = both.join(columns, key, "left")
    in_off = F.exists(F.coalesce("off", F.array().cast("array<struct<col:int,col2:int>>")), lambda r: F.col("col").between(r["col"], r["col2"]))
    d = d.withColumn("hidden", F.col("sheet_hidden") | F.coalesce("row_hidden", F.lit(False)) | in_off)
    warning = F.when(F.col("formula").isNotNull() & F.col("raw").isNull(), "FORMULA_NOT_CACHED")
    if most is not None:
        d = d.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("row", "col"))).withColumn("_all", F.count("*").over(Window.partitionBy(*key))).filter(F.col("_n") <= most)
        warning = F.when((F.col("_n") == most) & (F.col("_all") > most), "CELLS_TRUNCATED").otherwise(warning)
    return d.select(*key, "sheet", "row", "col", reference(F.col("row"), F.col("col")).alias("ref"), "raw", "type", "formula", "number_format", "hidden", "merged", warning.alias("warning"))


# -- delimited files

#: What Windows-1252 has where ISO-8859-1, which Spark reads, has control characters.
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def sniffed(files: DataFrame) -> DataFrame:
    """Files (path, content) with encoding, delimiter and an upper bound of their columns.

    A file is UTF-8 if all of it is valid, else of one byte a character (Windows-1252). The delimiter is the one that its first twenty lines agree on most:
    first by the least count in a line, then by the sum; a file without any has one column.
    """
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    d = files.select("path", F.when(utf8, "UTF-8").otherwise("ISO-8859-1").alias("encoding"), F.when(utf8, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))
    d = d.select("path", "encoding", F.filter(F.split(F.regexp_replace("text", "^\\ufeff", ""), r"\r\n|\r|\n"), lambda x: x != "").alias("lines"))

    def score(i: int, mark: str) -> Column:
        counts = F.transform(F.slice("lines", 1, 20), lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))
        return F.struct(F.coalesce(F.array_min(counts), F.lit(0)).alias("least"), F.aggregate(counts, F.lit(0), lambda a, n: a + n).alias("all"), F.lit(-i).alias("order"), F.lit(mark).alias("mark"))

    scores = [score(i, m) for i, m in enumerate(DELIMITERS)]
    d = d.withColumn("delimiter", F.array_max(F.array(*scores))["mark"])
    return d.select("path", "encoding", "delimiter", F.coalesce(F.array_max(F.transform("lines", lambda x: F.length(x) - F.length(F.replace(x, F.col("delimiter"), F.lit(""))) + 1)), F.lit(1)).alias("width"))


def delimited_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All delimited files of a folder as cells (path, row, col, ref, value): values stay text, empty cells are dropped.

    Files are read once to be sniffed and once, group by group, by Spark's reader. A quoted value may hold delimiters and line
    ends; a file is one task, so that its rows keep their order.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.lower("path").rlike(r"\.(?:csv|tsv|txt|tab)$") & (F.col("length") > 0))
    groups = sniffed(files).groupBy("encoding", "delimiter").agg(F.collect_list("path").alias("paths"), F.max("width").alias("width")).collect()
    out = None
    for g in groups:
        names = [f"c{i}" for i in range(g.width)]
        rows = spark.read.csv(g.paths, schema=", ".join(f"{n} string" for n in names), sep=g.delimiter, encoding=g.encoding, header=False, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        rows = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), *names)
        rows = rows.withColumn("row", (F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).cast("int"))
        cells = rows.select("path", "row", F.posexplode(F.array(*names)).alias("col", "value")).filter("value IS NOT NULL AND value <> ''")
        cells = cells if g.encoding == "UTF-8" else cells.withColumn("value", F.translate("value", _CONTROLS, _WINDOWS))
        out = cells if out is None else out.unionByName(cells)
    if out is None:
        return spark.createDataFrame([], "path string, row int, col int, ref string, value string")
    marked = F.when((F.col("row") == 0) & (F.col("col") == 0), F.regexp_replace("value", "^\\ufeff", "")).otherwise(F.col("value"))
    return out.select("path", "row", "col", reference(F.col("row"), F.col("col")).alias("ref"), marked.alias("value"))


# -- tables on grids

_NUMBER = r"^[-+(]?[\d.,]+%?\)?$"


def islands(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells (by, row, col, ...) with `part`: the grid is cut at empty rows, each band at its empty columns, and so on in turn until no cut is left.

    A band is a run of row numbers without a gap: the number less its rank is one for all of it. Each turn is two windows over a
    part and settled, so a turn doesn't repeat the one before.
    """
    d, parts = cells.withColumn("part", F.lit("")), None
    while True:
        for axis in ("row", "col"):
            w = Window.partitionBy(*by, "part").orderBy(axis)
            d = d.withColumn("part", F.concat_ws(".", "part", (F.col(axis) - F.dense_rank().over(w)).cast("string")))
        d = settled(d, "islands")
        now = d.select(*by, "part").distinct().count()
        if now == parts:
            return d
        parts = now


def probable_tables(cells: DataFrame, by: list[str], value: str = "raw") -> DataFrame:
    """(by, r1, c1, r2, c2, range, has_header) of islands of two rows and two columns at least; the header is a first row of texts that are no numbers."""
    d = islands(cells.filter(F.coalesce(F.col(value), F.lit("")) != ""), by)
    top = F.min("row").over(Window.partitionBy(*by, "part"))
    word = (F.col("row") != top) | ~F.col(value).rlike(_NUMBER)
    t = d.withColumn("word", word).groupBy(*by, "part").agg(F.min("row").alias("r1"), F.min("col").alias("c1"), F.max("row").alias("r2"), F.max("col").alias("c2"), F.bool_and("word").alias("has_header")).filter("r2 > r1 AND c2 > c1")
    return t.select(*by, "r1", "c1", "r2", "c2", range_reference(*(F.col(c) for c in ("r1", "c1", "r2", "c2"))).alias("range"), "has_header")


def table_blocks(cells: DataFrame, tables: DataFrame, by: list[str], value: str = "raw") -> DataFrame:
    """Cells of the found tables as blocks (by, range, row, col, header, value): row 0 is the header if there is one, and names the columns below it."""
    t = tables.select(*by, "range", "r1", "c1", "r2", "c2", "has_header")
    inside = cells.join(t, by).filter(F.col("row").between(F.col("r1"), F.col("r2")) & F.col("col").between(F.col("c1"), F.col("c2")))
    d = inside.select(*by, "range", (F.col("row") - F.col("r1")).alias("row"), (F.col("col") - F.col("c1")).alias("col"), "has_header", F.col(value).alias("value"))
    heads = d.filter("has_header AND row = 0").select(*by, "range", "col", F.col("value").alias("header"))
    return d.join(heads, [*by, "range", "col"], "left").withColumn("is_header", F.col("has_header") & (F.col("row") == 0)).drop("has_header")
