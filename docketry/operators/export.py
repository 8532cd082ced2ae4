"""Exports: flattening, renderers, signed links."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.security import check_signature, csv_safe, mask_sensitive, sign
from docketry.functions.text import escape_html, escape_markdown

ROWS, LINK_TTL_S = 200_000, 900
#: Columns and fields that name evidence, left out of exports that are not to carry it.
EVIDENCE = ("evidence", "excerpt", "bbox")
RENDERERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def renderer(name: str):
    def add(f):
        RENDERERS[name] = f
        return f

    return add


def _paths(schema: T.StructType, prefix: str = ""):
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            yield from _paths(f.dataType, f"{path}.")
        else:
            yield path, f.dataType


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names; arrays and maps as JSON texts; everything as text."""
    cell = lambda p, t: F.to_json(F.col(p)) if isinstance(t, (T.ArrayType, T.MapType)) else F.col(p).cast("string")
    return df.select(*(cell(p, t).alias(p.replace(".", "__")) for p, t in _paths(df.schema)))


def long_form(df: DataFrame, key: str) -> DataFrame:
    """(key, field, value) rows of a flat frame, null fields left out."""
    rest = [c for c in df.columns if c != key]
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in rest))
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.field", "p.value").filter("value IS NOT NULL")


def row_tables(items: DataFrame, key: str, rows: str) -> DataFrame:
    """Cells (key, row, place, column, value) of the tables that a JSON text column holds as lists of objects, ragged ones too.

    A table's columns are all that any of its objects has, in the order in which they first come; an object without one gives an
    empty text there, as a null does; what is nested is a JSON text. Texts that are no such list have no cells.
    """
    objects = F.from_json(F.col(rows), "array<map<string,string>>")
    cells = items.select(F.col(key), F.posexplode(objects).alias("row", "o")).select(key, "row", F.posexplode_outer("o").alias("_at", "column", "value"))
    first = cells.filter("column IS NOT NULL").groupBy(key, "column").agg(F.min(F.struct("row", "_at")).alias("_first"))
    columns = first.select(key, "column", (F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1).alias("place"))
    grid = cells.select(key, "row").distinct().join(columns, key)
    return grid.join(cells.select(key, "row", "column", "value"), [key, "row", "column"], "left").select(key, "row", "place", "column", F.coalesce("value", F.lit("")).alias("value"))


def without_evidence(df: DataFrame, evidence: tuple[str, ...] = EVIDENCE) -> DataFrame:
    """The frame without its evidence columns, and without the evidence fields of its structs at any depth."""

    def kept(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            fields = [kept(c[f.name], f.dataType).alias(f.name) for f in t.fields if f.name not in evidence]
            return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.ArrayType)):
            return F.transform(c, lambda x: kept(x, t.elementType))
        return c

    return df.select(*(kept(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in evidence))


def prepared(df: DataFrame, locked: list[str], masked: list[str], rows: int | None = ROWS, key: str | None = None) -> DataFrame:
    """Locked columns dropped, sensitive ones masked, the export's row limit applied: the first `rows` in the order of `key`, or of all columns. None exports all rows."""
    out = df.drop(*locked)
    out = out.withColumns({c: mask_sensitive(F.col(c)) for c in masked if c in out.columns})
    return out if rows is None else out.orderBy(*([key] if key else out.columns)).limit(rows)


def content_digest(lines: DataFrame) -> DataFrame:
    """One row of a rendered export: its lines and a digest that is the same in any order of rows or partitions, to check a download against."""
    part = lambda i: F.conv(F.substring(F.sha2("line", 256), 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")
    return lines.agg(F.count("*").alias("n_lines"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(F.coalesce(F.sum(part(i)), F.lit(0)).cast("string") for i in range(4))), 256).alias("digest"))


def _joined(df: DataFrame, cell: Callable[[Column], Column], sep: str, left: str = "", right: str = "") -> DataFrame:
    return df.select(F.concat(F.lit(left), F.concat_ws(sep, *(F.coalesce(cell(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns)), F.lit(right)).alias("line"))


@renderer("json")
def to_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


@renderer("csv")
def to_csv_lines(df: DataFrame) -> DataFrame:
    quote = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return _joined(df, lambda c: quote(csv_safe(c)), ",")


@renderer("markdown")
def to_markdown_rows(df: DataFrame) -> DataFrame:
    return _joined(df, escape_markdown, " | ", "| ", " |")


@renderer("html")
def to_html_rows(df: DataFrame) -> DataFrame:
    return _joined(df, escape_html, "</td><td>", "<tr><td>", "</td></tr>")


def render(df: DataFrame, kind: str) -> DataFrame:
    if kind not in RENDERERS:
        raise ValueError(f"UNSUPPORTED_FORMAT: {kind}")
    return RENDERERS[kind](df)


def exports(df: DataFrame, kinds: list[str], folder: str) -> dict[str, str]:
    """Writes each format; one format's failure is reported and does not stop the others."""
    out = {}
    for kind in kinds:
        try:
            render(df, kind).write.mode("overwrite").text(f"{folder}/{kind}")
            out[kind] = "ok"
        except ValueError as e:
            out[kind] = str(e)
    return out


def signed_link(export_id: str, user: str, key: bytes, ttl: int = LINK_TTL_S, now: float | None = None) -> str:
    until = int((time.time() if now is None else now) + ttl)
    return f"/exports/{export_id}?exp={until}&sig={sign(f'{export_id}:{user}:{until}', key)}"


def link_valid(link: str, user: str, key: bytes, now: float | None = None) -> bool:
    head, _, query = link.partition("?")
    args = dict(x.split("=", 1) for x in query.split("&"))
    message = f"{head.rsplit('/', 1)[1]}:{user}:{args['exp']}"
    return check_signature(message, key, args["sig"]) and int(args["exp"]) >= (time.time() if now is None else now)


def history(exports_table: DataFrame, user: str, limit: int = 50) -> DataFrame:
    return exports_table.filter(F.col("user_id") == user).orderBy(F.desc("created_at"), "export_id").limit(limit)
