"""Nested values: keys dropped, values masked, floats as text, texts collected, at any depth.

A column's type is walked once, on the driver, and becomes one expression: structs field by field, arrays and map values by
`transform`. Work on rows is native. JSON texts of any shape are given the type that fits all of them (`typed_json`) first.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import security

#: Words in the names of keys whose values are secret, what stands for them, and how deep a value may be nested.
SECRET_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "cookie", "ssn", "iban")
REDACTED, TOO_DEEP, MAX_DEPTH = "[redacted]", "[too deep]", 12

Leaf = Callable[[Column, T.DataType], Column]
KeyRule = Callable[[str], bool]


def is_secret(name: str) -> bool:
    return any(w in name.lower() for w in SECRET_KEYS)


def named(*names: str) -> KeyRule:
    """A rule that fits the given keys, whatever their case."""
    low = {n.lower() for n in names}
    return lambda name: name.lower() in low


def _secret_key(key: Column) -> Column:
    return F.lower(key).rlike("|".join(map(re.escape, SECRET_KEYS)))


def rewritten(value: Column, kind: T.DataType, leaf: Leaf, drop: KeyRule = lambda _: False, hide: KeyRule = lambda _: False, depth: int = MAX_DEPTH) -> Column:
    """`value` with `leaf(value, type)` for each value that is not nested, without the keys that `drop` names; values under keys that `hide` names become REDACTED.

    Keys of maps are data: `drop` and `hide` don't see them, but entries whose key looks secret are redacted if `hide` is
    `is_secret`. What is nested deeper than `depth` becomes TOO_DEEP. Nulls stay null.
    """
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) and depth == 0:
        return F.when(value.isNotNull(), F.lit(TOO_DEEP))
    again = lambda v, k: rewritten(v, k, leaf, drop, hide, depth - 1)
    if isinstance(kind, T.StructType):
        fields = [f for f in kind.fields if not drop(f.name)]
        hidden = lambda f: F.when(value.getField(f.name).isNotNull(), F.lit(REDACTED))
        built = F.struct(*((hidden(f) if hide(f.name) else again(value.getField(f.name), f.dataType)).alias(f.name) for f in fields)) if fields else F.lit(None)
        return F.when(value.isNotNull(), built)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: again(x, kind.elementType))
    if isinstance(kind, T.MapType):
        plain = lambda v: again(v, kind.valueType)
        return F.transform_values(value, (lambda k, v: F.when(_secret_key(k), F.lit(REDACTED)).otherwise(plain(v).cast("string"))) if hide is is_secret and not isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)) else (lambda k, v: plain(v)))
    return leaf(value, kind)


def _masked_text(value: Column, kind: T.DataType) -> Column:
    return security.mask_sensitive(value) if isinstance(kind, T.StringType) else value


def _audit_leaf(value: Column, kind: T.DataType) -> Column:
    """Texts masked, floats and decimals as text, the rest as it is."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return value.cast("string")
    return _masked_text(value, kind)


def _column(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    return F.col(f"`{name}`"), df.schema[name].dataType


def without_keys(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """The column without the named keys at any depth (an export's locked fields)."""
    value, kind = _column(df, column)
    return df.withColumn(column, rewritten(value, kind, lambda v, _: v, drop=named(*keys)))


def masked(df: DataFrame, column: str, *hidden: str) -> DataFrame:
    """The column with its texts masked and the values of the named keys redacted."""
    value, kind = _column(df, column)
    return df.withColumn(column, rewritten(value, kind, _masked_text, hide=named(*hidden)))


def audit_safe(df: DataFrame, column: str, depth: int = MAX_DEPTH) -> DataFrame:
    """The column as a ledger may hold it: secret keys redacted, texts masked, floats as text so that digests don't depend on their printing."""
    value, kind = _column(df, column)
    return df.withColumn(column, rewritten(value, kind, _audit_leaf, hide=is_secret, depth=depth))


def collected_text(df: DataFrame, column: str, keys: tuple[str, ...], name: str = "texts", depth: int = 5) -> DataFrame:
    """Adds `name`, an array of the texts under the given keys, in the order of the type, at most `depth` levels down."""
    wanted = named(*keys)

    def walk(v: Column, kind: T.DataType, under: bool, left: int) -> Column | None:
        if isinstance(kind, T.StringType):
            return F.array(v) if under else None
        if left == 0:
            return None
        if isinstance(kind, T.StructType):
            parts = [x for f in kind.fields if (x := walk(v.getField(f.name), f.dataType, wanted(f.name), left - 1)) is not None]
            empty = F.array().cast("array<string>")
            return F.concat(*(F.coalesce(p, empty) for p in parts)) if parts else None
        if isinstance(kind, T.ArrayType):
            if walk(F.lit(None), kind.elementType, under, left - 1) is None:
                return None
            return F.flatten(F.transform(v, lambda x: F.coalesce(walk(x, kind.elementType, under, left - 1), F.array().cast("array<string>"))))
        return None

    value, kind = _column(df, column)
    found = walk(value, kind, False, depth + 1)
    return df.withColumn(name, F.array_compact(F.coalesce(found, F.array().cast("array<string>"))) if found is not None else F.array().cast("array<string>"))


def typed_json(df: DataFrame, column: str) -> DataFrame:
    """A column of JSON texts as values of the one type that fits them all, found by one aggregation over their variants; texts that are no JSON become null.

    Where rows disagree on a key, its values are texts: JSON texts if they are nested.
    """
    variants = df.withColumn(column, F.try_parse_json(F.col(f"`{column}`")))
    found = variants.agg(F.schema_of_variant_agg(F.col(f"`{column}`")).alias("s")).first().s or "VOID"
    kind = re.sub(r"\bOBJECT<", "STRUCT<", found)
    kind = re.sub(r"\b(?:VARIANT|VOID)\b", "STRING", kind)
    return variants.withColumn(column, F.variant_get(F.col(f"`{column}`"), "$", kind))


def json_text(df: DataFrame, column: str) -> DataFrame:
    """Back to JSON texts, keys without a value left out."""
    value, kind = _column(df, column)
    return df.withColumn(column, F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string"))


def redacted_json(df: DataFrame, column: str, *dropped: str) -> DataFrame:
    """JSON texts without the dropped keys and otherwise `audit_safe`."""
    typed = typed_json(df, column)
    return json_text(audit_safe(without_keys(typed, column, *dropped), column), column)
