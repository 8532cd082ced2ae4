"""Spreadsheet number formats: sections, colours and conditions, grouping, scaling, percent, scientific, fractions, dates, text."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_TOKEN = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]|AM/PM|A/P|yyyy|yy|mmmmm|mmmm|mmm|mm|m|dddd|ddd|dd|d|hh|h|ss(?:\.0+)?|s(?:\.0+)?|E[+-]0+|General|@|.', re.I)
_CONDITION = re.compile(r"\[(<=|>=|<>|<|>|=)(-?[\d.]+)\]")
_TEST = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}


def sections(code: str) -> list[str]:
    return re.findall(r'(?:"[^"]*"|\\.|[^;"\\])+|(?<=;)(?=;|$)', code) or [code]


def _literal(token: str) -> str | None:
    if token.startswith('"'):
        return token[1:-1]
    if token.startswith("\\"):
        return token[1:]
    if token.startswith("_"):
        return " "
    if token.startswith("*"):
        return ""
    if token.startswith("[$"):
        return token[2:-1].split("-")[0]
    if token.startswith("[") and not re.fullmatch(r"\[[hms]+\]", token, re.I):
        return ""
    return None


def is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', "", code, flags=re.I)
    return bool(re.search(r"[ymdhs]", bare, re.I)) and not re.search(r"[0#?]", re.sub(r"\.0+", "", bare))


def general(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.10g}"


def to_datetime(serial: float, epoch_1904: bool = False) -> datetime:
    base = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    return base + timedelta(seconds=round(serial * 86400))


def _date(serial: float, code: str, epoch_1904: bool) -> str:
    tokens, t = _TOKEN.findall(code), to_datetime(serial, epoch_1904)
    noon, out, after_hour = any(x.upper() in ("AM/PM", "A/P") for x in tokens), [], False
    for i, k in enumerate(tokens):
        low, literal = k.lower(), _literal(k)
        ahead = next((x.lower() for x in tokens[i + 1 :] if re.fullmatch(r"[hs]{1,2}(?:\.0+)?|[ymd]+", x, re.I)), "")
        hour = (t.hour % 12 or 12) if noon else t.hour
        minute = low in ("m", "mm") and (after_hour or ahead.startswith("s"))
        if literal is not None:
            out.append(literal)
            continue
        value = {"yyyy": f"{t.year}", "yy": f"{t.year % 100:02d}", "mmmm": _MONTHS[t.month - 1], "mmm": _MONTHS[t.month - 1][:3], "mmmmm": _MONTHS[t.month - 1][0], "dddd": _DAYS[t.weekday()], "ddd": _DAYS[t.weekday()][:3], "dd": f"{t.day:02d}", "d": f"{t.day}", "hh": f"{hour:02d}", "h": f"{hour}", "ss": f"{t.second:02d}", "s": f"{t.second}", "am/pm": "AM" if t.hour < 12 else "PM", "a/p": "A" if t.hour < 12 else "P"}.get(low)
        if low in ("m", "mm"):
            n = t.minute if minute else t.month
            value = f"{n:02d}" if low == "mm" else str(n)
        elif re.fullmatch(r"\[h+\]", low):
            value = str(int(serial * 24 + 1e-9))
        elif re.fullmatch(r"\[m+\]", low):
            value = str(int(serial * 1440 + 1e-9))
        out.append(k if value is None else value)
        if re.fullmatch(r"\[?h+\]?", low):
            after_hour = True
        elif low[0] in "ymds" and low[0] != "m":
            after_hour = False
    return "".join(out)


def _grouped(digits: str) -> str:
    return f"{int(digits):,}" if digits else ""


def _interleaved(x: float, code: str) -> str:
    """Whole-number digits laid from the right into placeholders that literals part; leading ones without digits fall away."""
    tokens, digits, out = _TOKEN.findall(code), f"{Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_UP):f}", []
    first = next(i for i, t in enumerate(tokens) if t in "0#?")
    for i, t in reversed(list(enumerate(tokens))):
        if t in "0#?":
            if i == first:
                out.append(digits)
                digits = ""
            elif digits:
                out.append(digits[-1])
                digits = digits[:-1]
            elif t == "0":
                out.append("0")
        elif digits or i < first:
            out.append(_literal(t) if _literal(t) is not None else t)
    return "".join(reversed(out))


def _number(x: float, code: str) -> str:
    """A numeric section on a value whose sign is already dealt with."""
    if re.search(r'[0#?](?:\\.|"[^"]*")[0#?]', code):
        return _interleaved(x, code)
    m = re.search(r'(?:(?<=^)|(?<=[^0#?]))[0#?][0#?,.]*(?:E[+-]0+|\s*[0#?]*/[0#?\d]+)?|[0#?.,]+', re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', lambda k: "\0" * len(k[0]), code))
    if not m:
        return "".join(v for v in (_literal(t) if _literal(t) is not None else t for t in _TOKEN.findall(code)))
    core = m[0]
    text = lambda part: "".join(_literal(t) if _literal(t) is not None else t for t in _TOKEN.findall(part)) if part else ""
    value = Decimal(repr(x))
    value *= Decimal(100) ** code.count("%")
    if "E" in core.upper():
        mantissa, exponent = re.split("E", core, flags=re.I)
        places = len(mantissa.partition(".")[2])
        a, b = f"{value:.{places}E}".split("E")
        sign = "-" if int(b) < 0 else "+" if exponent[0] == "+" else ""
        shown = f"{a}E{sign}{abs(int(b)):0{len(exponent) - 1}d}"
    elif "/" in core:
        den = core.rpartition("/")[2]
        whole = int(value) if re.search(r"[0#?]\s+[0#?]", core) else 0
        part = Fraction(value) - whole
        f = Fraction(round(part * int(den)), int(den)) if den.isdigit() else part.limit_denominator(10 ** len(den) - 1)
        shown = " ".join(([str(whole)] if whole else []) + ([f"{f.numerator}/{f.denominator}"] if f else [])) or "0"
    else:
        while core.endswith(","):
            core, value = core[:-1], value / 1000
        left, _, right = core.partition(".")
        value = value.quantize(Decimal(1).scaleb(-len(right)), ROUND_HALF_UP)
        whole, _, fraction = f"{value:f}".partition(".")
        least = left.count("0")
        whole = whole.lstrip("0").rjust(least, "0")
        while fraction and right[len(fraction) - 1] == "#" and fraction[-1] == "0":
            fraction = fraction[:-1]
        shown = (_grouped(whole).rjust(least, "0") if "," in left and whole else whole) + (f".{fraction}" if fraction else "")
    return text(code[: m.start()]) + shown + text(code[m.end() :])


def format_value(value: object, code: str | None, epoch_1904: bool = False) -> str:
    """A cell's displayed text."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    parts = sections(code) if code else []
    if isinstance(value, str):
        if len(parts) >= 4 or (parts and "@" in parts[-1]):
            return "".join(value if t == "@" else _literal(t) or "" for t in _TOKEN.findall(parts[-1]))
        return value
    x = float(value)
    if not code or code.lower() == "general" or code == "@":
        return general(x)
    parts = parts[:3]
    conditions = [_CONDITION.search(p) for p in parts]
    if any(conditions):
        chosen = next((p for p, c in zip(parts, conditions) if c is None or _TEST[c[1]](x, float(c[2]))), parts[-1])
        sign = "-" if x < 0 and chosen is parts[-1] and conditions[-1] is None else ""
        x = abs(x)
    elif x < 0 and len(parts) > 1:
        chosen, x, sign = parts[1], -x, ""
    elif x == 0 and len(parts) > 2:
        chosen, sign = parts[2], ""
    else:
        chosen, sign = parts[0], "-" if x < 0 else ""
        x = abs(x)
    if chosen.lower().strip() == "general":
        return sign + general(x)
    return _date(x, chosen, epoch_1904) if is_date(chosen) else sign + _number(x, chosen)


@F.pandas_udf(T.StringType())
def format_number_udf(value: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([format_value(None if v is None or v != v else v, c) for v, c in zip(value, code)])
