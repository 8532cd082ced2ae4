"""Sources: intake by magic bytes, routing, HTML and mail text, delimited files, workbooks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.addresses import address_fault
from docketry.functions.words import bound

MAX_BYTES, MAX_RATIO, MAX_DEPTH = 100 << 20, 100, 1
#: Hex prefixes of file kinds.
_MAGIC = (("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("504B0304", "application/zip"), ("D0CF11E0", "application/x-ole"), ("1F8B", "application/gzip"))
#: Router thresholds: least characters of a text page, image shares of scanned and mixed pages, and of a blank one.
MIN_CHARS, SCANNED, MIXED, BLANK = 20, 0.80, 0.25, 0.01
_SKIP = frozenset("script style head title noscript template".split())
_BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article table ul ol header footer nav aside td th pre blockquote".split())


def detect_mime(content: Column, extension: Column) -> Column:
    """The kind of a file by its first bytes; mail is tried before HTML, delimited text needs its extension and printable bytes."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.decode(F.substring(content, 1, 2048), "ISO-8859-1")
    out = F.when(F.octet_length(content) == 0, F.lit(None))
    for prefix, mime in _MAGIC:
        out = out.when(head.startswith(prefix), mime)
    printable = F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")) >= 0.95 * F.length(text)
    mail = text.rlike(r"(?im)\A(?:[A-Za-z-]+:[^\n]*\r?\n(?:[ \t][^\n]*\n)*)*?(?:From|To|Subject|Received|Message-ID):")
    return out.when(mail & printable, "message/rfc822").when(text.rlike(r"(?i)<(?:!doctype html|html|body|head)\b"), "text/html").when(F.lower(extension).isin("csv", "tsv") & printable, "text/csv").when(printable, "text/plain").otherwise("application/octet-stream")


def zip_report(content: bytes) -> tuple[str | None, str, int]:
    """(reason to refuse or None, kind, parts) of a ZIP: traversal, bombs, macros and nested archives are refused."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
    except zipfile.BadZipFile:
        return "CORRUPT_ARCHIVE", "zip", 0
    names = [i.filename for i in infos]
    if any(n.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", n) for n in names):
        return "PATH_TRAVERSAL", "zip", 0
    if any(i.flag_bits & 1 for i in infos):
        return "ENCRYPTED", "zip", 0
    if sum(i.file_size for i in infos) > MAX_RATIO * max(sum(i.compress_size for i in infos), 1):
        return "ARCHIVE_BOMB", "zip", 0
    if any(n.lower().endswith("vbaproject.bin") for n in names):
        return "MACROS", "zip", 0
    for kind, part in (("xlsx", r"xl/worksheets/[^/]+\.xml"), ("docx", r"word/document\.xml"), ("pptx", r"ppt/slides/slide\d+\.xml")):
        if n := sum(bool(re.fullmatch(part, x)) for x in names):
            return None, kind, n
    return ("NESTED_ARCHIVE" if any(n.lower().endswith((".zip", ".gz", ".7z", ".rar")) for n in names) else None), "zip", len(names)


def intake(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files (path, content) as sources: name, digest, kind, size, status with reason, and the first file with the same digest."""
    from docketry.functions.text import sanitize_filename

    d = files.select("path", "content", sanitize_filename(F.col("path")).alias("filename"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"))
    d = d.withColumn("mime", detect_mime(F.col("content"), F.regexp_extract("filename", r"\.(\w+)$", 1)))

    @F.pandas_udf("struct<reason:string,kind:string,parts:long>")
    def archive(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([zip_report(bytes(c)) for c in content], columns=["reason", "kind", "parts"])

    d = d.withColumn("zip", F.when(F.col("mime") == "application/zip", archive("content")))
    low = F.decode("content", "ISO-8859-1")
    pdf = F.when(F.col("mime") == "application/pdf", F.when(low.contains("/Encrypt"), "ENCRYPTED").when(low.contains("/Launch"), "ACTIVE_CONTENT"))
    reason = F.when(F.col("size_bytes") == 0, "EMPTY").when(F.col("size_bytes") > max_bytes, "TOO_LARGE").when(F.col("mime").isin("application/octet-stream", "application/x-ole", "application/gzip"), "UNSUPPORTED").otherwise(F.coalesce(pdf, F.col("zip.reason")))
    first = F.min("path").over(Window.partitionBy("sha256"))
    return d.select("path", "filename", "sha256", "size_bytes", "mime", F.col("zip.kind").alias("kind"), F.col("zip.parts").alias("parts"), reason.alias("reason"), F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), F.when(first != F.col("path"), first).alias("duplicate_of"))


def classify_page(chars: Column, image_share: Column, vector: Column) -> Column:
    """native_text, scanned, mixed, image_only or blank."""
    text = chars >= MIN_CHARS
    return F.when(text & (image_share < MIXED), "native_text").when(text & (image_share >= SCANNED), "scanned").when(text, "mixed").when(image_share >= SCANNED, "scanned").when(image_share > BLANK, "image_only").when((chars > 0) | vector, "native_text").otherwise("blank")


def route(pages: DataFrame) -> DataFrame:
    """Route of each source from its page classes: (source_id, page_class)."""
    n = lambda c: F.count_if(F.col("page_class") == c)
    d = pages.groupBy("source_id").agg(F.count("*").alias("pages"), n("native_text").alias("native"), (n("scanned") + n("image_only")).alias("scanned"), n("mixed").alias("mixed"), n("blank").alias("blank"))
    r = F.when(F.col("blank") == F.col("pages"), "blank").when(F.col("native") + F.col("blank") == F.col("pages"), "native").when(F.col("scanned") + F.col("blank") == F.col("pages"), "ocr").otherwise("mixed")
    return d.withColumn("route", r)


def rotation_vote(units: DataFrame) -> DataFrame:
    """The rotation that more than half of a source's pages vote for, else 0."""
    votes = units.groupBy("source_id", "rotation").count()
    return votes.groupBy("source_id").agg(F.max_by("rotation", F.struct("count", -F.col("rotation"))).alias("top"), F.max("count").alias("n"), F.sum("count").alias("all")).select("source_id", F.when(F.col("n") * 2 > F.col("all"), F.col("top")).otherwise(0).alias("rotation"))


class _Visible(HTMLParser):
    """Lines of visible text; hidden elements and what they hold are passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.stack, self.hidden, self.links = [], [], 0, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _BLOCKS:
            self.parts.append("\n")
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        off = tag in _SKIP or "hidden" in a or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))
        self.stack.append((tag, off))
        self.hidden += off
        if tag == "a" and not self.hidden and a.get("href"):
            self.links.append(a["href"])

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                t, off = self.stack.pop()
                self.hidden -= off
                if t == tag:
                    break
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible(source: str | None) -> tuple[list[str], list[str]]:
    """(visible lines, links) of a page."""
    p = _Visible()
    p.feed(source or "")
    p.close()
    return [x for x in (" ".join(y.split()) for y in "".join(p.parts).split("\n")) if x], p.links


@F.pandas_udf(T.StructType([T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StringType()))]))
def _visible_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([visible(h) for h in html], columns=["lines", "links"])


def html_lines(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, line_no, text): visible lines; they have no box, and say why."""
    return pages.select(key, _visible_udf("html").alias("v")).select(key, F.posexplode("v.lines").alias("line_no", "text")).withColumns({"bbox": F.lit(None).cast("array<double>"), "bbox_unavailable_reason": F.lit("not_paginated")})


def html_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    return pages.select(key, _visible_udf("html").alias("v")).select(key, F.posexplode("v.links").alias("link_no", "href"))


def text_spans(texts: DataFrame, key: str, column: str) -> DataFrame:
    """One span a non-blank line, with its number in the text."""
    return texts.select(key, F.posexplode(F.split(column, r"\r?\n")).alias("line_no", "text")).withColumn("text", F.trim("text")).filter("text <> ''")


def mail_parts(content: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """(head and preferred body as text, attachments)."""
    m = message_from_bytes(content, policy=policy.default)
    head = "\n".join(f"{h}: {m[h]}" for h in ("From", "To", "Cc", "Date", "Subject") if m[h])
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_subtype() == "html":
        text = "\n".join(visible(text)[0])
    return f"{head}\n\n{text.strip()}", [(a.get_filename() or "attachment", a.get_payload(decode=True) or b"") for a in m.iter_attachments()]


def mails(files: DataFrame) -> DataFrame:
    """Mail files (path, content) as a body unit and child sources: (path, part, filename, text, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                text, attached = mail_parts(bytes(content))
                rows.append((path, 0, None, text, None))
                rows += [(path, i, name, None, data) for i, (name, data) in enumerate(attached, 1)]
            yield pd.DataFrame(rows, columns=["path", "part", "filename", "text", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, part int, filename string, text string, content binary")


def cells_of(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A wide table as cells (key, col, value): values stay text, empty cells are dropped."""
    cells = F.array(*(F.struct(F.lit(i).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)))
    return rows.select(key, F.explode(cells).alias("c")).select(key, "c.col", "c.value").filter("value IS NOT NULL AND value <> ''")


def probable_tables(cells: DataFrame, by: str = "sheet") -> DataFrame:
    """Row bands of a cell grid (by, row, col, value): runs of rows without a gap, with their box and whether the first row is all text."""
    rows = cells.groupBy(by, "row").agg(F.min("col").alias("c1"), F.max("col").alias("c2"), F.min((~F.col("value").rlike(r"^[\d.,%()\-]+$")).cast("int")).alias("words"))
    band = F.col("row") - F.row_number().over(Window.partitionBy(by).orderBy("row"))
    return rows.withColumn("band", band).groupBy(by, "band").agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("c1").alias("c1"), F.max("c2").alias("c2"), (F.min_by("words", "row") == 1).alias("header")).filter("r2 > r1 AND c2 > c1").drop("band")


def url_policy(url: Column) -> Column:
    """null for a URL that may be fetched, else why not: scheme, credentials, host, port, private address.

    A host that ends in a number must be a plain public address, so that no other spelling of one passes; a host without a dot
    is internal; version 6 addresses are judged as what they carry.
    """
    scheme, host = F.lower(F.call_function("try_parse_url", url, F.lit("PROTOCOL"))), F.lower(F.call_function("try_parse_url", url, F.lit("HOST")))
    user, port = F.call_function("try_parse_url", url, F.lit("USERINFO")), F.regexp_extract(F.call_function("try_parse_url", url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    numeric = host.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$") | host.startswith("[")
    private = numeric & bound(host, lambda h: address_fault(h).isNotNull())
    return (
        F.when(scheme.isNull() | ~scheme.isin("http", "https"), "SCHEME")
        .when(user.isNotNull(), "CREDENTIALS_IN_URL")
        .when(host.isNull() | (host == ""), "NO_HOST")
        .when((host == "localhost") | host.rlike(r"\.(?:local|internal|localhost)$") | private | (~numeric & ~host.contains(".")), "PRIVATE_ADDRESS")
        .when((port != "") & ~port.isin("80", "443"), "PORT")
    )


def registered_elements(elements: DataFrame, width: float, height: float, review_below: float = 0.85) -> DataFrame:
    """Fetched page elements (element_id, text, bbox, confidence) as blocks: blank ones dropped, boxes clamped, weak ones for review."""
    clamp = lambda i, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.get("bbox", F.lit(i)).cast("double")))
    d = elements.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return d.withColumn("bbox", F.array(clamp(0, width), clamp(1, height), clamp(2, width), clamp(3, height))).withColumn("needs_review", F.col("confidence") < review_below)


def restored(state: DataFrame) -> DataFrame:
    """Saved jobs after a restart: what was running is interrupted."""
    return state.withColumn("status", F.when(F.col("status").isin("running", "queued"), "interrupted").otherwise(F.col("status")))
