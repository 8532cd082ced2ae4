"""The audit ledger: hash chain, verification, checkpoints, filters and keyset pages.

Appending is sequential by nature, so a chain belongs to a tenant and tenants are chained side by side; verification is one
lag over each chain and recomputes every hash natively.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.security import signed
from docketry.operators.fold import scanned

GENESIS, CHECKPOINT_EVERY, PAGE = "0" * 64, 1000, 500
BODY = ("seq", "event_id", "event_type", "actor", "object_id", "details")


def body(c: tuple[str, ...] = BODY) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c))


def append(events: DataFrame) -> DataFrame:
    """Chains events per tenant: seq from 1 in the order of (ts, event_id), prev_hash, hash = sha256(prev_hash|body).

    Rows are dealt by tenant and sorted; a tenant streams through and nothing but the last number and hash is carried.
    """
    ready = events.withColumn("rest", F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("")) for x in BODY if x != "seq")))
    names = [c for c in ready.select("tenant", *[c for c in ready.columns if c != "tenant"]).columns]

    def step(last: tuple[int, str] | None, row: tuple) -> tuple[tuple[int, str], list[tuple]]:
        seq, prev = (last[0] + 1, last[1]) if last else (1, GENESIS)
        mark = hashlib.sha256(f"{prev}|{seq}|{row[-1]}".encode()).hexdigest()
        return (seq, mark), [(*row[:-1], seq, prev, mark)]

    fields = [ready.schema[c] for c in names[:-1]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", seq long, prev_hash string, hash string"
    return scanned(ready.select(*names), "tenant", ["ts", "event_id"], step, schema, [*names[:-1], "seq", "prev_hash", "hash"])


def judged(ledger: DataFrame) -> DataFrame:
    """Each row with its fault: gap, link, hash or null."""
    w = Window.partitionBy("tenant").orderBy("seq")
    d = ledger.withColumn("_s", F.lag("seq").over(w)).withColumn("_h", F.lag("hash").over(w))
    fault = (
        F.when(F.col("seq") != F.coalesce(F.col("_s"), F.lit(0)) + 1, "gap")
        .when(F.col("prev_hash") != F.coalesce(F.col("_h"), F.lit(GENESIS)), "link")
        .when(F.col("hash") != F.sha2(F.concat_ws("|", "prev_hash", body()), 256), "hash")
    )
    return d.withColumn("fault", fault).drop("_s", "_h")


def verify(ledger: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Per tenant: rows, valid, first bad seq and reason; anchors (tenant, seq, hash) must be rows of the ledger, which shows a cut tail."""
    bad = F.col("fault").isNotNull()
    out = judged(ledger).groupBy("tenant").agg(F.count("*").alias("n"), F.min(F.when(bad, F.struct("seq", "fault"))).alias("first"))
    out = out.select("tenant", "n", F.col("first.seq").alias("bad_seq"), F.col("first.fault").alias("reason"))
    if anchors is not None:
        lost = anchors.join(ledger.select("tenant", "seq", "hash"), ["tenant", "seq", "hash"], "left_anti").groupBy("tenant").agg(F.min("seq").alias("lost"))
        out = out.join(lost, "tenant", "left").select("tenant", "n", F.coalesce("bad_seq", "lost").alias("bad_seq"), F.coalesce("reason", F.when(F.col("lost").isNotNull(), "anchor")).alias("reason"))
    return out.withColumn("valid", F.col("bad_seq").isNull())


def checkpoints(ledger: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    return ledger.filter(F.col("seq") % every == 0).select("tenant", "seq", "hash")


def signed_checkpoints(ledger: DataFrame, key: bytes, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Checkpoints (tenant, seq, hash) with a signature over all three."""
    return checkpoints(ledger, every).withColumn("signature", _signature(key))


def _signature(key: bytes) -> Column:
    return signed(F.concat_ws("|", "tenant", F.col("seq").cast("string"), "hash"), key)


def checkpoint_faults(ledger: DataFrame, signed_rows: DataFrame, key: bytes) -> DataFrame:
    """Each signed checkpoint with its fault: signature (not made by the key), lost (the ledger has no such row), hash (the row has another hash), or null."""
    rows = ledger.select("tenant", "seq", F.col("hash").alias("_hash"))
    fault = F.when(~F.col("signature").eqNullSafe(_signature(key)), "signature").when(F.col("_hash").isNull(), "lost").when(F.col("_hash") != F.col("hash"), "hash")
    return signed_rows.join(rows, ["tenant", "seq"], "left").withColumn("fault", fault).drop("_hash")


def latched(runs: DataFrame) -> DataFrame:
    """Verification runs with a state that stays invalid once a run was."""
    w = Window.partitionBy("tenant").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("state", F.when(F.min(F.col("valid").cast("int")).over(w) == 1, "valid").otherwise("invalid"))


def encode_cursor(seq: int) -> str:
    return base64.urlsafe_b64encode(f"seq:{seq}".encode()).decode()


def decode_cursor(cursor: str | None) -> int:
    return int(base64.urlsafe_b64decode(cursor).decode().removeprefix("seq:")) if cursor else 0


def page(ledger: DataFrame, cursor: str | None = None, limit: int = PAGE, tenant: str | None = None, actor: str | None = None, event_type: str | None = None, since=None, until=None) -> DataFrame:
    """One keyset page and one row more: filters and the cursor are in the scan, times are inclusive."""
    d = ledger.filter(F.col("seq") > decode_cursor(cursor))
    for c, v in (("tenant", tenant), ("actor", actor), ("event_type", event_type)):
        if v is not None:
            d = d.filter(F.col(c) == v)
    d = d.filter(F.col("ts") >= since) if since is not None else d
    d = d.filter(F.col("ts") <= until) if until is not None else d
    return d.orderBy("seq").limit(min(limit, PAGE) + 1)
