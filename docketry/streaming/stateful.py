"""Streams: windowed alerts with a watermark, anchored state per key, ledger and outbox sinks.

The anchored folds are the batch ones of `docketry.operators.workflow`; a stream only carries their state between batches.
Within a batch a key's events are folded in time order. State ends by event time: once the watermark has passed the last moment
at which it could matter, it is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docketry.operators.workflow import accept_times, anchor_starts, approve_step


def windowed_alerts(blocked: DataFrame, window: str = "10 minutes", slide: str = "1 minute", late: str = "5 minutes", alert_at: int = 3) -> DataFrame:
    """Users with at least `alert_at` blocked queries in a sliding window: (user_id, ts)."""
    return blocked.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "user_id").agg(F.count("*").alias("n")).filter(F.col("n") >= alert_at)


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """Rows with their epoch as event time; a key's state may end once no row before its end can come."""
    return rows.withColumn("event_time", F.timestamp_seconds("epoch")).withWatermark("event_time", late)


def _keep(state: GroupState, values: tuple, until_s: float) -> None:
    state.update(values)
    state.setTimeoutTimestamp(max(int(until_s * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def rate_limited(hits: DataFrame, limit: int, window_s: float, late: str = "1 hour") -> DataFrame:
    """(domain, epoch, hit_id, accepted): the state holds the times of accepted hits inside the window, at most `limit` of them, and ends with the window."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["epoch", "hit_id"])
        accepted, kept = accept_times(rows["epoch"].tolist(), limit, window_s, kept)
        _keep(state, (kept,), rows["epoch"].iloc[-1] + window_s)
        yield rows.assign(accepted=accepted)[["domain", "epoch", "hit_id", "accepted"]]

    rows = _timed(hits.select("domain", "epoch", "hit_id"), late)
    return rows.groupBy("domain").applyInPandasWithState(fold, "domain string, epoch double, hit_id long, accepted boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def collapsed(notices: DataFrame, span: float, late: str = "1 hour") -> DataFrame:
    """(dedupe_key, started, count) updates: the state is the open row's start and count, and ends when nothing more can join it."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, count = state.get if state.exists else (None, 0)
        times = sorted(pd.concat(list(frames))["epoch"].tolist())
        out: dict[float, int] = {anchor: count} if anchor is not None else {}
        for s in anchor_starts(times, span, anchor):
            out[s] = out.get(s, 0) + 1
        last = max(out)
        _keep(state, (last, out[last]), last + span)
        yield pd.DataFrame({"dedupe_key": key[0], "started": list(out), "count": list(out.values())})

    rows = _timed(notices.select("dedupe_key", "epoch"), late)
    return rows.groupBy("dedupe_key").applyInPandasWithState(fold, "dedupe_key string, started double, count long", "anchor double, count long", "update", GroupStateTimeout.EventTimeTimeout)


def approvals(events: DataFrame, keep_s: float = 30 * 86400, late: str = "1 hour") -> DataFrame:
    """(action_id, step, state, refused): the approval workflow as a stream of events; an action is forgotten `keep_s` after its last one."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        rows, last = [], 0.0
        for r in pd.concat(list(frames)).sort_values("step").itertuples(index=False):
            now, refused = approve_step(now, r.actor, r.verb, r.epoch, r.idempotency_key)
            rows.append((key[0], r.step, now[0], refused))
            last = max(last, r.epoch)
        _keep(state, now, last + keep_s)
        yield pd.DataFrame(rows, columns=["action_id", "step", "state", "refused"])

    keyed = events if "idempotency_key" in events.columns else events.withColumn("idempotency_key", F.lit(None).cast("string"))
    rows = _timed(keyed.select("action_id", "step", "actor", "verb", "epoch", "idempotency_key"), late)
    return rows.groupBy("action_id").applyInPandasWithState(fold, "action_id long, step long, state string, refused string", "state string, creator string, signed double, seen array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def outbox_sink(send: Callable[[dict], None], max_attempts: int = 5) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that delivers a batch's notices from the executors: each dedupe key once, exhausted ones not at all."""

    def deliver(rows) -> None:
        for r in rows:
            send(r.asDict())

    return lambda batch, _epoch: batch.filter(F.col("attempts") < max_attempts).dropDuplicates(["dedupe_key"]).foreachPartition(deliver)


def events_stream(spark, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the memory table of its results (tests and small controls only)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
