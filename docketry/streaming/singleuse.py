"""Approvals that may be used once, as state of a stream and as a fold over a table (K6, M).

An approval of a key is open until it is used, replaced or older than its time to live; a use without an open approval is
refused. The stream keeps, per key, the open approval (a value), the steps already handled so that repeated deliveries do
nothing (a map), and the refusals (a list); a timer by event time ends all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketry.operators.fold import scanned

#: Times the time to live after which nothing is known of an approval any more.
KEEP = 2
RESULT = "request_key string, step long, epoch double, verdict string"
_NAMES = ["request_key", "step", "epoch", "verdict"]


def use_step(opened: float | None, action: str, epoch: float, ttl_s: float) -> tuple[float | None, str]:
    """The approval's time after one action, and the verdict on it."""
    if action == "approve":
        return epoch, "opened"
    if opened is None or epoch - opened > KEEP * ttl_s:
        return None, "no_approval"
    if epoch - opened > ttl_s:
        return None, "expired"
    return None, "used"


def decisions(actions: DataFrame, ttl_s: float) -> DataFrame:
    """(request_key, step, epoch, verdict) of actions (request_key, step, epoch, action), in the order of (epoch, step); equal steps of a key are one delivery."""
    once = actions.select("request_key", "step", "epoch", "action").dropDuplicates(["request_key", "step"])

    def step(opened: object, row: tuple) -> tuple[object, list[tuple]]:
        opened, verdict = use_step(opened[0] if opened else None, row[3], row[2], ttl_s)
        return (opened,), [(row[0], row[1], row[2], verdict)]

    return scanned(once, "request_key", ["epoch", "step"], step, RESULT, _NAMES)


class SingleUse(StatefulProcessor):
    """The same fold over a stream; rows of a batch are taken in order of time."""

    def __init__(self, ttl_s: float, keep_s: float):
        self.ttl_s, self.keep_s = ttl_s, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "epoch double")
        self.handled = handle.getMapState("handled", "step long", "epoch double")
        self.refused = handle.getListState("refused", "step long, verdict string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened = self.opened.get()[0] if self.opened.exists() else None
        out, last = [], 0.0
        for r in pd.concat(list(rows)).sort_values(["epoch", "step"]).itertuples(index=False):
            if self.handled.containsKey((int(r.step),)):
                continue
            opened, verdict = use_step(opened, r.action, r.epoch, self.ttl_s)
            self.handled.updateValue((int(r.step),), (float(r.epoch),))
            if verdict not in ("opened", "used"):
                self.refused.appendValue((int(r.step), verdict))
            out.append((key[0], int(r.step), float(r.epoch), verdict))
            last = max(last, r.epoch)
        if opened is None:
            self.opened.clear()
        else:
            self.opened.update((opened,))
        if out:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(max(int((last + self.keep_s) * 1000), timerValues.getCurrentWatermarkInMs() + 1))
            yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.opened, self.handled, self.refused):
            state.clear()
        yield pd.DataFrame({"request_key": pd.Series(dtype="str"), "step": pd.Series(dtype="int64"), "epoch": pd.Series(dtype="float64"), "verdict": pd.Series(dtype="str")})

    def close(self) -> None:
        pass


def decided(actions: DataFrame, ttl_s: float, late: str = "1 hour") -> DataFrame:
    """The stream of verdicts on a stream of actions. Its state store must be RocksDB, which `with_state_store` sets."""
    rows = actions.select("request_key", "step", "epoch", "action").withColumn("event_time", F.timestamp_seconds("epoch")).withWatermark("event_time", late)
    return rows.groupBy("request_key").transformWithStateInPandas(SingleUse(ttl_s, KEEP * ttl_s), RESULT, "append", "eventTime")


def with_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
