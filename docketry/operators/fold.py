"""Folding sorted rows key by key inside a partition: one Python call a batch instead of one a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame


def folded(df: DataFrame, key: str, order: list[str], step: Callable[[list[tuple]], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    """`step(rows of one key, in order) -> result rows`; the key is the first column of `df`, its rows may cross Arrow batches.

    Rows are dealt by the key and sorted by Spark, so a partition streams through and one key's rows are held at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_rows: list[tuple] = []
        for frame in frames:
            out: list[tuple] = []
            for _, rows in groupby(frame.itertuples(index=False, name=None), key=lambda r: r[0]):
                rows = list(rows)
                if open_rows and open_rows[0][0] != rows[0][0]:
                    out += step(open_rows)
                    open_rows = []
                open_rows += rows
            if out:
                yield pd.DataFrame(out, columns=names)
        if open_rows:
            yield pd.DataFrame(step(open_rows), columns=names)

    first = df.select(key, *[c for c in df.columns if c != key])
    return first.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def scanned(df: DataFrame, key: str, order: list[str], step: Callable[[object, tuple], tuple[object, list[tuple]]], schema: str, names: list[str], finish: Callable[[object, object], list[tuple]] | None = None) -> DataFrame:
    """`step(state, row) -> (state, result rows)` over each key's rows in order; the state is None at a key's first row.

    Nothing but the state is kept from one Arrow batch to the next, so a key of any length streams through. `finish(key, state)`
    gives rows when a key ends.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False, name=None):
                if not begun or row[0] != now:
                    out += finish(now, state) if begun and finish else []
                    now, state, begun = row[0], None, True
                state, rows = step(state, row)
                out += rows
            if out:
                yield pd.DataFrame(out, columns=names)
        if begun and finish and (out := finish(now, state)):
            yield pd.DataFrame(out, columns=names)

    first = df.select(key, *[c for c in df.columns if c != key])
    return first.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
