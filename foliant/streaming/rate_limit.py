"""Sliding-window rate limiter: a call is admitted if fewer than `most` calls of its key were admitted in the last window.
Refused calls do not count, so each key is a sequential fold and no window function."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _admit(times: list[int], state: deque[int], most: int, window: int) -> list[bool]:
    """times: microseconds, ascending. An admitted call leaves the window when it is older than it, not as old."""
    out = []
    for t in times:
        while state and t - state[0] > window:
            state.popleft()
        ok = len(state) < most
        if ok:
            state.append(t)
        out.append(ok)
    return out


def rate_limit(events: DataFrame, key: str = "user_id", ts: str = "ts", ident: str = "event_id", most: int = 60, window_secs: float = 60) -> DataFrame:
    """(key, ident, admitted) of every event. Keys are hash partitioned and sorted; a task streams through its keys and holds one
    window's admitted times, so a key with any number of events needs no memory. Null times are refused."""
    kinds = dict(events.dtypes)
    window = int(window_secs * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: object = object()
        state: deque[int] = deque()
        for b in batches:
            admitted = []
            for k, null, t in zip(b["k"].tolist(), b["t"].isna().tolist(), b["t"].tolist()):
                k = None if k != k else k
                if k != last:
                    last, state = k, deque()
                admitted.append(False if null else _admit([int(t)], state, most, window)[0])
            yield pd.DataFrame({key: b["k"], ident: b["i"], "admitted": admitted})

    rows = events.select(F.col(key).alias("k"), F.col(ident).alias("i"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    ordered = rows.repartition("k").sortWithinPartitions("k", "t", "i")
    return ordered.mapInPandas(run, f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}, admitted boolean")


def rate_limit_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", ident: str = "event_id", most: int = 60, window_secs: float = 60) -> DataFrame:
    """The same over a stream, per micro-batch in time order; the state of a key is its admitted times in the window."""
    kinds = dict(events.dtypes)
    window = int(window_secs * 1_000_000)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["t", "i"])
        held = deque(state.get[0]) if state.exists else deque()
        admitted = _admit(rows["t"].astype("int64").tolist(), held, most, window)
        state.update((list(held),))
        yield pd.DataFrame({key: rows["k"], ident: rows["i"], "admitted": admitted})

    rows = events.select(F.col(key).alias("k"), F.col(ident).alias("i"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).filter("t is not null")
    return rows.groupBy("k").applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}, admitted boolean", "held array<long>", "append", "NoTimeout")
