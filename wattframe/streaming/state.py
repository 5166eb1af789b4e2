"""Keyed state of the streaming jobs: feed watches with timers, and the rows of a day that may be records."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state where timers and typed state need it; the session's setting stays."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class FeedWatch(StatefulProcessor):
    """One timer a feed: set anew by each reading, it tells of the silence when it runs out.

    With the clock "EventTime" time is the newest reading of all feeds, behind by `lateness`, so the timer is set as
    much earlier; with "ProcessingTime" it is the machine's, and a timer runs out also when no feed sends anything.
    A feed heard again after an alert gives a row with silent = false.
    """

    def __init__(self, limit: timedelta, clock: str, lateness: timedelta):
        self.limit, self.clock, self.lateness = (limit / timedelta(milliseconds=1), clock, lateness / timedelta(milliseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feed = handle.getValueState("feed", "last_seen timestamp, silent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(r["interval"].max() for r in rows)
        last, silent = self.feed.get() if self.feed.exists() else (None, False)
        if last is not None and newest <= pd.Timestamp(last):
            return
        self.feed.update((newest.to_pydatetime(), False))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if self.clock == "EventTime":
            due = newest.timestamp() * 1000 + self.limit - self.lateness
        else:
            due = timerValues.getCurrentProcessingTimeInMs() + self.limit
        self.handle.registerTimer(int(due))
        if silent:
            yield self.told(key, newest, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.feed.get()
        self.feed.update((last, True))
        yield self.told(key, pd.Timestamp(last), True)

    def told(self, key, last: pd.Timestamp, silent: bool) -> pd.DataFrame:
        return pd.DataFrame({"network_id": [key[0]], "last_seen": [last], "silent": [silent]})

    def close(self) -> None:
        pass


def followers(at: np.ndarray, value: np.ndarray, gap: int) -> tuple[np.ndarray, float]:
    """Which rows of a day can be records at all, and what stands at the end of the day at least.

    Rows come in order of time, values already turned so that more is better. A record must beat the standing one and
    follow it by `gap` or more. Whatever stood before the day, the first record of the day is the first row of
    some value above it, from the first row not too near to an earlier record on; every later one is the first row
    far enough that beats the one before. Those rows are found; all others can never be records.
    """
    n = len(at)
    if n == 0:
        return np.zeros(0, np.int64), -np.inf
    day = at[0] - at[0] % 86_400_000_000
    late = int(np.searchsorted(at, day + gap, "left"))
    found: set[int] = set()
    for first in range(min(late, n - 1) + 1):
        run = np.maximum.accumulate(value[first:])
        found.update((first + np.flatnonzero(np.append(True, run[1:] > run[:-1]))).tolist())
    starts, ends = sorted(found), {}

    def follower(i: int) -> int | None:
        j = max(i + 1, int(np.searchsorted(at, at[i] + gap, "left")))
        better = np.flatnonzero(value[j:] > value[i])
        return j + int(better[0]) if len(better) else None

    for i in starts:
        chain = [i]
        while chain[-1] not in ends and (j := follower(chain[-1])) is not None:
            chain.append(j)
        end = ends.get(chain[-1], value[chain[-1]])
        ends.update(dict.fromkeys(chain, end))
    least = min(ends[i] for i in starts)
    return np.array(sorted(ends)), float(min(least, value[late:].max() if late < n else -np.inf))


class RecordDays(StatefulProcessor):
    """The rows of one id and day, and which of them can be records; told anew whenever rows come, however late."""

    def __init__(self, gap: timedelta):
        self.gap = gap // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.day = handle.getValueState("day", "at array<bigint>, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        kind = new.iloc[0]
        held = dict(zip(*self.day.get(), strict=True)) if self.day.exists() else {}
        held.update(zip(new["at"].tolist(), new["value"].tolist(), strict=True))
        at, value = np.array(sorted(held), np.int64), np.array([held[t] for t in sorted(held)])
        self.day.update((at.tolist(), value.tolist()))
        turned = np.array([round(v, int(kind["digits"])) for v in value]) * (1 if kind["aggregate"] == "high" else -1)
        gap = self.gap if kind["period"] == "interval" else 0
        rows, least = followers(at, turned, gap)
        yield pd.DataFrame(
            {
                "record_id": key[0],
                "day": key[1],
                "at": at[rows],
                "value": value[rows],
                "turned": turned[rows],
                "gap": gap,
                "stands": least,
            }
        )

    def close(self) -> None:
        pass
