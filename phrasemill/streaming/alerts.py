"""Whether an alert is on, as a stream: keyed state over windows that have closed, with a timer for every period that may change it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from phrasemill.session import ship

CHANGES = "kind string, window_start timestamp, alert boolean"


def judged(failing: list[int], on: bool, period: int, until: int, width: int, periods: int, least: int) -> tuple[list[tuple[int, bool]], list[int], bool, int]:
    """Goes through the periods from ``period`` on that end by ``until`` -> the changes, the failing periods that still matter, whether
    the alert is on, and the next period. ``failing`` is sorted; while the alert is off, periods without failures are skipped."""
    changes, lo, hi = [], 0, 0
    while on or lo < len(failing):
        if not on and hi == lo:
            period = max(period, failing[lo])
        if period + width > until:
            break
        while hi < len(failing) and failing[hi] <= period:
            hi += 1
        while lo < hi and failing[lo] <= period - periods * width:
            lo += 1
        if (hi - lo >= least) != on:
            on = not on
            changes.append((period, on))
        period += width
        while lo < hi and failing[lo] <= period - periods * width:
            lo += 1
    return changes, failing[lo:], on, period


class AlertState(StatefulProcessor):
    """Closed failing windows of a kind -> the periods in which its alert goes on or off.

    The state is one small value: whether the alert is on, the next period to judge, and the failing periods that still matter (as many as
    ``periods``). Periods are judged once the watermark has passed their end, when no window before can come any more: at once for those that have
    closed, and for the next one by a timer, so that an alert goes off though nothing comes.
    """

    def __init__(self, width_ms: int, periods: int, least: int):
        self.width, self.periods, self.least = width_ms, periods, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "alert boolean, period long, failing string")

    def _advance(self, kind: str, more: list[int], until: int) -> Iterator[pd.DataFrame]:
        on, period, failing = self.state.get() if self.state.exists() else (False, 0, "")
        known = sorted({*map(int, filter(None, failing.split(","))), *more})
        changes, left, on, period = judged(known, on, period, until, self.width, self.periods, self.least)
        self.state.update((on, period, ",".join(map(str, left))))
        if on or left:
            self.handle.registerTimer(period + self.width)
        if changes:
            starts, states = zip(*changes)
            yield pd.DataFrame({"kind": kind, "window_start": pd.to_datetime(list(starts), unit="ms"), "alert": list(states)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts = [int(x) for frame in rows for x in frame["start_ms"]]
        return self._advance(key[0], starts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance(key[0], [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def alert_changes(windows: DataFrame, width: timedelta, periods: int = 3, least: int = 2) -> DataFrame:
    """kind, window (closed ones, with their watermark), n -> kind, window_start, alert: the periods in which an alert goes on (at least
    ``least`` of the last ``periods`` windows have rows) or off again. Append mode; the state store must be RocksDB's (``jobs.started``)."""
    ship(windows.sparkSession)
    start = (F.unix_millis(F.col("window.start"))).alias("start_ms")
    processor = AlertState(int(width.total_seconds() * 1000), periods, least)
    return windows.select("kind", start, "window", "n").groupBy("kind").transformWithStateInPandas(statefulProcessor=processor, outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
