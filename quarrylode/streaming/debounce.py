"""Bursts of changes told once each, after a key has been quiet for a while."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_BURST = "key string, first_ms long, last_ms long, n_changes long"
_STATE = "first array<long>, last array<long>, n array<long>"


class Debouncer(StatefulProcessor):
    """Open bursts of a key as (first, last, n) in milliseconds, kept merged: a change belongs to a
    burst if less than the quiet time lies between them. A key has one timer, at the last change of its
    earliest burst plus the quiet time, which a further change of that burst moves; when it fires, all
    bursts that the watermark has passed are told and dropped, and the timer moves on to the next."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def _held(self) -> list[tuple[int, int, int]]:
        held = self.open.get()
        return list(zip(*held)) if held else []

    def _keep(self, bursts: list[tuple[int, int, int]]) -> None:
        self.open.update(tuple([list(c) for c in zip(*bursts)]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        fresh = [(r["ms"], r["ms"], 1) for r in rows]
        merged: list[tuple[int, int, int]] = []
        for first, last, n in sorted([*held, *fresh]):
            if merged and first - merged[-1][1] < self.quiet:
                merged[-1] = (merged[-1][0], max(last, merged[-1][1]), merged[-1][2] + n)
            else:
                merged.append((first, last, n))
        if merged:
            self._keep(merged)
            if not held or held[0][1] != merged[0][1]:
                if held:
                    self.handle.deleteTimer(held[0][1] + self.quiet)
                self.handle.registerTimer(merged[0][1] + self.quiet)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due = [b for b in held if b[1] + self.quiet <= passed]
        if due and len(due) < len(held):
            self._keep(held[len(due) :])
            self.handle.registerTimer(held[len(due)][1] + self.quiet)
        elif due:
            self.open.clear()
        return iter([Row(key=key[0], first_ms=a, last_ms=b, n_changes=n) for a, b, n in due])

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, key: str, at: str, quiet_ms: int = 2000, late: str = "0 seconds") -> DataFrame:
    """key, first_change, last_change, n_changes: a row for each burst of a key's changes, told when the
    watermark has passed its last change by the quiet time; changes that are later than that are left
    out. A stream of rows of which time and key are read; keys and times that are null tell nothing."""
    named = changes.selectExpr(f"cast({key} as string) as key", f"cast({at} as timestamp) as at").filter("key is not null and at is not null")
    marked = named.withWatermark("at", late).selectExpr("key", "at", "unix_millis(at) as ms")
    told = marked.groupBy("key").transformWithState(statefulProcessor=Debouncer(quiet_ms), outputStructType=_BURST, outputMode="Append", timeMode="EventTime")
    return told.selectExpr("key", "timestamp_millis(first_ms) as first_change", "timestamp_millis(last_ms) as last_change", "n_changes")
