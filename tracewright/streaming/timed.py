"""Keyed stream operators whose state ends with event time: bounded de-duplication, and releases matched with what they release.

Both set an event-time timer for every instant at which state stops mattering. Rows later than the watermark are dropped by Spark, so once the
watermark has passed that instant no further row can ask for the state, and removing it changes no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class TimedDedupe(StatefulProcessor):
    """Keep a row that lies more than the window from the last kept row of its key; the kept instant goes when the watermark is beyond its window."""

    def __init__(self, columns: Sequence[str], ms: str, ident: str, window_ms: int) -> None:
        self.columns, self.ms, self.ident, self.window_ms = list(columns), ms, ident, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = before = self.kept.get()[0] if self.kept.exists() else None
        batch = pd.concat(list(rows), ignore_index=True).sort_values([self.ms, self.ident], kind="stable")
        keep = []
        for ms in batch[self.ms]:
            keep.append(last is None or abs(ms - last) > self.window_ms)
            last = int(ms) if keep[-1] else last
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.window_ms + 1)
            self.kept.update((last,))
            self.handle.registerTimer(last + self.window_ms + 1)
        yield batch.loc[keep, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedupe_timed(events: DataFrame, keys: Sequence[str], ms: str, ident: str, window_ms: int, lateness_ms: int) -> DataFrame:
    """Streaming bounded de-duplication whose state is one instant for each key seen within window and lateness.

    Rows up to ``lateness_ms`` behind the newest are judged, older ones are dropped.
    """
    timed = events.withColumn("_time", F.timestamp_millis(ms)).withWatermark("_time", f"{lateness_ms} milliseconds")
    return timed.groupBy(*keys).transformWithStateInPandas(
        TimedDedupe(events.columns, ms, ident, window_ms), events.schema, "Append", "EventTime"
    )


class ReleaseMatch(StatefulProcessor):
    """Closes with the latest open of their key that no other close has consumed.

    Rows wait until the watermark has passed them and are then taken in order, so the order of arrival within the lateness does not matter.
    Of the rows that a key waits for only the earliest one of each batch sets a timer, and rows go to and from the state in lists, so the calls
    to the state store grow with keys and batches, not with rows.
    """

    def __init__(self, names: Sequence[str], within_ms: int) -> None:
        self.within_ms, self.row = within_ms, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms bigint, ref string, is_open boolean")
        self.open = handle.getValueState("open", "ms bigint, ref string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        for some in slices((int(r["row_ms"]), str(r["row_ref"]), bool(r["row_open"])) for r in rows):
            self.waiting.appendList(some)
            first = min(some[0][0] if first is None else first, *(ms for ms, _, _ in some))
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        # a row that came twice counts once
        waiting = {(ms, ref): is_open for ms, ref, is_open in self.waiting.get()}
        ready = sorted(at for at in waiting if at[0] <= watermark)
        before = held = self.open.get() if self.open.exists() else None
        for ms, ref in ready:
            if waiting.pop((ms, ref)):
                held = (ms, ref)
            elif held is not None and ms - held[0] <= self.within_ms:
                yield self.row(*key, ref, held[1], ms, ms - held[0])
                held = None
        if ready:
            self.waiting.clear()
            for some in slices((*at, is_open) for at, is_open in waiting.items()):
                self.waiting.appendList(some)
            if waiting:
                self.handle.registerTimer(min(ms for ms, _ in waiting))
        if held is not None and held[0] + self.within_ms < watermark:
            held = None  # every close to come lies beyond the window
        if held is None:
            if before is not None:
                self.open.clear()
        elif held != before:
            self.open.update((held[0], str(held[1])))
            self.handle.registerTimer(held[0] + self.within_ms + 1)

    def close(self) -> None:
        pass


def slices(rows: Iterable[tuple], size: int = 10_000) -> Iterator[list[tuple]]:
    """Rows in lists that one call to the state store can take."""
    rest = iter(rows)
    while some := list(islice(rest, size)):
        yield some


def release_match(
    rows: DataFrame, keys: Sequence[str], ms: str, ident: str, opens: Column, closes: Column, within_ms: int, lateness_ms: int
) -> DataFrame:
    """Stream of ``(*keys, close_ref, open_ref, ms, elapsed_ms)``: each close with the open it consumes, at most ``within_ms`` before it.

    Rows are ordered by time and then by ident as text; a close comes out once the watermark has passed it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    marks = rows.where(opens | closes).select(*keys, F.col(ms).alias("row_ms"), F.col(ident).cast("string").alias("row_ref"), opens.alias("row_open"))
    timed = marks.withColumn("_time", F.timestamp_millis("row_ms")).withWatermark("_time", f"{lateness_ms} milliseconds")
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", close_ref string, open_ref string, ms bigint, elapsed_ms bigint"
    names = [*keys, "close_ref", "open_ref", "ms", "elapsed_ms"]
    return timed.groupBy(*keys).transformWithState(ReleaseMatch(names, within_ms), schema, "Append", "EventTime")
