"""Event-time order on a stream whose files and micro-batches know none.

Rows wait in keyed state until the watermark has passed them and are then handed
over in the order of their times, whatever micro-batch brought them. An
event-time timer per key wakes the state; what is behind the watermark leaves it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed value: the time of the row that closes a stream, in milliseconds (the year 9999).
CLOSE_MS = 253_370_764_800_000

#: The event-time clock runs this much ahead of `ts_ms`, so that times at or before zero
#: are not behind the watermark of a stream that has just begun.
SHIFT_MS = 1_000_000_000_000


def closes() -> Column:
    """Is this the row that closes a stream? Filters before the watermark must let it pass."""
    return F.col("ts_ms") == CLOSE_MS


class Ordered(StatefulProcessor):
    """Hands the rows of a key to `take` in order of `ts_ms`, cell by cell.

    Held rows lie in cells of `cell_ms`, so that one cell at a time is in memory; the
    wider they are, the fewer reads of state sparse keys need.
    `columns` (name → SQL type) are kept, `ts_ms` first; `order` breaks ties. `take(key,
    rows, carried)` gives result rows and the number that later rows of the key need, or
    None; `idle(carried, now)` gives that number as it is at `now` and the next time to look, if any.
    A call of the state store costs more than its rows, so each wake reads and writes `carried`
    once, and no timer is looked up: timers of the same time are one, and a wake leaves one more at most.
    """

    columns: dict[str, str]
    order: list[str] = ["ts_ms"]
    result: list[str]
    cell_ms: int = 1 << 20

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{n} ARRAY<{t}>" for n, t in self.columns.items())
        self.held = handle.getMapState("held", "cell BIGINT", arrays)
        self.carried = handle.getValueState("carried", "value BIGINT")

    def reduce(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows of a cell that are worth keeping."""
        return rows

    def take(self, key: tuple, rows: pd.DataFrame, carried: int | None) -> tuple[list[tuple], int | None]:
        raise NotImplementedError

    def idle(self, carried: int | None, now: int) -> tuple[int | None, int | None]:
        return carried, None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = list(self.columns)
        for frame in rows:
            first, last = int(frame["ts_ms"].min()), int(frame["ts_ms"].max())
            one = first // self.cell_ms
            several = one < last // self.cell_ms
            for cell, part in frame[names].groupby(frame["ts_ms"] // self.cell_ms) if several else [(one, frame[names])]:
                at = (int(cell),)
                if self.held.containsKey(at):
                    part = pd.concat([self._frame(self.held.getValue(at)), part], ignore_index=True)
                self._hold(at, self.reduce(part))
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() - SHIFT_MS
        before = carried = self.carried.get()[0] if self.carried.exists() else None
        for cell in sorted(c[0] for c in self.held.keys()):
            if cell * self.cell_ms > now:
                self._wake(cell * self.cell_ms)
                break
            rows = self._frame(self.held.getValue((cell,))).sort_values(self.order, kind="stable")
            ready = rows["ts_ms"] <= now
            if ready.all():
                self.held.removeKey((cell,))
            else:
                self._hold((cell,), rows[~ready])
                self._wake(int(rows["ts_ms"][~ready].min()))
            found, carried = self.take(key, rows[ready], carried)
            if found:
                yield pd.DataFrame(found, columns=self.result)
        carried, later = self.idle(carried, now)
        if carried is None and before is not None:
            self.carried.clear()
        elif carried != before:
            self.carried.update((carried,))
        if later is not None:
            self._wake(later)

    def close(self) -> None:
        pass

    def _frame(self, value: tuple) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(self.columns, value)))

    def _hold(self, at: tuple, rows: pd.DataFrame) -> None:
        self.held.updateValue(at, tuple(rows[n].tolist() for n in self.columns))

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(ms + SHIFT_MS)


def by_key(rows: DataFrame, key: str, columns: Iterable[str], delay: str) -> GroupedData:
    """`rows` (`key`, `ts_ms` and the columns) per key; those that come more than `delay`
    behind the latest time are dropped. The closing row moves the watermark only."""
    at = F.timestamp_millis(F.col("ts_ms") + SHIFT_MS)
    return (
        rows.where(F.col("ts_ms").isNotNull()).select(key, *columns, at.alias("at")).withWatermark("at", delay)
        .where(F.col("at") < F.timestamp_millis(F.lit(CLOSE_MS + SHIFT_MS)))
        .groupBy(key)
    )


def in_order(rows: DataFrame, key: str, processor: Ordered, schema: str, delay: str) -> DataFrame:
    """Run `processor` over `by_key`."""
    return by_key(rows, key, processor.columns, delay).transformWithStateInPandas(processor, schema, "Append", "EventTime")
