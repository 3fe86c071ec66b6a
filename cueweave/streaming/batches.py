"""Grouping a stream into batches, and merging inside them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.functions.timecode import int_div
from cueweave.operators.blocks import BLOCK, block_of, lookup_join
from cueweave.operators.events import coalesce_events
from cueweave.streaming.ordered import CLOSE_MS, Ordered, in_order

# Length of a batch, spacing of checks.
WINDOW_MS = 100
CHECK_INTERVAL_MS = 86_400_000
WATERMARK = "10 seconds"

_OPENINGS = "task_id BIGINT, opened_ms BIGINT"
_CELL_MS = 1 << 16


def tumbling_batches(messages: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Add `batch_ms`, the start of the fixed window of each message.

    A projection: nothing is buffered, lost or reordered.
    """
    return messages.withColumn("batch_ms", int_div(F.col("ts_ms"), window_ms) * window_ms)


def windowed_counts(messages: DataFrame, window_ms: int = WINDOW_MS, watermark: str = WATERMARK) -> DataFrame:
    """Messages per task and window; rows later than the watermark are dropped.

    The watermark is an addition of this library with its own default. In append
    mode a window is delivered once it is over; the last ones need a stream
    that is closed (`runner.drain_closed`).
    """
    return (
        messages.withWatermark("ts", watermark).where(F.col("ts") < F.timestamp_millis(F.lit(CLOSE_MS)))
        .groupBy("task_id", F.window("ts", f"{window_ms} milliseconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("task_id", F.col("w.start").alias("window_start"), "n")
    )


def distinct_times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per (task, millisecond) of an Arrow batch, before the exchange."""
    for rows in batches:
        yield rows[["task_id", "ts_ms"]].drop_duplicates()


class Openings(Ordered):
    """Emits the times that open a window of fixed length.

    The first time opens a window; the first one at or past its end opens the
    next. The last opening is kept until its window has ended.
    """

    columns = {"ts_ms": "BIGINT"}
    result = ["task_id", "opened_ms"]

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms
        self.cell_ms = max(self.cell_ms, 64 * window_ms)

    def reduce(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.drop_duplicates()

    def take(self, key: tuple, rows: pd.DataFrame, carried: int | None) -> tuple[list[tuple], int | None]:
        opened = []
        for t in rows["ts_ms"].tolist():
            if carried is None or t - carried >= self.window_ms:
                carried = t
                opened.append((key[0], t))
        return opened, carried

    def idle(self, carried: int | None, now: int) -> tuple[int | None, int | None]:
        # Once a window has ended, every row before the watermark has been handed over.
        ended = carried is None or carried + self.window_ms <= now
        return (None, None) if ended else (carried, carried + self.window_ms)


def stream_openings(messages: DataFrame, window_ms: int = WINDOW_MS, delay: str = WATERMARK) -> DataFrame:
    """(task_id, opened_ms): exact windows, each opened by its first message by event time.

    Files and micro-batches may bring the messages in any order within `delay`.
    Only distinct milliseconds reach the state, so its work is bounded by
    elapsed time and not by the number of messages.
    """
    times = messages.select("task_id", "ts_ms").mapInPandas(distinct_times, "task_id BIGINT, ts_ms BIGINT")
    return in_order(times, "task_id", Openings(window_ms), _OPENINGS, delay)


def assign_batches(messages: DataFrame, openings: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Add `batch_ms`, the opening of each message's window.

    A window touches at most the cells of its two ends, so each opening is
    listed there and the lookup is an equi-join per cell.
    """
    end = F.col("opened_ms") + (window_ms - 1)
    cells = F.array_distinct(F.array(block_of(F.col("opened_ms"), _CELL_MS), block_of(end, _CELL_MS)))
    lists = (
        openings.select("task_id", "opened_ms", F.explode(cells).alias(BLOCK))
        .groupBy("task_id", BLOCK).agg(F.array_sort(F.collect_set("opened_ms")).alias("_opened"))
    )
    placed = messages.withColumn(BLOCK, block_of(F.col("ts_ms"), _CELL_MS))
    found = lookup_join(placed, lists, ["task_id", BLOCK], ["seq"])
    before = F.filter("_opened", lambda t: t <= F.col("ts_ms"))
    return found.select(*messages.columns, F.try_element_at(before, F.lit(-1)).alias("batch_ms"))


def closed_windows(messages: DataFrame, window_ms: int = WINDOW_MS, delay: str = WATERMARK) -> DataFrame:
    """The messages of each fixed window, delivered together when the window is over.

    State is native and ends with the window. A window's messages are held in
    groups of 65,536 sequence numbers, since one task may send a third of all.
    """
    at = F.timestamp_millis("ts_ms")
    rest = messages.columns
    return (
        messages.where(F.col("ts_ms").isNotNull()).withColumn("at", at).withWatermark("at", delay)
        .where(F.col("at") < F.timestamp_millis(F.lit(CLOSE_MS)))
        .groupBy("task_id", F.window("at", f"{window_ms} milliseconds"), F.floor(F.col("seq") / 65_536).alias("_part"))
        .agg(F.collect_list(F.struct(*rest)).alias("_rows"))
        .select(F.inline("_rows"))
    )


def coalesce_batch(batch: DataFrame) -> DataFrame:
    """Work of `foreachBatch`: merge neighbours inside each task and window."""
    return coalesce_events(tumbling_batches(batch), ["task_id", "batch_ms"])


def settled(written: DataFrame) -> DataFrame:
    """Read view over micro-batches that were merged before their windows were over.

    Merging again closes windows that two micro-batches shared, if they came in
    order; messages keep the number that opened them.
    """
    again = written.drop("batch").withColumnRenamed("message_seq", "_opened_seq")
    return coalesce_events(again, ["task_id", "batch_ms"], "_opened_seq").drop("_opened_seq")


def stream_daily_check(checks: DataFrame, interval_ms: int = CHECK_INTERVAL_MS, delay: str = WATERMARK) -> DataFrame:
    """Checks that are due: at most one per key and interval."""
    return stream_openings(checks, interval_ms, delay)
