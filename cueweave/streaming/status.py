"""Running status, provisional segments and the daily watch, as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.timecode import int_div
from cueweave.operators.blocks import BLOCK, block_of, block_scan, in_block
from cueweave.operators.events import task_status
from cueweave.streaming.batches import WATERMARK
from cueweave.streaming.ordered import Ordered, closes, in_order

# Fixed value: outcome code that says nothing about the watched service.
INCONCLUSIVE_CODE = 12

DAY_MS = 86_400_000
#: Runs of a target are ordered within blocks of about a year.
_RUN_BLOCK_MS = 365 * DAY_MS


def stream_status(events: DataFrame) -> DataFrame:
    """Streaming form of `task_status` (update mode): a native aggregation."""
    return task_status(events)


def latest_status(written: DataFrame) -> DataFrame:
    """Read view: the last written status of each task."""
    rest = [c for c in written.columns if c not in ("task_id", "batch")]
    return (
        written.groupBy("task_id").agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select("task_id", "_s.*")
    )


def supersede(written: DataFrame) -> DataFrame:
    """Read view over provisional and final segments: the final one wins.

    Input: media_id, segment_id, final, seq, …; among equals the later row.
    """
    rest = [c for c in written.columns if c not in ("media_id", "segment_id")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("final"), F.col("seq")))
    return (
        written.groupBy("media_id", "segment_id").agg(best.alias("_s")).select("media_id", "segment_id", "_s.*")
    )


def watch_state(code: Column, term_found: Column) -> Column:
    """Outcome of a watch run: inconclusive, success or failure."""
    return (
        F.when(code == INCONCLUSIVE_CODE, "inconclusive")
        .when((code == 0) & F.coalesce(term_found, F.lit(False)), "success")
        .otherwise("failure")
    )


def watch_actions(runs: DataFrame, block_ms: int = _RUN_BLOCK_MS) -> DataFrame:
    """Batch form: (target_id, ts_ms, seq, day, action) with open, append or close.

    `runs`: target_id, ts_ms, seq, state; every run counts, in order of time and
    `seq`. A failure opens an incident or is added to the open one, a success
    closes it, inconclusive runs change nothing.
    """
    conclusive = runs.where(F.col("state") != "inconclusive").withColumn(BLOCK, block_of(F.col("ts_ms"), block_ms))
    latest = F.max_by("state", F.struct("ts_ms", "seq"))
    placed = block_scan(conclusive, ["target_id"], [latest.alias("_end")],
                        lambda order, before: {"_carry": F.last("_end").over(before)})
    ordered, _ = in_block(["target_id"], "ts_ms", "seq")
    previous = F.coalesce(F.lag("state").over(ordered), F.col("_carry"))
    action = (
        F.when((F.col("state") == "failure") & (previous == "failure"), "append")
        .when(F.col("state") == "failure", "open")
        .when(previous == "failure", "close")
    )
    return placed.withColumn("action", action).where(F.col("action").isNotNull()).select(
        "target_id", "ts_ms", "seq", int_div(F.col("ts_ms"), DAY_MS).alias("day"), "action")


def incidents(actions: DataFrame, block_ms: int = _RUN_BLOCK_MS) -> DataFrame:
    """(target_id, incident, opened, failures, closed) from the actions."""
    opens = (F.col("action") == "open").cast("bigint")
    placed = block_scan(actions.withColumn(BLOCK, block_of(F.col("ts_ms"), block_ms)), ["target_id"], [F.sum(opens).alias("_opens")],
                        lambda order, before: {"_before": F.coalesce(F.sum("_opens").over(before), F.lit(0))})
    ordered, _ = in_block(["target_id"], "ts_ms", "seq")
    numbered = placed.withColumn("incident", F.col("_before") + F.sum(opens).over(ordered))
    return numbered.groupBy("target_id", "incident").agg(
        F.min("day").alias("opened"),
        F.count_if(F.col("action") != "close").alias("failures"),
        F.max(F.when(F.col("action") == "close", F.col("day"))).alias("closed"),
    )


class Watch(Ordered):
    """State machine per target; state is held only while an incident is open."""

    columns = {"ts_ms": "BIGINT", "seq": "BIGINT", "state": "STRING"}
    order = ["ts_ms", "seq"]
    result = ["target_id", "ts_ms", "seq", "day", "action"]
    cell_ms = _RUN_BLOCK_MS

    def take(self, key: tuple, rows: pd.DataFrame, carried: int | None) -> tuple[list[tuple], int | None]:
        out = []
        for ts_ms, seq, state in zip(rows["ts_ms"].tolist(), rows["seq"].tolist(), rows["state"]):
            if state == "failure":
                out.append((key[0], ts_ms, seq, ts_ms // DAY_MS, "append" if carried else "open"))
                carried = 1
            elif carried:
                out.append((key[0], ts_ms, seq, ts_ms // DAY_MS, "close"))
                carried = None
        return out, carried


def stream_watch(runs: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Streaming form of `watch_actions` over runs (target_id, ts_ms, seq, state).

    Every run counts, in order of time, whatever micro-batch brings it within `delay`.
    """
    conclusive = runs.where((F.col("state") != "inconclusive") | closes()).select("target_id", "ts_ms", "seq", "state")
    return in_order(conclusive, "target_id", Watch(), "target_id BIGINT, ts_ms BIGINT, seq BIGINT, day BIGINT, action STRING", delay)
