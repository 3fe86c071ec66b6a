"""Rising progress per task, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cueweave.streaming.batches import WATERMARK
from cueweave.streaming.ordered import SHIFT_MS, by_key, closes

_SCHEMA = "task_id BIGINT, seq BIGINT, percent INT"
_STATE = "ts_ms ARRAY<BIGINT>, seq ARRAY<BIGINT>, percent ARRAY<BIGINT>, high BIGINT"


def first_per_percent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keep the first row of each (task, percent) of an Arrow batch.

    Run before the exchange: a task sends a hundred rows per batch at most.
    """
    for rows in batches:
        yield rows.sort_values(["ts_ms", "seq"]).drop_duplicates(["task_id", "percent"])


def highwater(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Passes a percentage only above the highest one seen so far, in order of `ts_ms`, then of `seq`.

    One row per percentage waits, whatever the time, so the state of a task is one small
    value that travels with its rows: no calls of the state store per task.
    """
    held = state.get if state.exists else ([], [], [], -1)
    parts = [held[:3], *((f["ts_ms"], f["seq"], f["percent"]) for f in frames)]
    ts, seq, percent = (np.concatenate([np.asarray(p[i], np.int64) for p in parts]) for i in range(3))
    order = np.lexsort((seq, ts))
    first = np.sort(np.unique(percent[order], return_index=True)[1])
    ts, seq, percent = (x[order][first] for x in (ts, seq, percent))
    now = state.getCurrentWatermarkMs() - SHIFT_MS
    n = int(np.searchsorted(ts, now, "right"))  # no row at or before the watermark comes any more
    before = np.maximum.accumulate(np.concatenate([[held[3]], percent[:n]]))
    up = percent[:n] > before[:-1]
    state.update((ts[n:].tolist(), seq[n:].tolist(), percent[n:].tolist(), int(before[-1])))
    if n < len(ts):
        state.setTimeoutTimestamp(int(ts[n]) + SHIFT_MS)
    if up.any():
        yield pd.DataFrame({"task_id": key[0], "seq": seq[:n][up], "percent": percent[:n][up]})


def stream_progress(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Streaming form of `progress_highwater`: task_id, seq, percent.

    Input: task_id, seq, ts_ms, percent. Rows are judged in order of their times, then of
    `seq`, in whatever order files and micro-batches bring them within
    `delay`. Beside what waits, state is one number per task.
    """
    first = events.where(F.col("percent").isNotNull() | closes()).select("task_id", "ts_ms", "seq", "percent").mapInPandas(
        first_per_percent, "task_id BIGINT, ts_ms BIGINT, seq BIGINT, percent INT")
    return by_key(first, "task_id", ["ts_ms", "seq", "percent"], delay).applyInPandasWithState(
        highwater, _SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
