"""Live events: projection to messages, rising progress, merging of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from cueweave.functions.text import trim_ws
from cueweave.operators.blocks import BLOCK, HOT_ROWS, block_scan, in_block, sparse_block

# Events that have no message, phases, notices.
SILENT_EVENTS = ("CacheKey", "Extracted", "Transcribed")
PHASES = {"CacheHit": "cache", "Loading": "loading", "Probing": "probe", "Extracting": "extraction"}
NOTICES = {
    "SubtitlesFailed": "Les sous-titres n'ont pas pu être téléchargés.",
    "SubtitlesFallback": "Pas de sous-titres exploitables : la vidéo sera transcrite.",
    "CacheWriteFailed": "La transcription n'a pas pu être mise en cache.",
}
OTHER_TYPES = {
    "Download": "download", "Probed": "video", "Subtitles": "subtitles",
    "Transcribing": "transcribing", "Progress": "progress", "Segment": "segments",
}
MERGED_TYPES = ("progress", "download", "segments")
BLOCK_EVENTS = 1 << 20


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def project_events(events: DataFrame, kind: str = "kind", text: str | None = None) -> DataFrame:
    """Events → messages: columns type, phase and message are added.

    Events without a message are dropped; a segment's text is trimmed.
    """
    k = F.col(kind)
    phase, notice = _lookup(PHASES, k), _lookup(NOTICES, k)
    out = (
        events.where(~k.isin(*SILENT_EVENTS))
        .withColumn(
            "type",
            F.when(phase.isNotNull(), "phase").when(notice.isNotNull(), "notice").otherwise(_lookup(OTHER_TYPES, k)),
        )
        .withColumn("phase", phase)
        .withColumn("message", notice)
        .where(F.col("type").isNotNull())
    )
    return out if text is None else out.withColumn(text, trim_ws(F.col(text)))


def progress_highwater(events: DataFrame) -> DataFrame:
    """Strictly rising progress per task: (task_id, seq, percent).

    A row passes when its percentage exceeds all earlier ones (and -1). It is
    then the first row with that percentage, so first occurrences are enough:
    a task shrinks to at most a hundred rows before the exchange.
    """
    firsts = events.groupBy("task_id", "percent").agg(F.min("seq").alias("seq"))
    earlier = Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        firsts.withColumn("_high", F.coalesce(F.max("percent").over(earlier), F.lit(-1)))
        .where(F.col("percent") > F.col("_high"))
        .select("task_id", "seq", "percent")
    )


def coalesce_events(
    messages: DataFrame,
    keys: list[str],
    opened_by: str = "seq",
    block_events: int = BLOCK_EVENTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Merge adjacent messages of each batch (`keys`), in `seq` order.

    Neighbours with the same type and item merge when they are progress,
    downloads or segments: of progress and downloads the last row stays; the
    segments of one message stay as rows. Adds `message_seq` (the number,
    `opened_by`, of the row that opened the message), so a message is the group
    of rows sharing it.
    """
    label = F.when(
        F.col("type").isin(*MERGED_TYPES),
        F.concat_ws("\x1f", "type", F.when(F.col("type") == "download", F.col("item"))),
    ).otherwise(F.concat_ws("\x1f", F.lit("#"), F.col("seq").cast("string")))
    blocked = sparse_block(messages.withColumn("_label", label), keys, F.col("seq"), block_events, hot_rows)
    placed = block_scan(
        blocked, keys,
        [F.min_by("_label", "seq").alias("_first"), F.max_by("_label", "seq").alias("_last")],
        lambda order, before: {"_before": F.lag("_last").over(order), "_after": F.lead("_first").over(order)},
    )
    ordered, _ = in_block(keys, "seq")
    previous = F.coalesce(F.lag("_label").over(ordered), F.col("_before"))
    following = F.coalesce(F.lead("_label").over(ordered), F.col("_after"))
    flagged = placed.select(
        *messages.columns, BLOCK,
        F.when(previous.isNull() | (previous != F.col("_label")), F.col(opened_by)).alias("_opened"),
        F.coalesce(following == F.col("_label"), F.lit(False)).alias("_superseded"),
    )
    numbered = block_scan(
        flagged, keys, [F.max("_opened").alias("_newest")],
        lambda order, before: {"_carried": F.max("_newest").over(before)},
    )
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return (
        numbered.withColumn("message_seq", F.coalesce(F.max("_opened").over(upto), F.col("_carried")))
        .where(~(F.col("_superseded") & F.col("type").isin("progress", "download")))
        .select(*messages.columns, "message_seq")
    )


def task_status(events: DataFrame) -> DataFrame:
    """Per task: latest percent, position and speed.

    Input: task_id, seq, ts_ms, percent (null for other events), end_ms (end of
    a segment, null for other events). Speed appears once a second has passed.
    """
    has_end = F.col("end_ms").isNotNull()
    elapsed = F.col("last_ms") - F.col("first_ms")
    return (
        events.groupBy("task_id")
        .agg(
            F.greatest(F.coalesce(F.max("percent"), F.lit(-1)), F.lit(0)).alias("percent"),
            F.max_by(F.col("end_ms"), F.when(has_end, F.col("seq"))).alias("position_ms"),
            F.min("ts_ms").alias("first_ms"),
            F.max("ts_ms").alias("last_ms"),
        )
        .select(
            "task_id", "percent", "position_ms", elapsed.alias("elapsed_ms"),
            F.when(elapsed >= 1000, F.floor(F.col("position_ms") / elapsed * 10.0 + 0.5) / 10.0).alias("speed"),
        )
    )
