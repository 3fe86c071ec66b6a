"""Subtitle cues: wrapping, sharing a segment's time, display durations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions.text import collapse_ws, wrap_lines
from cueweave.functions.timecode import half_up, int_div
from cueweave.operators.blocks import BLOCK, MULTI, block_of, block_scan, in_block

BLOCK_SEGMENTS = 65_536


@dataclass(frozen=True)
class CueOptions:
    """Readability limits."""

    max_line_width: int = 42
    max_line_count: int = 2
    min_duration_ms: int = 1_000
    max_duration_ms: int = 7_000


def drop_empty_segments(segments: DataFrame) -> DataFrame:
    """Segments whose text is not blank."""
    return segments.where(collapse_ws(F.col("text")) != "")


def _line_groups(lines: Column, per_cue: int) -> Column:
    count = F.floor((F.size(lines) + F.lit(per_cue - 1)) / F.lit(per_cue)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda g: F.slice(lines, g * per_cue + 1, per_cue)
    )


def clamp_end(start: Column, end: Column, next_start: Column, options: CueOptions) -> Column:
    """Cut what stays too long; lengthen what is too brief, never past the next
    cue's start (nor below the present end)."""
    cut = F.when(end - start > options.max_duration_ms, start + options.max_duration_ms).otherwise(end)
    wanted = start + options.min_duration_ms
    longer = F.when(next_start.isNull(), wanted).otherwise(
        F.greatest(F.least(wanted, next_start), cut)
    )
    return F.when(cut - start < options.min_duration_ms, longer).otherwise(cut)


def build_cues(
    segments: DataFrame, options: CueOptions = CueOptions(), block_segments: int = BLOCK_SEGMENTS
) -> DataFrame:
    """(media_id, cue_index, segment_id, start_ms, end_ms, lines).

    Input: media_id, segment_id (dense), start_ms, end_ms, text. A segment's
    time is shared by its line groups in proportion to their characters; the
    last group takes the segment's exact end. Numbering starts at 1 per media.
    """
    per_cue = max(options.max_line_count, 1)
    wrapped = (
        # Generated, so that the filter does not wrap each text a second time.
        segments.select("media_id", "segment_id", "start_ms", "end_ms",
                        F.explode(F.array(wrap_lines(F.col("text"), options.max_line_width))).alias("_lines"))
        .where(F.size("_lines") > 0)
        .withColumn(BLOCK, block_of(F.col("segment_id"), block_segments))
    )
    count = int_div(F.size("_lines").cast("bigint") + (per_cue - 1), per_cue)
    # Cues before each block, and the first start after it.
    placed = block_scan(
        wrapped,
        ["media_id"],
        [F.sum(count).alias("_n"), F.min_by(F.col("start_ms"), F.col("segment_id")).alias("_first")],
        lambda order, before: {
            "_offset": F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")),
            "_next_block_start": F.lead("_first").over(order),
        },
    )
    groups = placed.select(
        "media_id", "segment_id", "start_ms", "end_ms", BLOCK, "_offset", "_next_block_start",
        F.posexplode(_line_groups(F.col("_lines"), per_cue)).alias("_g", "lines"),
    )
    chars = F.greatest(F.aggregate("lines", F.lit(0), lambda n, line: n + F.length(line)), F.lit(1))
    in_segment = Window.partitionBy("media_id", BLOCK, "segment_id").orderBy("_g")
    whole = Window.partitionBy("media_id", BLOCK, "segment_id")
    ordered, _ = in_block(["media_id"], "segment_id", "_g")
    span = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)).cast("double")
    at = lambda chars_before: F.col("start_ms") + span * (chars_before / F.col("_total"))
    timed = (
        groups.withColumn("_chars", chars.cast("double"))
        .withColumn("_upto", F.sum("_chars").over(in_segment))
        .withColumn("_total", F.sum("_chars").over(whole))
        .withColumn("_start", at(F.col("_upto") - F.col("_chars")))
        .withColumn(
            "_end",
            F.when(F.col("_upto") == F.col("_total"), F.col("end_ms").cast("double")).otherwise(at(F.col("_upto"))),
        )
        .withColumn("_next", F.coalesce(F.lead("_start").over(ordered), F.col("_next_block_start").cast("double")))
        .withColumn("cue_index", F.col("_offset") + F.row_number().over(ordered))
    )
    end = clamp_end(F.col("_start"), F.col("_end"), F.col("_next"), options)
    return timed.select(
        "media_id",
        F.col("cue_index").cast("bigint").alias("cue_index"),
        "segment_id",
        half_up(F.greatest(F.col("_start"), F.lit(0.0))).alias("start_ms"),
        half_up(F.greatest(end, F.lit(0.0))).alias("end_ms"),
        "lines",
    )


def clamp_cue_durations(
    cues: DataFrame, options: CueOptions = CueOptions(), block_cues: int = BLOCK_SEGMENTS
) -> DataFrame:
    """Apply the display limits to a cue table (media_id, cue_index, start_ms, end_ms, …)."""
    placed = block_scan(
        cues.withColumn(BLOCK, block_of(F.col("cue_index"), block_cues)),
        ["media_id"],
        [F.min_by(F.col("start_ms"), F.col("cue_index")).alias("_first")],
        lambda order, before: {"_next_block_start": F.lead("_first").over(order)},
    )
    ordered, _ = in_block(["media_id"], "cue_index")
    next_start = F.coalesce(F.lead("start_ms").over(ordered), F.col("_next_block_start"))
    return (
        placed.withColumn("_next", next_start)
        .withColumn("end_ms", clamp_end(F.col("start_ms"), F.col("end_ms"), F.col("_next"), options))
        .drop("_next", "_next_block_start", MULTI, BLOCK)
    )
