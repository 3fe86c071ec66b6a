"""WebVTT parsing and removal of scrolling repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.naming import let
from cueweave.functions.text import strip_tags, trim_ws
from cueweave.functions.timecode import parse_cue_timing, to_ms

# Lines remembered to recognise a repeat, error of an empty track.
RECENT_LINES = 8
EMPTY_TRACK = 20

_CHUNK = 512
_CUE = "struct<start:double,end:double,lines:array<string>>"


def caption_cues(text: Column) -> Column:
    """File text → array<struct<start, end, lines>> of raw cues.

    Cues are separated by truly empty lines. In each block the first valid
    timing line opens the cue and everything after it is its body; blocks
    without one (header, notes) are skipped.
    """
    arrow = lambda s: F.contains(s, F.lit("-->"))

    def cue(lines: Column) -> Column:
        timed = F.transform(
            lines, lambda l, i: F.when(arrow(l), F.struct(parse_cue_timing(l).alias("t"), i.alias("i")))
        )
        first = F.get(F.filter(timed, lambda x: x["t"].isNotNull()), F.lit(0))

        def with_body(opening: Column) -> Column:
            body = F.slice(lines, opening["i"] + 2, F.size(lines))
            kept = F.filter(F.transform(body, lambda l: trim_ws(strip_tags(l))), lambda l: l != "")
            return F.struct(
                opening["t"]["start"].alias("start"), opening["t"]["end"].alias("end"), kept.alias("lines")
            )

        return let(first, lambda opening: F.when(opening.isNotNull(), with_body(opening)))

    blocks = F.filter(F.split(text, r"\r?\n(?:\r?\n)+"), arrow)
    cues = F.transform(F.transform(blocks, lambda b: F.split(b, r"\r?\n")), cue)
    return F.filter(cues, lambda c: c.isNotNull())


def dedup_rolling(cues: Column) -> Column:
    """Keep the lines of each cue that are not among the last 8 kept ones.

    What a cue keeps depends on what its predecessors kept, so this is a fold;
    its unit is one caption file, which is one row. Kept cues are gathered in
    chunks, which keeps the copying small for long files.
    """
    zero = F.struct(
        F.array().cast("array<string>").alias("recent"),
        F.array().cast(f"array<{_CUE}>").alias("chunk"),
        F.array().cast(f"array<array<{_CUE}>>").alias("done"),
    )

    def advance(state: Column, cue: Column, fresh: Column) -> Column:
        seen = F.concat(state["recent"], fresh)
        kept = F.array(F.struct(cue["start"].alias("start"), cue["end"].alias("end"), fresh.alias("lines")))
        full = F.size(state["chunk"]) >= _CHUNK
        return F.struct(
            F.slice(seen, F.greatest(F.size(seen) - RECENT_LINES, F.lit(0)) + 1, RECENT_LINES).alias("recent"),
            F.when(full, kept).otherwise(F.concat(state["chunk"], kept)).alias("chunk"),
            F.when(full, F.concat(state["done"], F.array(state["chunk"]))).otherwise(state["done"]).alias("done"),
        )

    def step(state: Column, cue: Column) -> Column:
        fresh = F.filter(cue["lines"], lambda l: ~F.array_contains(state["recent"], l))
        return let(fresh, lambda f: F.when(F.size(f) > 0, advance(state, cue, f)).otherwise(state))

    return F.aggregate(
        cues, zero, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["chunk"])))
    )


def parse_vtt(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per segment: the file's other columns, segment_id, start_ms, end_ms, text.

    Works inside each row (a file's text), so nothing is shuffled.
    """
    others = [c for c in files.columns if c != text]
    return (
        files.select(*others, F.posexplode(dedup_rolling(caption_cues(F.col(text)))).alias("_id", "_cue"))
        .select(
            *others,
            F.col("_id").cast("bigint").alias("segment_id"),
            to_ms(F.col("_cue.start")).alias("start_ms"),
            to_ms(F.col("_cue.end")).alias("end_ms"),
            F.array_join("_cue.lines", " ").alias("text"),
        )
    )


def track_status(files: DataFrame, text: str = "text") -> DataFrame:
    """Number of raw cues and error 20 for tracks without any segment."""
    kept = F.exists(caption_cues(F.col(text)), lambda c: F.size(c["lines"]) > 0)
    others = [c for c in files.columns if c != text]
    return files.select(
        *others,
        F.size(caption_cues(F.col(text))).cast("bigint").alias("n_cues"),
        F.when(~kept, F.lit(EMPTY_TRACK)).alias("error_code"),
    )
