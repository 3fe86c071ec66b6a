"""Time expressions. Inside the engine times are BIGINT milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueweave.functions.naming import let
from cueweave.functions.text import trim_ws

# Sampling rate, samples per centisecond, silence kept between
# speech spans and lengthening of each span (a tenth of a second).
SAMPLE_RATE = 16_000
SAMPLES_PER_CS = 160
SILENCE = 1_600
OVERLAP = 1_600

_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def half_up(c: Column) -> Column:
    """Round a non-negative double to the nearest BIGINT, ties upward."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def _number(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def parse_timestamp(c: Column) -> Column:
    """`H:M:S.mmm` or `M:S.mmm`, decimal comma tolerated → seconds, else null."""

    def seconds(parts: Column) -> Column:
        part = lambda i: _number(F.get(parts, F.lit(i)))
        return F.when(
            F.size(parts) == 3, part(0) * 3600.0 + part(1) * 60.0 + part(2)
        ).when(F.size(parts) == 2, part(0) * 60.0 + part(1))

    return let(F.split(F.replace(trim_ws(c), F.lit(","), F.lit(".")), ":"), seconds)


def parse_cue_timing(line: Column) -> Column:
    """`a --> b settings` → struct(start, end) in seconds; null when not a timing line."""
    right = trim_ws(F.regexp_extract(line, r"(?s)^.*?-->(.*)\z", 1))
    both = F.struct(
        parse_timestamp(F.substring_index(line, "-->", 1)).alias("start"),
        parse_timestamp(F.regexp_extract(right, r"(?U)^(\S+)", 1)).alias("end"),
    )
    valid = let(both, lambda t: F.when(t["start"].isNotNull() & t["end"].isNotNull(), t))
    return F.when(F.contains(line, F.lit("-->")), valid)


def to_ms(seconds: Column) -> Column:
    """Seconds → milliseconds; negatives clamp to zero."""
    return half_up(F.greatest(seconds, F.lit(0.0)) * 1000.0)


def int_div(a: Column, b: int) -> Column:
    """Integer division of BIGINTs (`/` would go through doubles)."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def _pad(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def format_timestamp(ms: Column, separator: Column | str) -> Column:
    """`HH:MM:SS<sep>mmm`; hours are unbounded (lpad would cut them)."""
    t = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    hours = int_div(t, 3_600_000)
    hh = F.when(hours < 10, _pad(hours, 2)).otherwise(hours.cast("string"))
    mm = int_div(t, 60_000) % 60
    ss = int_div(t, 1000) % 60
    return F.concat(
        hh, F.lit(":"), _pad(mm, 2), F.lit(":"), _pad(ss, 2), separator if isinstance(separator, Column) else F.lit(separator),
        _pad(t % 1000, 3),
    )


def cs_to_samples(cs: Column) -> Column:
    """Centiseconds (float) → samples; NaN, infinite or non-positive give 0."""
    x = cs.cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < F.lit(float("inf")))
    return F.when(usable, half_up(x * float(SAMPLES_PER_CS))).otherwise(F.lit(0).cast("bigint"))


def duration_min(seconds: Column) -> Column:
    """Whole minutes, rounded up; null stays null."""
    return F.ceil(seconds / 60.0).cast("bigint")


def speed_realtime(audio_ms: Column, elapsed_ms: Column) -> Column:
    """Audio time over elapsed time, one decimal; 0 when nothing elapsed."""
    ratio = audio_ms.cast("double") / elapsed_ms.cast("double")
    return F.when(elapsed_ms > 0, F.floor(ratio * 10.0 + 0.5) / 10.0).otherwise(0.0)
