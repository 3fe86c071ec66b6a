"""Admission rules: live content, duration, memory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueweave.functions.timecode import duration_min

# Fixed share, bytes per second of audio (two float copies at
# 16 kHz and the spectrogram), surcharge for word times, usable percentage,
# live states, default limits.
FIXED_BYTES = 1 << 30
BYTES_PER_SECOND = 2 * 4 * 16_000 + 4 * 100 * 80
BYTES_PER_SECOND_WORDS = 4 * 16_000
USABLE_PERCENT = 85
LIVE_STATES = ("is_live", "is_upcoming", "post_live")
MAX_DURATION_MIN = 720
MIB = 1 << 20


def is_live(flag: Column, status: Column) -> Column:
    """Running, announced or just finished live content."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(status.isin(*LIVE_STATES), F.lit(False))


def bytes_per_second(words: Column) -> Column:
    return F.when(words, F.lit(BYTES_PER_SECOND + BYTES_PER_SECOND_WORDS)).otherwise(
        F.lit(BYTES_PER_SECOND)
    ).cast("bigint")


def memory_required(duration_s: Column, words: Column) -> Column:
    """Bytes a transcription of `duration_s` seconds needs; unknown for an unknown duration."""
    audio = F.ceil(F.greatest(duration_s, F.lit(0.0)) * bytes_per_second(words).cast("double"))
    return F.when(duration_s.isNotNull(), F.lit(FIXED_BYTES).cast("bigint") + audio.cast("bigint"))


def _div(a: Column, b: Column | int) -> Column:
    """Integer division of BIGINTs (`/` would go through doubles)."""
    b = F.lit(b).cast("bigint") if isinstance(b, int) else b
    return F.call_function("div", a, b)


def memory_budget(available: Column) -> Column:
    """Usable share; the integer division comes first."""
    a = available.cast("bigint")
    return _div(a, 100) * F.lit(USABLE_PERCENT)


def max_minutes(available: Column, words: Column) -> Column:
    """Longest media, in minutes, that the available memory permits; unknown for unknown memory."""
    useful = F.greatest(memory_budget(available) - F.lit(FIXED_BYTES), F.lit(0).cast("bigint"))
    return F.when(available.isNotNull(), _div(_div(useful, bytes_per_second(words)), 60))


def too_long(duration_s: Column, limit_min: Column) -> Column:
    """Unknown durations are never refused."""
    return F.coalesce(duration_min(duration_s) > limit_min, F.lit(False))


def short_of_memory(duration_s: Column, words: Column, available: Column) -> Column:
    """Unknown durations or unknown memory are never refused."""
    finite = ~F.isnan(duration_s) & (duration_s < F.lit(float("inf")))
    return F.coalesce(
        finite & (memory_required(duration_s, words) > memory_budget(available)), F.lit(False)
    )
