"""Content address of a transcription configuration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueweave.functions.naming import let

# Field separator and tags of the optional fields.
SEPARATOR = "\x1f"
VAD_TAG = "vad:j2"
PROMPT_TAG = "prompt"
NO_SPEECH_TAG = "no_speech_thold"
ENTROPY_TAG = "entropy_thold"


def _magnitude_bits(x: Column) -> Column:
    """Bits of a non-negative single-precision value held in a double."""

    def normal(exponent: Column) -> Column:
        fraction = x / F.pow(F.lit(2.0), exponent) - 1.0
        return (exponent + 127) * F.lit(1 << 23) + fraction * float(1 << 23)

    def exact(guess: Column) -> Column:
        # log2 may be one off next to a power of two.
        scaled = x / F.pow(F.lit(2.0), guess)
        return guess + F.when(scaled >= 2.0, 1).when(scaled < 1.0, -1).otherwise(0)

    return (
        F.when(F.isnan(x), F.lit(0x7FC00000))
        .when(x == F.lit(float("inf")), F.lit(0x7F800000))
        .when(x == 0.0, F.lit(0))
        .when(x < F.lit(2.0**-126), x * F.lit(2.0**149))
        .otherwise(let(let(F.floor(F.log2(x)), exact), normal))
        .cast("bigint")
    )


def float_bits_le(c: Column) -> Column:
    """IEEE-754 single-precision bits, little endian, as BINARY.

    Spark has no float-to-bits function; the exponent and the mantissa are
    recovered by exact arithmetic in double precision.
    """
    single = c.cast("float")
    sign = F.when(F.startswith(single.cast("string"), F.lit("-")), F.lit(1 << 31)).otherwise(F.lit(0))
    bits = let(F.abs(single.cast("double")), _magnitude_bits) + sign.cast("bigint")
    return let(
        F.lpad(F.hex(bits), 8, "0"),
        lambda h: F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])),
    )


def _utf8(c: Column | str) -> Column:
    return F.encode(F.lit(c) if isinstance(c, str) else c, "UTF-8")


def _flag(c: Column) -> Column:
    return F.when(c, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))


def _optional(present: Column, *parts: Column) -> Column:
    return F.when(present, F.concat(*parts)).otherwise(F.unhex(F.lit("")))


def config_digest(
    video_id: Column,
    model: Column,
    lang: Column,
    translate: Column,
    vad: Column,
    words: Column,
    prompt: Column,
    no_speech_thold: Column,
    entropy_thold: Column,
) -> Column:
    """Hex SHA-256 over every parameter that influences a result.

    Mandatory fields end with a separator; optional ones are tagged and leave no
    trace when absent.
    """
    head = F.concat(
        _utf8(F.concat(video_id, F.lit(SEPARATOR), model, F.lit(SEPARATOR),
                       F.coalesce(lang, F.lit("auto")), F.lit(SEPARATOR))),
        _flag(translate), _flag(vad), _flag(words),
    )
    return F.sha2(
        F.concat(
            head,
            _optional(vad, _utf8(VAD_TAG + SEPARATOR)),
            _optional(prompt.isNotNull(), _utf8(PROMPT_TAG + SEPARATOR), _utf8(prompt), _utf8(SEPARATOR)),
            _optional(no_speech_thold.isNotNull(), _utf8(NO_SPEECH_TAG + SEPARATOR), float_bits_le(no_speech_thold)),
            _optional(entropy_thold.isNotNull(), _utf8(ENTROPY_TAG + SEPARATOR), float_bits_le(entropy_thold)),
        ),
        256,
    )
