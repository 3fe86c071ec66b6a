"""Exit codes and classification of an extractor's error output."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.functions.text import trim_ws

# Contractual exit codes.
EXIT_CODES = (
    (0, "Ok"),
    (2, "Usage"),
    (10, "InvalidUrl"),
    (11, "Unavailable"),
    (12, "AuthRequired"),
    (13, "LiveNotSupported"),
    (14, "TooLong"),
    (15, "InsufficientMemory"),
    (20, "ExtractionFailed"),
    (21, "SidecarMissing"),
    (30, "ModelUnavailable"),
    (40, "InferenceFailed"),
    (50, "OutputFailed"),
    (130, "Interrupted"),
)

# Fragments searched in the lower-cased message; the groups are
# tried in this order.
AUTH_NEEDLES = (
    "not a bot",
    "sign in to confirm",
    "confirm your age",
    "age-restricted",
    "age restricted",
    "login required",
    "requires authentication",
    "use --cookies",
)
UNAVAILABLE_NEEDLES = (
    "private video",
    "video unavailable",
    "this video is unavailable",
    "removed by the uploader",
    "has been removed",
    "not available in your country",
    "blocked it in your country",
    "members-only",
    "join this channel",
    "video has been terminated",
    "account associated with this video has been terminated",
)
LIVE_NEEDLES = (
    "is a live event",
    "live event will begin",
    "premieres in",
    "this live event",
)
DETAIL_BYTES = 400


def _any_of(needles: tuple[str, ...]) -> str:
    return "|".join(re.escape(n) for n in needles)


def error_detail(message: Column) -> Column:
    """The informative end of a long message."""
    text = trim_ws(message)
    return F.when(F.octet_length(text) <= DETAIL_BYTES, text).otherwise(
        F.concat(F.lit("…"), F.right(text, F.lit(DETAIL_BYTES + 1)))
    )


def classify_error(message: Column) -> Column:
    """struct(code, detail): 12, 11 or 13 by fragment, else 20 with the raw text."""
    low = F.lower(message)
    auth, gone, live = (
        low.rlike(_any_of(n)) for n in (AUTH_NEEDLES, UNAVAILABLE_NEEDLES, LIVE_NEEDLES)
    )
    return F.struct(
        F.when(auth, 12).when(gone, 11).when(live, 13).otherwise(20).alias("code"),
        F.when(auth | gone, error_detail(message))
        .when(~live, trim_ws(message))
        .alias("detail"),
    )


def error_codes(spark: SparkSession) -> DataFrame:
    """The fixed dimension (code, variant)."""
    return spark.createDataFrame(list(EXIT_CODES), "code INT, variant STRING")


def error_variant(code: Column) -> Column:
    """Variant name of an exit code, without a join: the table is fixed."""
    table = F.create_map(*[F.lit(x) for pair in EXIT_CODES for x in pair])
    return F.element_at(table, code.cast("int"))
