"""Validation of media URLs and rebuilding of the canonical one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueweave.functions.naming import let
from cueweave.functions.text import trim_ws

# Accepted hosts, the host whose first path segment is the id,
# path kinds followed by an id, id alphabet and canonical prefix.
HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be")
SHORT_HOST = "youtu.be"
ID_KINDS = ("shorts", "embed", "live", "v")
ID_PATTERN = r"^[A-Za-z0-9_-]{11}\z"
CANONICAL_PREFIX = "https://www.youtube.com/watch?v="
INVALID_URL = 10


def _tidy(raw: Column) -> Column:
    """What browsers forgive and java.net.URI does not: tabs and newlines inside
    an address vanish; other forbidden characters are kept as an escaped `%`,
    which no id contains, so they can never make a bad id good."""
    flat = F.regexp_replace(trim_ws(raw), r"[\t\n\r]", "")
    return F.regexp_replace(flat, r'[ "<>\\^`{|}]|%(?![0-9A-Fa-f]{2})', "%25")


def _query_pairs(url: Column) -> Column:
    pieces = F.filter(
        F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&"),
        lambda p: p != "",
    )
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("key"),
            F.try_url_decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)\z", 1)).alias("value"),
        ),
    )


def canonical_url(
    raw: Column,
    hosts: tuple[str, ...] = HOSTS,
    short_host: str = SHORT_HOST,
    prefix: str = CANONICAL_PREFIX,
) -> Column:
    """struct(video_id, had_playlist, canonical_url, error_code)."""

    def take_apart(url: Column) -> Column:
        part = lambda name: F.try_parse_url(url, F.lit(name))
        path = F.split(F.coalesce(part("PATH"), F.lit("")), "/")
        return F.struct(
            F.lower(part("PROTOCOL")).alias("scheme"),
            F.lower(part("HOST")).alias("host"),
            F.coalesce(part("USERINFO"), F.lit("")).alias("user"),
            _query_pairs(url).alias("pairs"),
            F.filter(path, lambda s: s != "").alias("segments"),
        )

    def candidate(u: Column) -> Column:
        segment = lambda i: F.get(u["segments"], F.lit(i))
        watched = F.get(F.filter(u["pairs"], lambda p: p["key"] == "v"), F.lit(0))["value"]
        return (
            F.when(u["host"] == short_host, segment(0))
            .when((F.size(u["segments"]) == 1) & (segment(0) == "watch"), watched)
            .when(segment(0).isin(*ID_KINDS), segment(1))
        )

    def verdict(u: Column, found: Column) -> Column:
        accepted = (
            (u["scheme"] == "https") & u["host"].isin(*hosts) & (u["user"] == "") & found.rlike(ID_PATTERN)
        )
        listed = F.exists(u["pairs"], lambda p: p["key"] == "list")
        return let(
            F.coalesce(accepted, F.lit(False)),
            lambda ok: F.struct(
                F.when(ok, found).alias("video_id"),
                F.when(ok, listed).alias("had_playlist"),
                F.when(ok, F.concat(F.lit(prefix), found)).alias("canonical_url"),
                F.when(~ok, F.lit(INVALID_URL)).alias("error_code"),
            ),
        )

    return let(_tidy(raw), lambda url: let(
        take_apart(url), lambda u: let(candidate(u), lambda found: verdict(u, found))
    ))
