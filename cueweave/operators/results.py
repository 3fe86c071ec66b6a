"""The content-addressed table of results: lookup, compaction, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from cueweave.operators.blocks import lookup_join

# Default ceiling in bytes, envelope version.
MAX_BYTES = 2 * 1024 * 1024 * 1024
CACHE_VERSION = 1


def latest_entry(entries: DataFrame, by: str = "written_at", tie: str = "entry_id") -> DataFrame:
    """One entry per digest, the last written.

    A grouped maximum, not a window: copies of one digest collapse before the
    exchange.
    """
    rest = [c for c in entries.columns if c != "digest"]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(by), F.col(tie)))
    return entries.groupBy("digest").agg(newest.alias("_e")).select("digest", "_e.*")


def cache_put(existing: DataFrame, fresh: DataFrame, by: str = "written_at", tie: str = "entry_id") -> DataFrame:
    """Table after inserting or replacing `fresh` under their digests."""
    return latest_entry(existing.unionByName(fresh), by, tie)


def cache_lookup(requests: DataFrame, entries: DataFrame, spread_by: list[str]) -> DataFrame:
    """Requests with `cached` and the stored title; entries are unique per digest."""
    stored = entries.select("digest", F.lit(True).alias("_hit"), F.col("title").alias("cached_title"))
    return lookup_join(requests, stored, ["digest"], spread_by).withColumn(
        "cached", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def cache_misses(requests: DataFrame, entries: DataFrame, spread_by: list[str]) -> DataFrame:
    """Requests that no entry answers."""
    return lookup_join(requests, entries.select("digest"), ["digest"], spread_by, how="left_anti")


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum("bytes"), F.lit(0).cast("bigint")).alias("total_bytes"),
        F.max("accessed").alias("last_access"),
        F.max_by("title", F.struct(F.col("accessed"), F.col("digest"))).alias("last_title"),
    )


def cache_list(entries: DataFrame) -> DataFrame:
    """Newest access first; the digest settles ties."""
    return entries.orderBy(F.col("accessed").desc(), F.col("digest"))


def access_micros(entries: DataFrame) -> Column:
    """Access time as a number: microseconds of a timestamp, else the number itself;
    entries that were never accessed come before all others."""
    kind = entries.schema["accessed"].dataType
    number = F.unix_micros("accessed") if isinstance(kind, TimestampType) else F.col("accessed").cast("bigint")
    return F.coalesce(number, F.lit(-(2**63)).cast("bigint"))


def first_evicted(entries: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row (`_time`, `_digest`): the first entry, newest access first and equal times by
    digest, with which the running size passes `max_bytes`; nulls if all fit.

    A hierarchical prefix sum: bytes per bucket of 16 bits of the time, a running
    sum over at most 65,536 buckets, then the same inside the bucket where the
    ceiling is passed; ties go on with four hex digits of the digest each. Only the
    entries of the last bucket, which share a microsecond and eight hex digits,
    are sorted. It is one plan; each level is a scan of three columns with a small aggregate.
    """
    time = F.col("_time")
    levels = [(F.shiftright(time, 48), True), *((F.shiftright(time, s).bitwiseAND(F.lit(0xFFFF)), True) for s in (32, 16, 0)),
              *((F.substring("_digest", at, 4), False) for at in (1, 5))]
    rows = entries.select(access_micros(entries).alias("_time"), F.coalesce("digest", F.lit("")).alias("_digest"),
                          F.coalesce(F.col("bytes"), F.lit(0)).alias("_bytes"))
    inside, path = rows.withColumn("_room", F.lit(max_bytes).cast("decimal(38,0)")), []
    for k, (digit, newest_first) in enumerate(levels):
        sums = inside.groupBy("_room", *path, digit.alias("_digit")).agg(F.sum(F.col("_bytes").cast("decimal(38,0)")).alias("_sum"))
        order = Window.orderBy(F.col("_digit").desc() if newest_first else F.col("_digit").asc())
        over = sums.withColumn("_upto", F.sum("_sum").over(order)).where(F.col("_upto") > F.col("_room"))
        first = F.max_by if newest_first else F.min_by
        room = (F.col("_room") - F.col("_upto") + F.col("_sum")).cast("decimal(38,0)")
        cut = over.agg(first(F.struct(*path, F.col("_digit").alias(f"_cut{k}"), room.alias("_left")), F.col("_digit")).alias("_c"))
        path.append(f"_cut{k}")
        cut = cut.select("_c.*").withColumnRenamed("_left", "_room")
        same = F.lit(True)
        for name, (d, _) in zip(path, levels):
            same = same & (d == F.col(name))
        inside = rows.join(F.broadcast(cut), same)  # one row
    order = Window.orderBy(time.desc(), "_digest")
    passed = inside.withColumns({"_upto": F.sum("_bytes").over(order), "_no": F.row_number().over(order)}).where("_upto > _room")
    return passed.agg(F.min_by(F.struct("_time", "_digest"), "_no").alias("_c")).select("_c.*")


def cache_evict(entries: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`entries` plus `kept`: least recently used ones go beyond the ceiling.

    `accessed` is a timestamp, to the microsecond, or a number; null times are the
    oldest, null sizes count nothing.
    """
    cut = F.broadcast(first_evicted(entries, max_bytes))  # one row
    time, digest = access_micros(entries), F.coalesce("digest", F.lit(""))
    newer = (time > F.col("_time")) | ((time == F.col("_time")) & (digest < F.col("_digest")))
    return entries.join(cut, F.lit(True), "left").select(
        *entries.columns, (F.col("_time").isNull() | newer).alias("kept"))


def touch(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """`entries` with the access time of those that `hits` (digest, accessed) found, if it is later."""
    last = hits.where("digest IS NOT NULL").groupBy("digest").agg(F.max("accessed").alias("_touched"))
    touched = entries.join(last, "digest", "left")
    return touched.withColumn("accessed", F.greatest("accessed", "_touched")).select(*entries.columns)


def read_versioned(envelopes: DataFrame, version: int = CACHE_VERSION) -> DataFrame:
    """Entries of the known version that could be read; others count as absent."""
    return envelopes.where((F.col("version") == version) & F.col("document").isNotNull())
