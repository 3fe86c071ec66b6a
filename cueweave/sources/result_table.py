"""The table of results by digest, in buckets that change one by one.

Rows lie in buckets of their digest. An update writes new files for the buckets it
touches and no others, then names them in the next manifest. A run that ends in
between leaves the old table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.operators.results import MAX_BYTES, cache_evict, latest_entry, touch
from cueweave.sources import manifest

#: Buckets of a new table; the number is part of the table and stays.
BUCKETS = 256
_COUNT = "buckets"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def _load(spark: SparkSession, path: str, folders: list[str], schema) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the manifest in force."""
    folders = manifest.read(spark, path)
    folders.pop(_COUNT, None)
    if not folders:
        raise FileNotFoundError(f"no results in {path}")
    return spark.read.parquet(*[f"{path}/{f}" for f in folders.values()])


def upsert_results(
    fresh: DataFrame, path: str, hits: DataFrame | None = None, buckets: int = BUCKETS,
    by: str = "written_at", tie: str = "entry_id",
) -> int:
    """Insert or replace `fresh` under their digests and move the access times of `hits`
    (digest, accessed), in one step. Returns the number of the new manifest.

    Only buckets with a fresh or hit digest are read and written. Hits without an
    entry change nothing; rows without a digest cannot be stored and are refused.
    """
    spark = fresh.sparkSession
    if not fresh.where("digest IS NULL").isEmpty():
        raise ValueError("entries need a digest")
    number = manifest.version(spark, path)
    folders = manifest.read(spark, path, number)
    buckets = int(folders.get(_COUNT, buckets))
    asked = fresh.select("digest") if hits is None else fresh.select("digest").unionByName(hits.select("digest"))
    touched = [r[0] for r in asked.where("digest IS NOT NULL").select(_bucket(buckets).alias("b")).distinct().collect()]  # at most `buckets`
    old = _load(spark, path, [folders[str(b)] for b in touched if str(b) in folders], fresh.schema)
    entries = latest_entry(old.unionByName(fresh), by, tie).select(*fresh.columns)
    if hits is not None:
        entries = touch(entries, hits)
    return _replace(entries, path, folders, touched, buckets, number)


def evict_results(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> int:
    """Remove the least recently used entries beyond the ceiling; rewrites their buckets only."""
    number = manifest.version(spark, path)
    folders = manifest.read(spark, path, number)
    buckets = int(folders[_COUNT])
    judged = cache_evict(read_results(spark, path), max_bytes)
    touched = [r[0] for r in judged.where("NOT kept").select(_bucket(buckets).alias("b")).distinct().collect()]
    kept = judged.where("kept").drop("kept").where(_bucket(buckets).isin(touched))
    return _replace(kept, path, folders, touched, buckets, number)


def _replace(rows: DataFrame, path: str, folders: dict[str, str], touched: list[int], buckets: int, number: int) -> int:
    spark, run = rows.sparkSession, manifest.new_run(path)
    rows.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{run}")
    found = {r[0] for r in spark.read.parquet(f"{path}/{run}").select("bucket").distinct().collect()} if touched else set()
    after = {name: folder for name, folder in folders.items() if name == _COUNT or int(name) not in touched}
    after |= {str(b): f"{run}/bucket={b}" for b in found} | {_COUNT: str(buckets)}
    return manifest.publish(spark, path, after, number)
