"""Writers: guarded output of rendered documents, and the result table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.functions.text import safe_filename
from cueweave.operators.blocks import lookup_join
from cueweave.sources import manifest


class OutputRefused(Exception):
    """The target cannot be written (exit code 50)."""

    code = 50


def _filesystem(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(conf)


def check_target(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """Refuse a target before any work: a plain file, an existing result
    without `overwrite`, a parent folder that does not exist."""
    _, target, fs = _filesystem(spark, path)
    if fs.exists(target):
        if not fs.getFileStatus(target).isDirectory():
            raise OutputRefused(f"not a folder: {path}")
        if not overwrite:
            raise OutputRefused(f"already exists: {path}")
    parent = target.getParent()
    if parent is not None and not fs.exists(parent):
        raise OutputRefused(f"no such folder: {parent}")


def document_rows(rendered: DataFrame, media: DataFrame) -> DataFrame:
    """(media_id, format, filename, part, content); `media`: media_id, title."""
    titled = lookup_join(rendered, media.select("media_id", "title"), ["media_id"], ["part"], how="inner")
    return titled.select(
        "media_id", "format", safe_filename(F.col("title"), F.col("format")).alias("filename"), "part", "content"
    )


def write_documents(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write document rows as parquet, one folder per format.

    The rows go to a sibling folder that replaces the target by renaming, so a
    failed job never leaves half a result under the target's name.
    """
    spark = rows.sparkSession
    check_target(spark, path, overwrite)
    jvm, target, fs = _filesystem(spark, path)
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    rows.write.mode("errorifexists").partitionBy("format").parquet(aside)
    staged = jvm.org.apache.hadoop.fs.Path(aside)
    old = None
    if overwrite and fs.exists(target):
        old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}.old")
        _rename(fs, target, old)
    try:
        _rename(fs, staged, target)
    except OutputRefused:
        if old is not None:
            _rename(fs, old, target)
        raise
    if old is not None:
        fs.delete(old, True)


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OutputRefused(f"could not rename {source} to {target}")


def publish_documents(rows: DataFrame, path: str) -> int:
    """Write document rows as the next state of the folder; returns its number.

    Two phases: files go below a new run, then one manifest names them. A failure at any
    step leaves the state before; readers never see a mixture, since one file
    names all folders. `rows` are computed once.
    """
    spark = rows.sparkSession
    number = manifest.version(spark, path)
    run = manifest.new_run(path)
    rows.write.partitionBy("format").parquet(f"{path}/{run}")
    manifest.publish(spark, path, {"documents": run}, number)
    return number + 1


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents that were published last."""
    folders = manifest.read(spark, path)
    if not folders:
        raise FileNotFoundError(f"nothing published in {path}")
    return spark.read.parquet(f"{path}/{folders['documents']}")


def write_table(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a segment, word or cue table, sorted by media inside its files so
    that row-group statistics prune lookups by media."""
    check_target(rows.sparkSession, path, overwrite)
    keys = [c for c in ("media_id", "segment_id", "cue_index") if c in rows.columns]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(
        "overwrite" if overwrite else "errorifexists"
    ).parquet(path)
