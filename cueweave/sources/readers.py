"""Readers. Each has a form that parses a column, so that texts held in tables
and texts held in files go through the same code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave import schemas
from cueweave.operators.audits import parse_checksums
from cueweave.operators.planning import with_request_defaults
from cueweave.operators.render import SCHEMA_VERSION
from cueweave.operators.results import CACHE_VERSION

EXTRACTION_FAILED = 20


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Request rows with defaults filled in; `fmt` is parquet, json or csv."""
    reader = spark.read.schema(schemas.REQUEST)
    return with_request_defaults((reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path))


def parse_probe(json: Column) -> Column:
    """Probe JSON → struct of the 11 fields used; missing ones are null."""
    return F.from_json(json, schemas.PROBE)


def parse_probe_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Probe fields as columns (`id` → video_id) plus error_code 20 for bad rows."""
    others = [c for c in rows.columns if c != column]
    p = rows.select(*others, parse_probe(F.col(column)).alias("_p"))
    fields = ("channel", "duration", "upload_date", "language", "is_live", "live_status",
              "age_limit", "subtitles", "automatic_captions")
    return p.select(
        *others,
        F.col("_p.id").alias("video_id"),
        F.coalesce(F.col("_p.title"), F.lit("")).alias("title"),
        *[F.col(f"_p.{f}").alias(f) for f in fields],
        F.when(F.col("_p.id").isNull(), F.lit(EXTRACTION_FAILED)).alias("error_code"),
    )


def read_probe_json(spark: SparkSession, path: str) -> DataFrame:
    """One probe document per line."""
    return parse_probe_json(spark.read.text(path).withColumnRenamed("value", "json"))


def read_caption_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one caption file per row."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")
    )


def read_transcript_json(spark: SparkSession, path: str) -> DataFrame:
    """Exported documents, one per line, of the known schema version."""
    return spark.read.schema(schemas.EXPORT).json(path).where(F.col("schema_version") == SCHEMA_VERSION)


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Stored results, one per line, of the known version; unreadable ones are absent."""
    rows = spark.read.schema(schemas.ENVELOPE).json(path)
    return rows.where((F.col("version") == CACHE_VERSION) & F.col("document").isNotNull())


def segments_of(documents: DataFrame, segments: str = "segments", key: str = "source.video_id") -> DataFrame:
    """Segment rows of nested documents, times in milliseconds."""
    ms = lambda c: F.floor(F.col(c) * 1000.0 + 0.5).cast("bigint")
    return documents.select(F.col(key).alias("media_id"), F.explode(segments).alias("_s")).select(
        "media_id", F.col("_s.id").alias("segment_id"), ms("_s.start").alias("start_ms"),
        ms("_s.end").alias("end_ms"), F.col("_s.text").alias("text"),
        F.col("_s.no_speech_prob").alias("no_speech_prob"), F.col("_s.words").alias("words"),
    )


def read_bench_json(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark lines under English column names."""
    names = {"modele": "model", "chargement_s": "load_s", "vitesse": "speed"}
    return spark.read.schema(schemas.BENCH).json(path).withColumnsRenamed(names)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, sum) of `SHA2-256SUMS` manifests."""
    return parse_checksums(read_caption_files(spark, path))


def read_files(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """(name, size[, sha256]) of files; content is read only when `full`."""
    rows = spark.read.format("binaryFile").load(path).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    plain = ["name", F.col("length").alias("size")]
    return rows.select(*plain, F.sha2("content", 256).alias("sha256")) if full else rows.select(*plain)


def read_pcm_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, chunk_no, bytes) of files named `<media>-<number>.pcm`."""
    name = lambda g: F.regexp_extract("path", r"([^/]+)-(\d+)\.pcm$", g)
    return spark.read.format("binaryFile").load(path).select(
        name(1).alias("media_id"), name(2).cast("bigint").alias("chunk_no"), F.col("content").alias("bytes")
    )
