"""PCM chunks: decoding across chunk borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from cueweave.functions.timecode import SAMPLE_RATE, int_div
from cueweave.operators.blocks import BLOCK, block_of, block_scan, in_block

BLOCK_CHUNKS = 65_536
EMPTY_STREAM = 20


@F.pandas_udf(ArrayType(FloatType()))
def _s16le(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for column in data:
        yield column.map(lambda b: np.frombuffer(b, dtype="<i2").astype(np.float32) / np.float32(32768))


def aligned_chunks(chunks: DataFrame, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """(media_id, chunk_no, data): whole samples of each chunk.

    Input: media_id, chunk_no (dense), bytes. The odd byte a chunk leaves over
    opens the next non-empty chunk.
    """
    keys = ["media_id"]
    size = F.octet_length("bytes").cast("bigint")
    blocked = chunks.select(
        "media_id", "chunk_no", "bytes", size.alias("_size"),
        F.when(size > 0, F.substring(F.col("bytes"), -1, 1)).alias("_tail"),
        block_of(F.col("chunk_no"), block_chunks).alias(BLOCK),
    )
    placed = block_scan(
        blocked, keys,
        [
            F.sum("_size").alias("_bytes"),
            F.max_by("_tail", F.when(F.col("_size") > 0, F.col("chunk_no"))).alias("_block_tail"),
        ],
        lambda order, before: {
            "_bytes_before": F.coalesce(F.sum("_bytes").over(before), F.lit(0)),
            "_tail_before": F.last("_block_tail", ignorenulls=True).over(before),
        },
    )
    _, before = in_block(keys, "chunk_no")
    total_before = F.col("_bytes_before") + F.coalesce(F.sum("_size").over(before), F.lit(0))
    tail = F.coalesce(F.last("_tail", ignorenulls=True).over(before), F.col("_tail_before"))
    joined = placed.withColumn("_odd", total_before % 2 == 1).withColumn("_low", tail)
    data = F.when(F.col("_odd"), F.concat("_low", "bytes")).otherwise(F.col("bytes"))
    whole = F.octet_length("_data") - F.octet_length("_data") % 2
    return joined.withColumn("_data", data).select(
        "media_id", "chunk_no", F.col("_data").substr(F.lit(1), whole).alias("data")
    )


def pcm_decode(chunks: DataFrame, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """(media_id, chunk_no, n_samples, samples) with samples in [-1, 1)."""
    return aligned_chunks(chunks, block_chunks).select(
        "media_id", "chunk_no",
        int_div(F.octet_length("data").cast("bigint"), 2).alias("n_samples"),
        _s16le("data").alias("samples"),
    )


def pcm_summary(chunks: DataFrame) -> DataFrame:
    """(media_id, n_samples, duration_s, pending_byte, error_code) without decoding."""
    total = F.sum(F.octet_length("bytes").cast("bigint"))
    samples = int_div(F.col("_total"), 2)
    return chunks.groupBy("media_id").agg(total.alias("_total")).select(
        "media_id",
        samples.alias("n_samples"),
        (samples / float(SAMPLE_RATE)).alias("duration_s"),
        (F.col("_total") % 2 == 1).alias("pending_byte"),
        F.when(samples == 0, F.lit(EMPTY_STREAM)).alias("error_code"),
    )
