"""Helpers that several operators share."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.session import scratch

#: Bytes of text that one group of a distributed step holds; the number of
#: groups follows from the measured size of the input.
GROUP_BYTES = 16 << 20

#: Bits of the largest bitmap that `perhaps_in` broadcasts (16 MB), and of one row of it.
MOST_BITS, ROW_BITS = 1 << 27, 1 << 15


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def process_state(key, make: Callable):
    """`make()`, once per Python process: vocabularies and caches outlive a task."""
    held = sys.__dict__.setdefault("_cueweave_llm", {})
    if key not in held:
        held[key] = make()
    return held[key]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with about `most` bytes in `column` (one row at least)."""
    for batch in batches:
        start, size = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start)


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and a lost
    executor costs no recomputation."""
    path = scratch(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def group_count(frame: DataFrame, text: str, bytes_per_group: int = GROUP_BYTES) -> int:
    """How many groups of about `bytes_per_group` bytes the texts make; at least the
    session's number of shuffle partitions."""
    total = frame.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(total / bytes_per_group))


def perhaps_in(rows: DataFrame, key: Column, wanted: DataFrame, hashed: Column) -> DataFrame:
    """`rows` plus `_perhaps`: may their hash `key` be that, `hashed`, of a row of `wanted`? No is certain.

    Rows that meet nothing need no shuffle then. What is broadcast is a bitmap with 64 bits or more per
    hash, so that one row in 64 passes by chance; beyond 2 million hashes it grows no more and more rows pass.
    """
    bits = min(MOST_BITS, max(ROW_BITS, 1 << (64 * wanted.count()).bit_length()))
    place = lambda h: F.pmod(h, F.lit(bits)) + 1
    bitmap = wanted.select(place(hashed).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_row_of_bits")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substr("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bitmap), F.bitmap_bucket_number(place(key)) == F.col("_row_of_bits"), "left")
    return met.select(*rows.columns, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias("_perhaps"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes, as many as the largest one needs."""
    bits = np.ascontiguousarray(values.astype("<i8")).view(np.uint64)
    planes = (int(np.bitwise_or.reduce(bits, initial=0)).bit_length() + 7) // 8
    raw = np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return bytes([planes]) + len(values).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(raw, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    """The integers of `pack`."""
    planes, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n and planes:
        raw = pa.decompress(data[9:], n * planes, codec="zstd", asbytes=True)
        out[:, :planes] = np.frombuffer(raw, np.uint8).reshape(planes, n).T
    return out.view("<i8").reshape(n)


def pack_columns(columns: list[np.ndarray]) -> bytes:
    """Columns of one length; the first, which rises, as differences."""
    parts = [pack(np.diff(columns[0], prepend=0)), *map(pack, columns[1:])]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpack_columns(data: bytes) -> list[np.ndarray]:
    """The columns of `pack_columns`."""
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 4], "little")
        out.append(unpack(data[at + 4:at + 4 + size]))
        at += 4 + size
    return [np.cumsum(out[0]), *out[1:]]
