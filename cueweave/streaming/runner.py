"""Running a stream to the end of its input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cueweave.session import scratch
from cueweave.streaming.ordered import CLOSE_MS

_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What one micro-batch reads at most.
TRIGGER_BYTES = 32 << 30


class SourceNotRead(RuntimeError):
    """The table has rows, but the stream over it read none."""


def table_stream(spark: SparkSession, folder: str, table: str, **options) -> DataFrame:
    """Stream over one parquet table of a folder, a file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    options = {"maxBytesPerTrigger": str(TRIGGER_BYTES), **options}
    # As a pattern, the path may name a file or a folder; a plain path must be a folder.
    return spark.readStream.schema(schema).options(**options).parquet(f"{folder}/[{table[0]}]{table[1:]}.parquet")


def table_delay(rows: DataFrame) -> str:
    """Watermark delay for a stored table read as a stream: its files come in no order of
    time, so that a row may come as late as the table is long. Column `ts_ms`."""
    span = rows.agg(F.max("ts_ms") - F.min("ts_ms")).first()[0] or 0
    return f"{span + 1} milliseconds"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _path(spark, path)
    return files.exists(target)


def _finish(query: StreamingQuery, table: DataFrame | None) -> None:
    query.awaitTermination()
    if table is not None and not any(p.numInputRows for p in query.recentProgress) and not table.isEmpty():
        raise SourceNotRead(f"stream {query.name or query.id} read nothing of a table with rows")


def _sink(stream: DataFrame, out: str) -> StreamingQuery:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True).start()
    )


def _written(stream: DataFrame, out: str) -> DataFrame:
    spark = stream.sparkSession
    if not _exists(spark, f"{out}/rows"):  # the source held nothing
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def drain(stream: DataFrame, label: str, table: DataFrame | None = None) -> DataFrame:
    """Process all available input into a parquet sink, exactly once; read it back.

    `table` is the source as a table: if it has rows and the stream read none,
    `SourceNotRead` is raised.
    """
    out = scratch(stream.sparkSession, label)
    _finish(_sink(stream, out), table)
    return _written(stream, out)


def drain_closed(
    source: DataFrame, work: Callable[[DataFrame], DataFrame], label: str, table: DataFrame | None = None,
    start: Callable[[DataFrame, str], StreamingQuery] = _sink,
) -> DataFrame:
    """`drain(work(source))`, then close the stream: nothing waits for a watermark any more.

    Once the source is drained, a row of the year 9999 is put into a second source and the
    query goes on from its checkpoint: the watermark passes every row, windows end,
    timers fire, and append mode delivers the last batch. `source` has `ts_ms`.
    """
    spark = source.sparkSession
    out = scratch(spark, label)
    files, folder = _path(spark, f"{out}/closing")
    files.mkdirs(folder)
    ends = spark.readStream.schema(source.schema).parquet(f"{out}/closing")
    stream = work(source.unionByName(ends))
    _finish(start(stream, out), table)
    empty = spark.createDataFrame([()], "").select(*[
        (F.lit(CLOSE_MS) if f.name == "ts_ms" else F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema])
    empty.write.mode("append").parquet(f"{out}/closing")
    start(stream, out).awaitTermination()
    return _written(stream, out)


def drain_batches(stream: DataFrame, label: str, work, mode: str = "append", table: DataFrame | None = None) -> DataFrame:
    """Apply `work(batch)` to every micro-batch; each result overwrites its own
    folder, so a repeated batch leaves no duplicates."""
    spark = stream.sparkSession
    out = scratch(spark, label)
    _finish(_batches(stream, out, work, mode), table)
    return _written_batches(stream, out, work)


def drain_closed_batches(source: DataFrame, prepare, label: str, work, table: DataFrame | None = None) -> DataFrame:
    """`drain_batches` over `prepare(source)`, closed as in `drain_closed`."""
    held = {}

    def start(stream: DataFrame, out: str) -> StreamingQuery:
        held["out"], held["stream"] = out, stream
        return _batches(stream, out, work, "append")

    drain_closed(source, prepare, label, table, start)
    return _written_batches(held["stream"], held["out"], work)


def _batches(stream: DataFrame, out: str, work, mode: str) -> StreamingQuery:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    )


def _written_batches(stream: DataFrame, out: str, work) -> DataFrame:
    spark = stream.sparkSession
    if not _exists(spark, f"{out}/rows"):
        return work(spark.createDataFrame([], stream.schema)).withColumn("batch", F.lit(0).cast("bigint"))
    return spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/batch=*").withColumn(
        "batch", F.col("batch").cast("bigint")
    )
