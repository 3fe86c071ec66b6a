"""Audits of files, downloads, runs and outcomes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions.errors import classify_error, error_variant
from cueweave.functions.timecode import int_div
from cueweave.operators.blocks import BLOCK, block_of, in_block

BLOCK_CHUNKS = 65_536


def verify_files(manifest: DataFrame, files: DataFrame, full: bool = False) -> DataFrame:
    """(name, status): installed, missing or corrupt.

    The cheap check compares sizes and never reads content; the full one also
    compares SHA-256 sums. `manifest`: name, size, sha256; `files`: name, size
    and, for the full check, sha256.
    """
    wanted = ["name", "size", "sha256"] if full else ["name", "size"]
    found = files.select("name", *[F.col(c).alias(f"_{c}") for c in wanted[1:]])
    same = F.col("size") == F.col("_size")
    if full:
        same = same & (F.col("sha256") == F.col("_sha256"))
    status = F.when(F.col("_size").isNull(), "missing").when(same, "installed").otherwise("corrupt")
    return manifest.join(found, "name", "left").select("name", status.alias("status"))


def parse_checksums(manifests: DataFrame, text: str = "text") -> DataFrame:
    """(other columns…, name, sum): `sum name` lines with 64-character sums.

    Of several lines for one name the first counts. A manifest is one row.
    """
    others = [c for c in manifests.columns if c != text]
    fields = F.filter(F.split("_line", r"(?U)\s+"), lambda f: f != "")
    lines = manifests.select(*others, F.posexplode(F.split(text, r"\r?\n")).alias("_no", "_line")).withColumn("_f", fields)
    valid = lines.where((F.size("_f") >= 2) & (F.octet_length(F.get("_f", F.lit(0))) == 64))
    return (
        valid.groupBy(*others, F.get("_f", F.lit(1)).alias("name"))
        .agg(F.min_by(F.get("_f", F.lit(0)), F.col("_no")).alias("sum"))
    )


def chunk_contiguity(log: DataFrame, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """(download_id, seq, start, received_before, total, contiguous).

    Input: download_id, seq (dense), status, content_range, length. A partial
    answer (206) must start at the bytes already received; any other answer
    carries the whole file and restarts from zero.
    """
    keys = ["download_id"]
    part = lambda g: F.regexp_extract("content_range", r"^bytes (\d+)-[^/]*/(.*)$", g)
    parsed = log.select(
        "download_id", "seq", "length",
        (F.col("status") != 206).alias("_full"),
        part(1).try_cast("bigint").alias("start"),
        part(2).try_cast("bigint").alias("total"),
        block_of(F.col("seq"), block_chunks).alias(BLOCK),
    )
    ordered, _ = in_block(keys, "seq")
    grouped = parsed.withColumn("_g", F.sum(F.col("_full").cast("bigint")).over(ordered))
    # Bytes since the last whole answer, block by block.
    per_block = (
        grouped.groupBy(*keys, BLOCK, "_g").agg(F.sum("length").alias("_sum"))
        .groupBy(*keys, BLOCK).agg(F.max_by("_sum", "_g").alias("_since"), F.max("_g").alias("_restarts"))
    )
    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    context = (
        per_block.withColumn("_era", F.sum(F.signum("_restarts").cast("bigint")).over(blocks))
        .withColumn("_cum", F.sum("_since").over(Window.partitionBy(*keys, "_era").orderBy(BLOCK)))
        .select(*keys, BLOCK, F.coalesce(F.lag("_cum").over(blocks), F.lit(0)).alias("_carry"))
    )
    in_group = Window.partitionBy(*keys, BLOCK, "_g").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("length").over(in_group), F.lit(0)) + F.when(F.col("_g") == 0, F.col("_carry")).otherwise(0)
    return (
        grouped.join(context, [*keys, BLOCK])
        .withColumn("received_before", F.when(F.col("_full"), F.lit(0).cast("bigint")).otherwise(before))
        .select(
            "download_id", "seq", F.when(F.col("_full"), F.lit(0).cast("bigint")).otherwise(F.col("start")).alias("start"),
            "received_before", "total",
            (F.col("_full") | F.coalesce(F.col("start") == F.col("received_before"), F.lit(False))).alias("contiguous"),
        )
    )


#: Size of the quantile sketches: ranks are off by 0.13 % at most (99 % of the time), and exact up to so many runs.
SKETCH_K = 4096


def bench_sketches(runs: DataFrame, keys: tuple[str, ...] = ("model", "backend", "vad")) -> DataFrame:
    """Per `keys`: counts, sums, extremes and mergeable quantile sketches of `speed` and `peak_mb`.

    The rows can be stored, for instance per day, and put together by `merge_bench` without
    the runs. Null speeds and sizes count as runs only.
    """
    sketch = lambda c: F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SKETCH_K))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.count("speed").alias("timed"), F.sum("speed").alias("speed_sum"),
        F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"), F.sum("segments").alias("segments"),
        F.max("peak_mb").alias("max_peak_mb"), sketch("speed").alias("speed_sketch"), sketch("peak_mb").alias("peak_sketch"),
    )


def merge_bench(sketches: DataFrame, keys: tuple[str, ...] = ("model", "backend", "vad")) -> DataFrame:
    """Rows of `bench_sketches` summed up by (fewer) `keys`."""
    merged = lambda c: F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(c)
    return sketches.groupBy(*keys).agg(
        F.sum("runs").alias("runs"), F.sum("timed").alias("timed"), F.sum("speed_sum").alias("speed_sum"),
        F.min("min_speed").alias("min_speed"), F.max("max_speed").alias("max_speed"), F.sum("segments").alias("segments"),
        F.max("max_peak_mb").alias("max_peak_mb"), merged("speed_sketch"), merged("peak_sketch"),
    )


def bench_figures(sketches: DataFrame) -> DataFrame:
    """What the sketches say, without the runs: means, extremes, the median and the 95th percentile of speed and memory."""
    rest = ("speed_sketch", "peak_sketch", "speed_sum", "timed")

    def quantile(sketch: str, share: float) -> Column:
        some = F.kll_sketch_get_n_double(sketch) > 0
        return F.when(some, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))

    return sketches.withColumns({
        "mean_speed": F.col("speed_sum") / F.nullif("timed", F.lit(0).cast("bigint")),
        "speed_p50": quantile("speed_sketch", 0.5), "speed_p95": quantile("speed_sketch", 0.95),
        "peak_mb_p50": quantile("peak_sketch", 0.5), "peak_mb_p95": quantile("peak_sketch", 0.95),
    }).drop(*rest)


def exact_quantiles(figures: DataFrame, sketches: DataFrame, runs: DataFrame, keys: tuple[str, ...] = ("model", "backend", "vad")) -> DataFrame:
    """`bench_figures` with the quantiles that the runs have: the smallest value that at least the share
    of the values reaches, whatever the sketch left out.

    The sketches only say where to look: values a percent of ranks around each share are
    zones of their own. Values are counted first, then zones; only the zones that hold a wanted rank are ordered,
    so a sketch that is off costs time and no digit. `runs` should be a stored table.
    """
    asked = {"speed": ("speed_sketch", "speed"), "peak_mb": ("peak_sketch", "peak_mb")}
    shares = {"p50": 50, "p95": 95}
    edges = [(q + d) / 100 for q in shares.values() for d in (-1, 1)]
    named = [F.col(k).alias(f"_{k}") for k in keys]
    same = lambda names: F.lit(True) if not names else functools.reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names])
    found = figures
    for measure, (sketch, column) in asked.items():
        some = F.kll_sketch_get_n_double(sketch) > 0
        cuts = sketches.select(*named, *[F.when(some, F.kll_sketch_get_quantile_double(sketch, F.lit(e))).alias(f"_e{i}") for i, e in enumerate(edges)])
        values = runs.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        # One row per group, as few as the result has.
        zone = sum((F.coalesce(F.col("_v") > F.col(f"_e{i}"), F.lit(False)).cast("int") for i in range(len(edges))), F.lit(0))
        placed = values.join(F.broadcast(cuts), same(keys)).select(*keys, "_v", "_n", zone.alias("_zone"))
        order = Window.partitionBy(*keys).orderBy("_zone")
        zones = placed.groupBy(*keys, "_zone").agg(F.sum("_n").alias("_in")).select(
            *[F.col(k).alias(f"_{k}") for k in keys], F.col("_zone").alias("_at"),
            (F.sum("_in").over(order) - F.col("_in")).alias("_below"), F.col("_in"),
            F.sum("_in").over(Window.partitionBy(*keys)).alias("_all"))
        ranks = {name: int_div(F.col("_all") * q + 99, 100) for name, q in shares.items()}
        holds = functools.reduce(lambda a, b: a | b, [(r > F.col("_below")) & (r <= F.col("_below") + F.col("_in")) for r in ranks.values()])
        inside = Window.partitionBy(*keys, "_zone").orderBy("_v")
        ordered = placed.join(F.broadcast(zones.where(holds)), same(keys) & (F.col("_zone") == F.col("_at"))).withColumn(
            "_upto", F.col("_below") + F.sum("_n").over(inside))
        exact = ordered.groupBy(*keys).agg(*[
            F.min(F.when(F.col("_upto") >= r, F.col("_v"))).cast("double").alias(f"_{measure}_{name}") for name, r in ranks.items()])
        exact = exact.select(*named, *[f"_{measure}_{name}" for name in shares])
        found = found.drop(*[f"{measure}_{name}" for name in shares]).join(F.broadcast(exact), same(keys), "left").select(
            *[c for c in found.columns if c not in {f"{measure}_{name}" for name in shares}],
            *[F.col(f"_{measure}_{name}").alias(f"{measure}_{name}") for name in shares])
    return found


def bench_summary(runs: DataFrame) -> DataFrame:
    """Runs, speed, memory and segments by model, backend and speech detection; quantiles are exact.

    `runs` should be a stored table: it is read for the sketches, then for the values near the quantiles.
    """
    sketches = bench_sketches(runs)
    return exact_quantiles(bench_figures(sketches), sketches, runs)


def error_summary(logs: DataFrame, message: str = "message") -> DataFrame:
    """(code, variant, n): outcomes of a run log; a null message is success."""
    code = F.when(F.col(message).isNull(), 0).otherwise(classify_error(F.col(message))["code"])
    return (
        logs.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
        .select("code", error_variant(F.col("code")).alias("variant"), "n")
    )
