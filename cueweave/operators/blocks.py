"""Ordered computations over keys of any size.

A window `PARTITION BY media ORDER BY position` puts a whole media into one
task, which fails when one media holds a third of the table. Every ordered
operator here works on blocks instead: `(key, position div width)` is a bounded
group, one summary row per block carries what the blocks before (or after) it
contribute, and the plain window then runs inside the block.

The summaries are built with map-side partial aggregation, so a hot key costs
one small row per block and task; rows themselves are shuffled once, by
`(key, block)`, and every window, join and aggregation of the operator reuses
that partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
MULTI = "_multi"

# Rows of one key beyond which its position axis is cut into blocks, where the
# axis is sparse. At most total / HOT_ROWS keys can be hot: 250,000 keys, a few
# megabytes, for 10**12 rows; that bound is what makes broadcasting them safe.
HOT_ROWS = 4_000_000


def block_of(position: Column, width: int) -> Column:
    """Block number of a position on a dense axis."""
    return F.floor(position / F.lit(width)).cast("bigint")


def block_scan(
    rows: DataFrame,
    keys: list[str],
    summary: list[Column],
    context: Callable[[Window, Window], dict[str, Column]],
) -> DataFrame:
    """`rows` plus context columns computed on one summary row per block.

    `rows` carries a `_block` column; `summary` aggregates a block; `context`
    maps (blocks in order, blocks strictly before) to columns. `_multi` is
    added too: has the key more than one block?
    """
    # The join below drops null keys anyway; dropping them up front gives both
    # branches the same input, so Spark can reuse an exchange beneath them.
    for key in (*keys, BLOCK):
        rows = rows.where(F.col(key).isNotNull())
    per_block = rows.groupBy(*keys, BLOCK).agg(*summary)
    order = Window.partitionBy(*keys).orderBy(BLOCK)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    columns = [c.alias(name) for name, c in context(order, before).items()]
    columns.append((F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1).alias(MULTI))
    rows = rows.drop(MULTI)
    return rows.join(per_block.select(*keys, BLOCK, *columns), [*keys, BLOCK])


def in_block(keys: list[str], *order: str | Column) -> tuple[Window, Window]:
    """(ordered, strictly before) windows inside a block."""
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    return w, w.rowsBetween(Window.unboundedPreceding, -1)


def hot_keys(rows: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows, and in how many ways (`_ways`) to spread them
    for at most half of that each; reads only the key columns."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.lit(True).alias("_hot"), F.ceil(F.col("_n") * 2 / F.lit(hot_rows)).cast("bigint").alias("_ways"))
    )


def sparse_block(
    rows: DataFrame, keys: list[str], position: Column, width: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add `_block` for a position axis that most keys use sparsely.

    Cutting every key would leave cold keys with a block per row, so only hot
    ones are cut.
    """
    hot = F.broadcast(hot_keys(rows, keys, hot_rows).drop("_ways"))
    return (
        rows.join(hot, keys, "left")
        .withColumn(BLOCK, F.when(F.col("_hot"), block_of(position, width)).otherwise(F.lit(0).cast("bigint")))
        .drop("_hot")
    )


def stitch(
    rows: DataFrame,
    keys: list[str],
    cut: Callable[[DataFrame], DataFrame],
    merge: list[Column],
    columns: list[str],
) -> DataFrame:
    """Find runs inside blocks and join those that block borders cut.

    `cut` turns rows into pieces, one per (keys, _block, _no), where number 0
    continues the last run of an earlier block. Keys of one block, nearly all,
    are done with that. Of the others only the first and the last piece of a
    block can belong to a longer run: at most two rows per block are regrouped.
    """
    whole = cut(rows.where(~F.col(MULTI))).select(*keys, *columns)
    last = F.max("_no").over(Window.partitionBy(*keys, BLOCK))
    marked = cut(rows.where(MULTI)).withColumn("_edge", (F.col("_no") == 0) | (F.col("_no") == last))
    inner = marked.where(~F.col("_edge")).select(*keys, *columns)
    runs = Window.partitionBy(*keys).orderBy(BLOCK, "_no").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        marked.where("_edge")
        .withColumn("_run", F.sum(F.when(F.col("_no") > 0, 1).otherwise(0)).over(runs))
        .groupBy(*keys, "_run")
        .agg(*merge)
        .select(*keys, *columns)
    )
    return whole.unionByName(inner).unionByName(edges)


def as_of(
    points: DataFrame, steps: DataFrame, keys: list[str], position: Column, at: Column, value: Column, width: int,
    asked_in: DataFrame | None = None, also: Column | None = None, packed: str | None = None,
) -> DataFrame:
    """`points` plus `_hit`, `value` of the last step at or before their position, and
    `_first`, that of their key's first step; null where there is none. `also` is a second
    position in the same block, and `_also` what is in force there.

    A merge: steps and points of a key lie in blocks of the axis, each block also
    gets what is in force where it begins, and one ordered pass over the block
    hands the value down. Points are shuffled once; a value reaches later blocks
    through one summary row per block. Null keys are a key of their own, null
    positions find nothing. Both inputs are read twice, so they should be stored; where
    the points are costly, `asked_in` may name keys and positions of at least the same blocks.
    With `packed`, an array of structs, a row of `points` holds many points of its `_block`; their fields,
    of which `position` and `also` are made as those of `_row`, become columns. They are shuffled as an array
    per field, which takes far fewer bytes than a row per point, and unrolled then.
    """
    here, lowest = [F.col(k) for k in keys], F.lit(-(2**63)).cast("bigint")
    names, fields = points.columns, [c for c in points.columns if c not in keys]
    if packed is not None:
        beside = [c for c in fields if c not in (BLOCK, packed)]
        one = points.schema[packed].dataType.elementType.names
        names = [*keys, *beside, *one]
        asked = points.select(
            *keys, BLOCK, *[F.col(packed)[c].alias(f"_each_{c}") for c in one], F.struct(F.lit(True).alias("_is"), *beside).alias("_beside"))
        asked_in = points.select(*keys, BLOCK)
    else:
        asked = points.select(*keys, block_of(position, width).alias(BLOCK), position.cast("bigint").alias("_at"), F.struct(F.lit(True).alias("_is"), *fields).alias("_row"),
                              *([] if also is None else [also.cast("bigint").alias("_at_also")]))
        asked_in = asked if asked_in is None else asked_in.select(*keys, block_of(position, width).alias(BLOCK))
    given = steps.select(*keys, block_of(at, width).alias(BLOCK), at.cast("bigint").alias("_at"), value.alias("_value"))
    cells = asked_in.select(*keys, BLOCK).distinct().unionByName(given, allowMissingColumns=True).groupBy(*keys, BLOCK).agg(
        F.max_by("_value", "_at").alias("_end"), F.min_by("_value", "_at").alias("_begin"))
    order = Window.partitionBy(*keys).orderBy(BLOCK)
    carried = cells.select(
        *here, BLOCK, lowest.alias("_at"),
        F.last("_end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_value"),
        F.first("_begin", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_first"))
    every = carried.unionByName(given, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    if packed is not None:
        each = [f"_each_{c}" for c in one]
        every = every.repartition(*keys, BLOCK).select("*", F.explode_outer(F.arrays_zip(*each)).alias("_one")).drop(*each)
        row = F.struct(*[F.col("_beside")[c].alias(c) for c in beside], *[F.col("_one")[f"_each_{c}"].alias(c) for c in one])
        every = every.select(*here, BLOCK, "_at", "_value", "_first", F.when(F.col("_one").isNotNull(), row).alias("_row"))
        here_only = lambda c: F.when(F.col("_row").isNotNull(), c.cast("bigint"))
        every = every.withColumns({"_at": F.coalesce("_at", here_only(position))} | ({} if also is None else {"_at_also": here_only(also)}))
    # At one position steps come before points: they have no row.
    merged = Window.partitionBy(*keys, BLOCK).orderBy(F.col("_at").asc_nulls_last(), F.col("_row").isNotNull())
    so_far = merged.rowsBetween(Window.unboundedPreceding, 0)
    columns = [F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in names]
    seen = every.withColumns({
        "_hit": F.last("_value", ignorenulls=True).over(so_far), "_first": F.first("_first", ignorenulls=True).over(so_far)})
    results = {"_hit": F.col("_hit"), "_first": F.col("_first")}
    if also is not None:  # the same block in the order of the other position: sorted again, not shuffled
        second = F.coalesce("_at_also", F.when(F.col("_row").isNull(), F.col("_at")))
        again = Window.partitionBy(*keys, BLOCK).orderBy(second.asc_nulls_last(), F.col("_row").isNotNull())
        last = F.last("_value", ignorenulls=True).over(again.rowsBetween(Window.unboundedPreceding, 0))
        seen = seen.withColumn("_also", last)
        results["_also"] = F.when(F.col("_at_also").isNotNull(), F.col("_also"))
    known = F.col("_at").isNotNull()
    return seen.where(F.col("_row").isNotNull()).select(
        *columns, *[F.when(known, c).alias(name) for name, c in results.items()])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    salts: int = 2,
    count_in: DataFrame | None = None,
) -> DataFrame:
    """Equi-join with a table that has few rows per key, safe for hot left keys.

    Rows of a hot key are spread in as many ways as its count asks for, at least `salts`, and only the
    matching right rows are copied that often; all other keys join as usual. Left rows
    with a null key meet nothing and are spread as well. Spark still
    broadcasts the right side by itself when its measured size allows it.
    `spread_by` names columns that tell the rows of a key apart. Hot keys are
    counted in `count_in` (default: `left`), which should be cheap to compute
    and may count a key too often, never too rarely.
    """
    hot = hot_keys(left if count_in is None else count_in, keys, hot_rows).withColumn(
        "_ways", F.greatest(F.col("_ways"), F.lit(salts).cast("bigint"))).drop("_hot")
    unmet = F.lit(False)
    for key in keys:
        unmet = unmet | F.col(key).isNull()
    spread = F.xxhash64(*spread_by)
    salted_left = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(unmet, spread).otherwise(F.pmod(spread, F.coalesce("_ways", F.lit(1).cast("bigint")))))
        .drop("_ways")
    )
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_ways", F.lit(1).cast("bigint")) - 1)
    salted_right = (
        right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(copies)).drop("_ways")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
