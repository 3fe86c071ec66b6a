"""Shards of near equal bytes: best-fit-decreasing bin packing of indivisible groups.

Equal texts are one group and stay together. Groups go, largest first, into the
shard whose remaining capacity is the tightest that holds them; a balanced tree
keeps the shards by remaining capacity. With a given number of shards the
smallest capacity is sought for which that many suffice.

Groups of one size are interchangeable, so the packing runs on the histogram of
group sizes: `d` distinct sizes need at least d * d / 2 bytes of text, which
bounds the histogram by sqrt(2 * bytes), 14 million entries for 100 TB. The
groups themselves are numbered and placed by Spark.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueweave.llm.common import stored

#: Bytes that a row counts besides those of its text.
ROW_BYTES = 8

#: Rows or groups that one block of a numbering holds.
BLOCK_ROWS = 4096

#: A group with more than this share of the rows is looked up by broadcast; at
#: most as many groups as the share's denominator can have it.
HOT_SHARE = 4096


class Tree:
    """A balanced search tree (treap) of keys: add, remove, least key at or above a bound.

    Priorities come from a fixed multiplicative sequence, so a plan is the same each time.
    """

    def __init__(self) -> None:
        self.root = None
        self.drawn = 1

    def _split(self, node, key):
        """(keys below `key`, the others); nodes are [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key) -> None:
        self.drawn = self.drawn * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.drawn >> 16, None, None]), right)

    def take_at_least(self, key):
        """Remove and give the least key >= `key`; None if there is none."""
        node, parent, found, above = self.root, None, None, None
        while node is not None:
            if node[0] >= key:
                found, above = node, parent
                parent, node = (node, 2), node[2]
            else:
                parent, node = (node, 3), node[3]
        if found is None:
            return None
        below = self._merge(found[2], found[3])
        if above is None:
            self.root = below
        else:
            above[0][above[1]] = below
        return found[0]


def best_fit_decreasing(sizes: list[int], counts: list[int], capacity: int, most: int | None = None):
    """(number of bins, [(size, first, bin, copies)]): of the groups of `size`, those
    numbered from `first` on go to `bin`. None if more than `most` bins are needed.

    `sizes` fall and are at most `capacity`. Every stop at a bin that does not use up
    a size more than halves the bin's room, so the plan has at most
    `len(sizes) + bins * log2(capacity)` lines.
    """
    bins, plan, room = 0, [], Tree()
    for size, count in zip(sizes, counts):
        first = 0
        while first < count:
            spot = room.take_at_least((size, -1))
            if spot is None:
                if bins == most:
                    return None
                spot, bins = (capacity, bins), bins + 1
            copies = min(count - first, spot[0] // size)
            plan.append((size, first, spot[1], copies))
            first += copies
            if spot[0] > copies * size:
                room.add((spot[0] - copies * size, spot[1]))
    return bins, plan


def fill_capacity(sizes: list[int], counts: list[int], capacity: int):
    """Plan of as few shards of `capacity` as best fit finds; a larger group has a shard of its own."""
    plan, bins = [], 0
    large = 0
    while large < len(sizes) and sizes[large] > capacity:
        plan += [(sizes[large], i, bins + i, 1) for i in range(counts[large])]
        bins += counts[large]
        large += 1
    more, rest = best_fit_decreasing(sizes[large:], counts[large:], capacity)
    return bins + more, plan + [(s, f, b + bins, c) for s, f, b, c in rest]


def fill_count(sizes: list[int], counts: list[int], bins: int):
    """Plan of `bins` shards of the smallest capacity for which best fit needs no more of them.

    A group above the mean of what is left has a shard of its own, since nothing can
    be gained by adding to it. The capacity is sought from the mean upwards; mean plus
    largest group always suffices.
    """
    plan, total, used = [], sum(s * c for s, c in zip(sizes, counts)), 0
    sizes, counts, taken = list(sizes), list(counts), 0
    while sizes and bins - used > 1 and sizes[0] * (bins - used) > total:
        plan.append((sizes[0], taken, used, 1))
        total, used, taken = total - sizes[0], used + 1, taken + 1
        if taken == counts[0]:
            sizes, counts, taken = sizes[1:], counts[1:], 0
    left = bins - used
    if not sizes:
        return bins, plan
    counts[0] -= taken
    low = max(math.ceil(total / left), sizes[0])
    gap, short = 0, -1
    while (found := best_fit_decreasing(sizes, counts, low + gap, left)) is None:
        gap, short = max(1, gap * 2), gap
    while gap - short > 1:
        middle = (gap + short) // 2
        better = best_fit_decreasing(sizes, counts, low + middle, left)
        gap, short, found = (middle, short, better) if better else (gap, middle, found)
    plan += [(s, f + (taken if s == sizes[0] else 0), b + used, c) for s, f, b, c in found[1]]
    return bins, plan


def shard(docs: DataFrame, count: int | None = None, capacity: int | None = None,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `size`, `text_crc32`, `shard`, `slot` for every row of `docs`.

    Give the number of shards (`count`) or the bytes one holds (`capacity`). A row's
    size is its UTF-8 bytes plus 8; null texts count as empty ones. Rows of equal
    text, repeated or null keys included, are one group and share a shard. Slots
    number the rows of a shard from 0 without gaps. An empty table gives no rows;
    other columns of `docs` are not read.
    """
    if (count is None) == (capacity is None):
        raise ValueError("give either the number of shards or their capacity")
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(
        F.col(key).alias("_key"), (F.octet_length(whole) + F.lit(ROW_BYTES)).cast("bigint").alias("_size"),
        F.crc32(whole).alias("_crc"), F.unhex(F.sha2(whole, 256)).alias("_text"),
        F.monotonically_increasing_id().alias("_at")), "shard-rows")
    groups = stored(rows.groupBy("_text").agg(F.count("*").alias("_n"), F.sum("_size").alias("_bytes")), "shard-groups")
    table = groups.groupBy("_bytes").agg(F.count("*").alias("_n")).toArrow().sort_by([("_bytes", "descending")])
    sizes, counts = table["_bytes"].to_pylist(), table["_n"].to_pylist()
    plan = (fill_count(sizes, counts, count) if capacity is None else fill_capacity(sizes, counts, capacity))[1]
    placed = stored(_placed(groups, _plan_frame(spark, plan)), "shard-placed")

    least = rows.count() // HOT_SHARE
    hot = F.broadcast(placed.where(F.col("_n") > least).select("_text", "_shard"))
    cold = placed.where(F.col("_n") <= least).select("_text", "_shard")
    known = rows.join(hot, "_text").unionByName(rows.join(hot, "_text", "left_anti").join(cold, "_text"))
    known = stored(known.select("_key", "_size", "_crc", "_shard", "_at",
                                F.floor(F.col("_at") / BLOCK_ROWS).alias("_block")), "shard-known")
    slots = _numbered(known, ["_shard"], "_at")
    return slots.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                        F.col("_shard").alias("shard"), F.col("_no").alias("slot"))


def _plan_frame(spark, plan: list[tuple]) -> DataFrame:
    names = ("_bytes", "_first", "_shard", "_copies")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
    table = pa.table({n: pa.array([p[i] for p in plan], k) for i, (n, k) in enumerate(zip(names, kinds))})
    if not plan:
        return spark.createDataFrame([], "_bytes BIGINT, _first BIGINT, _shard INT, _copies BIGINT")
    return stored(spark.createDataFrame(table), "shard-plan")


def _numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`rows` plus `_no`, their number within `keys` from 0: counts per `_block` give each
    block its first number, so that no task has to see a whole key."""
    cells = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    within = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order))
    return rows.join(cells, [*keys, "_block"]).withColumn("_no", (F.col("_base") + within - 1).cast("bigint"))


def _placed(groups: DataFrame, plan: DataFrame) -> DataFrame:
    """`_text`, `_n`, `_shard`: groups of a size are numbered and dealt out by its lines of the plan.

    Plan lines meet the counts per block of a size first, so a size that very many
    groups share is never one task's work.
    """
    blocks = groups.count() // BLOCK_ROWS + 1
    dealt = groups.withColumn("_block", F.pmod(F.xxhash64("_text"), F.lit(blocks)))
    cells = dealt.groupBy("_bytes", "_block").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_bytes").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    lines = plan.groupBy("_bytes").agg(F.collect_list(F.struct("_first", "_copies", "_shard")).alias("_lines"))
    meets = F.filter("_lines", lambda p: (p["_first"] < F.col("_base") + F.col("_rows"))
                     & (p["_first"] + p["_copies"] > F.col("_base")))
    cells = cells.join(lines, "_bytes").select("_bytes", "_block", "_base", meets.alias("_lines"))
    within = F.row_number().over(Window.partitionBy("_bytes", "_block").orderBy("_text"))
    numbered = dealt.join(cells, ["_bytes", "_block"]).withColumn("_no", F.col("_base") + within - 1)
    line = F.filter("_lines", lambda p: (p["_first"] <= F.col("_no")) & (p["_first"] + p["_copies"] > F.col("_no")))
    return numbered.select("_text", "_n", line[0]["_shard"].alias("_shard"))
