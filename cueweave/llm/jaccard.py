"""Exact Jaccard join of documents on word shingles, with set relations.

0. Sets that cannot be linked are left aside. A set may lack a few of its shingles
   in another one only, so that one with more shingles that no other set has is linked
   with nothing. Half of the shingles, chosen by hash, are counted: that finds fewer
   such shingles, never more.
1. Signatures make families. Two sets as similar as the threshold differ in at
   most `d` shingles, d from their sizes. If the shingles are dealt by hash into
   d + 1 + e classes, two such sets agree on e + 1 classes at least, hence on a
   class that is not empty, unless both have more than e empty classes (such
   sets emit those too). So every link lies within a family: documents joined
   by equal class contents. Families are found from hashes alone.
2. A family is joined exactly. Sets are ordered by size, index lists hold the
   sets of a shingle in that order. A list is skipped up to the first set that
   is long enough (block skipping by position). A set's overlaps with all sets
   before it are derived from those of the most similar set before it: only the
   lists of the shingles in which the two differ are read.
3. A family with more members than `BLOCK` is cut into blocks; each pair of
   blocks is a task. Equal sets are one member throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import group_count, perhaps_in, slices, stored
from cueweave.llm.components import components

#: Members of a family that one task compares with each other (or with another such block).
BLOCK = 3000

_ODD = tuple(np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray, odd: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[odd]
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD[(odd + 1) % 6]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, set borders): the sorted distinct shingle hashes of each text, one after the other.

    A-Z are lower-cased; words are runs without ASCII white space; a text of
    fewer than `k` words is one shingle, one without words none.
    """
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    data = [b"" if t is None else t.encode("utf-8").translate(lower) for t in texts]
    buffer = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    ends_of_text = np.cumsum([len(d) + 1 for d in data]) if data else np.zeros(0, np.int64)
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    inside = ~blank[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    # Polynomial hashes of the words from one running sum of letter * base ** position.
    n = len(buffer)
    letters = mixed(np.arange(1, 257, dtype=np.uint64), 2) | np.uint64(1)
    base = int(_ODD[3])
    inverse = pow(base, -1, 1 << 64)
    power, back = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    power[0] = back[0] = 1
    power[1:], back[1:] = np.uint64(base), np.uint64(inverse)
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[buffer] * power[:-1], out=total[1:])
    words = mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _ODD[4])
    first = np.searchsorted(start, np.concatenate([[0], ends_of_text])) if len(data) else np.zeros(1, np.int64)
    counts = np.diff(first)
    sums = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        sums += words[i : i + len(sums)] * _ODD[i % 6] if i < 6 else mixed(words[i : i + len(sums)] + np.uint64(i))
    # A window belongs to a text if it ends there as well; short texts add their own.
    text_of = np.repeat(np.arange(len(data)), counts)
    whole = text_of[: len(sums)] == text_of[k - 1 :] if len(sums) else np.zeros(0, bool)
    owner, value = text_of[: len(sums)][whole], mixed(sums[whole], 1)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = []
        for t in short:
            h = np.array([counts[t]], np.uint64)
            for w in range(first[t], first[t + 1]):
                h = mixed(h + words[w : w + 1], 3)
            own.append(h[0])
        owner, value = np.concatenate([owner, short]), np.concatenate([value, np.array(own, np.uint64)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(data) + 1))


def prints(hashes: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; 0 for an empty one."""
    out = []
    for odd in (1, 4):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes, odd), dtype=np.uint64)])
        out.append(total[border[1:]] - total[border[:-1]])
    return out[0], out[1]


class Levels:
    """Sizes in levels such that similar sets are in the same or neighbouring ones.

    The threshold is `share` percent: a link needs 100 * shared >= share * united.
    """

    def __init__(self, share: int):
        self.share, self.starts = share, [1]

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * 100 // self.share + 1)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def classes(self, level: int) -> tuple[int, int]:
        """(classes, empty ones allowed) for sets of this level and the next."""
        while len(self.starts) < level + 3:
            self.starts.append(self.starts[-1] * 100 // self.share + 1)
        longest = self.starts[level + 2] - 1
        # 100 s >= share (S - s) with S the sum of sizes: the sets differ in S - 2 s shingles.
        apart = 2 * longest * (100 - self.share) // (100 + self.share)
        if not apart:
            return 1, 0
        per_class = self.starts[level] / (apart + 1)
        spare = 1 + int(1.5 * apart * np.exp(-per_class))
        return apart + 1 + spare, spare


def signatures(values: np.ndarray, levels: Levels) -> np.ndarray:
    """Hashes of the class contents of one set (sorted hashes), for its level and the one before."""
    level = levels.of(len(values))
    out = []
    spread = mixed(values, 5)
    for t in {level, max(0, level - 1)}:
        m, spare = levels.classes(t)
        group = ((values >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as the hashes are
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        own = np.array([t + 1], np.uint64) * _ODD[2]
        kinds = group[cut] * _ODD[0] + own
        out.append(mixed(np.add.reduceat(spread, cut) + kinds, 3))
        if m - len(cut) > spare:
            missing = np.setdiff1d(np.arange(m, dtype=np.uint64), group[cut], assume_unique=True)
            out.append(mixed(missing * _ODD[0] + own + _ODD[5], 4))
    return np.concatenate(out)


def probes(values: np.ndarray) -> np.ndarray:
    """Which shingles are counted to tell the sets that cannot be linked."""
    return values & np.uint64(1) == 0


def _met(node: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, how many of its shingles another node has too), for nodes that have such."""
    order = np.lexsort((node, shingle))
    node, shingle = node[order], shingle[order]
    new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])])
    node, shingle = node[new], shingle[new]
    same = shingle[1:] == shingle[:-1]
    return np.unique(node[np.concatenate([[False], same]) | np.concatenate([same, [False]])], return_counts=True)


def links(sets: list[np.ndarray], share: int, first: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(i, linked sets before i) for sets in order of size, exactly.

    With `first` > 0 only links between one of the first sets and one of the
    others are given; sets must then be ordered by size within both parts.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    # Shingles of one set alone cannot be shared; sets with too few others cannot be linked.
    alive = np.ones(m, bool)
    while True:
        use = alive[owner]
        df = np.bincount(at[use], minlength=len(token))
        shared = np.bincount(owner[use & (df[at] > 1)], minlength=m)
        still = alive & (100 * shared >= share * sizes)
        if (still == alive).all():
            break
        alive = still
    use = alive[owner] & (df[at] > 1)
    at, owner = at[use], owner[use]
    by = np.argsort(at, kind="stable")  # index lists: the sets of a shingle, in order
    lists, begin = owner[by], np.searchsorted(at[by], np.arange(len(token) + 1))
    border = np.searchsorted(owner, np.arange(m + 1))
    overlap = np.zeros((m, m), np.int32)

    def read(tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of the shingles' lists name each set of [low, high)."""
        start, stop = begin[tokens], begin[tokens + 1]
        length = stop - start
        where = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        named = lists[where]
        named = named[(named >= low) & (named < high)]
        return np.bincount(named - low, minlength=high - low)

    for i in np.flatnonzero(alive):
        mine = at[border[i] : border[i + 1]]
        overlap[i, i] = len(mine)
        if i == 0:
            continue
        # Sets before position `low` are too short; their part of every list is skipped.
        low = 0 if first else int(np.searchsorted(sizes, -(-share * sizes[i] // 100)))
        probe = mine[:: max(1, len(mine) // 8)][:8]
        votes = read(probe, low, i)
        parent = low + int(votes.argmax()) if len(votes) else -1
        counted = None
        if parent >= 0 and votes[parent - low]:
            theirs = at[border[parent] : border[parent + 1]]
            gone, new = np.setdiff1d(theirs, mine, assume_unique=True), np.setdiff1d(mine, theirs, assume_unique=True)
            if len(gone) + len(new) < len(mine):
                counted = overlap[parent, low:i] - read(gone, low, i) + read(new, low, i)
        if counted is None:
            counted = read(mine, low, i)
        overlap[i, low:i] = counted
        overlap[low:i, i] = counted
        other = np.arange(low, i)
        linked = (counted > 0) & (100 * counted >= share * (sizes[i] + sizes[low:i] - counted))
        if first:
            linked &= (other < first) & (i >= first)
        if linked.any():
            yield int(i), other[linked]


def similar(frame: DataFrame, k: int, share: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_shingles`, `component_id`, `n_links`, `text_hash` (xxhash64) per row; links need 100 * shared >= share * united.

    A null or empty text, or one without words, has no shingles and is linked
    with nothing. `component_id` is the smallest key that links reach, the
    row's own included; null keys are linked by their text like others and
    never give the id, so it is null only where all reached keys are. Repeated
    rows are copies of each other. `n_links` counts the other rows linked. An
    empty table gives none. Other columns are not read.

    Shuffled are half of the shingles as 32-bit numbers (packed per task and bucket), a few
    numbers per row, and texts, signatures and sets of what may be linked.
    """
    spark = frame.sparkSession
    docs = frame.select(F.col(key).cast("bigint").alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    buckets = group_count(docs, "_text")
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets // 4))  # a probe takes 4 bytes
    levels = Levels(share)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2 << 20):
            values, border = shingle_sets(batch.column("_text").to_pylist(), k)
            f1, f2 = prints(values, border)
            probed = np.concatenate([[0], np.cumsum(probes(values), dtype=np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_hash"), pa.array(np.diff(border), pa.int64()), pa.array(np.diff(probed[border])),
                 pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))],
                ["_id", "_hash", "n", "probes", "f1", "f2"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2 << 20):
            values, border = shingle_sets(batch.column("_text").to_pylist(), k)
            f1, _ = prints(values, border)
            doc = np.repeat(np.arange(len(f1)), np.diff(border))
            use = probes(values)
            values, doc = values[use], doc[use]
            bucket = ((values >> np.uint64(32)) * np.uint64(wide) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, values, doc = bucket[order], (values[order] >> np.uint64(1)).astype(np.uint32), doc[order]
            cut = np.searchsorted(bucket, np.arange(wide + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cut)):
                some, count = np.unique(doc[cut[b] : cut[b + 1]], return_counts=True)
                rows.append((b, f1[some].tobytes(), count.astype(np.uint32).tobytes(), values[cut[b] : cut[b + 1]].tobytes()))
            if rows:
                b, *packed = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["bucket", "nodes", "counts", "probes"])

    def count(table: pa.Table) -> pa.Table:
        node, times, value = (np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
                              for name, kind in (("nodes", np.int64), ("counts", np.uint32), ("probes", np.uint32)))
        node, met = _met(np.repeat(node, times), value)
        # A set's shingles lie in as many buckets as it has shingles, so its counts travel packed, by groups of sets.
        group = ((node.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        node, met = node[order], met[order].astype(np.uint32)
        some, cut = np.unique(group[order], return_index=True)
        cut = [*cut.tolist(), len(node)]
        return pa.table({"g": pa.array(some, pa.int32()),
                         "nodes": pa.array([node[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                         "mets": pa.array([met[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        node, met = (np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
                     for name, kind in (("nodes", np.int64), ("mets", np.uint32)))
        node, which = np.unique(node, return_inverse=True)
        return pa.table({"f1": pa.array(node), "met": pa.array(np.bincount(which, met).astype(np.int64))})

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set", 4 << 20):
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("set").to_pylist()]
            f1 = batch.column("f1").to_numpy().view(np.uint64)
            each = [signatures(x, levels) for x in sets]
            node = np.repeat(f1, [len(x) for x in each])
            sign = np.concatenate(each)
            bucket = (sign % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, sign, node = bucket[order], sign[order], node[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(b, *_packed(sign[cut[b] : cut[b + 1]], node[cut[b] : cut[b + 1]])) for b in range(buckets) if cut[b] < cut[b + 1]]
            b, signs, nodes, which = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b, pa.int32()), *(pa.array(x, pa.binary()) for x in (signs, nodes, which))], ["bucket", "signs", "nodes", "which"])

    def meet(table: pa.Table) -> pa.Table:
        raw = lambda name, kind: [np.frombuffer(x, kind) for x in table[name].to_pylist()]
        node = np.concatenate([n[w] for n, w in zip(raw("nodes", np.uint64), raw("which", np.uint32))])
        sign = np.concatenate(raw("signs", np.uint64))
        return pa.table(dict(zip("ab", (pa.array(x.view(np.int64)) for x in _stars(sign, node)))))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2 << 20):
            values, border = shingle_sets(batch.column("_text").to_pylist(), k)
            f1, f2 = prints(values, border)
            own = (f1.view(np.int64) == batch.column("f1").to_numpy()) & (f2.view(np.int64) == batch.column("f2").to_numpy())
            keep = np.flatnonzero(own)
            sets = [values[border[d] : border[d + 1]].tobytes() for d in keep]
            some = batch.take(pa.array(keep))
            names = ["f1", "member", "copies"]
            yield pa.RecordBatch.from_arrays([*(some.column(n) for n in names), pa.array(sets, pa.binary())], [*names, "set"])

    rows = stored(docs.mapInArrow(describe, "_id bigint, _hash bigint, n bigint, probes bigint, f1 bigint, f2 bigint"), "sets")
    # One member per distinct set.
    members = rows.where("n > 0").groupBy("f1", "f2").agg(
        F.min("_id").alias("_rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("probes").alias("probes"))
    met = docs.mapInArrow(probe, "bucket int, nodes binary, counts binary, probes binary").groupBy("bucket").applyInArrow(
        count, "g int, nodes binary, mets binary").groupBy("g").applyInArrow(total, "f1 bigint, met bigint")
    lacking = F.col("probes") - F.coalesce("met", F.lit(0))
    members = members.join(met, "f1", "left").select(
        "f1", "f2", "_rep", "copies", (100 * lacking <= (100 - share) * F.col("n")).alias("near"))
    members = stored(members.withColumn("member", F.monotonically_increasing_id()), "members")

    # The sets that may be linked, and families of those that share a signature with another.
    near = members.where("near").drop("near")
    some = perhaps_in(docs.drop("_hash"), F.xxhash64("_id"), near, F.xxhash64("_rep")).where("_perhaps").drop("_perhaps")
    sets = stored(some.hint("shuffle_hash").join(near.hint("shuffle_hash"), some["_id"].eqNullSafe(near["_rep"])).mapInArrow(
        fetch, "f1 bigint, member bigint, copies bigint, set binary"), "near")
    signed = sets.mapInArrow(sign, "bucket int, signs binary, nodes binary, which binary")
    edges = stored(signed.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint"), "edges")  # read twice below
    family = stored(components(edges).withColumnRenamed("node", "f1"), "families")
    inside = near.join(family, "f1")
    blocks = inside.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    inside = inside.join(blocks, "root").select(
        "root", "blocks", F.pmod(F.xxhash64("f1", "f2"), F.col("blocks")).alias("block"), "member")
    sets = sets.drop("f1").join(inside, "member")
    # A family of one block shares a task with others; of several, each pair of blocks has its own.
    one = F.col("blocks") == 1
    sets = sets.withColumn("other", F.explode(F.when(one, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    sets = sets.withColumn("task", F.when(one, F.concat(F.lit("b"), F.pmod(F.xxhash64("root"), F.lit(buckets)))).otherwise(
        F.concat_ws(":", "root", low, high))).withColumn("half", F.when(low == high, -1).otherwise((F.col("block") == high).cast("int")))

    def join(table: pa.Table) -> pa.Table:
        frame = table.select(["root", "member", "copies", "half"]).to_pandas()
        frame["set"] = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        frame["size"] = [len(s) for s in frame["set"]]
        frame = frame.drop_duplicates(["root", "member"]).sort_values(["root", "half", "size", "member"])
        member, to, degrees = [], [], []
        for _, part in frame.groupby("root", sort=False):
            first = int((part["half"] == 0).sum())  # two blocks: links across only
            if len(part) < 2 or part["half"].max() >= 0 and first in (0, len(part)):
                continue
            copies = part["copies"].to_numpy()
            comp, degree = np.arange(len(part)), np.zeros(len(part), np.int64)
            for i, linked in links(list(part["set"]), share, first):
                degree[i] += copies[linked].sum()
                degree[linked] += copies[i]
                joined = np.unique(np.append(comp[linked], comp[i]))
                comp[np.isin(comp, joined)] = joined[0]
            hit, names = np.flatnonzero(degree), part["member"].to_numpy()
            member.append(names[hit]), to.append(names[comp[hit]]), degrees.append(degree[hit])
        return pa.table({n: pa.array(np.concatenate([*x, np.zeros(0, np.int64)]), pa.int64())
                         for n, x in (("member", member), ("to", to), ("links", degrees))})

    found = stored(sets.select("task", "half", "root", "member", "copies", "set").groupBy("task").applyInArrow(
        join, "member bigint, to bigint, links bigint"), "links")
    named = components(found.select(F.col("member").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "member")
    degree = found.groupBy("member").agg(F.sum("links").alias("links"))
    known = members.join(named, "member", "left").join(degree, "member", "left").select(
        "f1", "f2", "_rep", F.coalesce("root", "member").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    least = known.groupBy("root").agg(F.min("_rep").alias("least"))
    known = stored(known.join(least, "root").select("f1", "f2", "least", "links"), "known")
    return rows.join(known, ["f1", "f2"], "left").select(
        F.col("_id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("links")).otherwise(F.lit(0)).alias("n_links"), F.col("_hash").alias("text_hash"))


def _packed(sign: np.ndarray, node: np.ndarray) -> tuple[bytes, bytes, bytes]:
    nodes, which = np.unique(node, return_inverse=True)
    return sign.tobytes(), nodes.tobytes(), which.astype(np.uint32).tobytes()


def _stars(sign: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smaller node of the same group): the nodes of equal signatures, grouped within this bucket."""
    order = np.lexsort((node, sign))
    sign, node = sign[order], node[order]
    cut = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
    lead = np.repeat(node[cut], np.diff(np.append(cut, len(sign))))
    use = lead != node
    pairs = np.unique(np.stack([node[use], lead[use]]), axis=1)
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(pairs.shape)
    root = np.arange(len(nodes))
    while len(a):  # minima along the edges, then along the trees, until nothing moves
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (before == root).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]
