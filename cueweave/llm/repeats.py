"""Repeated passages: a multi-document suffix order, built by doubling.

Two equal strings of `width` bytes have the same smallest k-byte hash at the
same offset, their anchor. So:

1. Anchors of all texts are dealt by hash; those found in one document only are
   dropped. (Copies of a whole text are known by their digest beforehand.)
2. Around each anchor that is left, the bytes that a `width`-byte string with
   that anchor can hold are a short segment, dealt by anchor; equal segments
   are one, with the smallest document that has it. Anchors of very many
   documents are dealt by whole strings instead, which splits them.
3. The segments of neighbouring anchors are a collection. Its suffixes are
   put in order by their first bytes, twice as many each round. Those that
   still share a place by their first `width` bytes are equal strings; their
   smallest document decides.
4. The starts found go back to the documents' rows, which lie bucketed in the
   shared folder, so texts are shuffled once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import GROUP_BYTES, slices, stored
from cueweave.llm.jaccard import _ODD, mixed
from cueweave.session import scratch

K = 20
#: Groups of segments per group of texts.
FINER = 4
#: Occurrences beyond which an anchor is dealt by whole strings.
HOT = 8192
#: Segments that a collection gathers before it is sorted; an anchor is never cut.
COLLECTED = 4096
#: Bytes of text whose hashes are in memory at once; a text is never cut.
HASHED = 512 << 10
#: The bits of an anchor's hash that travel.
LOW = np.uint64((1 << 48) - 1)
LAST = np.iinfo(np.int64).max


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string, by doubling."""
    power, size, at, done, out = int(_ODD[3]), 1, 0, 0, None
    h = mixed(data.astype(np.uint64) + np.uint64(1))
    need = k
    while True:
        if need & 1:
            if out is None:
                out, done = h, size
            else:
                n = len(data) - done - size + 1
                out = out[:n] * np.uint64(pow(power, size, 1 << 64)) + h[done : done + n]
                done += size
        need >>= 1
        if not need:
            return mixed(out, 1)
        n = max(0, len(h) - size)
        h = h[:n] * np.uint64(pow(power, size, 1 << 64)) + h[size : size + n]
        size *= 2


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    size = 1
    n = len(values) - width + 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:n], values[width - size : width - size + n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, text number) of every position that is the smallest of some `width`-byte string of a text."""
    none = np.zeros(0, np.int64)
    found, first = [(none.astype(np.uint64), none, none)], 0
    while first < len(starts):
        stop = max(first + 1, int(np.searchsorted(ends, starts[first] + HASHED, "right")))
        base = starts[first]
        h, at, doc = _anchors(data[base : ends[stop - 1]], starts[first:stop] - base, ends[first:stop] - base, width, k)
        found.append((h, at + base, doc + first))
        first = stop
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none.astype(np.uint64), none, none
    h = window_hashes(data, k)
    w = width - k + 1
    low = _sliding(h, w, np.minimum)  # of the string that starts here
    own = np.zeros(len(low), bool)
    for a, b in zip(starts, ends):
        if b - a >= width:
            own[a : b - width + 1] = True
    low = np.where(own, low, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(len(h) - len(low), np.uint64)])
    # The greatest of the minima around a position is its own hash exactly if it is some string's minimum.
    at = np.flatnonzero((_sliding(padded, w, np.maximum) == h))
    return h[at], at, np.searchsorted(starts, at, "right") - 1


def suffix_classes(data: np.ndarray, lengths: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Per segment and start: is the string of `width` bytes there in a segment of a smaller owner?

    `data` holds the segments one after the other. Suffixes are put in order by
    their first bytes, twice as many each round up to `width`: a suffix's place
    among those of `size` bytes and the place of the one that many bytes on
    give its place by both. Suffixes that share a place at the end share `width` bytes.
    """
    m, longest = len(lengths), int(lengths.max())
    end = np.cumsum(lengths)
    left = np.repeat(end, lengths) - np.arange(len(data))  # bytes from here to the segment's end
    place, places, size = data.astype(np.uint64), 256, 1
    at = np.arange(len(data))
    while size < width:
        step = min(size, width - size)
        if places * places > 1 << 64:
            place[at], places = _dense(place[at])
        size += step
        at = np.flatnonzero(left >= size)
        place[at] = place[at] * np.uint64(places) + place[at + step]
        places *= places
    which, places = _dense(place[at])
    segment = np.repeat(np.arange(m), lengths)[at]
    smallest = np.full(places, LAST, np.int64)
    np.minimum.at(smallest, which, owner[segment])
    out = np.zeros((m, max(longest - width + 1, 1)), bool)
    out[segment, at - (end - lengths)[segment]] = smallest[which] < owner[segment]
    return out


def _dense(values: np.ndarray) -> tuple[np.ndarray, int]:
    """The place of each value among the distinct ones, and their number."""
    some, which = np.unique(values, return_inverse=True)
    return which, len(some)


def _fields(*arrays: np.ndarray) -> bytes:
    """Arrays packed into one compressed value: their lengths in bytes first."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zlib.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts), 1)


def _unpacked(value: bytes, *kinds) -> list[np.ndarray]:
    data = zlib.decompress(value)
    sizes = np.frombuffer(data, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    return np.frombuffer(b"".join(texts), np.uint8), end - size, end


def _cut_by(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    return order, np.searchsorted(key[order], np.arange(n + 1))


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """One of `n` buckets by hash. Anchors are the smallest hashes around them, so they are mixed again."""
    return ((mixed(h, 3) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _parts(table: pa.Table, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    return slices(iter(table.to_batches()), "text", size)


def find(frame: DataFrame, width: int = 50, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (),
         whole: bool = False) -> DataFrame:
    """`key`, the `carry` columns, `n_bytes`, `n_removed`, `n_spans`, `kept` (binary) per row.

    Removed is each byte covered by a string of `width` bytes that also starts
    in a row with a smaller key. A null or empty text has no bytes; null keys
    count as greater than all others and as equal to each other; rows of equal
    keys take nothing from each other, so repeated rows give equal rows; an
    empty table gives none. Columns outside `carry` are not read. With `whole` a
    character goes only if all its bytes do, so `kept` is text again.
    """
    spark = frame.sparkSession
    least = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = frame.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(int(LAST))).alias("o"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
        F.struct(F.col(key).alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("row"))
    docs = docs.withColumn("digest", F.sha2("text", 256))
    rows = stored(docs.select("o", "digest", F.octet_length("text").cast("bigint").alias("n")), "digests")
    groups = max(least, -(-(rows.agg(F.sum("n")).first()[0] or 0) // GROUP_BYTES))
    # Segments around shared anchors can take more bytes than the texts and several arrays each.
    dealt_to = groups * FINER
    # A copy of a whole text is removed whole; the smallest key of each text stands for it.
    firsts = rows.groupBy("digest").agg(F.min("o").alias("o"))
    marks = firsts.select(F.xxhash64("o", "digest").alias("id")).withColumn("g", F.pmod("id", F.lit(groups)))
    docs = docs.select("o", "text", "row", F.xxhash64("o", "digest").alias("id")).withColumn("g", F.pmod("id", F.lit(groups)))

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        return left.append_column("first", pa.compute.is_in(left["id"], value_set=right["id"]))

    kind = docs.schema["row"].dataType.simpleString()
    marked = docs.select("o", "text", "row", "id", "g").groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(
        mark, f"o bigint, text binary, row {kind}, id bigint, g bigint, first boolean")
    name = f"cueweave_{uuid.uuid4().hex}"
    marked.write.bucketBy(groups, "g").option("path", scratch(spark, "texts")).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, start, end = _laid(batch.column("text").to_pylist())
            h, _, doc = anchors(data, start, end, width, K)
            o, g = batch.column("o").to_numpy(), batch.column("g").to_numpy()
            order, cut = _cut_by(_bucket(h & LOW, groups), groups)
            h, doc = h[order], doc[order]
            out = []
            for b in np.flatnonzero(np.diff(cut)):
                some, count = np.unique(doc[cut[b] : cut[b + 1]], return_counts=True)
                x = h[cut[b] : cut[b + 1]]
                out.append((b, _fields(o[some], g[some], count.astype(np.int32), x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint16))))
            if out:
                b, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(v, pa.binary())], ["bucket", "value"])

    def shared(table: pa.Table) -> pa.Table:
        """Of the anchors of a bucket those of several documents, back to their groups; bit 63: of very many."""
        parts = [_unpacked(v, np.int64, np.int64, np.int32, np.uint32, np.uint16) for v in table["value"].to_pylist()]
        o, g, count, low, high = (np.concatenate(x) for x in zip(*parts))
        h = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
        doc = np.repeat(np.arange(len(o)), count)
        order = np.argsort(h, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        owner = o[doc[order]]
        many = np.minimum.reduceat(owner, cut) < np.maximum.reduceat(owner, cut)
        size = np.diff(np.append(cut, len(h)))
        flag = np.where(many, h[order][cut] | np.where(size > HOT, np.uint64(1 << 63), np.uint64(0)), np.uint64(0))
        back = np.empty(len(h), np.uint64)
        back[order] = np.repeat(flag, size)
        use = np.repeat(many, size)
        pick = np.empty(len(h), bool)
        pick[order] = use
        h, doc = back[pick], doc[pick]
        order, _ = _cut_by(g[doc], 0)
        h, doc = h[order], doc[order]
        gs, at = np.unique(g[doc], return_index=True)
        values = []
        for a, b in zip(at, np.append(at[1:], len(h))):
            some, n = np.unique(doc[a:b], return_counts=True)
            by = np.argsort(doc[a:b], kind="stable")
            values.append(_fields(o[some], n.astype(np.int32), h[a:b][by]))
        return pa.table({"g": pa.array(gs, pa.int64()), "value": pa.array(values, pa.binary())})

    def segments(left: pa.Table, right: pa.Table) -> pa.Table:
        """Bytes around the shared anchors of a group's documents, dealt by anchor."""
        asked: dict[int, list[np.ndarray]] = {}
        for v in right["value"].to_pylist():
            o, n, h = _unpacked(v, np.int64, np.int32, np.uint64)
            at = np.cumsum(n)
            for x, a, b in zip(o.tolist(), at - n, at):
                asked.setdefault(x, []).append(h[a:b])
        out_b, out_v = [], []
        left = left.filter(left["first"]).combine_chunks()
        _, one = np.unique(left["id"].to_numpy(), return_index=True)  # repeated rows once
        for batch in _parts(left.take(pa.array(one))):
            o, ids, gs = (batch.column(c).to_numpy() for c in ("o", "id", "g"))
            data, start, end = _laid(batch.column("text").to_pylist())
            h, at, doc = anchors(data, start, end, width, K)
            cut = np.searchsorted(doc, np.arange(len(o) + 1))
            use, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
            for d in range(len(o)):
                if (mine := asked.get(int(o[d]))) is not None and cut[d] < cut[d + 1]:
                    mine = np.concatenate(mine)
                    x = h[cut[d] : cut[d + 1]] & LOW
                    use[cut[d] : cut[d + 1]] = np.isin(x, mine & LOW)
                    very = mine[mine >> np.uint64(63) > 0]
                    if len(very):
                        hot[cut[d] : cut[d + 1]] = np.isin(x, very & LOW)
            plain = use & ~hot
            a = np.maximum(at[plain] - (width - K), start[doc[plain]])
            z = np.minimum(at[plain] + width, end[doc[plain]])
            of, where = doc[plain], h[plain]
            if hot.any():  # every string with the anchor, by its own hash
                a1 = np.maximum(at[hot] - (width - K), start[doc[hot]])
                z1 = np.minimum(at[hot], end[doc[hot]] - width) + 1
                n = np.maximum(0, z1 - a1)
                s = np.repeat(a1 - np.cumsum(n) + n, n) + np.arange(n.sum())
                a, z, of = np.concatenate([a, s]), np.concatenate([z, s + width]), np.concatenate([of, np.repeat(doc[hot], n)])
                where = np.concatenate([where, window_hashes(data, width)[s]])
            order, cut = _cut_by(_bucket(where, dealt_to), dealt_to)
            for b in np.flatnonzero(np.diff(cut)):
                i = order[cut[b] : cut[b + 1]]
                size = z[i] - a[i]
                bytes_ = data[np.repeat(a[i] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                some, which = np.unique(of[i], return_inverse=True)
                out_b.append(b)
                out_v.append(_fields(o[some], ids[some], gs[some], which.astype(np.int32), (a[i] - start[of[i]]).astype(np.int32),
                                     size.astype(np.uint8), where[i], bytes_))
        return pa.table({"bucket": pa.array(out_b, pa.int32()), "value": pa.array(out_v, pa.binary())})

    def decide(table: pa.Table) -> pa.Table:
        """Starts of strings that a smaller document has too, back to the groups of their documents."""
        parts = [_unpacked(v, np.int64, np.int64, np.int64, np.int32, np.int32, np.uint8, np.uint64, np.uint8) for v in table["value"].to_pylist()]
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        o, ids, gs = (np.concatenate([p[i] for p in parts]) for i in range(3))
        doc = np.concatenate([p[3] + x for p, x in zip(parts, base)])
        pos, size, where, data = (np.concatenate([p[i] for p in parts]) for i in range(4, 8))
        del parts
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        # Equal segments of an anchor are one; two hashes of their bytes and the length tell them apart.
        padded = np.concatenate([data, np.zeros(1, np.uint8)])
        marks = []
        for odd in (2, 4):
            letters = mixed(np.arange(256, dtype=np.uint64), odd) | np.uint64(1)
            total = np.zeros(len(size), np.uint64)
            for c in range(int(size.max())):
                total = total * _ODD[odd + 1] + np.where(c < size, letters[padded[np.minimum(begin + c, len(data))]], np.uint64(0))
            marks.append(mixed(total + size.astype(np.uint64), odd))
        order = np.lexsort((o[doc], marks[1], marks[0], where))
        new = np.ones(len(order), bool)
        for x in (where, *marks):
            new[1:] &= x[order][1:] == x[order][:-1]
        new[1:] = ~new[1:]
        lead = order[new]  # the first of each, with its smallest document
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        owner, hashes = o[doc[lead]], where[lead]
        runs, at = [], 0  # (segment, first start, the start behind the last) of strings found elsewhere
        while at < len(lead):
            stop = min(at + COLLECTED, len(lead))
            stop = int(np.searchsorted(hashes, hashes[stop - 1], "right"))
            some = lead[at:stop]
            n = size[some]
            bytes_ = data[np.repeat(begin[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            part = suffix_classes(bytes_, n, owner[at:stop], width)
            edge = np.diff(np.pad(part.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, first = np.nonzero(edge == 1)
            runs.append((row + at, first, np.nonzero(edge == -1)[1]))
            at = stop
        least = owner[kind]
        later = o[doc] > least
        out_doc, out_start, out_count = [doc[later]], [pos[later]], [size[later] - width + 1]
        # The smallest document of a segment loses what an even smaller one has in another segment.
        row, first, last = (np.concatenate(x) for x in zip(*runs))
        begin = np.searchsorted(row, np.arange(len(lead) + 1))
        n = np.diff(begin)
        some = np.flatnonzero(~later & (n > 0)[kind])
        n = n[kind[some]]
        run = np.repeat(begin[kind[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        some = np.repeat(some, n)
        out_doc.append(doc[some]), out_start.append(pos[some] + first[run]), out_count.append(last[run] - first[run])
        doc, begin, count = (np.concatenate(x) for x in (out_doc, out_start, out_count))
        order = np.argsort(gs[doc], kind="stable")
        doc, begin, count = doc[order], begin[order], count[order]
        groups_, at = np.unique(gs[doc], return_index=True)
        values = [_fields(ids[doc[a:b]], begin[a:b].astype(np.int32), count[a:b].astype(np.int32))
                  for a, b in zip(at, np.append(at[1:], len(doc)))]
        return pa.table({"g": pa.array(groups_, pa.int64()), "value": pa.array(values, pa.binary())})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [_unpacked(v, np.int64, np.int32, np.int32) for v in right["value"].to_pylist()]
        ids, begin, count = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
        order = np.argsort(ids, kind="stable")
        ids, begin, count = ids[order], begin[order].astype(np.int64), count[order].astype(np.int64)
        out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept")}
        for batch in _parts(left):
            for value, own, first in zip(batch.column("text").to_pylist(), batch.column("id").to_pylist(), batch.column("first").to_pylist()):
                a, b = np.searchsorted(ids, [own, own + 1]) if first else (0, 0)
                removed, spans, kept = 0, 0, value
                if not first and len(value) >= width:
                    removed, spans, kept = len(value), 1, b""
                elif a < b:
                    depth = np.zeros(len(value) + 1, np.int64)
                    np.add.at(depth, begin[a:b], 1)
                    np.add.at(depth, begin[a:b] + count[a:b] - 1 + width, -1)
                    covered = np.cumsum(depth[:-1]) > 0
                    if whole:
                        letter = np.flatnonzero(np.frombuffer(value, np.uint8) & 0xC0 != 0x80)
                        covered = np.repeat(np.logical_and.reduceat(covered, letter), np.diff(np.append(letter, len(value))))
                    removed = int(covered.sum())
                    spans = int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())
                    kept = np.frombuffer(value, np.uint8)[~covered].tobytes()
                for n, x in zip(out, (len(value), removed, spans, kept)):
                    out[n].append(x)
        return pa.table([left["row"], *(pa.array(out[n], pa.binary() if n == "kept" else pa.int64()) for n in out)], ["row", *out])

    firsts = texts.where("first").select("o", "g", "text")
    replies = stored(firsts.mapInArrow(emit, "bucket int, value binary").groupBy("bucket").applyInArrow(shared, "g bigint, value binary"), "anchors")
    dealt = texts.select("o", "text", "id", "g", "first").groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(
        segments, "bucket int, value binary")
    starts = stored(dealt.groupBy("bucket").applyInArrow(decide, "g bigint, value binary"), "starts")
    found = texts.select("text", "row", "id", "first", "g").groupBy("g").cogroup(starts.groupBy("g")).applyInArrow(
        remove, f"row {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return found.select(F.col("row.k").alias(key), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)],
                        "n_bytes", "n_removed", "n_spans", "kept")
