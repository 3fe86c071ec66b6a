"""Alignment of two tokenizers over the bytes of each text.

Tokenizer A is a byte-level BPE of `tokenizers`, B a SentencePiece model. Their
own spans are coarse cuts: character offsets of A, byte spans of B's proto. A
span that several tokens share (a character cut by A, or spelt by B in byte
tokens) is refined by the bytes that the tokens decode to, and joined bytes
must be the text.

Both tokenizers break before a single space between two visible characters, so
a text is a row of chunks cut there. A Python worker aligns a chunk once and
keeps the result; chunks are encoded in joined texts of some tens of kilobytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueweave.llm.common import pack, process_state, slices, stored, unpack

#: Text bytes per shard, within which pairs of a document's tokens are counted before Spark sums them.
SHARD_BYTES = 12 << 20

#: Text bytes that are looked up together, and that one encoding call gets.
STEP_BYTES, CALL_BYTES = 2 << 20, 1 << 15

#: Chunks that a worker keeps; when there are more, those met only once go.
KEPT_CHUNKS = 600_000

TURN_BITS = 20

_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def chunks(text: str) -> list[str]:
    """The text cut at single spaces between visible characters (the spaces go)."""
    plain = text.split(" ")
    if "" not in plain and not any(b in text and (f"{b} " in text or f" {b}" in text) for b in _BLANKS):
        return plain  # no space has a blank beside it
    return _CUT.split(text)


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        letters = _byte_letters()
        self.bytes_a = [bytes(letters.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(size_a)]
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in b], np.int64) for b in (self.bytes_a, self.bytes_b))
        #: Does B break before every space that follows something else?
        self.breaks = not any("▁" in p.lstrip("▁") for p in pieces)
        texts = [f"{i}{end}" for size in (size_a, self.size_b) for i in range(size) for end in (",", "|", ";")]
        self.ids_text = pa.array(texts, pa.binary())
        self.b_text = 3 * size_a

    def encode_a(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends in bytes) of a text."""
        found = self.a.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        spans = np.array(found.offsets, np.int64).reshape(-1, 2)
        if len(text) == len(text.encode()):
            at = spans
        else:
            width = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            width = 1 + (width > 0x7F) + (width > 0x7FF) + (width > 0xFFFF)
            at = np.concatenate(([0], np.cumsum(width)))[spans]
        return ids, refined(at[:, 0], at[:, 1], self.len_a[ids])

    def encode_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends in bytes) of a text; B puts a space before it, which counts."""
        pieces = self.b.encode(text, return_type="proto").pieces
        found = np.array([(p.id, p.begin, p.end) for p in pieces], np.int64).reshape(-1, 3)
        # The space that B adds has no place in its spans: everything lies one byte further.
        starts = found[:, 1] + 1
        if len(starts):
            starts[0] = 0
        return found[:, 0], refined(starts, found[:, 2] + 1, self.len_b[found[:, 0]])

    def fits(self, ids: np.ndarray, table: list[bytes], text: bytes) -> bool:
        return b"".join([table[i] for i in ids.tolist()]) == text


def _byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def refined(starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse spans: where the next span begins no earlier than
    one ends, that end is a cut, unless the span is empty (a byte token of a character that
    its last byte token is given); between two cuts the decoded lengths count."""
    if not len(ends):
        return ends
    cut = np.append(starts[1:] >= ends[:-1], True) & (ends > starts)
    summed = np.cumsum(lengths)
    # How far sums and cuts are apart at the last cut before each token.
    last = np.maximum.accumulate(np.where(cut, np.arange(len(ends)), -1))
    before = np.concatenate(([-1], last[:-1]))
    drift = np.where(before >= 0, ends[before] - summed[before], 0)
    return np.where(cut, ends, summed + drift)


class _Places(dict):
    """Numbers strings as they come; `new` lists those not seen before."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = place = len(self)
        return place


class Aligned:
    """Chunks met so far, with counts, text of groups, and links of each."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.place = _Places()
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.good = np.zeros(0, bool)
        self.met = np.zeros(0, np.int64)
        self.text = pa.array([], pa.large_binary())
        self.links = np.zeros(0, np.int64)  # a * size_b + b, chunk after chunk

    def codes(self, texts: list[list[str]]) -> np.ndarray:
        """Places of the chunks of all texts; new ones are aligned."""
        if len(self.place) > KEPT_CHUNKS:
            self._forget()
        codes = np.fromiter(map(self.place.__getitem__, chain.from_iterable(texts)), np.int64)
        new, self.place.new = self.place.new, []
        if new:
            self._learn(new)
        self.met += np.bincount(codes, minlength=len(self.met))
        return codes

    def _forget(self) -> None:
        keep = self.met > 1
        links = np.repeat(keep, self.counts[:, 3])
        names = [c for c, k in zip(self.place, keep) if k]  # in the order of places
        self.place.clear()
        self.place.update((c, i) for i, c in enumerate(names))
        self.text = self.text.filter(pa.array(keep))
        self.counts, self.good, self.links = self.counts[keep], self.good[keep], self.links[links]
        self.met = np.where(self.met[keep] > 8, self.met[keep] // 2, 1)

    def _learn(self, new: list[str]) -> None:
        parts, held, size = [], [], 0
        for c in new:
            blank = not c or c[0].isspace() or c[-1].isspace()
            if held and (blank or size > CALL_BYTES):
                parts += self._aligned(held)
                held, size = [], 0
            if blank:
                parts += self._aligned([c])
            else:
                held.append(c)
                size += len(c)
        if held:
            parts += self._aligned(held)
        counts, good, text, links = zip(*parts)
        self.counts = np.concatenate((self.counts, *counts))
        self.good = np.concatenate((self.good, *good))
        self.met = np.append(self.met, np.zeros(len(new), np.int64))
        self.text = pa.concat_arrays([self.text, *text])
        self.links = np.concatenate((self.links, *links))

    def _aligned(self, parts: list[str]) -> list[tuple]:
        """Counts, soundness, group texts and links of chunks, encoded as one text; one
        whose bytes a tokenizer does not give back is sought by halves."""
        pair, n = self.pair, len(parts)
        text = " ".join(parts)
        whole = b" " + text.encode()
        a, ends_a = pair.encode_a(" " + text)
        b, ends_b = pair.encode_b(text)
        if not text or not (pair.fits(a, pair.bytes_a, whole) and pair.fits(b, pair.bytes_b, whole)):
            if n > 1:
                return self._aligned(parts[:n // 2]) + self._aligned(parts[n // 2:])
            return [(np.zeros((1, 4), np.int64), np.zeros(1, bool), pa.array([b""], pa.large_binary()), np.zeros(0, np.int64))]
        sizes = np.array([1 + len(p.encode()) for p in parts], np.int64)
        limit = np.cumsum(sizes)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        both = np.union1d(ends_a, ends_b)  # one link ends at each
        link = a[np.searchsorted(ends_a, both)] * pair.size_b + b[np.searchsorted(ends_b, both)]
        of = [np.searchsorted(limit, x) for x in (ends_a, ends_b, common, both)]
        counts = np.stack([np.bincount(x, minlength=n) for x in of], 1)
        # Elements in order: a group's tokens of A, then those of B, each with what follows it.
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        before_b = np.concatenate(([0], np.cumsum(in_b)))
        element = np.empty(len(a) + len(b), np.int64)
        chunk = np.empty(len(element), np.int64)
        at_a = np.arange(len(a)) + before_b[group_a]
        at_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        element[at_a] = 3 * a + np.isin(np.arange(len(a)), np.cumsum(in_a) - 1)
        element[at_b] = pair.b_text + 3 * b + 2 * np.isin(np.arange(len(b)), np.cumsum(in_b) - 1)
        chunk[at_a], chunk[at_b] = of[0], of[1]
        spelt = pair.ids_text.take(pa.array(element))
        length = pc.binary_length(spelt).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.bincount(chunk, weights=length, minlength=n).astype(np.int64))
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [
            None, pa.py_buffer(np.concatenate(([0], ends))), spelt.buffers()[2]])
        return [(counts, np.ones(n, bool), joined, link)]


_SHARD = ("shard BIGINT, keys ARRAY<{key}>, n_a ARRAY<BIGINT>, n_b ARRAY<BIGINT>, n_groups ARRAY<BIGINT>, n_links ARRAY<BIGINT>, "
          "sha ARRAY<STRING>, n_pairs ARRAY<BIGINT>, places BINARY, times BINARY, pairs ARRAY<BIGINT>, counts ARRAY<BIGINT>")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    offset = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - offset, sizes)


def _documents(aligned: Aligned, texts: list[str | None]) -> dict[str, np.ndarray | list]:
    """Counts, digest and distinct links of each text."""
    cut = [(chunks(t) if aligned.pair.breaks else [t]) if t else [] for t in texts]
    codes = aligned.codes(cut)
    n = len(cut)
    owner = np.repeat(np.arange(n), [len(c) for c in cut])
    bad = np.bincount(owner, weights=~aligned.good[codes], minlength=n) > 0
    bad |= np.array([not c for c in cut], bool)
    use = ~bad[owner]
    codes, owner = codes[use], owner[use]
    counts = np.stack([np.bincount(owner, weights=aligned.counts[codes, k], minlength=n) for k in range(4)], 1).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    spelt = aligned.text.take(pa.array(codes))
    length = np.concatenate(([0], np.cumsum(pc.binary_length(spelt).to_numpy(zero_copy_only=False))))
    data = memoryview(spelt.buffers()[2] or b"")
    base = np.frombuffer(spelt.buffers()[1], np.int64)[spelt.offset] if len(spelt) else 0
    sha = ["" if bad[d] else hashlib.sha256(data[base + length[first[d]]:base + length[first[d + 1]] - 1]).hexdigest() for d in range(n)]
    starts = np.cumsum(aligned.counts[:, 3]) - aligned.counts[:, 3]
    sizes = aligned.counts[codes, 3]
    link = aligned.links[_spread(starts[codes], sizes)]
    key, times = np.unique(np.repeat(owner, sizes) << 40 | link, return_counts=True)
    return {"counts": counts, "sha": sha, "n_pairs": np.bincount(key >> 40, minlength=n), "pair": key & (1 << 40) - 1, "times": times}


def _shards(path_a: str, path_b: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = process_state(("aligned", path_a, path_b), lambda: Aligned(Pair(path_a, path_b)))
        task, turn, size, keys, parts = TaskContext.get().partitionId(), 0, 0, [], []

        def shard() -> pa.RecordBatch:
            get = lambda k: np.concatenate([p[k] for p in parts])
            pairs, place, counts = np.unique(get("pair"), return_inverse=True, return_counts=True)
            n_pairs = get("n_pairs")
            start = np.zeros(len(place), np.int64)
            start[(np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]] = 1
            steps = np.diff(place, prepend=0)  # places rise within a document
            steps[start > 0] = place[start > 0]
            if turn >> TURN_BITS:
                raise ValueError("too many shards in one task: read the documents in more partitions")
            four = get("counts")
            columns = [pa.array([task << TURN_BITS | turn]), pa.ListArray.from_arrays([0, sum(map(len, keys))], pa.concat_arrays(keys))]
            columns += [pa.array([four[:, k]], pa.list_(pa.int64())) for k in range(4)]
            columns += [pa.array([[s for p in parts for s in p["sha"]]]), pa.array([n_pairs], pa.list_(pa.int64())),
                        pa.array([pack(steps)]), pa.array([pack(get("times"))]),
                        pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for piece in slices(iter([batch]), "text", STEP_BYTES):
                parts.append(_documents(aligned, piece.column("text").to_pylist()))
                keys.append(piece.column("key"))
                size += piece.column("text").nbytes
                if size > SHARD_BYTES:
                    yield shard()
                    size, keys, parts, turn = 0, [], [], turn + 1
        if parts:
            yield shard()

    return run


def _summed(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: links that are their A token's best, and the sum of all links' counts."""
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                n_pairs = row["n_pairs"].values.to_numpy(zero_copy_only=False)
                steps, times = unpack(row["places"].as_py()), unpack(row["times"].as_py())
                sums = np.zeros((2, len(n_pairs)), np.int64)
                if len(steps):
                    offset = np.cumsum(n_pairs) - n_pairs
                    run_up = np.cumsum(steps)
                    first = np.repeat(offset, n_pairs)
                    place = run_up - run_up[first] + steps[first]
                    told = row["told"].values
                    order = told.field("place").to_numpy()
                    some = np.flatnonzero(n_pairs)
                    for k, name in enumerate(("best", "total")):
                        value = np.empty(len(order), np.int64)
                        value[order] = told.field(name).to_numpy(zero_copy_only=False)
                        sums[k, some] = np.add.reduceat(value[place] * times, offset[some])
                out = [row["keys"].values, *(row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")),
                       pa.array(sums[0]), pa.array(sums[1]), row["sha"].values]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256` per row of `docs`.

    A encodes a space and the text, B the text, to which it adds the space. Places
    where tokens of both end cut them into groups; tokens that share a byte are
    linked. A pair of ids counts the documents (rows) that hold it linked; a link is best
    if no pair of its A id counts more. Null and empty texts, and those that the bytes of
    either's tokens do not spell, have zeros and an empty digest. Rows with null or
    repeated keys are documents of their own; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = _SHARD.format(key=kind)
    names = [c.split(" ")[0] for c in schema.split(", ")]
    shards = stored(plain.mapInArrow(_shards(path_a, path_b, names), schema), "align-shards")
    entries = shards.select("shard", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "e")).select(
        "shard", F.col("place").cast("bigint").alias("place"), "e.pairs", "e.counts").toDF("shard", "place", "pair", "count")
    totals = stored(entries.withColumn("total", F.sum("count").over(Window.partitionBy("pair"))).withColumn(
        "a", F.expr(f"pair div {_size_b(path_b)}")).drop("count"), "align-totals")
    # One row per id of A: its vocabulary bounds what is broadcast.
    most = F.broadcast(totals.groupBy("a").agg(F.max("total").alias("most")))
    told = totals.join(most, "a").groupBy("shard").agg(F.collect_list(F.struct(
        "place", (F.col("total") == F.col("most")).cast("bigint").alias("best"), "total")).alias("told"))
    out = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kinds = [kind] + ["bigint"] * 6 + ["string"]
    rows = shards.drop("pairs", "counts").join(told, "shard", "left")
    return rows.mapInArrow(_summed(out), ", ".join(f"`{n}` {k}" for n, k in zip(out, kinds)))


def _size_b(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
