"""Best-fit packing of documents into sequences, by bin completion.

Packing depends on lengths only, and there are at most `capacity` different
ones. So Spark counts pieces per length, the driver packs that histogram
(bounded by the capacity, whatever the corpus), and Spark places each piece by
its rank among pieces of its length. A plan is a list of patterns (one filling
of a sequence and how often it is used); each pattern uses up a length, so it
has no more patterns than there are lengths.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueweave.llm.bpe import packed
from cueweave.llm.common import process_state, slices, stored

#: Pieces of one length that are ranked in one task.
RANKED_TOGETHER = 50_000
#: Nodes that the branch-and-bound search may visit after its incumbents.
NODES = 200

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # times used, ((length, count), ...)


class FastTokenizer:
    """The ids that the tokenizers library gives, with default settings.

    Its own encoder takes several times the CPU time of a whole packing job.
    A byte-level file holds one token per merge, in the order of merging, so
    merging by rank gives the same ids; a compiled encoder for ranks does that.
    Strings of special tokens inside a text are that token, as in the library.
    """

    def __init__(self, content: str, pattern: str):
        import tiktoken

        spec = json.loads(content)
        model, stage = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or stage["type"] != "ByteLevel" or stage["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser or added space is needed")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(back[c] for c in token): n for token, n in model["vocab"].items() if token not in special}
        self.special = special
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return packed(self.encoding.encode(text, allowed_special="all"))
        return packed(self.encoding.encode_ordinary(text))


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level files: itself where it is
    a visible Latin-1 character, else the next unused one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {**{b: chr(b) for b in visible}, **{b: chr(0x100 + i) for i, b in enumerate(rest)}}


def cut(frame: DataFrame, tokenizer_path: str, pattern: str, capacity: int, end_id: int, key: str = "doc_id",
        text: str = "text") -> DataFrame:
    """Pieces of the tokenised documents: `key`, `piece`, `start`, `length`, `ids_crc32`.

    A document is its ids and then `end_id`; one longer than `capacity` is cut so
    that every piece but the first is full. A null text counts as empty.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        content = frame.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: 1.5 MB
    schema = f"`{key}` {dict(frame.dtypes)[key]}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = process_state(("fast", tokenizer_path, pattern), lambda: FastTokenizer(content.value, pattern))
        last = packed([end_id])
        for batch in slices(batches, text):
            row, piece, start, length, crc = [], [], [], [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                data = memoryview(tokenizer(value) + last)
                n = len(data) // 4
                at, stop = 0, (n - 1) % capacity + 1
                for k in range((n + capacity - 1) // capacity):
                    row.append(i), piece.append(k), start.append(at), length.append(stop - at)
                    crc.append(zlib.crc32(data[4 * at : 4 * stop]))
                    at, stop = stop, stop + capacity
            keys = batch.column(key).take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                [key, "piece", "start", "length", "ids_crc32"])

    return frame.select(key, text).mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """The incumbent: largest first, each gap filled with the largest that fits, many sequences at a time."""
    left, plan = dict(counts), []
    while left:
        room, filling = capacity, {}
        while (fits := [n for n in left if n <= room and left[n] > filling.get(n, 0)]):
            n = max(fits)
            k = min(room // n, left[n] - filling.get(n, 0))
            filling[n] = filling.get(n, 0) + k
            room -= k * n
        plan.append(_use(left, filling))
    return plan


def _use(left: dict[int, int], filling: dict[int, int]) -> Pattern:
    """Take the filling as often as the counts allow; that uses up a length."""
    times = min(left[n] // k for n, k in filling.items())
    for n, k in filling.items():
        left[n] -= times * k
        if not left[n]:
            del left[n]
    return times, tuple(sorted(filling.items(), reverse=True))


def fillings(left: dict[int, int], room: int, most: int = 6, steps: int = 400) -> list[dict[int, int]]:
    """Undominated fillings of the room beside the largest piece, the least waste first.

    A filling whose waste another length still left would fit into is dominated
    by the fuller one, and so is one that swaps a piece for several that fit in
    its place; so only full ones are listed and larger pieces are tried first.
    """
    lengths = sorted((n for n in left if n <= room), reverse=True)
    found: list[tuple[int, int, dict[int, int]]] = []
    if not lengths:
        return [{}]
    smallest, tried = lengths[-1], 0

    def extend(at: int, gap: int, chosen: dict[int, int]) -> None:
        nonlocal tried
        tried += 1
        if gap < smallest or all(n > gap or left[n] <= chosen.get(n, 0) for n in lengths[at:]):
            if not any(n <= gap and left[n] > chosen.get(n, 0) for n in lengths):
                found.append((gap, sum(chosen.values()), dict(chosen)))
            return
        for i in range(at, len(lengths)):
            n = lengths[i]
            if tried > steps or sum(1 for g, _, _ in found if g == 0) >= most:
                return
            if n <= gap and left[n] > chosen.get(n, 0):
                chosen[n] = chosen.get(n, 0) + 1
                extend(i, gap - n, chosen)
                chosen[n] -= 1
                if not chosen[n]:
                    del chosen[n]

    extend(0, room, {})
    found.sort(key=lambda x: x[:2])
    return [c for _, _, c in found[:most]] or [{}]


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """The fewest sequences found: bin completion, depth first, bounded by waste.

    The bound: sequences so far, plus what the rest needs if nothing of it is
    wasted. A branch that cannot beat the incumbent is left. `nodes` bounds the
    effort, not the pieces: every plan holds all of them.
    """
    counts = {n: k for n, k in counts.items() if k}
    best = best_fit(counts, capacity)
    fewest, total = sum(t for t, _ in best), sum(n * k for n, k in counts.items())
    least = -(-total // capacity)
    visited = 0

    def search(left: dict[int, int], rest: int, plan: list[Pattern], used: int) -> None:
        nonlocal best, fewest, visited
        while left:
            visited += 1
            if used - (-rest // capacity) >= fewest or visited > nodes:
                return
            largest = max(left)
            after = dict(left)
            after[largest] -= 1
            if not after[largest]:
                del after[largest]
            options = fillings(after, capacity - largest)
            for option in options[1:]:
                if fewest == least or visited > nodes:
                    break
                other = dict(left)
                pattern = _use(other, {**option, largest: option.get(largest, 0) + 1})
                search(other, rest - pattern[0] * sum(n * k for n, k in pattern[1]), [*plan, pattern], used + pattern[0])
            option = options[0]
            pattern = _use(left, {**option, largest: option.get(largest, 0) + 1})
            rest -= pattern[0] * sum(n * k for n, k in pattern[1])
            plan.append(pattern)
            used += pattern[0]
        if used < fewest:
            best, fewest = list(plan), used

    if fewest > least:
        # The greedy descent first: its fillings with the least waste make a second incumbent.
        left, plan = dict(counts), []
        while left:
            largest = max(left)
            after = {n: k - (n == largest) for n, k in left.items() if k > (n == largest)}
            option = fillings(after, capacity - largest)[0]
            plan.append(_use(left, {**option, largest: option.get(largest, 0) + 1}))
        if sum(t for t, _ in plan) < fewest:
            best, fewest = plan, sum(t for t, _ in plan)
    if fewest > least:
        import sys

        depth = sys.getrecursionlimit()
        sys.setrecursionlimit(max(depth, 4 * len(counts) + 1000))
        try:
            search(dict(counts), total, [], 0)
        finally:
            sys.setrecursionlimit(depth)
    return best


def pack(pieces: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """`pieces` with `sequence_id` and `offset` (gapless from 0 in each sequence).

    `pieces` must be a stored table with the columns of `cut`; it is read for
    the histogram and for the placing. Equal rows are ranked in any order, which
    gives them different places. An empty table gives none. No length is
    collected into one task: ranks are counted in salted groups of at most about
    `RANKED_TOGETHER` pieces and shifted by the groups before.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = complete(counts, capacity)
    slots, taken, base = [], {}, 0
    for times, filling in plan:
        offset = 0
        for n, k in filling:
            start = taken.get(n, 0)
            slots.append((n, start, start + times * k, k, base, offset))
            taken[n] = start + times * k
            offset += n * k
        base += times
    # At most `capacity` patterns of a few lengths each, whatever the corpus.
    slots = spark.createDataFrame(slots, "length bigint, _from bigint, _to bigint, _each bigint, _base bigint, _offset bigint")
    salts = [(n, 1 + k // RANKED_TOGETHER) for n, k in counts.items()]  # a row per length
    salts = spark.createDataFrame(salts, "length bigint, _salts bigint")
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "_salt", F.pmod(F.xxhash64(key, "piece"), F.col("_salts")))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "_salt").count().select(
        "length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece", "start")) - 1)
    ranked = ranked.join(groups, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(F.broadcast(slots), "length").where("_rank >= _from AND _rank < _to")
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("_base") + F.floor(nth / F.col("_each")).cast("bigint")).alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_each")) * F.col("length")).alias("offset"))


def pack_documents(frame: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 0,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut, store and pack documents: the columns of `cut`, `sequence_id`, `offset`.

    Texts are read once, while their ids are counted; only lengths move.
    """
    return pack(stored(cut(frame, tokenizer_path, pattern, capacity, end_id, key, text), "pieces"), capacity, key)
