"""Phrase collocations: n-gram counts from an FM-index per shard, summed across shards.

A task cuts its documents into shards of bounded bytes; a shard is a sequence of
word ids with separators between pieces. Both of its Burrows-Wheeler transforms
(of the sequence and of its reverse) hold every phrase as an interval; a step to
the right reads the symbols of the interval in the reverse transform and moves
both intervals at once, a step to the left does the same the other way round.

Phrases grow by one word per round. A round's counts are summed over the shards,
and only phrases that occur often enough in the whole corpus grow on; a phrase
is never more frequent than its parts, so none is lost. Words, then word pairs,
that are too rare are cut out of the sequences as separators.

The sum is a shuffle by a hash of the phrase. A shard packs its counts per group
of hashes into one row, and a group packs what it tells a shard likewise, since
sorted numbers take a third of the bytes that rows of their own would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueweave.llm.common import group_count, pack, pack_columns, stored, unpack, unpack_columns

#: Bytes of text per shard: bounds the memory of a task.
SHARD_BYTES = 6 << 20

#: Bits of a word's number for its place in the shard's dictionary, and of a shard's for its place in the task.
PLACE_BITS, TURN_BITS = 30, 11

#: Occurrences that one step looks at together.
STEP_ROWS = 1 << 18

#: What separates pieces of a text, and the language of documents without one.
SEPARATORS = "[.,;:!?\n-\r]+"
NO_LANGUAGE = "und"


# --- one shard -----------------------------------------------------------------


def word_ids(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """(ids, languages, words, counts): the texts as word ids from 1, separators 0, and
    the language, word and count of each id. A word of two languages has two ids."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=SEPARATORS, replacement=" \n ")
    ends, between = (pa.scalar(c, pa.large_string()) for c in ("\n", " "))
    spaced = pc.binary_join_element_wise(pc.replace_substring(spaced, "\t", " "), ends, between)
    lists = pc.split_pattern(spaced, " ")
    del spaced  # each of these arrays is as large as the texts
    names = langs.dictionary_encode()
    lang = np.repeat(names.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    del lists
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    empty, gap = (pc.index(words, pa.scalar(w, words.type)).as_py() for w in ("", "\n"))
    real = code != empty
    code, lang = code[real], lang[real]
    both = lang * np.int64(len(words)) + code
    both[code == gap] = -1
    del coded, code, lang, real
    seen, ids, counts = np.unique(both, return_inverse=True, return_counts=True)
    del both
    ids, seen, counts = (ids, seen[1:], counts[1:]) if len(seen) and seen[0] == -1 else (ids + 1, seen, counts)
    order = np.argsort(-counts, kind="stable")  # frequent words have small ids, which compress well
    place = np.zeros(len(seen) + 1, np.int64)
    place[order + 1] = np.arange(1, len(seen) + 1)
    seen, counts = seen[order], counts[order]
    return place[ids], names.dictionary.take(pa.array(seen // max(1, len(words)))), words.take(pa.array(seen % max(1, len(words)))), counts


def tidy(s: np.ndarray) -> np.ndarray:
    """Without words that stand alone and without repeated separators; a separator at both ends."""
    s = np.concatenate(([0], s, [0]))
    word = s > 0
    beside = np.zeros(len(s), bool)
    beside[1:] |= word[:-1]
    beside[:-1] |= word[1:]
    s = np.where(word & beside, s, 0)
    keep = s > 0
    keep[:-1] |= s[1:] > 0
    keep[-1] = True
    return s[keep]


def cut_pairs(s: np.ndarray, alive: np.ndarray, base: int) -> np.ndarray:
    """Separators between neighbours whose number `a * base + b` is not in `alive` (sorted)."""
    beside = (s[:-1] > 0) & (s[1:] > 0)
    dead = beside & ~_holds(alive, s[:-1] * base + s[1:])
    return tidy(np.insert(s, np.flatnonzero(dead) + 1, 0))


def _holds(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def transform(s: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix (in a circle), suffixes ordered by their first `depth`
    symbols (a power of two) and then by place. That order is all phrases of `depth` words need."""
    rank, reach = s, 1
    while reach < depth:
        pair = rank * (int(rank.max()) + 1) + np.roll(rank, -reach)
        order = np.argsort(pair, kind="stable")
        steps = np.concatenate(([0], np.cumsum(np.diff(pair[order]) != 0)))
        rank = np.empty_like(s)
        rank[order] = steps
        reach *= 2
    return s[np.argsort(rank, kind="stable") - 1]


class Index:
    """Both transforms of a shard's sequence, and the intervals of phrases in them."""

    def __init__(self, left: np.ndarray, right: np.ndarray, symbols: int) -> None:
        self.side = {"left": left, "right": right}  # symbols found to the left, to the right
        self.symbols = symbols
        self.start = np.concatenate(([0], np.cumsum(np.bincount(left, minlength=symbols))))
        self._step: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, s: np.ndarray, symbols: int, depth: int) -> Index:
        return cls(transform(s, depth), transform(s[::-1], depth), symbols)

    def step(self, side: str) -> np.ndarray:
        """Row of the suffix that is longer by one symbol, for every row."""
        if side not in self._step:
            rows = self.side[side]
            moved = np.empty(len(rows), np.int64)
            moved[np.argsort(rows, kind="stable")] = np.arange(len(rows))
            self._step[side] = moved
        return self._step[side]

    def words(self) -> dict[str, np.ndarray]:
        """Intervals of the single words: where they start in the order of suffixes
        (`left`) and of reversed prefixes (`right`), their size, their symbols."""
        size = np.diff(self.start)
        at = np.flatnonzero(size[1:]) + 1
        return {"left": self.start[at], "right": self.start[at], "size": size[at], "phrase": at.reshape(-1, 1)}

    def grown(self, nodes: dict[str, np.ndarray], side: str) -> dict[str, np.ndarray]:
        """Every phrase of `nodes` with one more word on `side`."""
        parts, first, ends = [], 0, np.cumsum(nodes["size"])
        while first < len(ends):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + STEP_ROWS, "right")))
            parts.append(self._grown({k: v[first:last] for k, v in nodes.items()}, side))
            first = last
        if not parts:
            parts = [self._grown(nodes, side)]
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    def _grown(self, nodes: dict[str, np.ndarray], side: str) -> dict[str, np.ndarray]:
        other = "left" if side == "right" else "right"
        size = nodes["size"]
        offset = np.cumsum(size) - size
        node = np.repeat(np.arange(len(size)), size)
        row = np.arange(len(node)) + np.repeat(nodes[side] - offset, size)
        key = node * self.symbols + self.side[side][row]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key)))
        node, symbol = np.divmod(key[new], self.symbols)
        word = symbol > 0
        new, count, node, symbol = new[word], count[word], node[word], symbol[word]
        phrase, more = nodes["phrase"][node], symbol.reshape(-1, 1)
        return {
            side: self.step(side)[row[order[new]]],  # first row of the interval that has the symbol
            other: nodes[other][node] + new - offset[node],  # past the smaller symbols
            "size": count,
            "phrase": np.hstack((phrase, more) if side == "right" else (more, phrase)),
        }


def chosen(nodes: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in nodes.items()}


def within(starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which rows lie in one of the (disjoint) intervals."""
    if not len(starts):
        return np.zeros(len(rows), bool)
    order = np.argsort(starts)
    at = np.searchsorted(starts[order], rows, "right") - 1
    return (at >= 0) & (rows < (starts + sizes)[order][at])


def ranks(phrases: np.ndarray, base: int) -> np.ndarray:
    """A number for each row of three symbols: the rank of its first two, then the third."""
    pairs = np.unique(phrases[:, 0] * base + phrases[:, 1], return_inverse=True)[1]
    return pairs * base + phrases[:, 2]


# --- tasks ---------------------------------------------------------------------

#: Rows of a shard (`part` is null) and of its counts for a group of the sum.
_BLOCK = "part BIGINT, shard BIGINT, data BINARY"
#: What a sum tells a shard, or (`shard` is null) the corpus.
_TOLD = "shard BIGINT, data BINARY"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"BIGINT": pa.int64(), "BINARY": pa.binary(), "STRING": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def _ipc(columns: dict) -> bytes:
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _runs(part: np.ndarray) -> list[tuple[int, int]]:
    start = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(start.tolist(), np.append(start[1:], len(part)).tolist()))


def _shards(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def shard() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            text, lang = (pa.concat_arrays(table[c].cast(pa.large_string()).chunks) for c in ("text", "lang"))
            ids, langs, words, counts = word_ids(text, lang)
            if turn >> TURN_BITS:
                raise ValueError("too many shards in one task: read the documents in more partitions")
            number = task << TURN_BITS | turn
            part = (pd.util.hash_array(words.to_numpy(zero_copy_only=False)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            by = [c.take(pa.array(order)) for c in (langs, words, pa.array(np.arange(1, len(order) + 1)), pa.array(counts))]
            runs = _runs(part[order])
            data = [_ipc(dict(zip(("lang", "word", "place", "count"), (c[a:b] for c in by)))) for a, b in runs]
            return _batch(_BLOCK, [None, *(int(part[order[a]]) for a, _ in runs)], [number] * (len(runs) + 1), [pack(ids), *data])

        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            first = 0
            for i, n in enumerate(lengths):
                if size and size + n > SHARD_BYTES:
                    held.append(batch.slice(first, i - first))
                    yield shard()
                    held, size, first, turn = [], 0, i, turn + 1
                size += int(n)
            held.append(batch.slice(first))
        if sum(map(len, held)):
            yield shard()

    return run


def _sum_words(least: int):
    def run(group: pa.Table) -> pa.Table:
        tables = []
        for shard, data in zip(group["shard"].to_pylist(), group["data"]):
            table = pa.ipc.open_stream(data.as_buffer()).read_all()
            tables.append(table.append_column("shard", pa.array(np.full(len(table), shard))))
        rows = pa.concat_tables(tables).combine_chunks()
        place, shard = rows["place"].to_numpy(), rows["shard"].to_numpy()
        rows = rows.append_column("id", pa.array(shard << PLACE_BITS | place))
        sums = rows.group_by(["lang", "word"]).aggregate([("count", "sum"), ("id", "min")])
        all_words = rows.group_by("lang").aggregate([("count", "sum")])
        sums = sums.filter(pc.greater_equal(sums["count_sum"], least))
        known = rows.select(["lang", "word", "shard", "place"]).join(sums, ["lang", "word"], join_type="inner").sort_by(
            [("shard", "ascending"), ("place", "ascending")])
        shard, place, word = (known[c].to_numpy() for c in ("shard", "place", "id_min"))
        runs = _runs(shard)
        total = _ipc({"lang": pa.concat_arrays([*sums["lang"].chunks, *all_words["lang"].chunks]),
                      "word": pa.concat_arrays([*sums["word"].chunks, pa.nulls(len(all_words), sums["word"].type)]),
                      "word_id": pa.concat_arrays([*sums["id_min"].chunks, pa.nulls(len(all_words), pa.int64())]),
                      "total": pa.concat_arrays([*sums["count_sum"].chunks, *all_words["count_sum"].chunks])})
        told = [pack_columns([place[a:b], word[a:b]]) for a, b in runs]
        return pa.Table.from_batches([_batch(_TOLD, [None, *(int(shard[a]) for a, _ in runs)], [total, *told])])

    return run


def _sum_phrases(least: int):
    def run(group: pa.Table) -> pa.Table:
        blocks = [unpack_columns(d.as_buffer().to_pybytes()) for d in group["data"]]
        shard = np.repeat(group["shard"].to_numpy(), [len(b[0]) for b in blocks])
        *words, count = (np.concatenate(c) for c in zip(*blocks))
        order = np.lexsort(words[::-1])
        words = [w[order] for w in words]
        new = np.flatnonzero(np.logical_or.reduce([np.diff(w, prepend=-1) != 0 for w in words]))
        total = np.add.reduceat(count[order], new)
        known = np.repeat(total >= least, np.diff(np.append(new, len(order))))
        frequent = new[total >= least]
        sums = pack_columns([*(w[frequent] for w in words), total[total >= least]])
        shard, words = shard[order][known], [w[known] for w in words]
        by_shard = np.argsort(shard, kind="stable")
        shard, words = shard[by_shard], [w[by_shard] for w in words]
        runs = _runs(shard)
        told = [pack_columns([w[a:b] for w in words]) for a, b in runs]
        return pa.Table.from_batches([_batch(_TOLD, [None, *(int(shard[a]) for a, _ in runs)], [sums, *told])])

    return run


def _rows(frames: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in frames:
        for i in range(len(batch)):
            yield {n: batch.column(n)[i] for n in batch.schema.names}


def _alive(row: dict) -> list[np.ndarray]:
    """The columns that all groups of a sum tell a shard."""
    return [np.concatenate(c) for c in zip(*(unpack_columns(p.as_buffer().to_pybytes()) for p in row["alive"].values))]


_REDUCED = "shard BIGINT, words BINARY, sequence BINARY"


def _frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of frequent words alone, numbered anew; `words` holds their numbers in the corpus."""
    for row in _rows(batches):
        place, word = _alive(row)
        order = np.argsort(place)
        ids = unpack(row["data"].as_py())
        symbol = np.zeros(max(int(ids.max(initial=0)), int(place.max())) + 1, np.int64)
        symbol[place[order]] = np.arange(1, len(order) + 1)
        yield _batch(_REDUCED, [row["shard"].as_py()], [pack(np.append(0, word[order]))], [pack(tidy(symbol[ids]))])


_INDEX = "shard BIGINT, words BINARY, before BINARY, after BINARY"


def _frequent_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index of the sequences in which every pair of neighbours is frequent."""
    for row in _rows(batches):
        words, s = unpack(row["words"].as_py()), unpack(row["sequence"].as_py())
        first, second = _local(words, _alive(row)).T
        s = cut_pairs(s, np.sort(first * len(words) + second), len(words))
        index = Index.of(s, len(words), 4)
        yield _batch(_INDEX, [row["shard"].as_py()], [row["words"].as_py()], [pack(index.side["left"])], [pack(index.side["right"])])


def _local(words: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Symbols of words given by their numbers in the corpus."""
    order = np.argsort(words)
    return np.stack([order[np.searchsorted(words[order], c)] for c in columns], 1)


def _index(row: dict) -> tuple[np.ndarray, Index]:
    words = unpack(row["words"].as_py())
    return words, Index(unpack(row["before"].as_py()), unpack(row["after"].as_py()), len(words))


def _counts(shard: int, parts: int, words: np.ndarray, nodes: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A shard's phrases and counts, one row per group of the sum."""
    columns = list(words[nodes["phrase"]].T)
    mixed = np.zeros(len(nodes["size"]), np.uint64)
    for c in columns:
        mixed = (mixed ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    part = (mixed % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((*columns[::-1], part))
    part, columns = part[order], [c[order] for c in (*columns, nodes["size"])]
    runs = _runs(part)
    if runs:
        yield _batch(_BLOCK, [int(part[a]) for a, _ in runs], [shard] * len(runs), [pack_columns([c[a:b] for c in columns]) for a, b in runs])


def _pairs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words = unpack(row["words"].as_py())
            index = Index.of(unpack(row["sequence"].as_py()), len(words), 2)
            yield from _counts(row["shard"].as_py(), parts, words, index.grown(index.words(), "right"))

    return run


def _triples(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, index = _index(row)
            pairs = index.grown(index.words(), "right")
            yield from _counts(row["shard"].as_py(), parts, words, index.grown(pairs, "left"))

    return run


def _fours(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, index = _index(row)
            triples = index.grown(index.grown(index.words(), "right"), "left")
            both = ranks(np.concatenate((_local(words, _alive(row)), triples["phrase"])), len(words))
            frequent, local = np.split(both, [len(both) - len(triples["size"])])
            triples = chosen(triples, np.isin(local, frequent))
            fours = index.grown(triples, "right")
            # The last three words are a frequent triple where the interval of the reversed phrase lies in one's.
            ends = within(triples["right"], triples["size"], fours["right"])
            yield from _counts(row["shard"].as_py(), parts, words, chosen(fours, ends))

    return run


_WORD_SUMS = "lang STRING, word STRING, word_id BIGINT, total BIGINT"


def _word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        table = pa.ipc.open_stream(row["data"].as_buffer()).read_all()
        yield from table.cast(pa.schema([("lang", pa.string()), ("word", pa.string()), ("word_id", pa.int64()), ("total", pa.int64())])).to_batches()


def _phrase_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        columns = unpack_columns(row["data"].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*_names(len(columns) - 1), "f"])


# --- the corpus ----------------------------------------------------------------


def _summed(blocks: DataFrame, how, label: str) -> tuple[DataFrame, DataFrame]:
    """(`shard`, `alive`: what the sums tell each shard; rows of the sums themselves).

    A shard has a phrase once, and hashes deal phrases evenly: no group is large.
    """
    found = stored(blocks.groupBy("part").applyInArrow(how, _TOLD), label)
    told = found.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list("data").alias("alive"))
    return told, found.where("shard IS NULL").select("data")


def phrase_counts(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(languages, words, phrases): `lang`, `n` (all words); `word_id`, `lang`, `word` of
    words that occur `least` times; `ids` (word ids, 1 to 4), `f` of such phrases.

    Null texts count as empty, null languages as `und`; an empty table gives empty ones.
    """
    plain = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"))
    parts = group_count(plain, "text", SHARD_BYTES)  # a group of a sum is about as large as a shard
    shards = stored(plain.mapInArrow(_shards(parts), _BLOCK), "phrase-shards")
    told, sums = _summed(shards.where("part IS NOT NULL"), _sum_words(least), "phrase-words")
    words = stored(sums.mapInArrow(_word_sums, _WORD_SUMS), "phrase-vocabulary")
    known = words.where("word_id IS NOT NULL")
    found = known.select(F.array("word_id").alias("ids"), F.col("total").alias("f"))

    sequences = shards.where("part IS NULL").select("shard", "data").join(told, "shard")
    reduced = stored(sequences.mapInArrow(_frequent_words, _REDUCED), "phrase-sequences")
    told, sums = _summed(reduced.mapInArrow(_pairs(parts), _BLOCK), _sum_phrases(least), "phrase-pairs")
    found = found.unionByName(_phrases(sums, 2))
    index = stored(reduced.join(told, "shard").mapInArrow(_frequent_pairs, _INDEX), "phrase-index")
    told, sums = _summed(index.mapInArrow(_triples(parts), _BLOCK), _sum_phrases(least), "phrase-triples")
    found = found.unionByName(_phrases(sums, 3))
    _, sums = _summed(index.join(told, "shard").mapInArrow(_fours(parts), _BLOCK), _sum_phrases(least), "phrase-fours")
    found = found.unionByName(_phrases(sums, 4))
    languages = words.where("word_id IS NULL").groupBy("lang").agg(F.sum("total").alias("n"))
    return languages, known.select("word_id", "lang", "word"), stored(found, "phrase-counts")


def _names(k: int) -> list[str]:
    return [f"w{i + 1}" for i in range(k)]


def _phrases(sums: DataFrame, k: int) -> DataFrame:
    schema = ", ".join(f"{n} BIGINT" for n in (*_names(k), "f"))
    return sums.mapInArrow(_phrase_sums, schema).select(F.array(*_names(k)).alias("ids"), "f")


def collocations(docs: DataFrame, least: int = 30, top: int | None = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """`lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`: phrases of two to four words that
    occur `least` times in a language, best scores first, the first `top` of each language.

    A phrase's cut after k words has the score floor(2000000 * a / (l + r)), with the counts of
    the whole and of both parts; its lowest cut counts. Phrases with 80 % of their
    occurrences inside one longer frequent phrase are left out. Ties go to the more
    frequent phrase, then to the byte order of its text.
    """
    spark = docs.sparkSession
    languages, words, found = phrase_counts(docs, least, text, lang)
    candidates = found.where(F.size("ids") > 1).withColumnRenamed("f", "a")
    part = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    cuts = candidates.select("ids", "a", part).withColumns({
        "head": F.slice("ids", 1, F.col("k")), "tail": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(found.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(
        found.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r)")
    scored = cuts.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("ids", "a", "c.l", "c.r", "c.score")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("ids") - m + 1), lambda i: F.slice("ids", i, m))))
    covers = candidates.where(F.size("ids") > 2).select(F.explode(inner).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    free = scored.join(covers, "ids", "left").where(
        F.col("longer").isNull() | F.expr("100 * cast(longer as decimal(20,0)) < 80 * cast(a as decimal(20,0))")).drop("longer")

    spelt = free.select("ids", F.posexplode("ids").alias("at", "word_id")).join(words, "word_id").groupBy("ids").agg(
        F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = free.join(spelt.select("ids", "lang", F.array_join(F.col("w.word"), " ").alias("phrase")), "ids").join(languages, "lang")
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:  # first within parts of a language, so that no task sorts all of its phrases
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        named = named.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
