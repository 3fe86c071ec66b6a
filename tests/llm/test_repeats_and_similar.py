"""Suffix-array dedup, the n-gram Jaccard join and components against brute force."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueweave.llm import jaccard, repeats
from cueweave.llm.components import components


def brute_repeats(rows, width):
    starts = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - width + 1):
            s = data[i:i + width]
            k = float("inf") if key is None else key
            starts[s] = min(k, starts.get(s, k))
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if starts[data[i:i + width]] < (float("inf") if key is None else key):
                gone[i:i + width] = b"\1" * width
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "béta", "gamma", "δ", "epsilon", "x"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = prose(30), prose(300)
    rows = [(i, prose(rng.randint(0, 40))) for i in range(40)]
    rows += [(100 + i, prose(5) + " " + passage[rng.randint(0, 20):] + " " + prose(5)) for i in range(20)]
    rows += [(200, long), (201, long), (199, "y" + long), (None, long[:200]), (None, "z" * 200), (300, "z" * 120), (301, "z" * 49), (302, "z" * 50)]
    rows += [(400, None), (401, ""), (5, rows[5][1]), (5, passage)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("kept", F.lit(1)).repartition(4)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.find(docs).collect()), key=repr)
    assert got == brute_repeats(rows, 50)
    assert repeats.find(docs.where("doc_id < 0")).count() == 0


def test_anchors_take_memory_by_piece():
    size = np.random.default_rng(4).integers(0, 4000, 2000)
    data, end = np.random.default_rng(5).integers(97, 100, size.sum()).astype(np.uint8), np.cumsum(size)
    whole = repeats._anchors(data, end - size, end, 50, 20)
    tracemalloc.start()
    got = repeats.anchors(data, end - size, end, 50, 20)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(got, whole))
    assert peak < 20 * len(data)


def test_anchors_are_dealt_evenly(spark, monkeypatch):
    """Anchors are the smallest of many hashes; dealt by these, one bucket would get nearly all."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin as grouped

    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(20000)
    rows = [(i, text(3000) + shared[500 * i : 500 * i + 3000]) for i in range(40)]
    dealt, apply = [], grouped.applyInArrow
    monkeypatch.setattr(grouped, "applyInArrow", lambda self, f, schema: dealt.append(self._df) or apply(self, f, schema))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        repeats.find(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4))
        for frame, buckets in zip(dealt, (12, 12 * repeats.FINER)):
            size = [r.n for r in frame.groupBy("bucket").agg(F.sum(F.octet_length("value")).alias("n")).collect()]
            assert max(size) < 4 * sum(size) / buckets
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_suffix_classes_equal_brute_force():
    rng = random.Random(9)
    for width in (20, 50, 64):
        base = "".join(rng.choice("ab") for _ in range(150)).encode()
        texts = [base[(at := rng.randrange(150 - width)) : at + rng.randint(width, 2 * width)] for _ in range(60)]
        owner = np.array([rng.randrange(20) for _ in texts])
        least = {}
        for t, o in zip(texts, owner):
            for i in range(len(t) - width + 1):
                least[t[i : i + width]] = min(o, least.get(t[i : i + width], o))
        got = repeats.suffix_classes(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), owner, width)
        want = [[i + width <= len(t) and least[t[i : i + width]] < o for i in range(got.shape[1])] for t, o in zip(texts, owner)]
        assert got.tolist() == want


def brute_similar(rows, k, share):
    sets = []
    for _, text in rows:
        low = (text or "").encode()
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in low)
        words = low.split()
        sets.append({tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("k,share,block", [(3, 90, 3000), (5, 80, 3), (1, 50, 2)])
def test_similar_equals_brute_force(spark, monkeypatch, k, share, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([2, 6, 40, 120]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.randrange(10**6), " ".join(copy)))
    rows += [(7, None), (8, ""), (9, " \t\n"), (10, "One two"), (11, "one TWO"), (None, "one two"), (12, "one"), (13, rows[0][1]), (13, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("n_shingles", F.lit("x")).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs, k, share).collect()), key=repr)
    want = brute_similar(rows, k, share)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    # Rows without shingles name themselves.
    assert got == sorted(((key, n, key if n == 0 else c) for key, n, c in want), key=repr)


def test_sets_that_cannot_be_linked_are_not_signed(spark, monkeypatch):
    """A passage that all share does not bring texts into one family."""
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage, twin = prose(40), prose(200)
    rows = [(i, f"{prose(80)} {passage} {prose(80)}") for i in range(60)] + [(100, twin), (101, f"{twin} more"), (102, twin)]
    held, store = {}, jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda frame, label: held.setdefault(label, store(frame, label)))
    found = jaccard.similar(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3), 5, 80).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in found} == {i: (100, 2) if i >= 100 else (i, 0) for i, _ in rows}
    assert held["near"].count() == 2


def test_counts_of_shared_shingles_travel_packed(spark, monkeypatch):
    """A set lies in as many buckets as it has shingles; the step does not give a row for each of them."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin as grouped

    rng = random.Random(6)
    rows = []
    for i in range(150):
        text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(120))
        rows += [(2 * i, text), (2 * i + 1, f"{text} more")]
    made, apply = [], grouped.applyInArrow
    monkeypatch.setattr(grouped, "applyInArrow", lambda *a: made.append(apply(*a)) or made[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        found = jaccard.similar(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3), 5, 80).collect()
        assert {r.doc_id: r.component_id for r in found} == {i: i - i % 2 for i in range(300)}
        assert made[0].count() <= 12 * 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 500)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {n: find(n) for n in root}
