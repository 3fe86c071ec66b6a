import random
import zlib

import pytest
from pyspark.sql import functions as F

from cueweave.llm import sharding


def plain_best_fit(items, capacity):
    rooms = []
    for size in sorted(items, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= size]
        if fitting:
            i = min(fitting, key=lambda i: (rooms[i], i))
            rooms[i] -= size
        else:
            rooms.append(capacity - size)
    return rooms


def histogram(items):
    sizes = sorted(set(items), reverse=True)
    return sizes, [items.count(s) for s in sizes]


@pytest.mark.parametrize("seed", range(40))
def test_histogram_packs_like_one_by_one(seed):
    rng = random.Random(seed)
    items = [rng.choice((1, 2, 3, 7, 20, rng.randint(1, 50))) for _ in range(rng.randint(1, 80))]
    bins, plan = sharding.best_fit_decreasing(*histogram(items), 50)
    rooms = [50] * bins
    for size, _, b, copies in plan:
        rooms[b] -= size * copies
    assert sorted(rooms) == sorted(plain_best_fit(items, 50))
    for size in set(items):
        numbers = [n for s, first, _, copies in plan if s == size for n in range(first, first + copies)]
        assert sorted(numbers) == list(range(items.count(size)))


@pytest.mark.parametrize("seed", range(40))
def test_smallest_capacity_for_a_count(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))] + [500] * rng.randint(0, 2)
    sizes, counts = histogram(items)
    _, plan = sharding.fill_count(sizes, counts, 6)
    loads = [0] * 6
    for size, _, b, copies in plan:
        loads[b] += size * copies
    assert sum(loads) == sum(items)
    for size in sizes:
        numbers = [n for s, first, _, copies in plan if s == size for n in range(first, first + copies)]
        assert sorted(numbers) == list(range(items.count(size)))
    small = [load for load in loads if load < 500]
    assert max(small, default=0) <= sum(s for s in items if s < 500) / max(1, len(small)) + 40


def test_tree_finds_the_tightest():
    rng, tree, held = random.Random(3), sharding.Tree(), []
    for i in range(600):
        if held and rng.random() < 0.5:
            want = (rng.randint(0, 99), -1)
            expected = min((k for k in held if k >= want), default=None)
            assert tree.take_at_least(want) == expected
            if expected:
                held.remove(expected)
        else:
            held.append((rng.randint(0, 99), i))
            tree.add(held[-1])


def test_rows_of_every_kind(spark):
    texts = [None, "", "a", "a", "bcd", "é" * 9, "long " * 900, None, "a"] + [f"text {i} " * (i % 7) for i in range(200)]
    rows = [(i if i % 11 else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, shard INT").withColumn("_text", F.lit(1)).repartition(5)
    got = sharding.shard(docs, count=4).collect()
    assert len(got) == len(rows)
    expected = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == expected
    by_text = {}
    for r in got:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    loads = sorted(sum(r.size for r in got if r.shard == s) for s in range(4))
    assert loads[-1] == 4508 and loads[2] - loads[0] <= 8  # the long text alone, the others even


def test_capacity_and_empty(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 30)) for i in range(300)] + [(999, "y" * 400)], "doc_id BIGINT, text STRING")
    got = sharding.shard(docs, capacity=300).collect()
    loads = {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert sorted(loads) == list(range(len(loads)))
    assert max(loads.values()) == 408 and sorted(loads.values())[-2] <= 380
    assert sharding.shard(docs.where("doc_id < 0"), count=3).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(docs)
