import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueweave.llm import phrases

FALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, total = {}, Counter()
    for text, lang in rows:
        seen = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(FALL)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                seen.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, seen in counts.items():
        frequent = {p: a for p, a in seen.items() if len(p) > 1 and a >= least}
        longest = {}
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i:i + m]] = max(a, longest.get(p[i:i + m], 0))
        found = []
        for p, a in frequent.items():
            if 100 * longest.get(p, 0) < 80 * a:
                score, k = min((2000000 * a // (seen[p[:k]] + seen[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), seen[p[:k]], seen[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def prose(rng, words, n):
    return "".join(rng.choice(words) + rng.choice((" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", " . ")) for _ in range(n))


@pytest.mark.parametrize("least,top,shard", [(1, 50, 300), (3, 2000, 100), (30, 2000, 1 << 20), (5, None, 700)])
def test_equals_brute_force(spark, monkeypatch, least, top, shard):
    rng = random.Random(least)
    words = ["the", "The", "of", "été", "a-b", "\x85", "x\x00y", "\x1c", "日本", "new", "york"] + [f"w{i}" for i in range(9)]
    rows = [(prose(rng, words, rng.randint(0, 60)), rng.choice(("en", "de", None))) for _ in range(60)]
    rows += [("new york city is new york city", "en")] * 12 + [(None, "en"), ("", None), ("...", "xx"), ("Word", "yy"), ("one " * 400, "de")]
    docs = spark.createDataFrame(rows, "text STRING, lang STRING").withColumn("shard", F.lit("clash")).repartition(3)
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)  # the tasks get the module's values with their functions
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, top).collect())
    assert got == brute(rows, least, top)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text STRING, lang STRING")).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_intervals_of_both_transforms(seed):
    rng = np.random.default_rng(seed)
    s = phrases.tidy(rng.integers(0, 5, 200))
    index = phrases.Index.of(s, 5, 4)
    nodes = index.words()
    for side in (("right", "left", "right"), ("left", "left", "left"), ("right", "right", "right"))[seed % 3]:
        nodes = index.grown(nodes, side)
        k = nodes["phrase"].shape[1]
        runs = Counter(tuple(s[i:i + k]) for i in range(len(s) - k + 1) if s[i:i + k].all())
        assert {tuple(p): n for p, n in zip(nodes["phrase"], nodes["size"])} == runs
        for way, text, step in (("left", s, 1), ("right", s[::-1], -1)):
            suffixes = sorted(tuple(np.roll(text, -i)[:4]) for i in range(len(text)))
            for p, at in zip(nodes["phrase"], nodes[way]):
                assert at == sum(x[:k] < tuple(p[::step]) for x in suffixes)


def test_small_shards_add_up(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(6)]
    rows = [(prose(rng, words, 30), "en") for _ in range(80)]
    docs = spark.createDataFrame(rows, "text STRING, lang STRING")
    one = phrases.collocations(docs.coalesce(1), 4, None).collect()
    many = phrases.collocations(docs.repartition(40), 4, None).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) == brute(rows, 4, None)
