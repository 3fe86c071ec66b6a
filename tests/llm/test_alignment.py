import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueweave.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*PATHS)


def whole_tokens(pair, text):
    """Both encodings of the whole text, cut by decoded bytes alone; None if they do not spell it."""
    if not text:
        return None
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    wanted = (" " + text).encode()
    if b"".join(pair.bytes_a[i] for i in a) != wanted or b"".join(pair.bytes_b[i] for i in b) != wanted:
        return None
    spans = []
    for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b)):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(table[i])))
            at += len(table[i])
        spans.append(out)
    return spans


def brute(pair, rows):
    docs, holds = [], Counter()
    for key, text in rows:
        spans = whole_tokens(pair, text)
        if spans is None:
            docs.append((key, None))
            continue
        a, b = spans
        links, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        holds.update(set(links))
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for end in cuts:
            groups.append("|".join(",".join(str(i) for i, _, e in side if start < e <= end) for side in spans))
            start = end
        docs.append((key, (len(a), len(b), groups, links)))
    most = defaultdict(int)
    for (i, _), n in holds.items():
        most[i] = max(most[i], n)
    out = []
    for key, found in docs:
        if found is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = found
            out.append((key, n_a, n_b, len(groups), len(links), sum(holds[x] == most[x[0]] for x in links),
                        sum(holds[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [None, "", " ", "a", " a", "a ", "a  b", "  a   b  ", "a\n b", "a \nb", "a\tb c", "x\x00y", "\x00", "é日本😀 𒀀𒀁 x", "▁", "a ▁ b", "a▁b c",
       "<|endoftext|> <s> </s> <unk> <0x0A>", "don't can't WE'LL", "ﬁ ½ \xa0 x", "a b 　 c", "﻿bom ​zero", "1234 5,678.90",
       "\r\n\r\n x\r\n", "é ö", "🇫🇷 👩‍👩‍👧 ok", "a\x85b c", "\x1c \x1f", "= == != ...", "word " * 700, "z" * 3000, "ü" * 500, "a", "a"]


def test_equals_brute_force(spark, pair):
    rng = random.Random(1)
    signs = ["a", "b", "the", "ing", " ", " ", "  ", "\n", ".", ", ", "é", "日", "😀", "\t", "▁", " ", "1", "'s", " "]
    rows = list(enumerate(ODD)) + [(None, "same words here"), (None, "same words here"), (3, "more words")]
    rows += [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(1, 80)))) for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("shard", F.lit("clash")).withColumn("key", F.lit(0)).repartition(5)
    got = sorted((tuple(r) for r in alignment.align(docs, *PATHS).collect()), key=repr)
    assert got == brute(pair, rows)


def test_small_shards_and_memory(spark, pair, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD_BYTES", 500)
    monkeypatch.setattr(alignment, "STEP_BYTES", 200)
    monkeypatch.setattr(alignment, "KEPT_CHUNKS", 20)
    monkeypatch.setattr(alignment, "process_state", lambda key, make: make())
    rng = random.Random(2)
    words = [f"wörd{i}" if i % 3 else f"Token{i}," for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    assert sorted((tuple(r) for r in alignment.align(docs, *PATHS).collect()), key=repr) == brute(pair, rows)


def test_spans_are_refined(pair):
    for text in (t for t in ODD if t):
        for ids, ends, lengths in ((*pair.encode_a(" " + text), pair.len_a), (*pair.encode_b(text), pair.len_b)):
            if int(lengths[ids].sum()) == len((" " + text).encode()):
                assert ends.tolist() == np.cumsum(lengths[ids]).tolist(), text


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id BIGINT, text STRING"), *PATHS).collect() == []
