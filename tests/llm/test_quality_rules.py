"""Quality rules judge a document by its own language, whichever that is."""

import random

import pytest

from cueweave.llm import quality

RUSSIAN = "и в не на что он с как это по но из у за то все так его от же для мы вы они бы когда только время дом человек".split()
ENGLISH = "the of and to in is that for it was on are as with his they at be this have from or one had by".split()


def prose(words, n, seed):
    pick = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(words))]
    made = pick.choices(words, weights, k=n)
    return ". ".join(" ".join(made[i : i + 9]).capitalize() + str(pick.randrange(99)) for i in range(0, n, 9))


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, prose(ENGLISH, 300, i), "en") for i in range(60)]
    rows += [(100 + i, prose(RUSSIAN, 300, i), "ru") for i in range(40)]
    rows += [(200, " ".join(f"{i * 7919 % 99991}#{i}" for i in range(300)), "ru")]  # numbers only
    rows += [(300, prose(RUSSIAN, 300, 99), None), (301, prose(RUSSIAN, 300, 98), "kk")]
    rows += [(302, None, "ru"), (303, "", None), (304, "one two", "xx")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return {r["doc_id"]: r for r in quality.judge(frame).collect()}


def test_every_language_of_the_corpus_has_its_reference(judged):
    assert len(judged) == 106
    assert all(judged[100 + i]["kept"] and judged[100 + i]["character_distance"] < 0.1 for i in range(40))
    assert all(judged[100 + i]["word_distance"] is not None for i in range(40))
    assert all(judged[i]["kept"] for i in range(60))


def test_documents_unlike_their_language_are_rejected(judged):
    assert not judged[200]["base_failed"] and not judged[200]["kept"]


def test_no_reference_no_distance_verdict(judged):
    for i in (300, 301):
        assert judged[i]["kept"] and judged[i]["character_distance"] is None and judged[i]["word_distance"] is None
    assert not any(judged[i]["kept"] for i in (302, 303, 304))


def test_common_words_are_counted_in_the_corpus(spark):
    rows = [("b | a\tb | |\na b | |", "xx"), ("c c", "yy"), ("x", None), (None, "zz")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert {r[0]: r[1] for r in quality.common_words(frame, n=2).collect()} == {"xx": ["b", "a"], "yy": ["c"]}
