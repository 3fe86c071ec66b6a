"""Random keys are candidates wherever they stand, structure is not taken for them."""

import random
import string

from cueweave.llm import secret_scan
from cueweave.llm.secret_scan import battery, pieces, spans_of

B64 = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"


def key(letters, n, seed):
    return "".join(random.Random(seed).choices(letters, k=n))


def covered(text, part):
    at = text.index(part)
    return any(a <= at and at + len(part) <= b for a, b, *_ in spans_of(text)[1])


def test_key_after_a_name_or_in_a_path_is_a_candidate():
    word = key(string.ascii_letters + string.digits, 32, 1)
    for text in (f"SIGNATURE={word}", f"?sig={word}", f"/v1-x/{word}/y_z", f"my_name-{word}/end", f"x+{word}-_"):
        assert (text.index(word), text.index(word) + 32) in [t[:2] for t in spans_of(text)[1]], text


def test_padding_belongs_to_the_key():
    text = f"SIGNATURE={key(B64, 30, 2)}== end"
    assert (10, 42) in [t[:2] for t in spans_of(text)[1]]


def test_keys_with_few_digits_and_decimal_keys_are_tested():
    for seed in range(300):
        assert covered(f"x {key(B64, 20, seed)} y", key(B64, 20, seed))
    number = key(string.digits, 22, 3)
    assert [t[2].split(":")[0] for t in spans_of(f"n {number}.")[1]] == ["decimal"]
    assert not spans_of("n 12345.")[1]


def test_words_and_repetition_are_unlikely_keys():
    for text in ("some-long-name-of-a-page-with-words", "aaaaaaaaaaaaaaaaaaaaaaaa", "src/main/java/org/example/pages", "Geschwindigkeitsbegrenzung"):
        assert all(battery(text[a:b], name) < 0.02 for a, b, name in pieces(text)), text
    assert sum(battery(key(B64, 24, s), "base64") < 0.05 for s in range(1000)) < 120


def test_scan_finds_the_keys_among_names(spark):
    keys = [key(string.ascii_letters + string.digits, 32, s) for s in range(20)]
    rows = [(i, f"see ?sig={k} ok") for i, k in enumerate(keys)]
    rows += [(100 + i, f"see some-long-name-of-a-page-number-{w}-with-words here") for i, w in enumerate("abcdefghijklmnopqrst")]
    found = {r["doc_id"]: r["spans"] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(any((s["start"], s["stop"]) == (9, 41) for s in found[i]) for i in range(20)) >= 19
    assert not any(found[100 + i] for i in range(20))
