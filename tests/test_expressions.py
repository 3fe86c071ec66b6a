"""Scalar expressions on literal cases."""

import hashlib
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from cueweave.functions import admission, catalogue, digest, errors, text, timecode, urls
from cueweave.functions.registration import FUNCTIONS, register


@pytest.mark.parametrize("ms,out", [(0, "00:00:00,000"), (12_500, "00:00:12,500"), (3_661_125, "01:01:01,125"),
                                    (-5_000, "00:00:00,000"), (360_000_001, "100:00:00,001")])
def test_format_timestamp(value, ms, out):
    assert value(lambda c: timecode.format_timestamp(c, ","), ms) == out


def test_wrap_counts_characters(value):
    assert value(lambda c: text.wrap_lines(c, 10), "é" * 10) == ["é" * 10]
    long = "https://example.org/a/very/long/path/of/44chr"
    pieces = value(lambda c: text.wrap_lines(c, 12), long)
    assert "".join(pieces) == long and max(map(len, pieces)) <= 12
    assert value(lambda c: text.wrap_lines(c, 12), "  ") == []
    assert value(lambda c: text.wrap_lines(c, 0), "ab c") == ["a", "b", "c"]
    assert value(lambda c: text.wrap_lines(c, 5), "a bcdefghij k l") == ["a", "bcdef", "ghij", "k l"]
    assert value(lambda c: text.wrap_lines(c, 3), "😀😀😀😀 a") == ["😀😀😀", "😀 a"]


def test_whitespace_is_unicode(value):
    assert value(text.collapse_ws, "  a \tb\n　c\u0085 ") == "a b c"
    assert value(text.trim_ws, "  a b ") == "a b"


def test_markup(value):
    assert value(text.strip_tags, "<00:00:01.000><c>mot</c> a &lt;b&gt; &amp;amp; x > y <open") == "mot a <b> &amp; x  y "
    assert value(text.vtt_escape, "R&D <inaudible> a>b") == "R&amp;D &lt;inaudible&gt; a&gt;b"


def test_safe_filename(value):
    assert value(lambda c: text.safe_filename(c, "srt"), "Cours n°3 : « Rust » / partie 1/2 ?") == "Cours n°3 « Rust » partie 1 2.srt"
    assert value(lambda c: text.safe_filename(c, "json"), " ?? ") == "transcription.json"
    assert value(lambda c: text.safe_filename(c, "txt"), "a" * 79 + ". b") == "a" * 79 + ".txt"


@pytest.mark.parametrize("raw,seconds", [("00:00:12.500", 12.5), ("01:02.5", 62.5), ("00:00:01,250", 1.25), ("12.5", None),
                                         ("a:b", None), ("1:2:3:4", None), ("00:12.5d", None), (" 00:01 ", 1.0)])
def test_parse_timestamp(value, raw, seconds):
    assert value(timecode.parse_timestamp, raw) == seconds


def test_parse_cue_timing(value):
    got = value(timecode.parse_cue_timing, "00:00:12.500 -->  00:00:15.000 align:start position:0%")
    assert (got["start"], got["end"]) == (12.5, 15.0)
    assert value(timecode.parse_cue_timing, "00:00:12.500 --> ") is None
    assert value(timecode.parse_cue_timing, "NOTE --> 1") is None


ID = "dQw4w9WgXcQ"
ACCEPTED = [
    f"https://www.youtube.com/watch?v={ID}", f"https://youtube.com/watch?v={ID}", f"https://m.youtube.com/watch?v={ID}&t=3",
    f"https://music.youtube.com/watch?v={ID}", f"https://youtu.be/{ID}", f"https://youtu.be/{ID}?si=x",
    f"https://www.youtube.com/shorts/{ID}", f"https://www.youtube.com/embed/{ID}", f"https://www.youtube.com/live/{ID}",
    f"https://www.youtube.com/v/{ID}", f"  https://WWW.YouTube.com/watch?v={ID}  ", f"https://www.youtube.com:443/watch?v={ID}",
    f"https://www.youtube.com//watch/?x=1&v={ID}&v=other", f"https://www.youtube.com/watch?v={ID}&t=a|b",
]
REFUSED = [
    f"http://www.youtube.com/watch?v={ID}", f"ftp://youtube.com/watch?v={ID}", "javascript:alert(1)", "", "not a url",
    f"https://youtube.com.evil.tld/watch?v={ID}", f"https://evilyoutube.com/watch?v={ID}", f"https://evil.tld/youtube.com/watch?v={ID}",
    f"https://user@www.youtube.com/watch?v={ID}", f"https://user:pw@www.youtube.com/watch?v={ID}",
    "https://youtu.be/short", "https://youtu.be/", "https://www.youtube.com/watch", f"https://www.youtube.com/watch?v={ID}x",
    f"https://www.youtube.com/watch?v={ID[:-1]}%20", f"https://www.youtube.com/watch?v={ID[:-1]}|", "https://www.youtube.com/playlist?list=PL1",
    f"https://www.youtube.com/watch?v={ID}%0A", "https://www.youtube.com/watch?v=;rm%20-rf", "https://www.youtube.com/shorts",
]


def test_urls(spark):
    rows = spark.createDataFrame([(u,) for u in ACCEPTED + REFUSED], "u STRING").select("u", urls.canonical_url(F.col("u")).alias("c")).collect()
    for r in rows:
        if r["u"] in ACCEPTED:
            assert (r["c"]["video_id"], r["c"]["error_code"]) == (ID, None), r
            assert r["c"]["canonical_url"] == f"https://www.youtube.com/watch?v={ID}"
        else:
            assert r["c"]["error_code"] == 10 and r["c"]["video_id"] is None, r


def test_playlist_is_noticed(value):
    assert value(urls.canonical_url, f"https://www.youtube.com/watch?v={ID}&list=PL1")["had_playlist"] is True
    assert value(urls.canonical_url, f"https://www.youtube.com/watch?v={ID}&playlist=1")["had_playlist"] is False


@pytest.mark.parametrize("message,code", [
    ("ERROR: Sign in to confirm you're not a bot. Video unavailable", 12), ("Private video", 11),
    ("This LIVE EVENT will begin in 3 hours", 13), ("HTTP Error 500", 20), ("USE --COOKIES", 12)])
def test_classify_error(value, message, code):
    assert value(errors.classify_error, message)["code"] == code


def test_error_detail_keeps_the_end(value):
    short, long = "x" * 400, "a" * 300 + "é" * 300
    assert value(errors.error_detail, f"  {short}\n") == short
    assert value(errors.error_detail, long) == "…" + long[-401:]
    assert value(errors.error_detail, "é" * 250) == "…" + "é" * 250


@pytest.mark.parametrize("x", [0.6, 2.4, 1.0, 2.0, 0.5, 3.0, -0.75, 0.0, 1e-40, 1.1754944e-38, 3.4e38, 16777216.0, 0.1, 1.9999999])
def test_float_bits(value, x):
    assert bytes(value(lambda c: digest.float_bits_le(c.cast("float")), x)) == struct.pack("<f", x)


def _digest(value, **changes):
    key = dict(video_id=ID, model="ggml-base", lang="fr", translate=False, vad=False, words=False, prompt=None, no_speech=None, entropy=None)
    key.update(changes)
    kinds = ["string", "string", "string", "boolean", "boolean", "boolean", "string", "float", "float"]
    return value(lambda *cs: digest.config_digest(*[c.cast(k) for c, k in zip(cs, kinds)]), *key.values())


def test_digest(value):
    plain = hashlib.sha256(f"{ID}\x1fggml-base\x1ffr\x1f".encode() + b"\0\0\0").hexdigest()
    assert _digest(value) == plain
    full = hashlib.sha256(
        f"{ID}\x1fggml-base\x1fauto\x1f".encode() + b"\1\1\1" + b"vad:j2\x1f" + "prompt\x1fété\x1f".encode()
        + b"no_speech_thold\x1f" + struct.pack("<f", 0.6) + b"entropy_thold\x1f" + struct.pack("<f", 2.4)).hexdigest()
    assert _digest(value, lang=None, translate=True, vad=True, words=True, prompt="été", no_speech=0.6, entropy=2.4) == full
    variants = [{}, {"video_id": "a"}, {"model": "m"}, {"lang": None}, {"translate": True}, {"vad": True}, {"words": True},
                {"prompt": "p"}, {"no_speech": 0.5}, {"entropy": 0.5}, {"entropy": 0.6}]
    assert len({_digest(value, **v) for v in variants}) == len(variants)


def test_memory(value):
    boolean = lambda f: (lambda d, w: f(d, w))
    assert value(boolean(admission.memory_required), 43_200.0, False) == (1 << 30) + 43_200 * 160_000
    assert value(boolean(admission.memory_required), -3.0, True) == 1 << 30
    assert value(admission.memory_budget, 199) == 85
    for available in (1 << 30, 8 << 30, 32 << 30):
        for words in (False, True):
            minutes = value(admission.max_minutes, available, words)
            if minutes:
                assert value(boolean(admission.memory_required), minutes * 60.0, words) <= value(admission.memory_budget, available)
            assert value(boolean(admission.memory_required), (minutes + 1) * 60.0, words) > value(admission.memory_budget, available)


def test_catalogue(value, spark):
    assert value(catalogue.model_id, "auto") == "ggml-base"
    assert value(lambda c: catalogue.model_id(c, gpu=True), "auto") == "ggml-large-v3-turbo-q5_0"
    assert value(catalogue.model_id, "silero") is None
    assert value(catalogue.resolve_any_alias, "vad") == "silero"
    assert value(catalogue.file_stem, "/a/b.c/model.v2.bin") == "model.v2"
    assert catalogue.model_catalogue(spark).count() == 6
    assert value(catalogue.translate_supported, "My-TURBO", True) is False


def test_samples(value):
    assert value(timecode.cs_to_samples, 120.0) == 19_200
    assert value(timecode.cs_to_samples, math.nan) == 0
    assert value(timecode.cs_to_samples, math.inf) == 0
    assert value(timecode.cs_to_samples, -1.0) == 0


def test_sql_functions_agree(spark):
    names = register(spark)
    assert len(names) == len(FUNCTIONS) == 26
    texts = ["  a   b ", "<b>x</b> &amp; y", "R&D <a>", "fr-FR", "un mot interminablementlong ici", "", None, "it's \\ \"q\"\n", "00:01.5", "1:02:03,250 --> 2:00:00.1 x",
             "https://youtu.be/abcdefghijk?list=1", "https://www.youtube.com/watch?v=abcdefghijk", "http://x", "Sign in to confirm", "ERROR: private video", "x" * 900]
    numbers = [None, 0, -5, 13, 61, 3661125, 8589934592]
    flags = [None, True, False]
    rnd = random.Random(2)
    pick = {"STRING": lambda: rnd.choice(texts), "BIGINT": lambda: rnd.choice(numbers), "INT": lambda: rnd.choice([None, 0, 9, 12, 42]),
            "DOUBLE": lambda: rnd.choice([None, 0.0, -1.5, 61.0, math.nan, math.inf]), "FLOAT": lambda: rnd.choice([None, 0.6, 2.4]),
            "BOOLEAN": lambda: rnd.choice(flags)}
    for name, (parameters, make) in FUNCTIONS.items():
        columns = [p.split(" ") for p in parameters.split(", ")]
        frame = spark.createDataFrame([tuple(pick[t]() for _, t in columns) for _ in range(60)], parameters)
        args = ", ".join(n for n, _ in columns)
        both = frame.select(make(*[F.col(n) for n, _ in columns]).alias("a"), F.expr(f"cue_{name}({args})").alias("b"))
        assert both.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == [], name
        assert both.schema["a"].dataType.simpleString() == both.schema["b"].dataType.simpleString(), name
    row = spark.sql("SELECT cue_format_timestamp(3661125, ','), cue_max_minutes(8589934592, true), cue_memory_required(1.5, false), cue_is_live(null, 'post_live'), cue_duration_min(61.0)").first()
    assert tuple(row) == ("01:01:01,125", (8589934592 // 100 * 85 - (1 << 30)) // 224_000 // 60, (1 << 30) + 240_000, True, 2)
