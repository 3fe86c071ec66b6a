"""Operators on literal cases, and on random data with tiny blocks against
plain loops: the blocks must not show in any result."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from cueweave.operators import audio, audits, blocks, captions, cues, events, planning, quality, render, results, timeline, words
from cueweave.operators.blocks import lookup_join
from cueweave.streaming import batches, status

SEGMENTS = "media_id BIGINT, segment_id BIGINT, start_ms BIGINT, end_ms BIGINT, text STRING"


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


# --- cues --------------------------------------------------------------------


def plain_wrap(text, width):
    out, line = [], ""
    for word in text.split():
        if len(word) > width:
            if line:
                out.append(line)
            parts = [word[i:i + width] for i in range(0, len(word), width)]
            out += parts[:-1]
            line = parts[-1]
        elif line and len(line) + 1 + len(word) <= width:
            line += " " + word
        else:
            if line:
                out.append(line)
            line = word
    return out + [line] if line else out


def plain_cues(segments, width=42, per=2, low=1000.0, high=7000.0):
    found = []
    for _, start, end, text in segments:
        lines = plain_wrap(text, width)
        groups = [lines[i:i + per] for i in range(0, len(lines), per)]
        sizes = [sum(map(len, g)) for g in groups]
        at = float(start)
        for k, g in enumerate(groups):
            stop = float(end) if k == len(groups) - 1 else start + (end - start) * (sum(sizes[:k + 1]) / sum(sizes))
            found.append([at, stop, g])
            at = stop
    for k, c in enumerate(found):
        if c[1] - c[0] > high:
            c[1] = c[0] + high
        if c[1] - c[0] < low:
            c[1] = max(min(c[0] + low, found[k + 1][0]), c[1]) if k + 1 < len(found) else c[0] + low
    return [(k + 1, int(s + 0.5), int(e + 0.5), tuple(g)) for k, (s, e, g) in enumerate(found)]


def random_segments(seed, media=3, count=60):
    rnd = random.Random(seed)
    data = []
    for m in range(media):
        t = 0
        for i in range(count):
            length = rnd.choice([50, 400, 3_000, 20_000])
            words_ = [rnd.choice(["a", "bonjour", "é" * 5, "x" * 60, "und", "der"]) for _ in range(rnd.choice([0, 1, 5, 40]))]
            data.append((m, i, t, t + length, rnd.choice(["", " "]) + "  ".join(words_)))
            t += length + rnd.choice([0, 200, 2_000])
    return data


def test_cues_do_not_depend_on_blocks(spark):
    data = random_segments(1)
    frame = spark.createDataFrame(data, SEGMENTS)
    for block in (3, 65_536):
        got = cues.build_cues(frame, block_segments=block)
        for m in range(3):
            want = plain_cues([(i, s, e, t) for mm, i, s, e, t in data if mm == m])
            have = [(r[0], r[1], r[2], tuple(r[3])) for r in rows(got.where(F.col("media_id") == m), "cue_index", "start_ms", "end_ms", "lines")]
            assert have == want


@pytest.mark.parametrize("segments,ends", [
    ([(0, 30_000, "court")], [7_000]), ([(0, 200, "bref")], [1_000]),
    ([(0, 200, "un"), (300, 500, "deux"), (600, 5_000, "trois")], [300, 600, 5_000])])
def test_cue_durations(spark, segments, ends):
    frame = spark.createDataFrame([(1, i, *s) for i, s in enumerate(segments)], SEGMENTS)
    for block in (1, 100):
        got = rows(cues.build_cues(frame, block_segments=block), "cue_index", "start_ms", "end_ms")
        assert [e for _, _, e in got] == ends
    plain = frame.select("media_id", F.col("segment_id").alias("cue_index"), "start_ms", "end_ms")
    assert [e for _, e in rows(cues.clamp_cue_durations(plain, block_cues=2), "cue_index", "end_ms")] == ends


# --- captions ----------------------------------------------------------------

ROLLING = """WEBVTT
Kind: captions
Language: fr

00:00:00.120 --> 00:00:03.500 align:start position:0%
 
<00:00:00.500><c>bonjour</c> à tous

00:00:03.500 --> 00:00:03.510 align:start position:0%
bonjour à tous
 

00:00:03.510 --> 00:00:07.000 align:start position:0%
bonjour à tous
et bienvenue<00:00:04.000><c> ici</c>
"""


def parsed(spark, text):
    frame = captions.parse_vtt(spark.createDataFrame([("f", text)], "media_id STRING, text STRING"))
    return rows(frame, "segment_id", "start_ms", "end_ms", "text")


def test_rolling_captions(spark):
    assert parsed(spark, ROLLING) == [(0, 120, 3500, "bonjour à tous"), (1, 3510, 7000, "et bienvenue ici")]
    assert parsed(spark, ROLLING.replace("\n", "\r\n")) == parsed(spark, ROLLING)


def test_vtt_corners(spark):
    assert parsed(spark, "WEBVTT\n\nNOTE a --> b\n\n1\n00:01,500 --> 00:02.000\nA &amp; B\nA &amp; B\n") == [(0, 1500, 2000, "A & B A & B")]
    # A timing line inside a body is text; like any text it loses its `>`.
    assert parsed(spark, "\n00:01.0 --> 00:02.0\nx\n00:05.0 --> 00:06.0\n\n00:03.0 --> 00:04.0\n<c>\n") == [(0, 1000, 2000, "x 00:05.0 -- 00:06.0")]
    assert parsed(spark, "WEBVTT\n\n\n") == []
    status_ = captions.track_status(spark.createDataFrame([("f", "WEBVTT")], "media_id STRING, text STRING")).first()
    assert (status_["n_cues"], status_["error_code"]) == (0, 20)


def test_repeats_are_forgotten_after_eight_lines(spark):
    rnd = random.Random(5)
    bodies = [[rnd.choice("abcdefghijkl") for _ in range(rnd.randint(0, 4))] for _ in range(1500)]
    text = "WEBVTT\n\n" + "\n".join(f"00:00.{i % 1000:03d} --> 00:01.000\n" + "".join(f"{l}\n" for l in b) for i, b in enumerate(bodies))
    recent, want = [], []
    for b in bodies:
        fresh = [l for l in b if l not in recent]
        if fresh:
            recent = (recent + fresh)[-8:]
            want.append(" ".join(fresh))
    assert [r[3] for r in parsed(spark, text)] == want


# --- timeline ----------------------------------------------------------------


def plain_merge(spans, length, overlap):
    out = []
    for s, e in sorted((min(s, length), min(e, length)) for s, e in spans):
        if e <= s:
            continue
        e = min(e + overlap, length)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def plain_map(merged, silence):
    pieces, at = [], 0
    for k, (s, e) in enumerate(merged):
        pieces.append((at, s, e - s, e - s))
        at += e - s
        if k + 1 < len(merged):
            gap = merged[k + 1][0] - e
            pieces.append((at, e, min(gap, silence), gap))
            at += min(gap, silence)
    return pieces


def plain_remap(pieces, p):
    if not pieces:
        return p
    hit = [x for x in pieces if x[0] <= p][-1]
    inside = p - hit[0]
    if inside >= hit[2]:
        return hit[1] + hit[3] + inside - hit[2]
    return hit[1] + inside * hit[3] // hit[2]


SPANS = "media_id BIGINT, start BIGINT, end BIGINT, length BIGINT"


def test_known_timeline(spark):
    spans = spark.createDataFrame([(1, 16_000, 32_000, 128_000), (1, 80_000, 96_000, 128_000)], SPANS)
    pieces = timeline.compact_timeline(timeline.merge_spans(spans))
    assert pieces.agg(F.sum("processed_len")).first()[0] == 36_800
    points = spark.createDataFrame([(1, 18_400), (1, 36_900), (1, 120 * 160), (2, 7)], "media_id BIGINT, processed BIGINT")
    got = dict(rows(timeline.remap_timeline(points, pieces), "processed", "original"))
    assert got == {18_400: 56_800, 36_900: 97_700, 19_200: 80_000, 7: 7}
    close = spark.createDataFrame([(1, 0, 1000, 128_000), (1, 1500, 3000, 128_000)], SPANS)
    assert rows(timeline.merge_spans(close), "start", "end") == [(0, 4600)]


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_timeline_does_not_depend_on_blocks(spark, block):
    rnd = random.Random(block)
    spans = {m: [(s, s + rnd.choice([0, 1, 5, 30, 300])) for s in (rnd.randrange(3_000) for _ in range(120))] for m in range(3)}
    spans[0] += [(5, 5_000)]
    data = [(m, s, e, 2_500) for m in spans for s, e in spans[m]] * 2
    merged = timeline.merge_spans(spark.createDataFrame(data, SPANS), 2, block)
    pieces = timeline.compact_timeline(merged, 4, block)
    points = [(m, p) for m in range(4) for p in range(0, 3_000, 13)]
    frame = spark.createDataFrame(points, "media_id BIGINT, processed BIGINT")
    mapped = timeline.remap_timeline(frame, pieces, block_samples=block)
    for m in range(4):
        want = plain_merge(spans.get(m, []), 2_500, 2)
        assert rows(merged.where(F.col("media_id") == m), "start", "end") == want
        table = plain_map(want, 4)
        assert rows(pieces.where(F.col("media_id") == m), "processed", "original", "processed_len", "original_len") == table
        got = rows(mapped.where(F.col("media_id") == m), "processed", "original")
        assert got == [(p, plain_remap(table, p)) for p in range(0, 3_000, 13)]
        assert all(a[1] <= b[1] for a, b in zip(got, got[1:]))


# --- words, quality ----------------------------------------------------------


@pytest.mark.parametrize("block", [2, 1000])
def test_words(spark, block):
    rnd = random.Random(3)
    tokens = [(1, s, i, rnd.choice([5, 5, 5, 60_000]), rnd.choice([" a", "b", "é", "  ", " cd"]), 10 * i, 10 * i + 7, rnd.randrange(100) / 100)
              for s in range(5) for i in range(40)]
    frame = spark.createDataFrame(tokens, "media_id BIGINT, segment_id BIGINT, token_index BIGINT, token_id BIGINT, text STRING, t0 BIGINT, t1 BIGINT, probability DOUBLE")
    want = []
    for s in range(5):
        made = []
        for _, ss, i, tid, text, t0, t1, p in tokens:
            if ss != s or tid >= 50_257 or not text.strip():
                continue
            if text.startswith(" ") or not made:
                made.append([s, i, text.lstrip(), t0, t1, [p]])
            else:
                made[-1][2] += text
                made[-1][4] = t1
                made[-1][5].append(p)
        want += [(s_, i, w, a, b, round(sum(p) / len(p), 9)) for s_, i, w, a, b, p in made]
    got = rows(words.assemble_words(frame, block_tokens=block).withColumn("probability", F.round("probability", 9)),
               "segment_id", "word_id", "word", "start", "end", "probability")
    assert got == sorted(want)


def test_words_of_segments_that_hold_their_tokens_are_not_shuffled(spark):
    schema = "media_id BIGINT, segment_id BIGINT, token_index BIGINT, token_id BIGINT, text STRING, t0 BIGINT, t1 BIGINT, probability DOUBLE"
    texts = ["he", "llo", " wor", "ld", "  ", " [x]", "!", "\u3000a", " b", None, "c"]
    flat = spark.createDataFrame(
        [(m, s, i, 50_300 if t == " [x]" else i, t, i * 10, None if i == 3 else i * 10 + 9, None if i % 4 == 1 else i / 16)
         for m in (1, 2, None) for s in (0, 1, None) for i, t in enumerate(texts[s or 0:])], schema)
    held = flat.groupBy("media_id", "segment_id").agg(F.reverse(F.collect_list(F.struct(*flat.columns[:1:-1]))).alias("tokens"))
    found = words.words_of_segments(held.localCheckpoint())
    names = ("media_id", "segment_id", "word_id", "word", "start", "end", "probability")
    assert rows(found, *names) == rows(words.assemble_words(flat), *names) == rows(words.assemble_words(flat, block_tokens=2), *names)
    assert found.count() > 8 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_cut_once_per_segment(spark):
    from cueweave.plans import bindings

    docs = spark.createDataFrame([(1, "one  twothree\n\n four five six seven eight nine"), (2, ""), (3, None), (4, "x " * 400)], "doc_id BIGINT, text STRING")
    made = words.transcribable_tokens(bindings.tokens(docs)).groupBy("media_id").agg(F.count("*").alias("n"))
    # Cut in a filter too, the text of a segment was cut once for each of its tokens.
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert rows(made, "media_id", "n") == [(1, 11), (4, 400)]
    listed = bindings.token_lists(docs).select("media_id", "segment_id", F.explode("tokens").alias("t")).select("media_id", "segment_id", "t.*")
    assert rows(bindings.tokens(docs), *listed.columns) == rows(listed, *listed.columns)


def test_both_bounds_in_one_shuffle(spark):
    pieces = spark.createDataFrame(
        [(m, p * 700, p * 1_000 + m, 700, 700 if p % 2 else 900) for m in (1, 2) for p in range(1, 9)],
        "media_id BIGINT, processed BIGINT, original BIGINT, processed_len BIGINT, original_len BIGINT")
    spans = [(m, i, a, a + i * 37 % 200) for m in (1, 2, 3) for i, a in enumerate(range(0, 8_000, 90))]
    points = spark.createDataFrame([*spans, (1, 100, None, None)], "media_id BIGINT, id BIGINT, a BIGINT, b BIGINT")
    near = points.where(timeline.block_of_sample("a", 1_024).eqNullSafe(timeline.block_of_sample("b", 1_024)))
    got = timeline.remap_bounds(near, pieces, "a", "b", block_samples=1_024)
    twice = timeline.remap_timeline(
        timeline.remap_timeline(near, pieces, "a").withColumnRenamed("original", "_start"), pieces, "b").withColumnRenamed("original", "_end")
    names = ("media_id", "id", "a", "b", "_start", "_end")
    assert 200 < near.count() < len(spans) and rows(got, *names) == rows(twice, *names)


def test_words_on_the_original_axis(spark):
    spans = spark.createDataFrame([(1, 160_000, 192_000, 10**12), (1, 10**10, 10**10 + 32_000, 10**12)], SPANS)
    pieces = timeline.compact_timeline(timeline.merge_spans(spans))
    second = 192_000 - 160_000 + 1_600 + 1_600  # where the second span lies in compacted sound, years of silence left out
    made = spark.createDataFrame(
        [(1, 0, 0, "a", -3, 50), (1, 0, 2, "b", 190, second // 160 + 10), (1, 1, 5, "c", second // 160 + 100, second // 160 + 900),
         (2, 0, 0, "none", 7, 9), (None, 0, 0, "null", 1, None)],
        "media_id BIGINT, segment_id BIGINT, word_id BIGINT, word STRING, start BIGINT, end BIGINT")
    got = {r["word"]: (r["start_ms"], r["end_ms"]) for r in words.on_original_axis(made, pieces).collect()}
    far = 10**10 // 16
    assert got == {"a": (10_000, 10_500), "b": (11_900, far + 100), "c": (far + 1_000, far + 9_000), "none": (70, 90), "null": (10, None)}
    segs = spark.createDataFrame([(1, 0, 10_000, far + 100, ""), (1, 1, far, far + 9_000, "")], SEGMENTS)
    mapped = words.on_original_axis(made, pieces)
    assert words.words_outside_segment(mapped, segs).count() == 0
    left_out = made.withColumns({"start_ms": F.col("start") * 10, "end_ms": F.col("end") * 10})
    assert rows(words.words_outside_segment(left_out, segs), "word") == [("a",), ("b",), ("c",)]


def test_words_travel_packed_by_block(spark):
    rnd = random.Random(9)
    spans = spark.createDataFrame([(m, k * 900_000 + m, k * 900_000 + 300_000, 10**12) for m in (1, 2) for k in range(6)], SPANS)
    pieces = timeline.compact_timeline(timeline.merge_spans(spans)).localCheckpoint()
    token = lambda i, n: (i, i, " w" if i % 3 else "v", rnd.choice([None, -5, i * 9000 // n]), rnd.choice([None, i * 9000 // n + 40, 60_000]), i / 8)
    segs = [(m, s, [token(i, n) for i in range(n)]) for m in (1, 2, 3, None) for s, n in enumerate((0, 1, 7, 90))]
    held = spark.createDataFrame(
        segs, "media_id BIGINT, segment_id BIGINT, tokens ARRAY<STRUCT<token_index BIGINT, token_id BIGINT, text STRING, t0 BIGINT, t1 BIGINT, probability DOUBLE>>")
    packed = words.words_by_block(held).localCheckpoint()
    flat = words.words_of_segments(held).localCheckpoint()
    names = ("media_id", "segment_id", "word_id", "word", "probability", "start_ms", "end_ms")
    got, want = words.blocks_on_original_axis(packed, pieces), words.on_original_axis(flat, pieces)
    assert got.columns == want.columns == list(names)
    key = lambda found: sorted(found, key=repr)
    assert key(map(tuple, got.collect())) == key(map(tuple, want.collect())) and got.count() > 150
    assert packed.where("_near").count() > 6 and packed.where("NOT _near").count() > 6
    # One row of the shuffle for a segment's words in a block, not one a word.
    assert packed.where("_near AND media_id = 1").count() < packed.where("_near AND media_id = 1").select(F.explode("_words")).count()


def test_as_of_takes_the_last_step(spark):
    rnd = random.Random(4)
    steps = [(m, rnd.randrange(1000), i) for i, m in enumerate([1, 2, 2, 1, 2, None, None] * 9)]
    steps = list({(m, at): (m, at, i) for m, at, i in steps}.values())
    points = [(rnd.choice([1, 2, 3, None]), rnd.choice([None, *range(1000)]), i) for i in range(400)]
    left = spark.createDataFrame(points, "k INT, p BIGINT, _hit2 INT")
    right = spark.createDataFrame(steps, "k INT, at BIGINT, v INT")
    for width in (1, 13, 5000):
        got = {r["_hit2"]: (r["_hit"], r["_first"]) for r in blocks.as_of(left, right, ["k"], F.col("p"), F.col("at"), F.col("v"), width).collect()}
        for k, p, i in points:
            mine = sorted((at, v) for m, at, v in steps if m == k)
            upto = [v for at, v in mine if p is not None and at <= p]
            assert got[i] == (upto[-1] if upto else None, mine[0][1] if mine and p is not None else None)


def test_words_outside(spark):
    segs = spark.createDataFrame([(1, 0, 1_000, 2_000, "x")], SEGMENTS)
    frame = spark.createDataFrame([(1, 0, 0, 960, 1_900), (1, 0, 1, 940, 1_900), (1, 0, 2, 1_500, 2_051)],
                                  "media_id BIGINT, segment_id BIGINT, word_id BIGINT, start_ms BIGINT, end_ms BIGINT")
    assert rows(words.words_outside_segment(frame, segs), "word_id") == [(1,), (2,)]


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_runs_of_equal_texts(spark, block):
    rnd = random.Random(9)
    data = [(m, i, i * 100, i * 100 + 90, rnd.choice("aab")) for m in range(4) for i in range(50)]
    data += [(9, i, i, i, "same") for i in range(30)]
    frame = spark.createDataFrame(data, SEGMENTS)
    want = []
    for m in (0, 1, 2, 3, 9):
        mine, runs = [d for d in data if d[0] == m], []
        for _, i, s, e, t in mine:
            if runs and runs[-1][1] == t:
                runs[-1][2] += 1
                runs[-1][5] = e
            else:
                runs.append([m, t, 1, i, s, e])
        want += [tuple(r) for r in runs]
    got = quality.text_runs(frame, block)
    assert rows(got, "media_id", "text", "n", "first_segment", "start_ms", "end_ms") == sorted(want)
    best = {m: max((r for r in want if r[0] == m), key=lambda r: (r[2], -r[3])) for m in (0, 1, 2, 3, 9)}
    assert rows(quality.repeat_runs(frame, block), "media_id", "text", "n", "first_segment", "start_ms", "end_ms") == sorted(best.values())


def test_a_hot_media_is_spread(spark):
    """One media alone must not end up in one task."""
    frame = spark.range(4_000).select(
        F.lit(1).cast("bigint").alias("media_id"), F.col("id").alias("segment_id"), F.col("id").alias("start_ms"),
        F.col("id").alias("end_ms"), F.lit("x").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = quality.with_previous_start(frame, 100).select(F.spark_partition_id().alias("p"))
        sizes = [r["count"] for r in placed.groupBy("p").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 4_000
        left = frame.select("media_id", "segment_id")
        right = spark.createDataFrame([(1, "t")], "media_id BIGINT, title STRING").hint("shuffle_hash")
        joined = lookup_join(left, right, ["media_id"], ["segment_id"], hot_rows=100, salts=32)
        assert joined.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and joined.count() == 4_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_order_faults(spark):
    segs = spark.createDataFrame([(1, 0, 0, 10, "a"), (1, 1, 100, 90, "a"), (1, 2, 89, 120, "a"), (1, 3, -1, 9_000, "a")], SEGMENTS)
    media = spark.createDataFrame([(1, 5_000)], "media_id BIGINT, duration_ms BIGINT")
    for block in (1, 10):
        assert rows(quality.monotonic_check(segs, media, block), "segment_id", "faults") == [
            (1, "negative_length"), (2, "backward"), (3, "negative_start,backward,overrun")]


def test_overlap_of_vocabularies(spark):
    texts = spark.createDataFrame([(1, "Bonjour à TOUS, bienvenue ici!"), (2, "bonjour bienvenue tous"), (3, "le la un")], "media_id BIGINT, text STRING")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "left_id BIGINT, right_id BIGINT")
    assert rows(quality.vocab_overlap(pairs, texts), "left_id", "right_id", "left_words", "right_words", "shared", "overlap", "agrees") == [
        (1, 2, 3, 3, 3, 1.0, True), (1, 3, 3, 0, 0, 0.0, False)]


# --- results -----------------------------------------------------------------


@pytest.mark.parametrize("cap", [0, 1, 500, 2_000, 10**9])
def test_eviction(spark, cap):
    rnd = random.Random(4)
    data = [(f"{rnd.getrandbits(256):064x}", rnd.choice([0, 10, 50]), rnd.choice([7, 8, 1 << 40, 1_700_000_000_000_000 + rnd.randrange(5)])) for _ in range(200)]
    data += [(f"{i:064x}", 30, 8) for i in range(40)]
    frame = spark.createDataFrame(data, "digest STRING, bytes BIGINT, accessed BIGINT")
    total, want = 0, []
    for d, n, a in sorted(data, key=lambda x: (-x[2], x[0])):
        total += n
        want.append((d, total <= cap))
    assert rows(results.cache_evict(frame, cap), "digest", "kept") == sorted(want)


@pytest.mark.parametrize("cap", [0, 35, 130, 10**6])
def test_eviction_within_a_second(spark, cap):
    """Microseconds count, unknown times are the oldest, unknown sizes weigh nothing."""
    start = datetime.datetime(2024, 5, 1, 12)
    data = [(f"{i:02x}" * 32, 10 if i % 9 else None, None if i % 5 == 4 else start + datetime.timedelta(microseconds=(i * 7) % 11)) for i in range(40)]
    frame = spark.createDataFrame(data, "digest STRING, bytes BIGINT, accessed TIMESTAMP")
    total, want = 0, []
    for d, n, a in sorted(data, key=lambda x: (x[2] is None, -(x[2] or start).microsecond, x[0])):
        total += n or 0
        want.append((d, total <= cap))
    assert rows(results.cache_evict(frame, cap), "digest", "kept") == sorted(want)
    assert results.cache_evict(frame.limit(0), cap).count() == 0


def test_quantiles_of_more_runs_than_a_sketch_holds_are_exact(spark):
    n = 60_000
    runs = spark.range(n).select(
        F.lit(None).cast("string").alias("model"), F.when(F.col("id") % 3 == 0, "cpu").otherwise("gpu").alias("backend"), F.lit(True).alias("vad"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 7919 % 60_013 / 8).alias("speed"), (F.col("id") * 31 % 50_021).alias("peak_mb"), F.lit(1).alias("segments"))
    held = [(r["backend"], r["speed"], r["peak_mb"]) for r in runs.collect()]
    got = {r["backend"]: r for r in audits.bench_summary(runs).collect()}
    assert len(got) == 2
    for backend, row in got.items():
        for name, at in (("speed", 1), ("peak_mb", 2)):
            values = sorted(h[at] for h in held if h[0] == backend and h[at] is not None)
            for share in (50, 95):
                assert row[f"{name}_p{share}"] == values[-(-len(values) * share // 100) - 1]


def test_sketches_merge_within_their_error(spark):
    """50,000 runs in parts: ranks of the quantiles are off by less than half a percent; few runs are exact."""
    runs = spark.range(50_000).select(
        F.lit("m").alias("model"), F.when(F.col("id") < 10, "gpu").otherwise("cpu").alias("backend"), (F.col("id") % 2 == 0).alias("vad"),
        (F.col("id") * 7919 % 50_021).cast("double").alias("speed"), F.lit(1).alias("segments"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("peak_mb"),
        (F.col("id") % 7).alias("day"))
    parts = audits.bench_sketches(runs, ("model", "backend", "vad", "day"))
    got = {r["backend"]: r for r in audits.bench_figures(audits.merge_bench(parts, ("backend",))).collect()}
    for backend, r in got.items():
        mine = runs.where(F.col("backend") == backend)
        assert r["runs"] == mine.count() and r["mean_speed"] == pytest.approx(mine.agg(F.avg("speed")).first()[0])
        for name, share in (("speed_p50", 0.5), ("speed_p95", 0.95)):
            rank = mine.where(F.col("speed") <= r[name]).count() / r["runs"]
            assert abs(rank - share) < (0.005 if backend == "cpu" else 0.11)
    assert got["gpu"]["speed_p50"] == sorted(i * 7919 % 50_021 for i in range(10))[4]
    none = audits.bench_summary(runs.limit(3).withColumn("speed", F.lit(None).cast("double"))).collect()
    assert all(r["speed_p50"] is None and r["mean_speed"] is None for r in none)
    assert audits.bench_summary(runs.limit(0)).count() == 0


def test_replacing_entries(spark):
    schema = "digest STRING, entry_id BIGINT, written_at BIGINT, title STRING"
    old = spark.createDataFrame([("a", 1, 5, "old"), ("b", 2, 5, "kept")], schema)
    new = spark.createDataFrame([("a", 3, 6, "new"), ("c", 4, 1, "added")], schema)
    assert rows(results.cache_put(old, new), "digest", "title") == [("a", "new"), ("b", "kept"), ("c", "added")]


@pytest.mark.parametrize("how", ["left", "left_anti", "inner"])
def test_hot_keys_join_like_others(spark, how):
    left = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = left.join(right, "k", how)
    got = lookup_join(left, right, ["k"], ["id"], how, hot_rows=20, salts=5)
    assert rows(got, *want.columns) == rows(want, *want.columns)


@pytest.mark.parametrize("how", ["left", "left_anti", "inner"])
def test_null_keys_join_like_others(spark, how):
    left = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 10).alias("k"))
    right = spark.createDataFrame([(4, 1), (8, 2), (None, 3)], "k BIGINT, v INT")
    want = left.join(right, "k", how)
    got = lookup_join(left, right, ["k"], ["id"], how, hot_rows=20)
    nulls = lambda f: sorted((tuple(r) for r in f.select(*want.columns).collect()), key=repr)
    assert nulls(got) == nulls(want)


# --- planning ----------------------------------------------------------------

V, J = {"ext": "vtt", "url": "u-vtt", "name": None}, {"ext": "json3", "url": "u-json", "name": None}
NO_EXT, NO_URL = {"ext": None, "url": "u-none", "name": None}, {"ext": "vtt", "url": None, "name": None}


@pytest.mark.parametrize("subs,auto,asked,declared,want", [
    ({"fr": [V]}, {"fr": [J]}, None, "fr", ("fr", False, "u-vtt")),
    ({}, {"aa": [V], "fr": [V]}, None, "fr", ("fr", True, "u-vtt")),
    ({}, {"aa": [V], "fr": [V]}, None, None, None),
    ({"en": [J]}, {}, None, None, ("en", False, "u-json")),
    ({"fr-FR": [J, V]}, {}, "fr", None, ("fr-FR", False, "u-vtt")),
    ({"fr": [NO_URL, J]}, {"fr": [NO_EXT, J]}, "fr", "en", ("fr", True, "u-none")),
    ({"fr-CA": [V], "fr": [J]}, {}, "fr", None, ("fr", False, "u-json")),
    (None, None, "fr", None, None),
    ({"fr": []}, {"fr": [V]}, "fr", None, ("fr", True, "u-vtt")),
    ({"en": [V]}, {"de": [V]}, "fr", None, None)])
def test_track_choice(spark, subs, auto, asked, declared, want):
    row = spark.createDataFrame([(subs, auto, asked, declared)], f"s {planning.NO_CAPTIONS}, a {planning.NO_CAPTIONS}, r STRING, d STRING")
    got = row.select(planning.select_track(F.col("s"), F.col("a"), F.col("r"), F.col("d")).alias("t")).first()["t"]
    assert (tuple(got) if got else None) == want


def test_admission(spark):
    schema = "id INT, duration DOUBLE, is_live BOOLEAN, live_status STRING, max_duration_min BIGINT, word_timestamps BOOLEAN, available_bytes BIGINT"
    data = [(1, 18_000.0, None, None, 240, False, None), (2, 86_400.0, None, None, 720, False, None), (3, 10.0, True, None, 720, False, None),
            (4, 10.0, False, "is_upcoming", 720, False, None), (5, None, None, None, 1, False, 1), (6, 3_600.0, None, None, 720, True, 1 << 30),
            (7, 3_600.0, None, None, 60, False, 8 << 30)]
    got = planning.admit_requests(spark.createDataFrame(data, schema))
    assert rows(got.fillna(0, ["code"]), "id", "code") == [(1, 14), (2, 14), (3, 13), (4, 13), (5, 0), (6, 15), (7, 0)]
    first = got.where("id = 1").first()
    assert (first["actual_min"], first["limit_min"]) == (300, 240)
    refused = got.where("id = 6").first()
    assert (refused["actual_min"], refused["limit_min"], refused["available_mb"], refused["limit_without_words_min"]) == (60, 0, 1024, 0)


def plan(spark, hit=(), probe=None, installed=("ggml-base.bin", "ggml-silero-v5.1.2.bin"), **options):
    request = {"request_id": 1, "url": "https://youtu.be/dQw4w9WgXcQ", **options}
    kinds = {"prefer_subs": "BOOLEAN", "translate": "BOOLEAN", "use_cache": "BOOLEAN", "max_duration_min": "BIGINT", "available_bytes": "BIGINT", "request_id": "BIGINT"}
    raw = spark.createDataFrame([tuple(request.values())], ", ".join(f"{k} {kinds.get(k, 'STRING')}" for k in request))
    facts = {"video_id": "dQw4w9WgXcQ", "duration": 600.0, "language": "fr", "is_live": False, "live_status": None, "subtitles": {}, "automatic_captions": {}, **(probe or {})}
    probes = spark.createDataFrame([tuple(facts.values())], f"video_id STRING, duration DOUBLE, language STRING, is_live BOOLEAN, live_status STRING, subtitles {planning.NO_CAPTIONS}, automatic_captions {planning.NO_CAPTIONS}")
    ready = planning.with_request_defaults(raw)
    stored = planning.with_digest(ready).select("digest") if hit else spark.createDataFrame([], "digest STRING")
    row = planning.plan_requests(ready, probes, stored, installed).first()
    return (row["outcome"], row["code"])


SUBS = {"subtitles": {"fr": [V]}}


@pytest.mark.parametrize("want,options", [
    (("inference", None), {}), (("refused", 10), {"url": "https://evil.tld/x"}), (("refused", 30), {"model": "nope"}),
    (("refused", 40), {"model": "turbo", "translate": True}), (("cache", None), {"hit": True, "installed": ()}),
    (("inference", None), {"hit": True, "use_cache": False}), (("refused", 30), {"installed": ()}),
    (("refused", 13), {"probe": {"is_live": True, **SUBS}, "prefer_subs": True}), (("refused", 14), {"max_duration_min": 9}),
    (("subtitles", None), {"prefer_subs": True, "probe": SUBS, "max_duration_min": 1, "installed": ()}),
    (("refused", 14), {"prefer_subs": True, "max_duration_min": 1, "installed": ()}), (("refused", 30), {"prefer_subs": True, "installed": ()}),
    (("refused", 15), {"available_bytes": 1 << 30}), (("refused", 20), {"probe": {"video_id": "otherotherx"}}),
    (("inference", None), {"probe": {"duration": None}, "available_bytes": 1})])
def test_planning_order(spark, want, options):
    assert plan(spark, **options) == want


# --- events ------------------------------------------------------------------


def test_rising_progress(spark):
    data = [(1, i, p) for i, p in enumerate([0, 0, 1, 1, 1, 0, 2, 2])] + [(2, 0, -1), (2, 1, 5)]
    frame = spark.createDataFrame(data, "task_id BIGINT, seq BIGINT, percent INT")
    assert rows(events.progress_highwater(frame), "task_id", "percent") == [(1, 0), (1, 1), (1, 2), (2, 5)]


def plain_coalesce(messages):
    out = []
    for seq, kind, item in messages:
        last = out[-1] if out else None
        same = last and last["type"] == kind and (kind != "download" or last["item"] == item)
        if same and kind in ("progress", "download"):
            last["rows"] = [seq]
        elif same and kind == "segments":
            last["rows"].append(seq)
        else:
            out.append({"type": kind, "item": item, "rows": [seq], "first": seq})
    return sorted((s, m["first"]) for m in out for s in m["rows"])


@pytest.mark.parametrize("block,hot", [(3, 0), (1 << 20, 10**6)])
def test_merging_of_neighbours(spark, block, hot):
    rnd = random.Random(6)
    data = [(t, i, rnd.choice(["progress", "segments", "download", "notice"]), rnd.choice(["base", "silero"])) for t in range(3) for i in range(80)]
    frame = spark.createDataFrame(data, "task_id BIGINT, seq BIGINT, type STRING, item STRING")
    got = events.coalesce_events(frame, ["task_id"], block_events=block, hot_rows=hot)
    for t in range(3):
        assert rows(got.where(F.col("task_id") == t), "seq", "message_seq") == plain_coalesce([d[1:] for d in data if d[0] == t])
    burst = [(1, i, "progress", "") for i in range(1000)] + [(1, 1000 + i, "segments", "") for i in range(500)]
    merged = events.coalesce_events(spark.createDataFrame(burst, frame.schema), ["task_id"], block_events=block, hot_rows=hot)
    assert merged.count() == 501 and merged.select("message_seq").distinct().count() == 2


def test_settling_split_batches(spark):
    """A window cut by two micro-batches ends like an uncut one."""
    data = [(1, i, 1_000 + i, "progress" if i < 6 else "segments", "x") for i in range(12)]
    frame = spark.createDataFrame(data, "task_id BIGINT, seq BIGINT, ts_ms BIGINT, type STRING, item STRING")
    whole = batches.coalesce_batch(frame)
    halves = batches.coalesce_batch(frame.where("seq < 4")).unionByName(batches.coalesce_batch(frame.where("seq >= 4 AND seq < 9"))).unionByName(
        batches.coalesce_batch(frame.where("seq >= 9")))
    assert rows(batches.settled(halves.withColumn("batch", F.lit(0))), "seq", "message_seq") == rows(whole, "seq", "message_seq")


def test_projection(spark):
    frame = spark.createDataFrame([("CacheKey", ""), ("CacheHit", ""), ("SubtitlesFallback", ""), ("Segment", " a "), ("Progress", "")], "kind STRING, text STRING")
    assert rows(events.project_events(frame, text="text"), "kind", "type", "text") == [
        ("CacheHit", "phase", ""), ("Progress", "progress", ""), ("Segment", "segments", "a"), ("SubtitlesFallback", "notice", "")]


# --- audio, audits, rendering ------------------------------------------------


@pytest.mark.parametrize("block", [2, 1000])
def test_pcm_across_chunks(spark, block):
    rnd = random.Random(2)
    data = bytes(rnd.randrange(256) for _ in range(301))
    cuts = sorted([0, 301] + [rnd.randrange(301) for _ in range(20)] + [50, 50])
    chunks = [(1, i, bytearray(data[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    frame = spark.createDataFrame(chunks, "media_id BIGINT, chunk_no BIGINT, bytes BINARY")
    got = [x for r in audio.pcm_decode(frame, block).orderBy("chunk_no").collect() for x in r["samples"]]
    want = [int.from_bytes(data[i:i + 2], "little", signed=True) / 32768 for i in range(0, 300, 2)]
    assert got == pytest.approx(want)
    assert rows(audio.pcm_summary(frame), "n_samples", "pending_byte", "error_code") == [(150, True, None)]
    empty = spark.createDataFrame([(1, 0, bytearray(b"x"))], frame.schema)
    assert rows(audio.pcm_summary(empty), "n_samples", "pending_byte", "error_code") == [(0, True, 20)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_chunk_log(spark, block):
    log = [(0, 206, "bytes 0-9/30", 10), (1, 206, "bytes 10-19/30", 10), (2, 206, "bytes 21-29/30", 9), (3, 200, None, 30),
           (4, 206, "bytes 30-30/*", 1), (5, 206, "garbage", 1), (6, 206, "bytes 32-32/33", 1)]
    frame = spark.createDataFrame([("d", *x) for x in log], "download_id STRING, seq BIGINT, status INT, content_range STRING, length BIGINT")
    got = rows(audits.chunk_contiguity(frame, block), "seq", "received_before", "contiguous")
    assert got == [(0, 0, True), (1, 10, True), (2, 20, False), (3, 0, True), (4, 30, True), (5, 31, False), (6, 32, True)]


def test_checksums(spark):
    text = f"{'a' * 64}  tool\n{'b' * 64} *tool.exe\nshort tool.exe\n{'c' * 64} tool\n"
    frame = spark.createDataFrame([(1, text)], "id INT, text STRING")
    assert rows(audits.parse_checksums(frame), "name", "sum") == [("*tool.exe", "b" * 64), ("tool", "a" * 64)]


def test_rendered_texts(spark):
    segs = spark.createDataFrame([(1, 0, 0, 2_500, " Bonjour à tous"), (1, 1, 2_500, 5_000, " et bienvenue."), (2, 0, 0, 1_000, "R&D <x>"), (3, 0, 0, 5, " ")], SEGMENTS)
    text = dict(rows(render.render("text", segs), "media_id", "content"))
    assert text == {1: "Bonjour à tous et bienvenue.\n", 2: "R&D <x>\n"}
    srt = dict(rows(render.render("SRT", segs), "media_id", "content"))
    assert srt[1] == "1\n00:00:00,000 --> 00:00:02,500\nBonjour à tous\n\n2\n00:00:02,500 --> 00:00:05,000\net bienvenue.\n\n"
    vtt = dict(rows(render.render("webvtt", segs), "media_id", "content"))
    assert vtt[2] == "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nR&amp;D &lt;x&gt;\n\n"
    with pytest.raises(ValueError):
        render.render("xml", segs)


def test_parts_make_the_whole(spark):
    frame = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 900, f"mot {i}" if i % 3 else " ") for i in range(50)], SEGMENTS)
    built = cues.build_cues(frame)
    docs = spark.createDataFrame([(1, {"title": "é"}, {"model": "m"}), (2, {"title": "vide"}, {"model": "m"})],
                                 "media_id BIGINT, source STRUCT<title: STRING>, run STRUCT<model: STRING>")
    join = lambda f, m: "".join(r["content"] for r in f.where(F.col("media_id") == m).orderBy("part").collect())
    for make in (lambda n: render.render_txt(frame, n), lambda n: render.render_srt(built, n), lambda n: render.render_vtt(built, n),):
        assert make(7).count() > 3
        assert join(make(7), 1) == join(make(1000), 1)
    import json

    for n in (7, 1000):
        doc = json.loads(join(render.render_json(docs, frame, n), 1))
        assert doc["schema_version"] == 1 and doc["source"] == {"title": "é"} and len(doc["segments"]) == 50
        assert doc["segments"][4] == {"id": 4, "start": 4.0, "end": 4.9, "text": "mot 4"}
        assert json.loads(join(render.render_json(docs, frame, n), 2))["segments"] == []


def test_watch(spark):
    states = ["success", "failure", "inconclusive", "failure", "success", "success", "failure"]
    frame = spark.createDataFrame([(1, d * 86_400_000, d, s) for d, s in enumerate(states)], "target_id BIGINT, ts_ms BIGINT, seq BIGINT, state STRING")
    assert rows(status.watch_actions(frame), "day", "action") == [(1, "open"), (3, "append"), (4, "close"), (6, "open")]
    assert rows(status.incidents(status.watch_actions(frame)), "opened", "failures") == [(1, 2), (6, 1)]


def test_quality_verdict(spark):
    """Loops are a note, whatever their case; captions that say something else fail the verdict."""
    said = ["Hello wonderful world"] + ["Again AGAIN", "again again"] * 3
    segs = spark.createDataFrame([(m, i, i * 1000, i * 1000 + 900, t) for m in (1, 2, 3) for i, t in enumerate(said)], SEGMENTS)
    media = spark.createDataFrame([(m, 7000, "en", "en") for m in (1, 2, 3)], "media_id BIGINT, duration_ms BIGINT, language STRING, detected STRING")
    captions = spark.createDataFrame([(1, "hello WONDERFUL world again"), (2, "quite another caption text"), (2, "more lines")], "media_id BIGINT, text STRING")
    assert rows(quality.repeated_segments(segs), "media_id", "text", "n") == [(m, "Again AGAIN", 6) for m in (1, 2, 3)]
    got = quality.quality_report(segs, media, captions=captions)
    assert rows(got.fillna(-1.0, ["overlap"]), "media_id", "loops", "overlap", "anomalies", "passed") == [
        (1, 1, 1.0, 0, True), (2, 1, 0.0, 1, False), (3, 1, -1.0, 0, True)]
    assert "overlap" not in quality.quality_report(segs, media).columns


def test_paths_are_compared_in_one_count_per_word(spark):
    left = spark.createDataFrame([(1, 0, 0, 5, "alpha bravo alpha"), (1, 1, 5, 9, "charlie"), (2, 0, 0, 4, "xray xray"), (3, 0, 0, 1, ""), (None, 0, 0, 1, "november")], SEGMENTS)
    right = spark.createDataFrame([(1, 0, 0, 7, "bravo delta bravo"), (4, 0, 0, 4, "yankee zulu"), (3, 0, 0, 1, "quebec"), (None, 0, 0, 1, "november")], SEGMENTS)
    found = quality.compare_paths(left, right)
    got = {r["media_id"]: r["overlap"] for r in found.where("media_id IS NOT NULL").collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}
    # Only media are joined: a join by words would sort both vocabularies.
    joins = re.findall(r"Join .*", found._jdf.queryExecution().optimizedPlan().toString())
    assert joins and not any("word" in j for j in joins)


def _optimised(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_cues_wrap_a_text_once_per_pass(spark):
    """The filter on wrapped lines is not a second wrapping: one pass over the rows, one for the blocks."""
    segs = spark.createDataFrame([(1, 0, 0, 900, "a word"), (1, 1, 900, 950, "  ")], SEGMENTS)
    made = cues.build_cues(segs)
    assert [r.lines for r in made.collect()] == [["a word"]]
    assert not any("regexp_extract_all" in line and "Filter" in line for line in _optimised(made).splitlines())
    assert _optimised(made).count("regexp_extract_all") == 2


def test_formats_of_cues_share_one_pass(spark):
    segs = spark.createDataFrame(
        [(m, i, i * 900, i * 900 + 800, f"Line {i} & so on " * (1 + i % 4)) for m in (1, 2) for i in range(9)] + [(3, 0, 0, 10, " ")],
        SEGMENTS)
    names = ["TXT", "srt", "WebVTT", "srt"]
    got = render.render_formats(names, segs, part_rows=4)
    columns = ["media_id", "part", "content", "format"]
    want = [r for name in names for r in rows(render.render(name, segs, part_rows=4), *columns)]
    assert rows(got, *columns) == sorted(want)
    assert _optimised(render.render_formats(["srt", "vtt"], segs)).count("row_number()") == _optimised(render.render("srt", segs)).count("row_number()")
    with pytest.raises(ValueError):
        render.render_formats(["xml"], segs)
