"""Quality of transcripts: coverage, loops, order, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions.text import words_of
from cueweave.operators.blocks import BLOCK, MULTI, block_of, block_scan, in_block, lookup_join, stitch

# Verdict thresholds.
MIN_COVERAGE_CAPTIONS = 0.9
MIN_COVERAGE_RECOGNISED = 0.95
MIN_OVERLAP = 0.55
# Arrays that the vocabulary of a media is kept in.
VOCABULARY_PARTS = 8
SHORT_CUE_MS = 100
MAX_REPEATS = 3
TOP_REPEATS = 5
SHOWN_CHARS = 55
NO_SPEECH_THRESHOLD = 0.6
BACKWARD_TOLERANCE_MS = 10
OVERRUN_TOLERANCE_MS = 1_000
BLOCK_SEGMENTS = 65_536


def short_cues(segments: DataFrame, under_ms: int = SHORT_CUE_MS) -> DataFrame:
    return segments.where(F.col("end_ms") - F.col("start_ms") < under_ms)


def filter_no_speech(segments: DataFrame, threshold: float = NO_SPEECH_THRESHOLD) -> DataFrame:
    """Drop segments that are probably not speech; unknown probability keeps them."""
    return segments.where(F.coalesce(F.col("no_speech_prob"), F.lit(0.0)) <= threshold)


def coverage(segments: DataFrame, media: DataFrame, minimum: float = MIN_COVERAGE_CAPTIONS) -> DataFrame:
    """(media_id, covered_ms, duration_ms, coverage, sufficient).

    Covered is the end of the last segment, not the greatest end.
    """
    covered = segments.groupBy("media_id").agg(F.max_by("end_ms", "segment_id").alias("covered_ms"))
    return covered.join(media.select("media_id", "duration_ms"), "media_id").select(
        "media_id", "covered_ms", "duration_ms",
        (F.col("covered_ms") / F.col("duration_ms")).alias("coverage"),
        (F.col("covered_ms") > F.col("duration_ms") * minimum).alias("sufficient"),
    )


def repeated_segments(segments: DataFrame, more_than: int = MAX_REPEATS) -> DataFrame:
    """(media_id, text, n) of texts met in more than 3 segments of one media.

    Case does not matter; the text is shown as its first segment has it.
    """
    return (
        segments.groupBy("media_id", F.lower("text").alias("_same"))
        .agg(F.min_by("text", "segment_id").alias("text"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > more_than).drop("_same")
    )


def top_repeats(segments: DataFrame, k: int = TOP_REPEATS, shown: int = SHOWN_CHARS) -> DataFrame:
    """The k most repeated texts of each media, cut for display.

    The rank filter is applied before the exchange too (window group limit), so
    a media with very many repeated texts sends at most k rows per task.
    """
    rank = Window.partitionBy("media_id").orderBy(F.col("n").desc(), F.col("text"))
    label = F.when(F.length("text") > shown, F.concat(F.substring("text", 1, shown), F.lit("..."))).otherwise(F.col("text"))
    return (
        repeated_segments(segments)
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select("media_id", "rank", "n", label.alias("label"))
    )


def text_runs(segments: DataFrame, block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """Runs of consecutive segments with the same text:
    (media_id, text, n, first_segment, last_segment, start_ms, end_ms)."""
    keys = ["media_id"]
    placed = block_scan(
        segments.select("media_id", "segment_id", "start_ms", "end_ms", "text",
                        block_of(F.col("segment_id"), block_segments).alias(BLOCK)),
        keys, [F.max_by("text", "segment_id").alias("_last_text")],
        lambda order, before: {"_previous": F.lag("_last_text").over(order)},
    )
    ordered, _ = in_block(keys, "segment_id")
    previous = F.coalesce(F.lag("text").over(ordered), F.col("_previous"))

    def cut(rows: DataFrame) -> DataFrame:
        return (
            rows.withColumn("_opens", F.coalesce(F.col("text") != previous, F.lit(True)))
            .withColumn("_no", F.sum(F.col("_opens").cast("bigint")).over(ordered))
            .groupBy(*keys, BLOCK, "_no")
            .agg(
                F.first("text").alias("text"),
                F.count(F.lit(1)).alias("n"),
                F.min("segment_id").alias("first_segment"),
                F.max("segment_id").alias("last_segment"),
                F.min_by("start_ms", "segment_id").alias("start_ms"),
                F.max_by("end_ms", "segment_id").alias("end_ms"),
            )
        )

    return stitch(
        placed, keys, cut,
        [
            F.first("text").alias("text"),
            F.sum("n").alias("n"),
            F.min_by("start_ms", "first_segment").alias("start_ms"),
            F.max_by("end_ms", "last_segment").alias("end_ms"),
            F.min("first_segment").alias("first_segment"),
            F.max("last_segment").alias("last_segment"),
        ],
        ["text", "n", "first_segment", "last_segment", "start_ms", "end_ms"],
    )


def repeat_runs(segments: DataFrame, block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """The longest run of each media (the earliest one on ties)."""
    runs = text_runs(segments, block_segments)
    best = F.max_by(F.struct("text", "n", "first_segment", "start_ms", "end_ms"),
                    F.struct(F.col("n"), -F.col("first_segment")))
    return runs.groupBy("media_id").agg(best.alias("_r")).select("media_id", "_r.*")


def with_previous_start(segments: DataFrame, block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """`segments` plus previous_start_ms."""
    placed = block_scan(
        segments.withColumn(BLOCK, block_of(F.col("segment_id"), block_segments)),
        ["media_id"], [F.max_by("start_ms", "segment_id").alias("_last_start")],
        lambda order, before: {"_previous": F.lag("_last_start").over(order)},
    )
    ordered, _ = in_block(["media_id"], "segment_id")
    return placed.withColumn(
        "previous_start_ms", F.coalesce(F.lag("start_ms").over(ordered), F.col("_previous"))
    ).drop("_previous", MULTI, BLOCK)


def order_faults() -> Column:
    """Faults of one segment row (needs previous_start_ms and duration_ms)."""
    return F.concat_ws(
        ",",
        F.when(F.col("start_ms") < 0, "negative_start"),
        F.when(F.col("end_ms") < F.col("start_ms"), "negative_length"),
        F.when(F.col("start_ms") < F.col("previous_start_ms") - BACKWARD_TOLERANCE_MS, "backward"),
        F.when(F.col("end_ms") > F.col("duration_ms") + OVERRUN_TOLERANCE_MS, "overrun"),
    )


def _with_duration(segments: DataFrame, media: DataFrame, block_segments: int) -> DataFrame:
    """Segments with previous_start_ms and the duration of their media."""
    return lookup_join(
        with_previous_start(segments, block_segments), media.select("media_id", "duration_ms"),
        ["media_id"], ["segment_id"], count_in=segments,
    )


def monotonic_check(segments: DataFrame, media: DataFrame, block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """Segments out of order: (media_id, segment_id, start_ms, end_ms, faults)."""
    return (
        _with_duration(segments.select("media_id", "segment_id", "start_ms", "end_ms"), media, block_segments)
        .select("media_id", "segment_id", "start_ms", "end_ms", order_faults().alias("faults"))
        .where(F.col("faults") != "")
    )


def vocabulary(texts: DataFrame) -> DataFrame:
    """Distinct (media_id, word); repeats vanish before the exchange.

    The filters are those that joins on the result would infer: stated here,
    every use has the same plan and Spark computes the vocabulary once.
    """
    said = texts.select("media_id", F.explode(words_of(F.col("text"))).alias("word"))
    return said.where(F.col("media_id").isNotNull() & F.col("word").isNotNull()).distinct()


def vocabulary_parts(texts: DataFrame, parts: int = VOCABULARY_PARTS) -> DataFrame:
    """(media_id, part, words): the distinct words of a media in `parts` arrays, by their hash.

    Words of one task collapse before the exchange, so a media of very many
    texts sends a few arrays per task, and no array holds its whole vocabulary.
    """
    said = texts.where(F.col("media_id").isNotNull()).select("media_id", F.explode(words_of(F.col("text"))).alias("word"))
    return said.groupBy("media_id", F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part")).agg(F.collect_set("word").alias("words"))


def _side_by_side(pairs: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Each distinct pair once per part, with the words of both (`_l`, `_r`). Both joins use one
    exchange of the vocabulary; a media met in very many pairs is split by AQE."""
    words = vocabulary_parts(texts, parts)
    each = pairs.select("left_id", "right_id").distinct().withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    left = words.select(F.col("media_id").alias("left_id"), "part", F.col("words").alias("_l"))
    right = words.select(F.col("media_id").alias("right_id"), "part", F.col("words").alias("_r"))
    return each.join(left, ["left_id", "part"], "left").join(right, ["right_id", "part"], "left")


def vocab_intersect(pairs: DataFrame, texts: DataFrame, parts: int = VOCABULARY_PARTS) -> DataFrame:
    """(left_id, right_id, word) both media of a pair use; only the given pairs are compared."""
    return _side_by_side(pairs, texts, parts).select("left_id", "right_id", F.explode(F.array_intersect("_l", "_r")).alias("word"))


def vocab_overlap(pairs: DataFrame, texts: DataFrame, minimum: float = MIN_OVERLAP, parts: int = VOCABULARY_PARTS) -> DataFrame:
    """Shared words over the smaller vocabulary, one row per distinct pair; media without
    texts have no words.

    (left_id, right_id, left_words, right_words, shared, overlap, agrees)
    """
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("bigint")
    none = F.array().cast("array<string>")
    both = _side_by_side(pairs, texts, parts).select("left_id", "right_id", F.coalesce("_l", none).alias("_l"), F.coalesce("_r", none).alias("_r"))
    overlap = F.col("shared") / F.greatest(F.least("left_words", "right_words"), F.lit(1))
    return (
        both.groupBy("left_id", "right_id")
        .agg(n("_l").alias("left_words"), n("_r").alias("right_words"), n(F.array_intersect("_l", "_r")).alias("shared"))
        .withColumn("overlap", overlap)
        .withColumn("agrees", F.col("overlap") > minimum)
    )


def language_mismatch(documents: DataFrame, media: DataFrame) -> DataFrame:
    """Media whose detected language differs from the declared one (if declared)."""
    declared = media.where(F.col("language").isNotNull()).select(
        "media_id", F.col("language").alias("declared")
    )
    return (
        documents.select("media_id", F.col("language").alias("detected"))
        .join(declared, "media_id")
        .where(~F.col("detected").eqNullSafe(F.col("declared")))
    )


def path_summary(segments: DataFrame) -> DataFrame:
    """(media_id, segments, covered_ms) of one result per media."""
    return segments.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("segments"), F.max_by("end_ms", "segment_id").alias("covered_ms")
    )


def compare_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two results per media side by side, whichever of them exists."""
    a = path_summary(left).select("media_id", F.col("segments").alias("left_segments"), F.col("covered_ms").alias("left_covered_ms"))
    b = path_summary(right).select("media_id", F.col("segments").alias("right_segments"), F.col("covered_ms").alias("right_covered_ms"))
    # A word of both paths is shipped once, and no vocabulary is sorted for a join.
    said = lambda s, name: s.select(
        "media_id", F.explode(words_of(F.col("text"))).alias("word"), *[F.when(F.lit(n == name), True).alias(n) for n in ("_a", "_b")])
    both = said(left, "_a").unionByName(said(right, "_b")).where(F.col("media_id").isNotNull() & F.col("word").isNotNull())
    vocab = (
        both.groupBy("media_id", "word").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
        .groupBy("media_id")
        .agg(F.count("_a").alias("_na"), F.count("_b").alias("_nb"), F.count(F.when(F.col("_a") & F.col("_b"), 1)).alias("_s"))
        .select("media_id", (F.col("_s") / F.greatest(F.least("_na", "_nb"), F.lit(1))).alias("overlap"))
    )
    return a.join(b, "media_id", "full_outer").join(vocab, "media_id", "left")


def _overlap_of_paths(captions: DataFrame, segments: DataFrame, parts: int = VOCABULARY_PARTS) -> DataFrame:
    """(media_id, overlap) of the media that have captions: shared words over the smaller vocabulary."""
    ours = vocabulary_parts(segments, parts).withColumnRenamed("words", "_r")
    theirs = captions.select("media_id").distinct().withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    both = theirs.join(vocabulary_parts(captions, parts).withColumnRenamed("words", "_l"), ["media_id", "part"], "left").join(
        ours, ["media_id", "part"], "left")
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    none = F.array().cast("array<string>")
    sized = both.select("media_id", F.coalesce("_l", none).alias("_l"), F.coalesce("_r", none).alias("_r")).groupBy("media_id").agg(
        n("_l").alias("_a"), n("_r").alias("_b"), n(F.array_intersect("_l", "_r")).alias("_s"))
    return sized.select("media_id", (F.col("_s") / F.greatest(F.least("_a", "_b"), F.lit(1))).alias("overlap"))


def quality_report(
    segments: DataFrame, media: DataFrame, minimum: float = MIN_COVERAGE_RECOGNISED,
    block_segments: int = BLOCK_SEGMENTS, captions: DataFrame | None = None, min_overlap: float = MIN_OVERLAP,
) -> DataFrame:
    """One row per media: coverage, brief cues, loops, order, language, verdict.

    `media`: media_id, duration_ms, language (declared), detected. Loops are a note and
    fail nothing. With `captions` (media_id, text) the vocabularies of both paths are
    compared: `overlap`, null for media without captions, which fails below `min_overlap`.
    """
    times = segments.select("media_id", "segment_id", "start_ms", "end_ms")
    per_media = _with_duration(times, media, block_segments).groupBy("media_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.max_by("end_ms", "segment_id").alias("covered_ms"),
        F.count_if(F.col("end_ms") - F.col("start_ms") < SHORT_CUE_MS).alias("short_cues"),
        F.count_if(order_faults() != "").alias("order_faults"),
    )
    loops = repeated_segments(segments).groupBy("media_id").agg(F.count(F.lit(1)).alias("loops"))
    covered = F.coalesce(F.col("covered_ms") > F.col("duration_ms") * minimum, F.lit(False))
    language_ok = F.col("language").isNull() | F.col("language").eqNullSafe(F.col("detected"))
    bad = lambda c: c.cast("bigint")
    if captions is None:
        shown, overlap = [], media.select("media_id", F.lit(None).cast("double").alias("overlap")).limit(0)
    else:
        shown, overlap = ["overlap"], _overlap_of_paths(captions, segments)
    return (
        media.join(per_media, "media_id", "left")
        .join(loops, "media_id", "left")
        .join(overlap, "media_id", "left")
        .na.fill(0, ["segments", "short_cues", "order_faults", "loops"])
        .withColumn("covered", covered)
        .withColumn("language_ok", language_ok)
        .withColumn(
            "anomalies",
            bad(~F.col("covered")) + bad(~F.col("language_ok")) + bad(F.col("short_cues") > 0)
            + bad(F.col("order_faults") > 0) + bad(F.coalesce(F.col("overlap") <= min_overlap, F.lit(False))),
        )
        .select("media_id", "segments", "covered_ms", "covered", "short_cues", "order_faults", "loops",
                "language_ok", *shown, "anomalies", (F.col("anomalies") == 0).alias("passed"))
    )
