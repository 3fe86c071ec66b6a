"""Tables of the caption domain, derived from the test tables.

Nothing here is an operator: each function turns given rows into requests,
captions, spans and so on. Texts are cut row by row, so no binding shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.functions.catalogue import MODELS
from cueweave.functions.naming import let
from cueweave.functions.text import collapse_ws
from cueweave.functions.timecode import format_timestamp, int_div
from cueweave.operators.blocks import BLOCK, block_of, block_scan, in_block
from cueweave.operators.planning import with_digest, with_request_defaults
from cueweave.sources.readers import parse_probe_json
from cueweave.streaming.status import watch_state

EPOCH_2024_US = 1_704_067_200_000_000
INSTALLED = ("ggml-base.bin", "ggml-small-q5_1.bin", "ggml-large-v3-turbo-q5_0.bin",
             "ggml-silero-v5.1.2.bin", "/models/custom-q5.bin")
CACHE_CEILING = 1_000_000

# Twelve messages, chosen by number.
STDERR = (
    "ERROR: [site] abc: Sign in to confirm you're not a bot. Video unavailable",
    "ERROR: [site] abc: Private video",
    "ERROR: This live event will begin in 3 hours.",
    "ERROR: HTTP Error 500: Internal Server Error",
    "ERROR: Use --cookies-from-browser for the authentication",
    "ERROR: The uploader has not made this video available in your country; not available in your country",
    "  ERROR: Premieres in 20 minutes  ",
    "ERROR: unable to download webpage: timed out",
    "ERROR: Join this channel to get access to members-only content",
    "ERROR: This video is age-restricted and only available on the site",
    "ERROR: This video has been removed by the uploader",
    "WARNING: " + "nsig extraction failed; " * 30 + "ERROR: Video unavailable",
)


#: Bytes of a stored table per partition, where a table in few files is spread.
SPREAD_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; texts in fewer files than cores are spread.

    Parquet splits at row groups, and these files have one. They are spread over the
    cores, and over more partitions where they are large, so that a task's share does not grow
    with the table. A table of a real cluster has more files than cores and is read as it lies.
    """
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and len(files := frame.inputFiles()) < cores:
        return frame.repartition(max(cores, -(-_bytes(spark, files) // SPREAD_BYTES)), "doc_id")
    return frame


def _bytes(spark: SparkSession, files: list[str]) -> int:
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def segments_of_text(text: Column) -> Column:
    """Non-blank lines as timed segments: 60 ms a character, 200 ms between lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), collapse_ws), lambda l: l != "")

    def ends(ls: Column) -> Column:
        return F.aggregate(
            ls, F.array().cast("array<bigint>"),
            lambda acc, l: F.concat(
                acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + F.length(l))
            ),
        )

    def timed(ls: Column, upto: Column) -> Column:
        return F.transform(
            ls,
            lambda l, i: F.struct(
                i.cast("bigint").alias("segment_id"),
                ((F.get(upto, i) - F.length(l)) * 60 + i * 200).alias("start_ms"),
                (F.get(upto, i) * 60 + i * 200).alias("end_ms"),
                l.alias("text"),
            ),
        )

    return let(lines, lambda ls: let(ends(ls), lambda upto: timed(ls, upto)))


def segments(docs: DataFrame) -> DataFrame:
    """media_id, segment_id, start_ms, end_ms, text."""
    return docs.select(F.col("doc_id").alias("media_id"), F.inline(segments_of_text(F.col("text"))))


def media(docs: DataFrame) -> DataFrame:
    """media_id, duration_ms, language (declared), detected."""
    return docs.select(
        F.col("doc_id").alias("media_id"),
        (F.col("n_chars") * 66).alias("duration_ms"),
        F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("language"),
        F.when(F.col("doc_id") % 10 == 3, "xx").otherwise(F.col("lang")).alias("detected"),
    )


def turns(conversations: DataFrame) -> DataFrame:
    """Conversations as segments of one second each."""
    start = F.col("turn") * 1000
    return conversations.select(
        F.col("conv_id").alias("media_id"), F.col("turn").alias("segment_id"),
        start.alias("start_ms"), (start + 900).alias("end_ms"), "text",
    )


def captions(docs: DataFrame) -> DataFrame:
    """media_id, text: scrolling WebVTT in which each cue repeats the line before."""
    def cue(s: Column, previous: Column) -> Column:
        return F.concat(
            format_timestamp(s["start_ms"], "."), F.lit(" --> "), format_timestamp(s["end_ms"], "."),
            F.lit(" align:start position:0%\n"),
            F.coalesce(F.concat(previous["text"], F.lit("\n")), F.lit("")),
            F.lit(" \n<00:00:00.500><c>"), s["text"], F.lit("</c>\n\n"),
        )

    body = let(
        segments_of_text(F.col("text")),
        lambda ss: F.array_join(F.transform(ss, lambda s, i: cue(s, F.get(ss, i - 1))), ""),
    )
    return docs.select(
        F.col("doc_id").alias("media_id"),
        F.concat(F.lit("WEBVTT\nKind: captions\nLanguage: "), F.col("lang"), F.lit("\n\nNOTE made\n\n"), body).alias("text"),
    )


def _token_lists(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Segments with what their tokens are made of, and the array of tokens."""
    pieces = F.regexp_extract_all(F.concat(F.lit(" "), "text"), F.lit(" ?[^ ]{1,4}"), F.lit(0))
    start, span = int_div(F.col("start_ms"), 10), int_div(F.col("end_ms") - F.col("start_ms"), 10)
    cut = segments(docs).select("media_id", "segment_id", start.alias("_start"), span.alias("_span"), pieces.alias("_pieces"))
    cut = cut.withColumn("_n", F.size("_pieces").cast("bigint"))
    share = lambda k: F.col("_start") + F.call_function("div", F.col("_span") * k, F.col("_n"))
    spoken = F.transform("_pieces", lambda text, i: F.struct(
        (i + F.call_function("div", i, F.lit(6))).alias("token_index"), i.cast("bigint").alias("token_id"), text.alias("text"),
        share(i).alias("t0"), share(i + 1).alias("t1"), (i * 37 % 100 / 100.0).alias("probability"),
    ))
    sixes = F.floor(F.col("_n") / 6).cast("int")  # tokens 5, 11, … are followed by a service token
    service = F.transform(F.slice(F.sequence(F.lit(1), sixes + 1), F.lit(1), sixes), lambda m: F.struct(
        (m * 7 - 1).cast("bigint").alias("token_index"), (m * 6 + 50_256).cast("bigint").alias("token_id"), F.lit("[_TT_]").alias("text"),
        F.col("_start").alias("t0"), F.col("_start").alias("t1"), F.lit(0.5).alias("probability"),
    ))
    return cut, F.concat(spoken, service)


def token_lists(docs: DataFrame) -> DataFrame:
    """Segment words cut into 4-character pieces, a service token after every 6: one row per
    segment with its `tokens`, as a recogniser delivers them."""
    cut, made = _token_lists(docs)
    return cut.select("media_id", "segment_id", made.alias("tokens"))


def tokens(docs: DataFrame) -> DataFrame:
    """`token_lists` with one row per token.

    The array is unrolled as it is made: for a column of arrays Spark adds a filter on its size, pushes it
    below what the array is made of, and so cuts the text of a segment anew for each of its tokens.
    """
    cut, made = _token_lists(docs)
    return cut.select("media_id", "segment_id", F.inline(made))


def spans(events: DataFrame) -> DataFrame:
    """Spans of five media, each as long as its last span says."""
    start = int_div(micros(F.col("ts")) - EPOCH_2024_US, 1_000_000)
    rows = events.select(
        (F.col("user_id") % 5).alias("media_id"), start.alias("start"), (start + F.floor(F.col("value") * 20)).alias("end"))
    return rows.join(rows.groupBy("media_id").agg(F.max("end").alias("length")), "media_id")


def speech(docs: DataFrame) -> DataFrame:
    """Spans of the segments in the original sound, where each is three seconds later than
    compaction leaves it after the one before."""
    shift = (F.col("segment_id") + 1) * 48_000
    return segments(docs).select(
        "media_id", (F.col("start_ms") * 16 + shift).alias("start"), (F.col("end_ms") * 16 + shift).alias("end"),
        F.lit(1 << 50).alias("length"))


def points(events: DataFrame) -> DataFrame:
    """Positions on the compacted axis; some lie past its end, media 5 has no map."""
    start = int_div(micros(F.col("ts")) - EPOCH_2024_US, 1_000_000)
    return events.select(
        F.col("event_id").alias("point_id"), (F.col("user_id") % 6).alias("media_id"), start.alias("processed")
    )


def progress(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.floor("value").cast("int").alias("percent")
    )


def timed_progress(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"),
        int_div(micros(F.col("ts")), 1000).alias("ts_ms"), F.floor("value").cast("int").alias("percent"),
    )


TYPES = {"click": "progress", "view": "segments", "purchase": "download", "signup": "notice", "error": "phase"}


def messages(events: DataFrame) -> DataFrame:
    """Five tasks; a minute of the table counts as one millisecond."""
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    return events.select(
        (F.col("user_id") % 5).alias("task_id"), F.col("event_id").alias("seq"),
        int_div(micros(F.col("ts")) - EPOCH_2024_US, 60_000_000).alias("ts_ms"),
        F.element_at(kinds, F.col("event_type")).alias("type"),
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("item"),
        F.floor("value").cast("bigint").alias("amount"),
    )


def video_id(doc: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("v"), doc.cast("string")), 256), 1, 11)


def wanted_doc(page: Column) -> Column:
    """Every third request asks for one hot video, some for an unknown one."""
    return F.when(page % 3 == 0, 8).when(page % 13 == 1, page + 1_000_000_000).otherwise(page * 4).cast("bigint")


def urls(pages: DataFrame) -> DataFrame:
    p, v = F.col("page_id"), video_id(wanted_doc(F.col("page_id")))
    form = lambda before, after="": F.concat(F.lit(before), v, F.lit(after))
    url = (
        F.when(p % 8 == 0, form("https://www.youtube.com/watch?v="))
        .when(p % 8 == 1, form("https://youtu.be/"))
        .when(p % 8 == 2, form("https://m.youtube.com/watch?list=PL1&v="))
        .when(p % 8 == 3, form("https://www.youtube.com/shorts/", "?feature=share"))
        .when(p % 8 == 4, form("http://www.youtube.com/watch?v="))
        .when(p % 8 == 5, form("https://youtube.com.evil.tld/watch?v="))
        .when(p % 16 == 6, F.lit("https://youtu.be/short"))
        .when(p % 16 == 14, form(" HTTPS://Music.YouTube.com//embed/", "/ "))
        .when(p % 16 == 7, F.col("url"))
        .otherwise(form("https://user@www.youtube.com/watch?v="))
    )
    return pages.select("page_id", url.alias("url"))


def probe_json(docs: DataFrame) -> DataFrame:
    """doc_id, json: what an extractor reports about each video."""
    d, lang = F.col("doc_id"), F.col("lang")
    track = lambda ext, url: F.struct(F.lit(ext).cast("string").alias("ext"), url.cast("string").alias("url"), F.lit(None).cast("string").alias("name"))
    at = lambda name: F.concat(F.lit(f"t/{name}/"), d.cast("string"))
    none = F.create_map().cast("map<string,array<struct<ext:string,url:string,name:string>>>")
    subs = (
        F.when(d % 5 == 1, F.create_map(lang, F.array(track("json3", at("a")), track("vtt", at("b")))))
        .when(d % 5 == 3, F.create_map(F.concat(lang, F.lit("-XX")), F.array(track("json3", at("c")), track(None, at("d")))))
        .when(d % 5 == 4, F.create_map(lang, F.array(track("vtt", F.lit(None)), track("json3", at("e")))))
        .otherwise(none)
    )
    auto = (
        F.when(d % 5 == 2, F.create_map(
            F.lit("aa"), F.array(track("vtt", at("f"))), lang, F.array(track("vtt", at("g"))),
            F.lit("zz"), F.array(track("vtt", at("h")))))
        .when(d % 5 >= 3, F.create_map(lang, F.array(track("json3", at("i")))))
        .otherwise(none)
    )
    doc = F.struct(
        video_id(d).alias("id"),
        collapse_ws(F.split("text", "\n")[0]).alias("title"),
        F.col("source").alias("channel"),
        F.when(d % 19 != 0, F.col("n_chars") / 15.0).alias("duration"),
        F.lit("20240131").alias("upload_date"),
        F.when(d % 7 != 0, lang).alias("language"),
        (d % 23 == 0).alias("is_live"),
        F.when(d % 17 == 0, "is_upcoming").otherwise("not_live").alias("live_status"),
        F.lit(0).alias("age_limit"), F.lit("dropped").alias("extractor"),
        subs.alias("subtitles"), auto.alias("automatic_captions"),
    )
    return docs.select("doc_id", F.when(d % 31 == 30, F.lit("{oops")).otherwise(F.to_json(doc)).alias("json"))


def probes(docs: DataFrame) -> DataFrame:
    return parse_probe_json(probe_json(docs))


def good_probes(docs: DataFrame) -> DataFrame:
    return probes(docs).where(F.col("error_code").isNull())


MODEL_NAMES = ("auto", "base", "small", "turbo", "tiny", "nope", "medium", "auto", "large-v3")


def raw_requests(pages: DataFrame) -> DataFrame:
    p = F.col("page_id")
    return urls(pages).select(
        p.alias("request_id"), "url",
        F.when(p % 9 != 7, F.get(F.array(*[F.lit(m) for m in MODEL_NAMES]), (p % 9).cast("int"))).alias("model"),
        F.when(p % 29 == 5, "/models/custom-q5.bin").alias("model_path"),
        F.when(p % 5 == 0, F.lit(False)).alias("vad"),
        F.when(p % 4 == 1, " FR ").when(p % 4 == 2, "auto").when(p % 4 == 3, "en").alias("lang"),
        F.when(p % 6 == 0, F.lit(True)).alias("translate"),
        F.when(p % 10 == 3, "  Bonjour ").when(p % 10 == 4, "   ").alias("initial_prompt"),
        F.when(p % 11 == 2, F.lit(0.6)).cast("float").alias("no_speech_thold"),
        F.when(p % 11 == 3, F.lit(2.4)).cast("float").alias("entropy_thold"),
        (int_div(p, 8) % 2 == 1).alias("prefer_subs"),
        F.when(p % 7 == 6, F.lit(False)).alias("use_cache"),
        F.when(p % 5 == 1, F.lit(5)).cast("bigint").alias("max_duration_min"),
        F.when(p % 12 == 5, "JSON").alias("format"),
        F.when(int_div(p, 4) % 3 == 1, F.lit(1_300_000_000)).cast("bigint").alias("available_bytes"),
    )


def requests(pages: DataFrame) -> DataFrame:
    return with_request_defaults(raw_requests(pages))


def stored(pages: DataFrame) -> DataFrame:
    """digest, title: the results of a part of the requests."""
    return (
        with_digest(requests(pages)).where(F.col("digest").isNotNull() & (F.col("request_id") % 5 == 1))
        .groupBy("digest").agg(F.min(F.concat(F.lit("title "), F.col("video_id"))).alias("title"))
    )


def stderr_log(events: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    text = F.get(F.array(*[F.lit(m) for m in STDERR]), (k % 12).cast("int"))
    return events.where(F.col("event_type") == "error").select("event_id", text.alias("message"))


def cache_entries(docs: DataFrame) -> DataFrame:
    """Entries by content; equal texts share a digest."""
    d = F.col("doc_id")
    return docs.select(
        d.alias("entry_id"), F.sha2("text", 256).alias("digest"), F.col("n_chars").alias("bytes"),
        (d * 7919 % 61).alias("accessed"), (d * 7919 % 1_000_003).alias("written_at"),
        F.concat(F.lit("title "), d.cast("string")).alias("title"),
    )


def runs(docs: DataFrame) -> DataFrame:
    """Two runs per document, on a processor and on a graphics card."""
    d = F.col("doc_id")
    elapsed = d * 131 % 5000
    run = lambda backend, ms: F.struct(
        F.lit(backend).alias("backend"), ms.alias("elapsed_ms"), (ms % 977 + 600).alias("peak_mb"))
    names = F.array(*[F.lit(m[0]) for m in MODELS])
    return docs.select(
        d.alias("media_id"), F.get(names, (d % 6).cast("int")).alias("model"), (d % 2 == 0).alias("vad"),
        (F.col("n_chars") * 66).alias("audio_ms"),
        F.size(F.filter(F.transform(F.split("text", "\n"), collapse_ws), lambda l: l != "")).cast("bigint").alias("segments"),
        F.inline(F.array(run("cpu", elapsed), run("vulkan", int_div(elapsed, 3)))),
    )


def scored(docs: DataFrame) -> DataFrame:
    s = F.col("segment_id")
    return segments(docs).withColumn("no_speech_prob", F.when(s % 10 != 9, s * 37 % 100 / 100.0))


def pairs(docs: DataFrame, block_docs: int = 1_000_000) -> DataFrame:
    """Consecutive documents of a language: left_id, right_id.

    A language is a huge group, hence the blocks.
    """
    placed = block_scan(
        docs.select("lang", "doc_id", block_of(F.col("doc_id"), block_docs).alias(BLOCK)),
        ["lang"], [F.min("doc_id").alias("_first")],
        lambda order, before: {"_next": F.lead("_first").over(order)},
    )
    ordered, _ = in_block(["lang"], "doc_id")
    right = F.coalesce(F.lead("doc_id").over(ordered), F.col("_next"))
    return placed.select(F.col("doc_id").alias("left_id"), right.alias("right_id")).where(F.col("right_id").isNotNull())


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("media_id"), "text")


def chunks(docs: DataFrame) -> DataFrame:
    """UTF-8 bytes of each line as a block of samples; empty and odd ones occur."""
    return docs.select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("_no", "_l")).select(
        "media_id", F.col("_no").cast("bigint").alias("chunk_no"), F.encode("_l", "UTF-8").alias("bytes")
    )


def chunk_log(docs: DataFrame) -> DataFrame:
    """Download log: line sizes as ranges, with a few gaps and whole answers."""
    rows = F.transform(F.split("text", "\n"), lambda l: F.octet_length(l).cast("bigint"))

    def log(sizes: Column) -> Column:
        upto = F.aggregate(
            sizes, F.array().cast("array<bigint>"),
            lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + n)),
        )
        return let(upto, lambda ends: F.transform(
            sizes, lambda n, i: F.struct(i.cast("bigint").alias("seq"), n.alias("length"), (F.get(ends, i) - n).alias("_at"))))

    shifted = F.col("_at") + F.when(F.col("seq") % 11 == 10, 1).otherwise(0)
    header = F.concat(F.lit("bytes "), shifted.cast("string"), F.lit("-"), (shifted + F.col("length")).cast("string"), F.lit("/"),
                      F.when(F.col("seq") % 2 == 0, F.lit("999999")).otherwise("*"))
    return docs.select(F.col("doc_id").alias("download_id"), F.inline(let(rows, log))).select(
        "download_id", "seq", "length",
        F.when(F.col("seq") % 17 == 16, 200).otherwise(206).alias("status"),
        F.when(F.col("seq") % 17 != 16, header).alias("content_range"),
    )


def manifest(pages: DataFrame) -> DataFrame:
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    return pages.select(name.alias("name"), F.octet_length("html").cast("bigint").alias("size"), F.sha2("html", 256).alias("sha256"))


def files(pages: DataFrame) -> DataFrame:
    """Files at hand: every 11th absent, every 7th longer, every 5th altered."""
    p = F.col("page_id")
    name = F.concat(F.lit("page-"), p.cast("string"))
    content = F.when(p % 7 == 0, F.concat("html", F.lit("x"))).when(p % 5 == 0, F.concat(F.lit("y"), F.expr("substr(html, 2)"))).otherwise(F.col("html"))
    return pages.where(p % 11 != 0).select(name.alias("name"), F.octet_length(content).cast("bigint").alias("size"), F.sha2(content, 256).alias("sha256"))


def checksum_manifests(pages: DataFrame) -> DataFrame:
    """One manifest per page: a good line, a later duplicate, a short sum, another name."""
    p, h = F.col("page_id").cast("string"), F.sha2("url", 256)
    text = F.concat(
        h, F.lit("  page-"), p, F.lit("\r\nabc123  page-"), p, F.lit(".old\n"),
        F.sha2("html", 256), F.lit("  page-"), p, F.lit("\n"), F.sha2("html", 256), F.lit(" \tpage-"), p, F.lit(".exe\n\n"),
    )
    return pages.select("page_id", text.alias("text"))


def watch_runs(events: DataFrame) -> DataFrame:
    """target_id, ts_ms, seq, state."""
    code = F.when(F.col("event_type") == "error", 20).when(F.col("event_type") == "click", 12).otherwise(0)
    found = F.col("event_type").isin("view", "signup")
    return events.select(
        F.col("user_id").alias("target_id"), int_div(micros(F.col("ts")), 1000).alias("ts_ms"),
        F.col("event_id").alias("seq"), watch_state(code, found).alias("state"),
    )


