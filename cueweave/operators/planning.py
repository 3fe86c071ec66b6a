"""Probe metadata, caption track choice, admission and request planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.admission import (
    MAX_DURATION_MIN, MIB, is_live, max_minutes, memory_required, short_of_memory, too_long,
)
from cueweave.functions.catalogue import (
    VAD_MODEL, model_file, model_id, translate_supported,
)
from cueweave.functions.digest import config_digest
from cueweave.functions.naming import let
from cueweave.functions.text import lang_primary, normalise_lang, normalise_prompt
from cueweave.functions.timecode import duration_min
from cueweave.functions.urls import canonical_url
from cueweave.operators.blocks import lookup_join

NO_CAPTIONS = "map<string,array<struct<ext:string,url:string,name:string>>>"


def with_request_defaults(raw: DataFrame) -> DataFrame:
    """Request rows with every option filled in.

    Columns that `raw` lacks are taken as absent options. Words are always on
    for JSON output.
    """
    col = lambda name, kind: (
        F.col(name).cast(kind) if name in raw.columns else F.lit(None).cast(kind)
    )
    filled = lambda name, kind, value: F.coalesce(col(name, kind), F.lit(value)).alias(name)
    output = F.lower(F.coalesce(col("format", "string"), F.lit("txt")))
    words = F.coalesce(col("word_timestamps", "boolean"), F.lit(False)) | (output == "json")
    return raw.select(
        "request_id", "url",
        filled("model", "string", "auto"), col("model_path", "string").alias("model_path"),
        filled("vad", "boolean", True), normalise_lang(col("lang", "string")).alias("lang"),
        filled("translate", "boolean", False),
        normalise_prompt(col("initial_prompt", "string")).alias("initial_prompt"),
        words.alias("word_timestamps"),
        col("no_speech_thold", "float").alias("no_speech_thold"),
        col("entropy_thold", "float").alias("entropy_thold"),
        filled("prefer_subs", "boolean", False), filled("use_cache", "boolean", True),
        filled("max_duration_min", "bigint", MAX_DURATION_MIN),
        filled("max_line_width", "int", 42), filled("max_line_count", "int", 2),
        output.alias("format"), col("available_bytes", "bigint").alias("available_bytes"),
    )


def captions_or_none(tracks: Column) -> Column:
    return F.coalesce(tracks, F.create_map().cast(NO_CAPTIONS))


def _track_in(tracks: Column, wanted: Column, auto: bool) -> Column:
    def language(keys: Column) -> Column:
        matching = F.filter(keys, lambda k: (k == wanted) | (lang_primary(k) == wanted))
        only = F.when(F.size(keys) == 1, F.get(keys, F.lit(0)))
        return F.when(wanted.isNotNull(), F.get(matching, F.lit(0))).otherwise(only)

    def first_form(listed: Column) -> Column:
        vtt = F.filter(listed, lambda t: t["ext"] == "vtt")
        return F.coalesce(F.get(vtt, F.lit(0)), F.get(listed, F.lit(0)))

    def track(m: Column, lang: Column) -> Column:
        return let(
            let(F.try_element_at(m, lang), first_form)["url"],
            lambda url: F.when(
                url.isNotNull(), F.struct(lang.alias("lang"), F.lit(auto).alias("auto"), url.alias("url"))
            ),
        )

    return let(
        captions_or_none(tracks),
        lambda m: let(let(F.array_sort(F.map_keys(m)), language), lambda lang: track(m, lang)),
    )


def select_track(subtitles: Column, automatic: Column, requested: Column, declared: Column) -> Column:
    """Best caption track, struct(lang, auto, url) or null.

    The wanted language is the requested one, else the declared one; without
    either a map is used only if it has a single language. Written captions
    come before automatic ones, languages in byte order, WebVTT before other
    forms; a chosen track without address disqualifies its whole map. All of it
    is one row's data, so nothing is exploded or shuffled.
    """
    wanted = F.coalesce(requested, declared)
    return F.coalesce(_track_in(subtitles, wanted, False), _track_in(automatic, wanted, True))


def is_translation(track_lang: Column, declared: Column) -> Column:
    """Automatic translation: the track's primary language is not the declared one."""
    return F.coalesce(lang_primary(track_lang) != declared, F.lit(False))


def caption_langs(subtitles: Column, automatic: Column) -> Column:
    """Languages with captions, written ones first, each once."""
    keys = lambda m: F.array_sort(F.map_keys(captions_or_none(m)))
    return F.array_distinct(F.concat(keys(subtitles), keys(automatic)))


def auto_caption_origin(automatic: Column, declared: Column) -> Column:
    """Declared language where automatic captions exist in it."""
    return F.when(F.map_contains_key(captions_or_none(automatic), F.coalesce(declared, F.lit(""))), declared)


def track_union(probes: DataFrame) -> DataFrame:
    """Every caption track as a row: video_id, lang, auto, position, ext, url."""
    def side(column: str, auto: bool) -> DataFrame:
        return (
            probes.select("video_id", F.explode(captions_or_none(F.col(column))).alias("lang", "_t"))
            .select("video_id", "lang", F.lit(auto).alias("auto"), F.posexplode("_t").alias("position", "_x"))
            .select("video_id", "lang", "auto", F.col("position").cast("bigint").alias("position"), "_x.ext", "_x.url")
        )
    return side("subtitles", False).unionByName(side("automatic_captions", True))


def admit_requests(rows: DataFrame) -> DataFrame:
    """Rows plus code (13, 14, 15 or null) and the limits memory would allow.

    Needs duration, is_live, live_status, max_duration_min, word_timestamps,
    available_bytes.
    """
    words, available = F.col("word_timestamps"), F.col("available_bytes")
    code = (
        F.when(is_live(F.col("is_live"), F.col("live_status")), 13)
        .when(too_long(F.col("duration"), F.col("max_duration_min")), 14)
        .when(short_of_memory(F.col("duration"), words, available), 15)
    )
    refused = F.col("code") == 15
    return (
        rows.withColumn("code", code)
        .withColumn("actual_min", F.when(F.col("code").isin(14, 15), duration_min(F.col("duration"))))
        .withColumn(
            "limit_min",
            F.when(F.col("code") == 14, F.col("max_duration_min")).when(refused, max_minutes(available, words)),
        )
        .withColumn("available_mb", F.when(refused, F.call_function("div", available, F.lit(MIB).cast("bigint"))))
        .withColumn("limit_without_words_min", F.when(refused & words, max_minutes(available, F.lit(False))))
    )


def with_digest(requests: DataFrame) -> DataFrame:
    """Requests with cleaned URL, model and digest: the columns the planning needs.

    early_code is 10, 30 or 40 where no digest can or need be made.
    """

    def checked(u: Column, model: Column) -> Column:
        code = (
            F.when(u["error_code"].isNotNull(), u["error_code"])
            .when(model.isNull(), 30)
            .when(~translate_supported(model, F.col("translate")), 40)
        )
        made = config_digest(
            u["video_id"], model, F.col("lang"), F.col("translate"), F.col("vad"), F.col("word_timestamps"),
            F.col("initial_prompt"), F.col("no_speech_thold"), F.col("entropy_thold"),
        )
        return let(code, lambda c: F.struct(
            u["video_id"].alias("video_id"), u["had_playlist"].alias("had_playlist"), model.alias("model_id"),
            c.alias("early_code"), F.when(c.isNull(), made).alias("digest"),
        ))

    facts = let(
        canonical_url(F.col("url")),
        lambda u: let(model_id(F.col("model"), F.col("model_path")), lambda m: checked(u, m)),
    )
    return requests.withColumn("_k", facts).select(*requests.columns, "_k.*")


def plan_requests(
    requests: DataFrame, probes: DataFrame, stored: DataFrame, installed: Sequence[str]
) -> DataFrame:
    """(request_id, video_id, digest, outcome, code, track_lang, track_auto, est_bytes).

    `requests` comes from `with_request_defaults`; `probes` has one row per
    video_id; `stored` one row per digest; `installed` names the model files at
    hand. Both lookups spread hot videos and digests, and rows already decided
    get keys of their own, which match nothing and pile up nowhere.
    """
    lone = F.concat(F.lit("\x00"), F.col("request_id").cast("string"))
    keyed = with_digest(requests)
    looked_up = lookup_join(
        keyed.withColumn("_d", F.when(F.col("use_cache") & F.col("digest").isNotNull(), F.col("digest")).otherwise(lone)),
        stored.select(F.col("digest").alias("_d"), F.lit(True).alias("_hit")),
        ["_d"], ["request_id"], count_in=keyed.select(F.col("digest").alias("_d")),
    )
    undecided = F.col("early_code").isNull() & F.col("_hit").isNull()
    facts = probes.select(
        F.col("video_id").alias("_v"), "duration", "language", "is_live", "live_status",
        "subtitles", "automatic_captions", F.lit(True).alias("_probed"),
    )
    full = lookup_join(
        looked_up.withColumn("_v", F.when(undecided, F.col("video_id")).otherwise(lone)),
        facts, ["_v"], ["request_id"], count_in=keyed.select(F.col("video_id").alias("_v")),
    )
    prefer = F.col("prefer_subs")
    file = F.when(F.col("model_path").isNotNull(), F.col("model_path")).otherwise(model_file(F.col("model")))
    at_hand = list(installed)
    missing = ~file.isin(*at_hand) if at_hand else F.lit(True)
    if VAD_MODEL[1] not in at_hand:
        missing = missing | F.col("vad")
    track = F.when(
        prefer & F.col("_probed"),
        select_track(F.col("subtitles"), F.col("automatic_captions"), F.col("lang"), F.col("language")),
    )
    over = too_long(F.col("duration"), F.col("max_duration_min"))
    outcome = (
        F.when(F.col("early_code").isNotNull(), F.struct(F.lit("refused").alias("outcome"), F.col("early_code").alias("code")))
        .when(F.col("_hit"), _outcome("cache"))
        .when(~prefer & F.col("_missing"), _outcome("refused", 30))
        .when(F.col("_probed").isNull(), _outcome("refused", 20))
        .when(is_live(F.col("is_live"), F.col("live_status")), _outcome("refused", 13))
        .when(~prefer & over, _outcome("refused", 14))
        .when(F.col("_track").isNotNull(), _outcome("subtitles"))
        .when(over, _outcome("refused", 14))
        .when(F.col("_missing"), _outcome("refused", 30))
        .when(short_of_memory(F.col("duration"), F.col("word_timestamps"), F.col("available_bytes")), _outcome("refused", 15))
        .otherwise(_outcome("inference"))
    )
    planned = full.withColumn("_missing", missing).withColumn("_track", track).withColumn("_o", outcome)
    by_captions = F.col("_o.outcome") == "subtitles"
    return planned.select(
        "request_id", "video_id", "digest", "_o.outcome", "_o.code",
        F.when(by_captions, F.col("_track.lang")).alias("track_lang"),
        F.when(by_captions, F.col("_track.auto")).alias("track_auto"),
        F.when(
            F.col("_o.outcome") == "inference",
            memory_required(F.coalesce(F.col("duration"), F.lit(0.0)), F.col("word_timestamps")),
        ).alias("est_bytes"),
    )


def _outcome(name: str, code: int | None = None) -> Column:
    return F.struct(F.lit(name).alias("outcome"), F.lit(code).cast("int").alias("code"))


def build_documents(media: DataFrame, runs: DataFrame) -> DataFrame:
    """(media_id, source, run): provenance and conditions of each result.

    The transcript's segments stay in their own table under media_id. `media`:
    media_id, canonical_url, video_id, title, channel, duration, upload_date;
    `runs`: media_id, model, backend, language, translated, vad, elapsed_ms,
    speed_realtime.
    """
    source = F.struct(
        F.col("canonical_url").alias("url"), "video_id", "title", "channel",
        F.col("duration").alias("duration_s"), "upload_date",
    )
    run = F.struct(
        F.lit("whisper.cpp").alias("engine"), "model", "backend", F.col("run_language").alias("language"),
        "translated", "vad", F.col("elapsed_ms").alias("duration_ms"), "speed_realtime",
    )
    renamed = runs.withColumnRenamed("language", "run_language")
    return media.join(renamed, "media_id").select("media_id", source.alias("source"), run.alias("run"))
