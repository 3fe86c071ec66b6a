"""Explicit schemas; nothing is inferred from data."""

REQUEST = (
    "request_id BIGINT, url STRING, model STRING, model_path STRING, vad BOOLEAN, lang STRING, "
    "translate BOOLEAN, initial_prompt STRING, word_timestamps BOOLEAN, no_speech_thold FLOAT, "
    "entropy_thold FLOAT, prefer_subs BOOLEAN, use_cache BOOLEAN, max_duration_min BIGINT, "
    "max_line_width INT, max_line_count INT, format STRING, available_bytes BIGINT"
)
_TRACKS = "MAP<STRING, ARRAY<STRUCT<ext: STRING, url: STRING, name: STRING>>>"
PROBE = (
    "id STRING, title STRING, channel STRING, duration DOUBLE, upload_date STRING, language STRING, "
    "is_live BOOLEAN, live_status STRING, age_limit INT, "
    f"subtitles {_TRACKS}, automatic_captions {_TRACKS}"
)
WORD = "STRUCT<word: STRING, start: DOUBLE, end: DOUBLE, probability: FLOAT>"
SEGMENT = (
    "STRUCT<id: BIGINT, start: DOUBLE, end: DOUBLE, text: STRING, no_speech_prob: FLOAT, "
    f"avg_logprob: FLOAT, words: ARRAY<{WORD}>>"
)
SOURCE = (
    "STRUCT<url: STRING, video_id: STRING, title: STRING, channel: STRING, duration_s: DOUBLE, "
    "upload_date: STRING>"
)
RUN = (
    "STRUCT<engine: STRING, model: STRING, backend: STRING, language: STRING, "
    "language_probability: FLOAT, translated: BOOLEAN, vad: BOOLEAN, duration_ms: BIGINT, "
    "speed_realtime: DOUBLE>"
)
TRANSCRIPT = (
    f"STRUCT<segments: ARRAY<{SEGMENT}>, language: STRING, language_probability: FLOAT, "
    "translated: BOOLEAN>"
)
EXPORT = f"schema_version INT, source {SOURCE}, transcription {RUN}, segments ARRAY<{SEGMENT}>"
ENVELOPE = f"version INT, document STRUCT<source: {SOURCE}, run: {RUN}, transcript: {TRANSCRIPT}>"
# Benchmark lines keep the field names of the files.
BENCH = (
    "modele STRING, backend STRING, threads INT, vad BOOLEAN, audio_s DOUBLE, chargement_s DOUBLE, "
    "inference_s DOUBLE, vitesse DOUBLE, segments BIGINT"
)
