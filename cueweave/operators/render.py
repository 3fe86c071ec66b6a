"""Rendering of transcripts as txt, srt, vtt and json.

A rendered document is a sequence of parts: (media_id, part, content). A media
of usual length has one part; longer ones are cut, so that no task has to hold
a whole media. The document is the concatenation of its parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.text import collapse_ws, vtt_escape
from cueweave.functions.timecode import format_timestamp
from cueweave.operators.blocks import BLOCK, block_of, block_scan, lookup_join
from cueweave.operators.cues import CueOptions, build_cues, drop_empty_segments

PART_ROWS = 65_536

# Format names with their synonyms, export version, VTT header.
FORMATS = {"txt": "txt", "text": "txt", "srt": "srt", "vtt": "vtt", "webvtt": "vtt", "json": "json"}
SCHEMA_VERSION = 1
VTT_HEADER = "WEBVTT\n\n"


def _parts(rows: DataFrame, position: str, piece: Column, separator: str = "") -> DataFrame:
    """Pieces of each (media, part) joined in order; `part` is 0 for the first."""
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("k"), piece.alias("v")))), lambda x: x["v"]),
        separator,
    )
    return rows.groupBy("media_id", BLOCK).agg(joined.alias("content")).select(
        "media_id", F.col(BLOCK).alias("part"), "content"
    )


def _edges(rows: DataFrame) -> DataFrame:
    """Rows with `_opening` and `_closing`: is this the media's first, last part?"""
    return block_scan(
        rows, ["media_id"], [F.count(F.lit(1)).alias("_n")],
        lambda order, before: {
            "_opening": F.lag("_n").over(order).isNull(),
            "_closing": F.lead("_n").over(order).isNull(),
        },
    )


def render_txt(segments: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Running text: segment texts joined by a space, a final newline.

    Media without any text have no row: their document is the empty string.
    """
    rows = drop_empty_segments(segments).select(
        "media_id", "segment_id", collapse_ws(F.col("text")).alias("text"),
        block_of(F.col("segment_id"), part_rows).alias(BLOCK),
    )
    marked = _edges(rows)
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "text"))), lambda x: x["text"]), " "
    )
    return marked.groupBy("media_id", BLOCK, "_opening", "_closing").agg(body.alias("_b")).select(
        "media_id", F.col(BLOCK).alias("part"),
        F.concat(
            F.when(F.col("_opening"), "").otherwise(" "), F.col("_b"), F.when(F.col("_closing"), "\n").otherwise("")
        ).alias("content"),
    )


def _cue_times(separator: str) -> Column:
    return F.concat(
        format_timestamp(F.col("start_ms"), separator), F.lit(" --> "), format_timestamp(F.col("end_ms"), separator)
    )


def srt_block(lines: Column) -> Column:
    return F.concat(
        F.col("cue_index").cast("string"), F.lit("\n"), _cue_times(","), F.lit("\n"),
        F.array_join(lines, "\n"), F.lit("\n\n"),
    )


def vtt_block(lines: Column) -> Column:
    header = F.when(F.col("cue_index") == 1, VTT_HEADER).otherwise("")
    return F.concat(
        header, _cue_times("."), F.lit("\n"), vtt_escape(F.array_join(lines, "\n")), F.lit("\n\n")
    )


def _render_cues(cues: DataFrame, piece: Column, part_rows: int) -> DataFrame:
    return _parts(cues.withColumn(BLOCK, block_of(F.col("cue_index") - 1, part_rows)), "cue_index", piece)


def render_srt(cues: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    return _render_cues(cues, srt_block(F.col("lines")), part_rows)


def render_vtt(cues: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    return _render_cues(cues, vtt_block(F.col("lines")), part_rows)


def json_segment() -> Column:
    """One segment as JSON; absent optionals and empty word lists are left out."""
    return F.to_json(
        F.struct(
            F.col("segment_id").alias("id"),
            (F.col("start_ms") / 1000.0).alias("start"),
            (F.col("end_ms") / 1000.0).alias("end"),
            "text",
            *[c for c in ("no_speech_prob", "avg_logprob", "words")],
        )
    )


def render_json(documents: DataFrame, segments: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Versioned JSON document from (media_id, source, run) and the segments."""
    absent = {"no_speech_prob": "float", "avg_logprob": "float"}
    full = segments.select(
        "media_id", "segment_id", "start_ms", "end_ms", "text",
        *[F.col(c) if c in segments.columns else F.lit(None).cast(t).alias(c) for c, t in absent.items()],
        (F.when(F.size("words") > 0, F.col("words")) if "words" in segments.columns else F.lit(None).cast("array<string>")).alias("words"),
        block_of(F.col("segment_id"), part_rows).alias(BLOCK),
    )
    marked = _edges(full)
    body = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("segment_id").alias("k"), json_segment().alias("v")))),
            lambda x: x["v"],
        ),
        ",\n",
    )
    parts = marked.groupBy("media_id", BLOCK, "_opening", "_closing").agg(body.alias("_b"))
    head = F.concat(
        F.lit(f'{{"schema_version":{SCHEMA_VERSION},"source":'), F.to_json("source"),
        F.lit(',"transcription":'), F.to_json("run"), F.lit(',"segments":['),
    )
    # Only opening parts need the head, so a media's many other parts are not
    # joined at all; a document without segments is a head of its own.
    heads = documents.select("media_id", head.alias("_head"))
    opening = heads.join(parts.where("_opening"), "media_id", "left")
    others = parts.where(~F.col("_opening"))
    close = F.when(F.coalesce(F.col("_closing"), F.lit(True)), "\n]}\n").otherwise("")
    known = lookup_join(others, heads.select("media_id"), ["media_id"], [BLOCK], how="left_semi")
    return opening.select(
        "media_id",
        F.coalesce(F.col(BLOCK), F.lit(0).cast("bigint")).alias("part"),
        F.concat("_head", F.lit("\n"), F.coalesce(F.col("_b"), F.lit("")), close).alias("content"),
    ).unionByName(
        known.select("media_id", F.col(BLOCK).alias("part"), F.concat(F.lit(",\n"), "_b", close).alias("content"))
    )


def format_name(name: str) -> str:
    """Canonical format name; unknown ones are a usage error."""
    known = FORMATS.get(name.lower())
    if known is None:
        raise ValueError(f"unknown format: {name!r} (expected: txt, srt, vtt, json)")
    return known


def render(
    name: str,
    segments: DataFrame,
    documents: DataFrame | None = None,
    options: CueOptions = CueOptions(),
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Render by format name; adds the column `format`."""
    chosen = format_name(name)
    if chosen == "txt":
        out = render_txt(segments, part_rows)
    elif chosen == "json":
        if documents is None:
            raise ValueError("the json format needs the documents table")
        out = render_json(documents, segments, part_rows)
    else:
        cues = build_cues(segments, options)
        out = (render_srt if chosen == "srt" else render_vtt)(cues, part_rows)
    return out.withColumn("format", F.lit(chosen))


def render_formats(
    names: list[str],
    segments: DataFrame,
    documents: DataFrame | None = None,
    options: CueOptions = CueOptions(),
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """`render` for several formats; those made of cues share one pass over them."""
    chosen = [format_name(name) for name in names]
    of_cues = [name for name in chosen if name in ("srt", "vtt")]
    out = [render(name, segments, documents, options, part_rows) for name in chosen if name not in of_cues]
    if of_cues:
        lines = F.col("lines")
        cues = build_cues(segments, options).select(
            "media_id", "cue_index", block_of(F.col("cue_index") - 1, part_rows).alias(BLOCK),
            *[(srt_block if name == "srt" else vtt_block)(lines).alias(name) for name in dict.fromkeys(of_cues)])
        pieces = cues.groupBy("media_id", BLOCK).agg(
            F.array_sort(F.collect_list(F.struct("cue_index", *dict.fromkeys(of_cues)))).alias("_pieces"))
        contents = [F.struct(F.array_join(F.col("_pieces")[name], "").alias("content"), F.lit(name).alias("format")) for name in of_cues]
        out.append(pieces.select("media_id", F.col(BLOCK).alias("part"), F.inline(F.array(*contents))))
    return reduce(DataFrame.unionByName, out)
