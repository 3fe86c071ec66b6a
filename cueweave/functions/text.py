"""Text expressions: whitespace, markup, wrapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U) makes \s the Unicode White_Space property; plain \s is ASCII only. Single
# plain spaces, the common case, are left alone.
_WS_RUN = r"(?U)\s{2,}|[^\S ]"

# The characters with that property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Entities a caption file escapes, in the order they are undone.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))


def trim_ws(c: Column) -> Column:
    """Trim any Unicode whitespace (`trim` alone only removes U+0020)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def collapse_ws(c: Column) -> Column:
    """Every run of whitespace becomes one space; both ends trimmed."""
    return F.btrim(F.regexp_replace(c, _WS_RUN, " "))


def strip_tags(c: Column) -> Column:
    """Drop `<…>` markup (an unclosed `<` swallows the rest), then unescape."""
    out = F.replace(F.regexp_replace(c, r"<[^>]*(?:>|\z)", ""), F.lit(">"), F.lit(""))
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def vtt_escape(c: Column) -> Column:
    """Escape `& < >` for a WebVTT body, the ampersand first."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def wrap_lines(c: Column, width: Column | int = 42) -> Column:
    """Greedy wrap of a text into lines of at most `width` code points.

    On collapsed text the greedy line is the longest run of at most `width`
    characters that stops before a space or the end; where the first word alone
    is longer, `width` characters of it are cut. Both are one regex scan, linear
    in the text, so no fold over words is needed.
    """
    if isinstance(width, Column):
        n = F.greatest(width, F.lit(1)).cast("string")
        pattern = F.concat(F.lit("(?s)(?:.{1,"), n, F.lit(r"}(?: |\z)|.{"), n, F.lit("})"))
    else:
        n = max(int(width), 1)
        pattern = F.lit(rf"(?s)(?:.{{1,{n}}}(?: |\z)|.{{{n}}})")
    return F.transform(
        F.regexp_extract_all(collapse_ws(c), pattern, F.lit(0)),
        lambda line: F.rtrim(line),
    )


def words_of(c: Column, longer_than: int = 3) -> Column:
    """Distinct lower-case words longer than `longer_than` characters."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > longer_than))


def lang_primary(c: Column) -> Column:
    """Primary sub-tag: `fr` of `fr-FR`."""
    return F.split_part(c, F.lit("-"), F.lit(1))


def normalise_prompt(c: Column) -> Column:
    """Trim; a blank prompt equals none."""
    return F.nullif(trim_ws(c), F.lit(""))


def normalise_lang(c: Column) -> Column:
    """Trim, lower-case; blank and `auto` mean detection (null)."""
    cleaned = F.lower(trim_ws(c))
    return F.when(~cleaned.isin("", "auto"), cleaned)


# Characters file systems refuse, the name length limit and the
# name of an untitled document.
UNSAFE_CHARS = '<>:"/\\|?*'
MAX_TITLE_CHARS = 80
UNTITLED = "transcription"


def safe_filename(title: Column, extension: Column | str) -> Column:
    """Title → file name that any file system accepts."""
    ext = F.lit(extension) if isinstance(extension, str) else extension
    spaced = F.regexp_replace(F.coalesce(title, F.lit("")), r'[\p{Cc}<>:"/\\|?*]', " ")
    base = F.regexp_replace(F.substring(collapse_ws(spaced), 1, MAX_TITLE_CHARS), r"[. ]+\z", "")
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit(UNTITLED)), F.lit("."), ext)
