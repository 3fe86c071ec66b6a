"""The scalar expressions as SQL functions of the session.

Each is defined once, as a Column expression over its parameters; the body of the
SQL function is written out from that expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cueweave.functions import admission, catalogue, digest, errors, text, timecode, urls

_BETWEEN = {"=": "=", "==": "=", "<=>": "<=>", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "+": "+", "-": "-", "*": "*", "/": "/",
            "%": "%", "and": "AND", "or": "OR", "&": "&", "|": "|", "^": "^", "div": "div"}
_BEFORE = {"!": "NOT", "not": "NOT", "negative": "-", "~": "~"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def sql_text(column: Column) -> str:
    """A Column expression as SQL text."""
    return _text(column._jc.node())


def _text(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "Literal":
        type_name = node.dataType().get().sql() if node.dataType().isDefined() else ""
        value = node.value()
        if value is None:
            return f"CAST(NULL AS {type_name or 'STRING'})"
        if isinstance(value, float):
            return f"CAST('{value!r}' AS DOUBLE)" if abs(value) != float("inf") else f"CAST('{'-' if value < 0 else ''}Infinity' AS DOUBLE)"
        return node.sql()
    if kind == "UnresolvedAttribute":
        return ".".join(_items(node.nameParts()))
    if kind == "UnresolvedNamedLambdaVariable":
        return node.name()
    if kind == "LambdaFunction":
        names = [a.name() for a in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_text(node.function())}"
    if kind == "Alias":
        return f"{_text(node.child())} AS {_items(node.name())[0]}"
    if kind == "Cast":
        return f"CAST({_text(node.child())} AS {node.dataType().sql()})"
    if kind == "CaseWhenOtherwise":
        branches = " ".join(f"WHEN {_text(b._1())} THEN {_text(b._2())}" for b in _items(node.branches()))
        last = f" ELSE {_text(node.otherwise().get())}" if node.otherwise().isDefined() else ""
        return f"CASE {branches}{last} END"
    if kind == "UnresolvedExtractValue":
        # The name of a field is bare; a place in an array is an expression.
        at = _text(node.extraction())
        return f"{_text(node.child())}.{at[1:-1]}" if at.startswith("'") else f"{_text(node.child())}[{at}]"
    if kind == "UnresolvedFunction":
        name, of = node.functionName().lower(), [_text(a) for a in _items(node.arguments())]
        if name in _BETWEEN and len(of) == 2:
            return f"({of[0]} {_BETWEEN[name]} {of[1]})"
        if name in _BEFORE and len(of) == 1:
            return f"({_BEFORE[name]} {of[0]})"
        if name == "in":
            return f"({of[0]} IN ({', '.join(of[1:])}))"
        return f"{node.functionName()}({', '.join(of)})"
    raise ValueError(f"no SQL text for {kind}")




#: name → (parameters with types, expression over them).
FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "collapse_ws": ("s STRING", text.collapse_ws),
    "strip_tags": ("s STRING", text.strip_tags),
    "vtt_escape": ("s STRING", text.vtt_escape),
    "wrap_lines": ("s STRING, width INT", text.wrap_lines),
    "lang_primary": ("s STRING", text.lang_primary),
    "normalise_prompt": ("s STRING", text.normalise_prompt),
    "normalise_lang": ("s STRING", text.normalise_lang),
    "safe_filename": ("title STRING, extension STRING", text.safe_filename),
    "words_of": ("s STRING", text.words_of),
    "parse_timestamp": ("s STRING", timecode.parse_timestamp),
    "parse_cue_timing": ("line STRING", timecode.parse_cue_timing),
    "format_timestamp": ("ms BIGINT, sep STRING", timecode.format_timestamp),
    "cs_to_samples": ("cs DOUBLE", timecode.cs_to_samples),
    "duration_min": ("seconds DOUBLE", timecode.duration_min),
    "speed_realtime": ("audio_ms BIGINT, elapsed_ms BIGINT", timecode.speed_realtime),
    "canonical_url": ("url STRING", urls.canonical_url),
    "error_detail": ("message STRING", errors.error_detail),
    "classify_error": ("message STRING", errors.classify_error),
    "error_variant": ("code INT", errors.error_variant),
    "is_live": ("flag BOOLEAN, status STRING", admission.is_live),
    "memory_required": ("seconds DOUBLE, words BOOLEAN", admission.memory_required),
    "memory_budget": ("available BIGINT", admission.memory_budget),
    "max_minutes": ("available BIGINT, words BOOLEAN", admission.max_minutes),
    "model_id": ("alias STRING, path STRING", lambda a, p: catalogue.model_id(a, p)),
    "translate_supported": ("model STRING, translate BOOLEAN", catalogue.translate_supported),
    "config_digest": ("video_id STRING, model STRING, lang STRING, translate BOOLEAN, vad BOOLEAN, words BOOLEAN, prompt STRING, "
                      "no_speech_thold FLOAT, entropy_thold FLOAT", digest.config_digest),
}


def definition(spark: SparkSession, name: str, prefix: str = "cue_") -> str:
    """The statement that creates the function."""
    parameters, make = FUNCTIONS[name]
    names = [p.split(" ")[0] for p in parameters.split(", ")]
    body = make(*[F.col(n) for n in names])
    returns = spark.createDataFrame([], parameters).select(body.alias("v")).schema["v"].dataType.simpleString()
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {returns} RETURN {sql_text(body)}"


def register(spark: SparkSession, prefix: str = "cue_") -> list[str]:
    """Create temporary SQL functions; returns their names."""
    for name in FUNCTIONS:
        spark.sql(definition(spark, name, prefix))
    return [prefix + name for name in FUNCTIONS]
