"""The fixed catalogue of recognition models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Alias, file, repository, revision, SHA-256, size in bytes.
_REPO = "ggerganov/whisper.cpp"
_REV = "5359861c739e955e79d9a303bcbc70fb988958b1"
MODELS = (
    ("tiny", "ggml-tiny.bin", _REPO, _REV,
     "be07e048e1e599ad46341c8d2a135645097a538221678b7acdd1b1919c6e1b21", 77_691_713),
    ("base", "ggml-base.bin", _REPO, _REV,
     "60ed5bc3dd14eea856493d334349b405782ddcaf0028d4b5df4088345fba2efe", 147_951_465),
    ("small", "ggml-small-q5_1.bin", _REPO, _REV,
     "ae85e4a935d7a567bd102fe55afc16bb595bdb618e11b2fc7591bc08120411bb", 190_085_487),
    ("medium", "ggml-medium-q5_0.bin", _REPO, _REV,
     "19fea4b380c3a618ec4723c3eef2eb785ffba0d0538cf43f8f235e7b3b34220f", 539_212_467),
    ("large-v3", "ggml-large-v3-q5_0.bin", _REPO, _REV,
     "d75795ecff3f83b5faa89d1900604ad8c780abd5739fae406de19f23ecd98ad1", 1_081_140_203),
    ("turbo", "ggml-large-v3-turbo-q5_0.bin", _REPO, _REV,
     "394221709cd5ad1f40c46e6031ca61bce88931e6e088c188294c6d5a55ffa7e2", 574_041_195),
)
VAD_MODEL = (
    "silero", "ggml-silero-v5.1.2.bin", "ggml-org/whisper-vad",
    "9ffd54a1e1ee413ddf265af9913beaf518d1639b",
    "29940d98d42b91fbd05ce489f3ecf7c72f0a42f027e4875919a28fb4c04ea2cf", 885_098,
)
SCHEMA = "alias STRING, file STRING, repo STRING, revision STRING, sha256 STRING, size BIGINT"
MODEL_URL_HOST = "https://huggingface.co"


def model_catalogue(spark: SparkSession, with_vad: bool = False) -> DataFrame:
    """The catalogue as a table of 6 rows (7 with the speech detector)."""
    rows = [*MODELS, VAD_MODEL] if with_vad else list(MODELS)
    return spark.createDataFrame(rows, SCHEMA).withColumn(
        "model_url",
        F.concat_ws("/", F.lit(MODEL_URL_HOST), "repo", F.lit("resolve"), "revision", "file"),
    )


def resolve_alias(alias: Column, gpu: Column | bool = False) -> Column:
    """`auto` is `turbo` on a GPU backend and `base` elsewhere."""
    on_gpu = F.lit(gpu) if isinstance(gpu, bool) else gpu
    return F.when(alias == "auto", F.when(on_gpu, F.lit("turbo")).otherwise(F.lit("base"))).otherwise(alias)


def resolve_any_alias(alias: Column, gpu: Column | bool = False) -> Column:
    """Wide lookup: `vad` also names the speech detector."""
    return F.when(alias == "vad", F.lit(VAD_MODEL[0])).otherwise(resolve_alias(alias, gpu))


def file_stem(path: Column) -> Column:
    """Last path component without its last extension."""
    name = F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def model_file(alias: Column, gpu: Column | bool = False) -> Column:
    """File of a transcription model, null for an unknown alias."""
    table = F.create_map(*[F.lit(x) for m in MODELS for x in m[:2]])
    return F.try_element_at(table, resolve_alias(alias, gpu))


def model_id(alias: Column, path: Column | None = None, gpu: Column | bool = False) -> Column:
    """Identifier that enters the digest; null when the alias is unknown."""
    known = file_stem(model_file(alias, gpu))
    return known if path is None else F.when(path.isNotNull(), file_stem(path)).otherwise(known)


def translate_supported(model: Column, translate: Column) -> Column:
    """False when translation is asked of a turbo model."""
    return ~(translate & F.contains(F.lower(model), F.lit("turbo")))
