"""One query per operator, over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.llm import (
    alignment, bpe, chat, jaccard, licenses, neighbours, packing, page_text, phrases, quality, repeats, secret_scan, sharding,
)
from cueweave.llm.common import documents


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(spark.read.parquet(f"{folder}/conversations.parquet"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.find(documents(spark, folder)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return neighbours.search(vectors.where("vec_id % 20 = 0"), neighbours.index(vectors, 20), 20)


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, folder))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(secret_scan.listed("base").cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed("spans").alias("spans"))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.PATTERN)


def op9_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.extract(spark.read.parquet(f"{folder}/pages.parquet"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(documents(spark, folder), 3, 90).select("doc_id", "n_shingles", "component_id")


def op11_best_fit_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(documents(spark, folder), count=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op12_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(documents(spark, folder))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_byte_bpe, op3_suffix_repeats, op4_graph_neighbours, op5_license_scan, op6_quality_rules, op7_secret_scan, op8_best_fit_packing, op9_page_text, op10_jaccard_join,
    op11_best_fit_sharding, op12_phrase_mining, op13_token_alignment,
)}

ORACLE: dict[str, str] = {
    "op12_phrase_mining": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
            worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
            placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
            grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS p, count(*) AS f
                FROM placed, range(1, 5) AS t(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
            candidates AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS ws FROM grams WHERE k > 1 AND f >= 30),
            cuts AS (SELECT c.lang, c.p, c.a, j, h.f AS l, t.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (h.f + t.f) AS score
                FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
                JOIN grams h ON h.lang = c.lang AND h.p = array_to_string(c.ws[1:j], ' ')
                JOIN grams t ON t.lang = c.lang AND t.p = array_to_string(c.ws[j + 1:], ' ')),
            lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
            inner_ones AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS p, max(a) AS longer
                FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates WHERE k > 2), range(1, 4) AS t(i) WHERE i + m - 1 <= k GROUP BY ALL),
            kept AS (SELECT x.* FROM lowest x LEFT JOIN inner_ones y ON y.lang = x.lang AND y.p = x.p WHERE y.p IS NULL OR 100 * y.longer < 80 * x.a),
            totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang)
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000""",
}
