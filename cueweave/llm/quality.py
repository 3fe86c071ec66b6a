"""Quality rules: fixed counts, and the divergence of a document from its language.

Two histograms describe a document: classes of characters, and the most common
words of its language (all others together are one more bin). Both come from the
corpus: the most common words of every language found there are counted, and the
reference of a language is the sum over all documents that name it. A document
whose Jensen-Shannon distance (base 2, square root) to the reference is too large
is rejected; short documents are not judged, as their histograms mean little, and
neither are documents without a language, or of one with few documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions.naming import let
from cueweave.llm.common import stored

# Fixed values of the contract.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

BLANK = "\t\n\x0b\f\r"

#: Common words per language; the histogram has a bin for each, and one for the rest.
N_COMMON = 8
CLASSES = ("upper", "digit", "mark", "symbol", "space", "wide", "other")
#: Documents with fewer words are judged by the fixed rules alone.
LEAST_WORDS = 100
#: A language with fewer documents of so many words has no reference.
LEAST_DOCUMENTS = 10
#: Largest distances that pass.
CHARACTER_LIMIT = 0.3
WORD_LIMIT = 0.26


def _count(text: Column, pattern: str) -> Column:
    """Matches of a class of ASCII characters."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"{pattern}+", ""))


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    def counted(hashes: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
            again = F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return let(F.array_sort(F.transform(again, lambda x: x["i"])), lambda starts: F.aggregate(
                F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3)))),
                F.lit(0), lambda a, n: a + n))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, of_sorted))

    # Windows are compared by 64-bit hashes within one text.
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(windows, counted))


def common_words(frame: DataFrame, text: str = "text", lang: str = "lang", n: int = N_COMMON) -> DataFrame:
    """`_l` and `_top`: the `n` most common words with a letter of each language, ties by the word."""
    words = F.explode(F.split(F.translate(F.col(text), BLANK, " " * len(BLANK)), " "))
    counts = frame.where(F.col(lang).isNotNull()).select(F.col(lang).alias("_l"), words.alias("_word"))
    counts = counts.where("_word <> ''").groupBy("_l", "_word").agg(F.count("*").alias("_n"))
    counts = counts.where(F.regexp_like("_word", F.lit(r"\p{L}")))  # marks of tables are no words
    rank = F.row_number().over(Window.partitionBy("_l").orderBy(F.desc("_n"), "_word"))  # limited per task before the shuffle
    top = counts.withColumn("_rank", rank).where(F.col("_rank") <= n)
    return top.groupBy("_l").agg(F.array_sort(F.collect_list(F.struct("_rank", "_word"))).alias("_top")).select(
        "_l", F.col("_top._word").alias("_top"))


def measure(frame: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: the fixed counts, and both histograms as arrays of counts."""
    rows = frame.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(lang).alias("_lang"))
    top = common_words(frame, text, lang)  # a row per language
    rows = rows.join(F.broadcast(top), F.col("_lang") == F.col("_l"), "left").drop("_l")
    rows = rows.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("_spaced", F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" ")))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    rows = rows.select(
        "*", F.length(F.array_join("_words", "")).alias("_chars"), _count(F.col("_text"), SYMBOL).alias("_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("_lines"),
        _repeated(F.col("_words")).alias("_repeated"))
    text_ = F.col("_text")
    upper, digit, mark = _count(text_, "[A-Z]"), _count(text_, "[0-9]"), _count(text_, "[.,;:!?'\"()-]")
    wide = F.octet_length("_text") - F.length("_text")  # further bytes of characters beyond ASCII
    space = F.length("_text") - F.col("_chars")
    classes = F.array(*[c.cast("double") for c in (upper, digit, mark, F.col("_symbols"), space, wide)])
    classes = let(classes, lambda a: F.concat(a, F.array(F.greatest(
        F.lit(0.0), F.octet_length("_text") - F.aggregate(a, F.lit(0.0), lambda s, x: s + x)))))

    counts = F.transform("_top", lambda w: let(F.concat(F.lit(" "), w, F.lit(" ")), lambda x: (
        F.octet_length("_spaced") - F.octet_length(F.replace("_spaced", x, F.lit("")))) / F.octet_length(x)))
    common = let(counts, lambda a: F.concat(a, F.array(
        F.size("_words") - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))))
    return rows.select(
        "_key", "_lang", F.size("_words").cast("bigint").alias("n_words"), F.col("_chars").cast("bigint").alias("word_chars"),
        F.col("_symbols").cast("bigint").alias("n_symbols"), F.col("_lines").cast("bigint").alias("n_dup_lines"),
        F.col("_repeated").cast("bigint").alias("n_repeat_words"), classes.alias("_classes"), common.alias("_common"))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms; 0 where one of them is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def of(s: Column) -> Column:
        terms = F.zip_with(s["a"], s["b"], lambda x, y: let(
            F.struct((x / s["ta"]).alias("p"), (y / s["tb"]).alias("q")),
            lambda v: let((v["p"] + v["q"]) / 2, lambda m: (part(v["p"], m) + part(v["q"], m)) / 2)))
        return F.when((s["ta"] > 0) & (s["tb"] > 0), F.sqrt(F.greatest(F.lit(0.0), total(terms)))).otherwise(0.0)

    return let(F.struct(a.alias("a"), b.alias("b"), total(a).alias("ta"), total(b).alias("tb")), of)


def judge(frame: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          character_limit: float = CHARACTER_LIMIT, word_limit: float = WORD_LIMIT,
          least_words: int = LEAST_WORDS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Per row: key, `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`,
    `base_failed`, `kept`, `character_distance`, `word_distance`.

    A null or empty text has no words, so it fails. A null language, or one with
    fewer than `least_documents` documents of `least_words` words, has no
    reference: its distances are null, and the fixed rules alone decide. Null keys
    stay null; repeated rows give equal rows and count as often as they occur; an
    empty table gives none. Other columns are not read. Texts are read twice, for
    the common words and for the counts, which are stored; the references are sums
    of a few numbers per language.
    """
    rows = stored(measure(frame, key, text, lang), "quality")
    sums = lambda name, n: F.array(*[F.coalesce(F.sum(F.get(F.col(name), F.lit(i))), F.lit(0.0)) for i in range(n)])
    reference = rows.where(F.col("_lang").isNotNull()).groupBy(F.col("_lang").alias("_l")).agg(
        sums("_classes", len(CLASSES)).alias("_ref_c"), sums("_common", N_COMMON + 1).alias("_ref_w"),
        F.count_if(F.col("n_words") >= least_words).alias("_judged"))
    reference = reference.where(F.col("_judged") >= least_documents).drop("_judged")  # a row per language
    rows = rows.join(F.broadcast(reference), F.col("_lang") == F.col("_l"), "left")
    known = F.col("_l").isNotNull()
    apart_c = F.when(known, distance(F.col("_classes"), F.col("_ref_c")))
    apart_w = F.when(known & F.col("_common").isNotNull(),
                     distance(F.col("_common"), F.slice("_ref_w", F.lit(1), F.size("_common"))))
    rows = rows.select(
        "*", apart_c.alias("character_distance"), apart_w.alias("word_distance"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"))
    far = F.coalesce((F.col("character_distance") > character_limit) | (F.col("word_distance") > word_limit), F.lit(False))
    return rows.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~((F.col("n_words") >= least_words) & far)).alias("kept"),
        "character_distance", "word_distance")
