"""The registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm import bpe, importance, language_id, license_scan, media, near_dup, packing, quality, substring_dedup, toxicity
from shapelake.llm.common import Scratch, table


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files lie; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_docs(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.to_json("spans"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.clean(table(spark, sf_dir, "documents"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe_tiles(media.tiled(media.store(table(spark, sf_dir, "documents")))).drop("n_tiles")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.certified(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_docs(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), language_id.train(table(spark, sf_dir, "documents")))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"), scratch=Scratch(spark, "near_dup")).select("doc_id", "class_id", "class_size")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_license_scan, op3_substring_dedup, op4_importance_resampling, op5_bpe, op6_media, op7_packing, op8_quality, op9_language_id, op10_near_dup)}
#: The whole of none of these can be put in SQL: each is tested against brute force, an exact round trip or held-out
#: accuracy. What SQL can say of them stands in PROJECTIONS: the same operators over the same tables, some columns only.
ORACLE_SQL: dict[str, str] = {}


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with -1 for none."""
    first, last = (F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_word", "last_word"))
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", first, last, "base_labels")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


PROJECTIONS = {f.__name__: f for f in (license_places, media_payloads, quality_counts)}
_PHRASE = " OR ".join("(" + " AND ".join(f"w[i+{n}] = '{word}'" for n, word in enumerate(phrase.split())) + ")" for phrase in license_scan.PHRASES)
_LABEL = "CASE " + " ".join("WHEN " + " AND ".join(f"w[i+{n}] = '{word}'" for n, word in enumerate(phrase.split())) + f" THEN '{label}'" for phrase, label in license_scan.PHRASES.items()) + " END"
_BLANK = r"\x20\x09-\x0D"
PROJECTION_SQL = {
    "license_places": rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM t), f AS (SELECT r, i, {_LABEL} AS label FROM p WHERE {_PHRASE}),
        s AS (SELECT r, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, list_sort(list_distinct(list(label))) AS own FROM f GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(coalesce(a, -1) AS BIGINT) AS first_word, CAST(coalesce(b, -1) AS BIGINT) AS last_word, coalesce(array_to_string(own, ','), '') AS base_labels FROM t LEFT JOIN s USING (r)""",
    "media_payloads": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents), p AS (SELECT *, greatest(({media.ROW} - n % {media.ROW}) % {media.ROW}, CASE WHEN n = 0 THEN {media.ROW} ELSE 0 END) AS pad FROM t)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + pad AS BIGINT) AS payload_bytes, sha256(t || repeat(' ', CAST(pad AS BIGINT))) AS payload_sha256 FROM p""",
    "quality_counts": rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS w FROM documents),
        g AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t), k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i+1], w[i+2]) AS n FROM g),
        c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS j FROM k WHERE n > 1) GROUP BY 1),
        l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS own FROM t)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'gs')) AS BIGINT) AS n_symbols,
        CAST(len(own) - len(list_distinct(own)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed FROM t JOIN l USING (r) LEFT JOIN c USING (r)""",
}
