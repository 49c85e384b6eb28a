"""Catalog entries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language, license_scan, media, near_duplicates, packing, quality, sharding, suffix_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), with_text=True)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    named = language.identify(docs, language.train(docs))
    return named.select("doc_id", quality.held_out().alias("held_out"), "lang_pred", "score")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.extract(_read(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(_read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_read(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_license_scan, op3_quality_classifier, op4_language_id, op5_html_extraction, op6_decontamination, op7_best_fit_packing, op8_media_columns, op9_ngram_jaccard_join, op10_sharding)}


#: Words and five-word shingles as the operators define them.
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+'), lambda x: x <> '')"
_SHINGLES = f"""
  SELECT DISTINCT id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i : i + 4], ' ') ELSE chr(1) || array_to_string(w, ' ') END AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM (SELECT id, {_WORDS} AS w FROM source) WHERE len(w) > 0)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": f"""
WITH d AS ({_SHINGLES.replace("source", "(SELECT doc_id AS id, text FROM documents)")}),
     b AS ({_SHINGLES.replace("source", "(SELECT item_id AS id, text FROM benchmark)")}),
     n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS n_shingles, count(*)::DOUBLE / n.n AS containment
FROM b JOIN d USING (s) JOIN n ON n.id = b.id GROUP BY d.id, b.id, n.n HAVING count(*) >= 0.8 * n.n
""",
        "op9_ngram_jaccard_join": f"""
WITH RECURSIVE d AS MATERIALIZED ({_SHINGLES.replace("source", "(SELECT doc_id AS id, text FROM documents)")}),
     n AS (SELECT id, count(*) AS n FROM d GROUP BY id),
     w AS (SELECT doc_id AS id, array_to_string({_WORDS}, ' ') AS w FROM documents),
     p AS MATERIALIZED (
       SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS c FROM d x JOIN d y USING (s) WHERE x.id <> y.id GROUP BY 1, 2) q
       JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c >= 0.8 * (na.n + nb.n - c)),
     r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
     k AS (SELECT w, count(*) AS k FROM w WHERE w <> '' GROUP BY w)
SELECT r.id AS doc_id, min(root) AS class_id, coalesce((SELECT count(*) FROM p WHERE p.a = r.id), 0)::BIGINT AS n_links,
       coalesce((SELECT k.k FROM w JOIN k ON k.w = w.w WHERE w.id = r.id), 1)::BIGINT AS n_copies
FROM r GROUP BY r.id
""",
    }
