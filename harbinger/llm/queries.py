"""The registered queries of the text operators, over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger.llm import (
    cotraining,
    decontaminate,
    filter_audit,
    hard_negatives,
    histogram_packing,
    langid,
    licenses,
    near_dedup,
    packing,
    pii,
    repetition,
    secrets,
    toxicity,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(function):
    QUERIES[function.__name__] = function
    return function


@register
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on 4-word shingles at 80 hundredths."""
    return near_dedup.link_documents(table(spark, sf_dir, "documents"), k=4, percent=80)


@register
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-kernel toxicity scores of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in documents, verified."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets and linked weak parts of every document."""
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


@register
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document placed in training sequences of four lengths."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@register
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.language_ids(table(spark, sf_dir, "documents"))


@register
def op5_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    return repetition.repetition(table(spark, sf_dir, "documents"))


@register
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License sentences, rules and licenses of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLES["op4_license_scans"] = licenses.scan_sql()


@register
def op9_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-trained quality scores of every document."""
    return cotraining.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# a documented key of the registered query; a real run names its own secret
SURROGATE_KEY = b"registered query"


@register
def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, SURROGATE_KEY)


ORACLES["op5_repetition_rules"] = repetition.repetition_sql()
ORACLES["op8_secret_scans"] = secrets.secret_sql()


@register
def op13_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids placed in sequences of 4,096 by the histogram of lengths."""
    return histogram_packing.pack_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in every order: what each step keeps, removes and loses, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = filter_audit.audit_sql()


@register
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).alias("label"),
        hard_negatives.scaled("embedding").alias("vector"),
    )
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id))::INT AS rank
FROM positives p JOIN pairs n USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
