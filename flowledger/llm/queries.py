"""The registered query of each training-data operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, langid, lm, media, mixing, pii, secrets, simhash, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the items."""
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.reply_order(_table(spark, sf_dir, "conversations"))


def op10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_simhash, op3_secrets, op4_token_counts, op5_mixing, op6_pii, op7_language, op8_media, op9_chat, op10_scores)
}

ORACLES: dict[str, str] = {
    # Sizes, weights and rates of the sources; the inverse of each Poisson distribution by its own formula; then as many copies.
    "op5_mixing": r"""
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(size) * sum(size) OVER () / (sum(sqrt(size)) OVER () * size) AS rate FROM sizes),
steps AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rates, (SELECT unnest(range(0, 120))::DOUBLE AS k)),
u AS (SELECT d.*, ('0x' || substr(md5('mix:1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents d),
n AS (SELECT u.*, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM u.source AND s.c <= u.u) AS n FROM u)
SELECT n.* EXCLUDE (u, n), c.copy::INTEGER AS copy FROM n, LATERAL (SELECT unnest(range(1, n.n + 1)) AS copy) c
""",
}
