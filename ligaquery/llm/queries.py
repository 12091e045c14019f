"""Queries of the training-data problems for language models: 1, 7, 8 and 9."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligaquery.llm import bpe, packing, percentiles, truncation
from ligaquery.session import table

TOKENIZERS = "/opt/tokenizers"
PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def _ranks(folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, "byte_bpe_50k.tiktoken")


def _scored_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of int_partners with the scores of their record; NaN and the 1000 of "no energy" are null."""
    c = lambda n: F.when(~F.isnan(n) & (F.col(n) != 1000), F.col(n)).cast("double").alias(n)
    scores = table(spark, sf_dir, "split_records").select("rec_no", c("xc"), c("xe"), F.to_date("called_at").alias("day"))
    return table(spark, sf_dir, "int_partners").select("rec_no", "partner").join(scores, "rec_no")


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per partner, from the counts of single days put together."""
    days = percentiles.value_counts(_scored_partners(spark, sf_dir), ["partner"], ["xc", "xe"], ["day"])
    out = percentiles.percentiles(percentiles.combined(days, ["partner"]), ["partner"], PROBS)
    return out.select("partner", "measure", "p", "n", F.round("value", 6).alias("value"))


def p1_day_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per day of called_at."""
    counts = percentiles.value_counts(_scored_partners(spark, sf_dir), ["day"], ["xc", "xe"])
    out = percentiles.percentiles(counts, ["day"], PROBS)
    return out.select(F.col("day").cast("string").alias("day"), "measure", "p", "n", F.round("value", 6).alias("value"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text", _ranks())


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = [(r.pack_name, r.capacity) for r in table(spark, sf_dir, "pack_sizes").collect()]  # four rows at any scale
    return packing.pack(bpe.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", _ranks()), "doc_id", "n_tokens", packs)


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(_packed(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.by_source(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def queries() -> dict:
    return {f.__name__: f for f in (p1_percentiles, p1_day_percentiles, p7_ids, p8_pack, p8_fill, p9_found, p9_sources)}


def _percentile_sql(group: str) -> str:
    probs = ", ".join(f"({p})" for p in PROBS)
    return f"""
            WITH s AS (
                SELECT i.partner, r.called_at::DATE::VARCHAR AS day, unnest([{{'measure': 'xc', 'v': r.xc::DOUBLE}}, {{'measure': 'xe', 'v': r.xe::DOUBLE}}], recursive := true)
                FROM int_partners i JOIN split_records r USING (rec_no)
            ), t AS (
                SELECT {group}, measure, v, count(*) OVER g AS n, row_number() OVER (PARTITION BY {group}, measure ORDER BY v) - 1 AS i
                FROM s WHERE v IS NOT NULL AND NOT isnan(v) AND v <> 1000 WINDOW g AS (PARTITION BY {group}, measure)
            ), w AS (SELECT t.*, p, (n - 1) * p::DOUBLE AS h FROM t, (VALUES {probs}) q(p))
            SELECT {group}, measure, p::DOUBLE AS p, n, round(
                max(CASE WHEN i = floor(h) THEN v END) * (1 - (max(h) - floor(max(h)))) + max(CASE WHEN i = ceil(h) THEN v END) * (max(h) - floor(max(h))), 6) AS value
            FROM w WHERE i IN (floor(h), ceil(h)) GROUP BY {group}, measure, p, n"""


def oracle_sql() -> dict[str, str]:
    return {"p1_percentiles": _percentile_sql("partner"), "p1_day_percentiles": _percentile_sql("day")}
