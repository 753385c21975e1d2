"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import binary_output, decontaminate, html_extraction, jaccard_join, language_id, mixing, neighbours, secret_scan, sharding, token_counts
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_with_redactions(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.write_records(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_secret_scan, op3_decontamination, op4_mixing, op5_html_extraction,
        op6_sharding, op7_language_id, op8_neighbours, op9_jaccard_join, op10_token_records,
    )
} | {"pipeline": corpus_pipeline.run}

JACCARD_SQL = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), grams AS (
    SELECT doc_id, list_sort(list_distinct(list_transform(
        range(1, greatest(1, len(w) - {jaccard_join.N - 1}) + 1), lambda i: array_to_string(w[i : i + {jaccard_join.N - 1}], ' ')))) AS g
    FROM words WHERE len(w) > 0
), sets AS (SELECT min(doc_id) AS rep, g, count(*) - 1 AS n_copies FROM grams GROUP BY g),
one AS (SELECT rep, len(g) AS n, unnest(g) AS gram FROM sets),
near AS (
    SELECT a.rep AS a, b.rep AS b FROM one a JOIN one b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY 1, 2
    HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*))::DOUBLE >= {jaccard_join.THRESHOLD}
), degree AS (SELECT a AS rep, count(*) AS n_links FROM near GROUP BY 1),
reach AS (SELECT rep, rep AS label FROM degree UNION SELECT near.b, reach.label FROM reach JOIN near ON near.a = reach.rep),
class AS (SELECT rep, min(label) AS class_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, s.rep) AS class_id, coalesce(n.n_links, 0) AS n_links, s.n_copies
FROM grams d JOIN sets s ON d.g = s.g LEFT JOIN degree n ON n.rep = s.rep LEFT JOIN class c ON c.rep = s.rep
WHERE s.n_copies > 0 OR n.n_links > 0
"""

ORACLE_SQL: dict[str, str] = {"op2_secret_scan": secret_scan.oracle(), "op9_jaccard_join": JACCARD_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
