"""A corpus pipeline of five stages over the documents table; part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, whatever further ones it has. Every stage takes empty tables,
null ids, null, empty and very long texts and repeated rows; what becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamstack.llm import binary_output, decontaminate, jaccard_join, language_id, mixing
from loamstack.llm.common import cut, discard, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; trained on these documents' own labels.

    Null, empty and letterless texts are rejected; repeated rows are judged alike; without labels all are rejected.
    """
    return language_id.keep_identified(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the lowest id; of repeated rows one.

    Rows with a null id, or without words, are no copies and stay.
    """
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark table; null and empty texts hold none, null ids are judged like others."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights picks them.

    Those without words, or with neither source nor language, are never picked; rows that repeat are picked alike.
    """
    return mixing.keep_mixed(docs)


def output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary token records, one for each row; the result is their manifest. Null texts have no tokens."""
    return binary_output.write_records(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_records", output_stage),
]

#: Linear machines and min-cost flow have no SQL form; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        done = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(docs)
        docs = done
    name, last = STAGES[-1]
    manifest = last(spark, docs, sf_dir)
    discard(docs)
    return manifest
