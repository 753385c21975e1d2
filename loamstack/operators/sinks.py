"""Rewrites and writes: upsert, update, delete, schema additions, and tables of a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; an aggregate, so that a hot key combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("__r")).select(*keys, *(F.col("__r")[c].alias(c) for c in rest))


def upsert(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those with the same keys."""
    return store.join(new.select(*keys), keys, "left_anti").unionByName(new)


def update_where(rows: DataFrame, condition: Column, values: dict[str, object]) -> DataFrame:
    return rows.withColumns({c: F.when(condition, F.lit(v)).otherwise(F.col(c)) for c, v in values.items() if v is not None})


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def add_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds what a table lacks, as nulls; a second run changes nothing."""
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in rows.columns})


def drop_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.drop(*columns)


MIGRATIONS = "name string, applied_at timestamp"


def migrate(rows: DataFrame, log: DataFrame, name: str, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Adds columns under a migration's name, and the name to the log; one that the log holds changes nothing."""
    if not log.where(F.col("name") == name).isEmpty():
        return rows, log
    return add_columns(rows, columns), log.unionByName(log.sparkSession.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("applied_at")))


def revert(rows: DataFrame, log: DataFrame, name: str, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Takes a migration's columns and its name out again; one that the log lacks changes nothing."""
    if log.where(F.col("name") == name).isEmpty():
        return rows, log
    return drop_columns(rows, columns), log.where(F.col("name") != name)


def store(rows: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def vector_rows(chunks: DataFrame) -> DataFrame:
    """One row for each token vector of (chunk_id, vectors), under the id chunk_vec_i."""
    flat = chunks.select("chunk_id", F.posexplode("vectors").alias("vector_id", "embedding"))
    return flat.withColumn("id", F.concat("chunk_id", F.lit("_vec_"), F.col("vector_id").cast("string")))


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
