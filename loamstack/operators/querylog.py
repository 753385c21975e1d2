"""Analytics over a query log. Averages leave nulls out, each metric by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col


def with_latest(df: DataFrame, ts: str) -> DataFrame:
    """Adds the table's latest time: one row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(F.max(ts).alias("__latest"))))


def trailing(log: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """The last days before ``now``, or before the log's latest entry."""
    span = F.expr(f"INTERVAL {int(days)} DAYS")
    if now is not None:
        return log.where(F.col("created_at") >= now - span)
    return with_latest(log, "created_at").where(F.col("created_at") >= F.col("__latest") - span).drop("__latest")


def stats(log: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6)
    return log.agg(F.count(F.lit(1)).alias("n"), mean("hallucination_score").alias("avg_risk"), mean("quality_score").alias("avg_quality"), mean("total_time_ms").alias("avg_time_ms"), mean("rating").alias("avg_rating"))


def stats_or_zero(log: DataFrame) -> DataFrame:
    """The counts and means, 0 where there is nothing to average."""
    return stats(log).select("n", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_time_ms", "avg_rating")))


def shares(log: DataFrame, **conditions: Column) -> DataFrame:
    """The share of the log's rows that meet each condition; 0 of an empty log."""
    return log.agg(*(F.round(F.coalesce(F.try_divide(F.count_if(c), F.count(F.lit(1))), F.lit(0.0)), 6).alias(name) for name, c in conditions.items()))


def rates(log: DataFrame, by: str = "llm_backend") -> DataFrame:
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count(F.lit(1))), F.lit(0.0)), 6)
    return log.groupBy(by).agg(share(F.col("level").isin("low", "medium")).alias("pass_rate"), share(F.col("rating").isNotNull()).alias("rated_rate"), F.round(F.avg("total_time_ms"), 6).alias("avg_time_ms"))


def high_quality() -> Column:
    return F.coalesce((F.col("quality_score") >= 0.7) & (F.col("hallucination_score") <= 0.3) & F.col("level").isin("low", "medium"), F.lit(False))


def request_problem(text: str | Column, days: str | Column) -> Column:
    n = F.coalesce(F.length(col(text)), F.lit(0))
    return F.when(n == 0, "empty_query").when(n > 2000, "long_query").when(col(days) > 365, "days_out_of_range")


def preview(text: str | Column, most: int = 200) -> Column:
    return F.when(F.length(col(text)) > most, F.concat(F.substring(col(text), 1, most), F.lit("..."))).otherwise(col(text))


def evict_oldest(entries: DataFrame, ts: str, key: str, above: int = 1000, tenth: int = 10) -> DataFrame:
    """Without the oldest tenth, if there are more than ``above`` rows.

    Neither a global sort nor a window: the last row to go is found by its time and then, among equal times, by its key.
    """
    n = entries.count()
    if n <= above:
        return entries
    drop = n // tenth
    at, before = value_at(entries, ts, drop - 1)
    last, _ = value_at(entries.where(F.col(ts) == at), key, drop - 1 - before)
    return entries.where((F.col(ts) > at) | ((F.col(ts) == at) & (F.col(key) > last)))


def value_at(rows: DataFrame, column: str, rank: int) -> tuple:
    """The value at a place (from 0) of a column's order, and how many rows lie below it.

    An approximate quantile at either side leaves a band of about 1/2000 of the rows, of which distinct values are counted.
    """
    kind = rows.schema[column].dataType.simpleString()
    number = F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.col(column)
    own = rows.select(number.alias("x"), F.col(column).alias("v")).where("x is not null")
    n = own.count()
    near = [min(1.0, max(0.0, rank / n + side * 0.00025)) for side in (-1, 1)]
    low, high = own.agg(F.percentile_approx("x", near, 10_000).alias("q")).first()[0]
    below = own.where(F.col("x") < low).count()
    band = own.where(F.col("x").between(low, high)).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v")).orderBy("x")
    for r in band.toLocalIterator():
        if below + r["n"] > rank:
            return r["v"], below
        below += r["n"]
    raise ValueError(f"no place {rank} among {n} rows")
