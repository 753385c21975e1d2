"""Helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if the table has at most ``most`` rows; else Spark shuffles as it sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
