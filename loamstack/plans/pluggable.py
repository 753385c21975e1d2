"""Queries through the places for models, and the streaming statistics over a bounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..operators import validation
from ..streaming import streams
from .answers import QUESTION, hits
from .corpus import good_chunks
from .registry import query, table


@query()
def enc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = good_chunks(spark, sf_dir)[1]
    return models.encode(c, parts=("n_vectors", "pooled")).select("chunk_id", "n_vectors", F.round(F.element_at("pooled", 1), 6).alias("first"))


@query()
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)[1]
    return h.select("chunk_id", F.round(models.pair_score(F.lit(QUESTION), F.col("text")), 6).alias("score"))


@query()
def answers_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn answered from its document by extraction, then validated."""
    u = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"))
    both = u.join(d, "conv_id", "left").withColumn("answer", models.extractive_answer(F.col("context"), F.col("question")))
    return validation.validate(both).select("conv_id", "turn", F.round("risk", 6).alias("risk"), "level", F.round("quality", 6).alias("quality"), "served")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def stream_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.windowed_stats(table(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"))
