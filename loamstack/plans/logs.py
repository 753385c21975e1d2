"""Query-log analytics, and sinks stated as queries. The log is the events table: the event type is the backend, the value a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import querylog, sinks
from .registry import query, table

LOG = """log AS (SELECT event_id AS id, ts AS created_at, user_id, event_type AS llm_backend, least(1e0, value / 500) AS hallucination_score, CAST(floor(value) AS BIGINT) AS total_time_ms,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 5 + 1 END AS rating, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1 - value / 1000 END AS quality_score FROM events),
lev AS (SELECT *, CASE WHEN hallucination_score < 0.25 THEN 'low' WHEN hallucination_score < 0.5 THEN 'medium' WHEN hallucination_score < 0.75 THEN 'high' ELSE 'critical' END AS level FROM log)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    score = F.least(F.lit(1.0), F.col("value") / 500)
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", F.col("event_type").alias("llm_backend"), score.alias("hallucination_score"),
        F.floor("value").alias("total_time_ms"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 5 + 1).alias("rating"),
        F.when(F.col("event_id") % 11 != 0, 1 - F.col("value") / 1000).alias("quality_score"), S.risk_level(score).alias("level"),
    )


RECENT = "lev WHERE created_at >= (SELECT max(created_at) FROM lev) - INTERVAL 7 DAY"


@query(f"WITH {LOG} SELECT count(*) AS n, round(avg(hallucination_score), 6) AS avg_risk, round(avg(quality_score), 6) AS avg_quality, round(avg(total_time_ms), 6) AS avg_time_ms, round(avg(rating), 6) AS avg_rating FROM {RECENT}")
def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.stats(querylog.trailing(log(spark, sf_dir), 7))


@query(f"WITH {LOG} SELECT level, count(*) AS n FROM {RECENT} GROUP BY level")
def log_risk_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.trailing(log(spark, sf_dir), 7).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT llm_backend, count(*) AS n FROM {RECENT} GROUP BY llm_backend")
def log_backend_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.trailing(log(spark, sf_dir), 7).groupBy("llm_backend").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT id FROM lev WHERE coalesce(quality_score >= 0.7 AND hallucination_score <= 0.3 AND level IN ('low', 'medium'), false)")
def log_high_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where(querylog.high_quality()).select("id")


@query(f"""WITH {LOG} SELECT llm_backend, round(count(*) FILTER (level IN ('low', 'medium')) / count(*), 6) AS pass_rate, round(count(*) FILTER (rating IS NOT NULL) / count(*), 6) AS rated_rate,
 round(avg(total_time_ms), 6) AS avg_time_ms FROM lev GROUP BY llm_backend""")
def log_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.rates(log(spark, sf_dir))


@query(f"""WITH {LOG} SELECT id, level, CAST(CASE WHEN level IN ('high', 'critical') THEN 1 ELSE 0 END + CASE WHEN quality_score < 0.6 THEN 1 ELSE 0 END AS BIGINT) AS warnings_count FROM lev""")
def log_risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("level").isin("high", "critical"), 1).otherwise(0) + F.when(F.col("quality_score") < 0.6, 1).otherwise(0)
    return log(spark, sf_dir).select("id", "level", n.cast("bigint").alias("warnings_count"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) = 0 OR text IS NULL THEN 'empty_query' WHEN length(text) > 2000 THEN 'long_query' WHEN turn > 365 THEN 'days_out_of_range' END AS problem FROM conversations""")
def log_request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", querylog.request_problem("text", "turn").alias("problem"))


@query("SELECT event_id, ts + INTERVAL 1 DAY < (SELECT max(ts) FROM events) AS expired FROM events")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.with_latest(table(spark, sf_dir, "events"), "ts").select("event_id", (F.col("ts") + F.expr("INTERVAL 1 DAY") < F.col("__latest")).alias("expired"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events) WHERE n <= 1000 OR rn > n // 10")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.evict_oldest(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id")


@query(f"WITH {LOG} SELECT round(count(*) FILTER (level IN ('low', 'medium')) / count(*), 6) AS pass_rate, round(count(*) FILTER (rating IS NOT NULL) / count(*), 6) AS rated_rate, round(count(*) FILTER (quality_score >= 0.5) / count(*), 6) AS success_rate FROM lev")
def log_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.shares(log(spark, sf_dir), pass_rate=F.col("level").isin("low", "medium"), rated_rate=F.col("rating").isNotNull(), success_rate=F.col("quality_score") >= 0.5)


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def snk_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return sinks.latest(e.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'completed' ELSE source END AS status FROM documents")
def snk_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.update_where(table(spark, sf_dir, "documents").withColumn("status", F.col("source")), F.col("lang") == "en", {"status": "completed"}).select("doc_id", "status")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def snk_delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return sinks.delete(table(spark, sf_dir, "documents"), gone, ["doc_id"]).select("doc_id", "source")


@query(f"WITH {LOG} SELECT id, CAST(floor(quality_score * 5) AS INT) AS confidence_score, CASE WHEN length(llm_backend) > 4 THEN llm_backend[1:4] || '...' ELSE llm_backend END AS preview FROM lev")
def snk_querylog_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).select("id", F.floor(F.col("quality_score") * 5).cast("int").alias("confidence_score"), querylog.preview("llm_backend", 4).alias("preview"))
