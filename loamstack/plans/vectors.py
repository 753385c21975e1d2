"""Queries over token vectors: chunk_id = vec_id div 10, vector_id = vec_id % 10; the query is a chunk's vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import search
from .lexical import BM25, QUESTION
from .registry import query, table

CHUNK = 3
VEC = "v AS (SELECT vec_id // 10 AS chunk_id, vec_id % 10 AS vector_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT vector_id AS q_id, e AS qe FROM v WHERE chunk_id = 3)"
SIMS = "s AS (SELECT chunk_id, vector_id, q_id, list_dot_product(e, qe) AS d FROM v, q), m AS (SELECT chunk_id, q_id, max(d) AS m FROM s GROUP BY 1, 2)"
POOL = "p AS (SELECT chunk_id, list(a ORDER BY i) AS mean FROM (SELECT chunk_id, i, avg(e[i]) AS a FROM v, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)"


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("chunk_id"), (F.col("vec_id") % 10).alias("vector_id"), F.col("embedding").cast("array<double>").alias("e"), "label"
    )


def weighted(a: Column) -> Column:
    """The sum of an array's elements times their places, so that a comparison takes in all of them."""
    return F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)


def query_vectors(vectors: DataFrame) -> list[list[float]]:
    """The query's own vectors, as many as one query has."""
    return [r[0] for r in vectors.where(F.col("chunk_id") == CHUNK).orderBy("vector_id").select("e").collect()]


@query(f"WITH {VEC} SELECT chunk_id, vector_id, round(list_dot_product(e, (SELECT qe FROM q WHERE q_id = 0)), 6) AS score FROM v ORDER BY list_dot_product(e, (SELECT qe FROM q WHERE q_id = 0)) DESC, chunk_id, vector_id LIMIT 100")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = token_vectors(spark, sf_dir)
    return search.nearest(v, query_vectors(v)[0], 100, ["chunk_id", "vector_id"]).select("chunk_id", "vector_id", F.round("score", 6).alias("score"))


@query(f"WITH {VEC}, {SIMS} SELECT chunk_id, round(avg(m), 6) AS score FROM m GROUP BY 1 ORDER BY avg(m) DESC, chunk_id LIMIT 100")
def maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = token_vectors(spark, sf_dir)
    return search.maxsim(v, query_vectors(v)).orderBy(F.desc("score"), "chunk_id").limit(100).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH {VEC}, {SIMS}, b AS (SELECT s.chunk_id, s.q_id, min(vector_id) AS first_at, any_value(m.m) AS m FROM s JOIN m ON s.chunk_id = m.chunk_id AND s.q_id = m.q_id AND s.d = m.m GROUP BY 1, 2)
SELECT chunk_id, q_id, first_at AS best_vector, round(m, 6) AS best, round(avg(m) OVER w, 6) AS score, round(min(m) OVER w, 6) AS low, round(max(m) OVER w, 6) AS high, round(stddev_pop(m) OVER w, 6) AS spread
 FROM b WINDOW w AS (PARTITION BY chunk_id)""")
def maxsim_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = token_vectors(spark, sf_dir)
    q = [(i, x) for i, x in enumerate(query_vectors(v))]
    return search.explain_maxsim(v, spark.createDataFrame(q, "q_id bigint, qe array<double>"))


@query(f"""WITH {VEC}, s AS (SELECT chunk_id, vector_id, q_id, list_dot_product(e, qe) AS d FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d DESC, chunk_id, vector_id) AS rn FROM s)
SELECT chunk_id, round(max(d), 6) AS score FROM r WHERE rn <= 40 GROUP BY 1 HAVING max(d) > 0 ORDER BY max(d) DESC, chunk_id LIMIT 20""")
def maxsim_maxofmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = token_vectors(spark, sf_dir)
    return search.max_of_max(v, query_vectors(v), 20).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {VEC}, {SIMS} SELECT l.label AS document, m.chunk_id AS page, round(avg(m.m), 6) AS score FROM m JOIN (SELECT chunk_id, min(label) AS label FROM v GROUP BY 1) l USING (chunk_id) GROUP BY 1, 2 ORDER BY avg(m.m) DESC, 2 LIMIT 10")
def page_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = token_vectors(spark, sf_dir)
    scored = search.maxsim(v, query_vectors(v), F.min("label").alias("document"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(10).select("document", F.col("chunk_id").alias("page"), F.round("score", 6).alias("score"))


@query(f"WITH {VEC} SELECT count(DISTINCT label) AS documents, count(DISTINCT chunk_id) AS pages, count(*) AS patches, round(count(*) / count(DISTINCT chunk_id), 6) AS patches_per_page FROM v")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = token_vectors(spark, sf_dir).groupBy("chunk_id", "label").agg(F.count(F.lit(1)).alias("n"))
    out = pages.agg(F.countDistinct("label").alias("documents"), F.countDistinct("chunk_id").alias("pages"), F.sum("n").alias("patches"))
    return out.withColumn("patches_per_page", F.round(F.try_divide("patches", "pages"), 6))


@query(f"WITH {VEC}, {POOL} SELECT chunk_id, i AS dim, round(mean[i] / sqrt(list_dot_product(mean, mean)), 6) AS value FROM p, range(1, 65) r(i)")
def vec_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = search.pooled(token_vectors(spark, sf_dir), "chunk_id", "e", 64)
    return pooled.select("chunk_id", F.posexplode("pooled").alias("dim", "value")).select("chunk_id", (F.col("dim") + 1).cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query(f"WITH {VEC} SELECT chunk_id, vector_id, round(list_dot_product(e[1:32], e[1:32]), 6) AS head, round(list_sum(list_transform(e[1:32], lambda x, i: x * i)) / sqrt(list_dot_product(e[1:32], e[1:32])), 5) AS weighted FROM v")
def vec_truncate_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = token_vectors(spark, sf_dir).withColumn("t", V.truncated(F.col("e"), 32))
    return short.select("chunk_id", "vector_id", F.round(V.dot(F.col("t"), F.col("t")), 6).alias("head"), F.round(weighted(V.unit(F.col("t"))), 5).alias("weighted"))


@query(f"WITH {VEC}, {POOL} SELECT chunk_id, vector_id, false AS is_pooled, round(list_sum(list_transform(e, lambda x, i: x * i)), 5) AS weighted FROM v UNION ALL SELECT chunk_id, -1, true, round(list_sum(list_transform(mean, lambda x, i: x * i)) / sqrt(list_dot_product(mean, mean)), 5) FROM p")
def snk_token_plus_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = token_vectors(spark, sf_dir)
    own = v.select("chunk_id", "vector_id", F.lit(False).alias("is_pooled"), F.round(weighted(F.col("e")), 5).alias("weighted"))
    pooled = search.pooled(v, "chunk_id", "e", 64).select("chunk_id", F.lit(-1).cast("bigint").alias("vector_id"), F.lit(True).alias("is_pooled"), F.round(weighted(F.col("pooled")), 5).alias("weighted"))
    return own.unionByName(pooled)


@query(f"""WITH {VEC}, {SIMS}, mm AS (SELECT chunk_id, avg(m) AS mm FROM m GROUP BY 1), {BM25}, t AS (SELECT doc_id AS chunk_id, bm AS t FROM bm25 WHERE bm > 0),
n AS (SELECT mm.chunk_id, (mm - min(mm) OVER ()) / coalesce(nullif(max(mm) OVER () - min(mm) OVER (), 0), 1) AS mm, coalesce(t, 0) AS t FROM mm LEFT JOIN t USING (chunk_id)),
k AS (SELECT chunk_id, mm, (t - min(t) OVER ()) / coalesce(nullif(max(t) OVER () - min(t) OVER (), 0), 1) AS t FROM n)
SELECT chunk_id, round(0.7e0 * mm + 0.3e0 * t, 6) AS score FROM k ORDER BY 0.7e0 * mm + 0.3e0 * t DESC, chunk_id LIMIT 100""")
def hybrid_maxsim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = token_vectors(spark, sf_dir)
    text = search.bm25(table(spark, sf_dir, "documents"), QUESTION).select(F.col("doc_id").alias("chunk_id"), F.col("score").alias("text_score"))
    both = search.hybrid_maxsim(search.maxsim(v, query_vectors(v)), text)
    return both.orderBy(F.desc("score"), "chunk_id").limit(100).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH {VEC}, x AS (SELECT chunk_id, max(list_dot_product(e, (SELECT qe FROM q WHERE q_id = 0))) AS a FROM v GROUP BY 1), {BM25}, t AS (SELECT doc_id AS chunk_id, bm AS b FROM bm25 WHERE bm > 0)
SELECT chunk_id, round(0.7e0 * coalesce(a, 0) + 0.3e0 * coalesce(b, 0), 6) AS score FROM x FULL JOIN t USING (chunk_id) ORDER BY 0.7e0 * coalesce(a, 0) + 0.3e0 * coalesce(b, 0) DESC, chunk_id LIMIT 50""")
def hybrid_vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = token_vectors(spark, sf_dir)
    q = V.literal(query_vectors(v)[0])
    hits = v.groupBy("chunk_id").agg(F.max(V.dot(F.col("e"), q)).alias("vector_score"))
    text = search.bm25(table(spark, sf_dir, "documents"), QUESTION).select(F.col("doc_id").alias("chunk_id"), F.col("score").alias("text_score"))
    return search.hybrid(hits, text, 0.7).orderBy(F.desc("score"), "chunk_id").limit(50).select("chunk_id", F.round("score", 6).alias("score"))
