"""Vector, lexical and hybrid search. A query's own vectors or terms are literals in the plan: a few dozen numbers a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from .common import small


def nearest(vectors: DataFrame, query: list[float], k: int, ids: list[str], column: str = "e") -> DataFrame:
    """The k rows of greatest dot product; ties by id. One pass, with a top-k in each task."""
    return vectors.withColumn("score", V.dot(F.col(column), V.literal(query))).orderBy(F.desc("score"), *ids).limit(k)


def maxsim(vectors: DataFrame, query: list[list[float]], *more: Column, alpha: float = 1.0) -> DataFrame:
    """(chunk_id, score): the mean over query vectors of the greatest dot product. Maxima combine before the shuffle."""
    best = vectors.groupBy("chunk_id").agg(*(F.max(V.dot(F.col("e"), V.literal(q))).alias(f"__m{i}") for i, q in enumerate(query)), *more)
    total = sum((F.coalesce(f"__m{i}", F.lit(0.0)) for i in range(1, len(query))), F.coalesce("__m0", F.lit(0.0))) if query else F.lit(0.0)
    return best.withColumn("score", alpha * total / max(1, len(query))).drop(*(f"__m{i}" for i in range(len(query))))


def maxsim_many(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) for a table of queries (query_id, q_id, qe)."""
    pairs = vectors.select("chunk_id", "e").crossJoin(small(queries))
    best = pairs.groupBy("query_id", "chunk_id", "q_id").agg(F.max(V.dot(F.col("e"), F.col("qe"))).alias("m"))
    return best.groupBy("query_id", "chunk_id").agg(F.avg("m").alias("score"))


def explain_maxsim(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Each query vector's best token vector (the first of ties), and the spread of the maxima by chunk."""
    pairs = vectors.select("chunk_id", "vector_id", "e").crossJoin(small(query)).withColumn("d", V.dot(F.col("e"), F.col("qe")))
    best = pairs.groupBy("chunk_id", "q_id").agg(F.max(F.struct("d", (-F.col("vector_id")).alias("v"))).alias("b"))
    w = Window.partitionBy("chunk_id")
    m = F.col("b.d")
    return best.select("chunk_id", "q_id", (-F.col("b.v")).alias("best_vector"), F.round(m, 6).alias("best"), F.round(F.avg(m).over(w), 6).alias("score"),
                       F.round(F.min(m).over(w), 6).alias("low"), F.round(F.max(m).over(w), 6).alias("high"), F.round(F.stddev_pop(m).over(w), 6).alias("spread"))


def max_of_max(vectors: DataFrame, query: list[list[float]], k: int) -> DataFrame:
    """Each query vector's 2k best rows, then each chunk's best of those; scores of 0 and less are dropped."""
    hits = None
    for q in query:
        top = nearest(vectors, q, 2 * k, ["chunk_id", "vector_id"]).select("chunk_id", "score")
        hits = top if hits is None else hits.unionByName(top)
    return hits.groupBy("chunk_id").agg(F.max("score").alias("score")).where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(k)


def pooled(vectors: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """(key, pooled): the unit vector along the mean. One partial sum for each dimension, no explode."""
    means = vectors.groupBy(key).agg(*(F.avg(F.col(column)[i]).alias(f"__d{i}") for i in range(width)))
    return means.select(key, F.array(*(F.col(f"__d{i}") for i in range(width))).alias("__mean")).select(key, V.unit(F.col("__mean")).alias("pooled"))


def minmax(x: str) -> Column:
    """x scaled to 0..1 over all rows; a range of 0 counts as 1."""
    return (F.col(x) - F.col(f"__lo_{x}")) / F.coalesce(F.nullif(F.col(f"__hi_{x}") - F.col(f"__lo_{x}"), F.lit(0.0)), F.lit(1.0))


def hybrid_maxsim(scored: DataFrame, text: DataFrame, weight: float = 0.3) -> DataFrame:
    """Both scores scaled to 0..1 over the hits, then blended; text hits that the vectors lack are dropped."""
    both = scored.join(text, "chunk_id", "left").select("chunk_id", "score", F.coalesce("text_score", F.lit(0.0)).alias("text"))
    # One row; so a broadcast of it has a fixed size.
    ends = both.agg(*(f(x).alias(f"__{n}_{x}") for x in ("score", "text") for n, f in (("lo", F.min), ("hi", F.max))))
    return both.crossJoin(F.broadcast(ends)).select("chunk_id", ((1 - weight) * minmax("score") + weight * minmax("text")).alias("score"))


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, alpha: float) -> DataFrame:
    """Raw scores blended over the hits of either; what a side lacks counts 0."""
    both = vector_hits.join(text_hits, "chunk_id", "full_outer")
    return both.select("chunk_id", (alpha * F.coalesce("vector_score", F.lit(0.0)) + (1 - alpha) * F.coalesce("text_score", F.lit(0.0))).alias("score"))


def bm25(docs: DataFrame, query: str, id_column: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents that hold a query term. Counts of these terms alone are made, in one pass; no postings are shuffled."""
    q = sorted(set(query.lower().split()))
    t = docs.select(id_column, T.terms_among("text", q).alias("__t"))
    own = t.select(id_column, F.size("__t").alias("__n"), F.array_remove("__t", "").alias("__own"))
    tf = own.select(id_column, "__n", *(T.count_of(F.col("__own"), w).alias(f"__f{i}") for i, w in enumerate(q)))
    # One row of statistics.
    stats = tf.agg(F.count(F.lit(1)).alias("__docs"), F.avg("__n").alias("__mean"), *(F.count_if(F.col(f"__f{i}") > 0).alias(f"__df{i}") for i in range(len(q))))
    both = tf.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(q)):
        f, df = F.col(f"__f{i}"), F.col(f"__df{i}")
        score = score + F.log(1 + (F.col("__docs") - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("__n") / F.col("__mean")))
    # Not just score > 0: from that Spark infers a null check of every count, each with the terms of all texts told apart once more.
    return both.select(id_column, score.alias("score")).where("coalesce(score, 0.0) > 0")
