"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs whole into a sink that drops its rows: once to warm up, then RUNS times, of which the median counts.
"""

from __future__ import annotations

import json
import os
import platform
import statistics
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstack.functions import vectors as V
from loamstack.operators import chunking, querylog, rerank, search
from loamstack.plans.answers import validated
from loamstack.plans.corpus import good_chunks
from loamstack.plans.lexical import QUESTION
from loamstack.plans.logs import log
from loamstack.plans.registry import table
from loamstack.plans.vectors import query_vectors, token_vectors

RUNS = 3


def quality_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = chunking.parents(chunking.good_documents(table(spark, sf_dir, "documents")))
    return parents.select("parent_id", "text").unionByName(chunking.children(parents).select("parent_id", "text"))


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = token_vectors(spark, sf_dir)
    return search.nearest(v, query_vectors(v)[0], 1000, ["chunk_id", "vector_id"]).select("chunk_id", "vector_id", "score")


def maxsim_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim as two aggregates over pairs of vectors."""
    v = token_vectors(spark, sf_dir)
    q = spark.createDataFrame(list(enumerate(query_vectors(v))), "q_id bigint, qe array<double>")
    pairs = v.select("chunk_id", "e").crossJoin(F.broadcast(q))  # a query's own vectors: ten
    best = pairs.groupBy("chunk_id", "q_id").agg(F.max(V.dot(F.col("e"), F.col("qe"))).alias("m"))
    return best.groupBy("chunk_id").agg(F.avg("m").alias("score"))


def maxsim_hof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim with the query's vectors as literals, one maximum each: what the operator does."""
    v = token_vectors(spark, sf_dir)
    return search.maxsim(v, query_vectors(v))


def maxsim_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MaxSim by a matrix product in Arrow batches."""
    v = token_vectors(spark, sf_dir)
    q = np.array(query_vectors(v))

    @F.pandas_udf("array<double>")
    def products(e: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(e.to_numpy()) @ q.T))

    scored = v.select("chunk_id", products("e").alias("p"))
    best = scored.groupBy("chunk_id").agg(*(F.max(F.col("p")[i]).alias(f"m{i}") for i in range(len(q))))
    return best.select("chunk_id", (sum(F.col(f"m{i}") for i in range(len(q))) / len(q)).alias("score"))


def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.cascade(good_chunks(spark, sf_dir)[1], QUESTION, ["chunk_id"])


def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.stats(log(spark, sf_dir))


QUERIES = (quality_chunk, knn_exact, maxsim_rel, maxsim_hof, maxsim_arrow, lexical_rerank, validate, stats)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for query in QUERIES:
        taken = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[f"bench_{query.__name__}"] = round(statistics.median(taken[1:]), 3)
    about = {"cpus": int(cpus), "shuffle_partitions": int(cpus), "memory_gb": round(os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2**30), "spark": spark.version, "python": platform.python_version()}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, median seconds each, summed", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "hardware": about}))
    spark.stop()


if __name__ == "__main__":
    main()
