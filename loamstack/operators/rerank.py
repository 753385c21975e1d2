"""Rerankers: lexical blend, weighted terms, listwise rules, ranking answers of a model, and the staged cascade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T


def lexical(chunks: DataFrame, query: str | Column, ids: list[str], k: int, prior: str | None = None, threshold: float | None = None) -> DataFrame:
    """The k best by Jaccard and phrase; with a prior score, 0.7 of that and 0.3 of the lexical one."""
    # As columns of their own, so that each text is lowered and split once.
    lowered = chunks.withColumn("__l", F.lower("text")).withColumn("__s", F.array_distinct(T.words("__l")))
    score = S.jaccard_with_phrase(query, "text", t=F.col("__s"), lower=F.col("__l"))
    if prior:
        score = 0.7 * F.col(prior) + 0.3 * score
    scored = lowered.withColumn("lexical_score", score).drop("__l", "__s")
    if threshold is not None:
        scored = scored.where(F.col("lexical_score") >= threshold)
    return scored.orderBy(F.desc("lexical_score"), *ids).limit(k)


STAGES = (100, 20, 5)


def placed(scored: DataFrame, score: str, ids: list[str], k: int) -> DataFrame:
    """Each query's k best rows with their ``place``. Tasks drop all beyond k of a query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *ids)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def stage(candidates: DataFrame, score: Column, name: str, k: int, force: bool = False) -> DataFrame:
    """One stage over short lists (each query's candidates with ``place``): their k best, renumbered, ties in the order before.

    A list of at most k rows passes unscored and in its order unless forced; where a score fails (null), 0.8 of the one
    before, ``prior``, counts if there is such a column.
    """
    lists = Window.partitionBy("query_id")
    if "prior" in candidates.columns:
        score = F.coalesce(score, 0.8 * F.col("prior"))
    counted = candidates.withColumn("__n", F.count(F.lit(1)).over(lists))
    scored = counted.withColumn(name, score if force else F.when(F.col("__n") > k, score))
    order = lists.orderBy(F.desc_nulls_last(name), "place")
    return scored.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("place", "__n").withColumnRenamed("__place", "place")


def rerank(candidates: DataFrame, sizes: tuple[int, int, int] = STAGES, pair: Callable[[Column, Column], Column] = S.word_cosine) -> DataFrame:
    """The later stages over first lists (query_id, query, text, place, lexical_score): pair scorer, then listwise rules; each stage's score is kept."""
    query, text = F.col("query"), F.col("text")
    second = stage(candidates.withColumn("prior", F.col("lexical_score")), pair(query, text), "pair_score", sizes[1]).drop("prior")
    third = stage(second, S.listwise(query, text, F.col("place")), "listwise_score", sizes[2])
    return third.withColumn("final_score", S.rank_score(F.col("place")))


def cascade(chunks: DataFrame, query: str, ids: list[str], sizes: tuple[int, int, int] = STAGES, pair: Callable[[Column, Column], Column] = S.word_cosine) -> DataFrame:
    """One question over all chunks: lexical top list, pair scorer, listwise rules."""
    top = lexical(chunks, query, ids, sizes[0]).withColumns({"query_id": F.lit(0), "query": F.lit(query)})
    return rerank(placed(top, "lexical_score", ids, sizes[0]), sizes, pair).drop("query")


def stage_records(candidates: DataFrame, ranked: DataFrame, pool: int, sizes: tuple[int, int, int] = STAGES) -> DataFrame:
    """What each stage of a cascade took in and gave out: (query_id, stage, n_in, n_out, reduction, low, high, mean).

    candidates: the first lists; ranked: rows of rerank before its cuts aren't kept, so counts follow from the lists' sizes.
    """
    n = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    steps = [("lexical", F.lit(pool), F.col("n"), "lexical_score", candidates)]
    steps += [(name, F.least("n", F.lit(a)), F.least("n", F.lit(b)), score, ranked) for name, a, b, score in (("pair", sizes[0], sizes[1], "pair_score"), ("listwise", sizes[1], sizes[2], "listwise_score"))]
    out = None
    for name, n_in, n_out, score, rows in steps:
        spread = rows.groupBy("query_id").agg(F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean"))
        part = n.join(spread, "query_id", "left").select(
            "query_id", F.lit(name).alias("stage"), n_in.cast("bigint").alias("n_in"), n_out.cast("bigint").alias("n_out"), F.coalesce(F.try_divide(n_in, n_out), F.lit(0.0)).alias("reduction"), "low", "high", "mean"
        )
        out = part if out is None else out.unionByName(part)
    return out


def sparse_dot(query_terms: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """(doc_id, score): sums of products over shared terms. Of a document's repeated term the last weight counts; repeated query terms each count."""
    last = doc_terms.groupBy("doc_id", "term").agg(F.max_by("weight", "pos").alias("weight"))
    return last.join(query_terms.select("term", "query_weight"), "term").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("query_weight")).alias("score"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, n_terms)."""
    t = docs.select("doc_id", T.terms("text").alias("__t"))
    return t.select("doc_id", F.size("__t").alias("n_terms"), F.explode("__t").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("n_terms").alias("n_terms"))


def relative_weights(docs: DataFrame, query_terms: list[str]) -> DataFrame:
    """(doc_id, term, weight) of the query's terms: 1 + ln(1 + share of the document's terms), relative to the document's greatest.

    Made inside each row: only ids and the query's terms are shuffled. Documents whose ids repeat, if there are any, are
    counted together over all of their terms.
    """
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    one, many = docs, None
    if not repeated.isEmpty():
        again = docs.join(repeated, "doc_id", "left_semi")
        # A null id is left by the anti-join, as a group of its own by the count; so it is taken with the rest.
        one, many = docs.join(repeated, "doc_id", "left_anti").where("doc_id is not null"), term_frequencies(again.unionByName(docs.where("doc_id is null")))
    query = F.array(*map(F.lit, sorted(set(query_terms))))
    t = one.select("doc_id", T.terms("text").alias("__t")).where(F.arrays_overlap("__t", query))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    most = F.aggregate(F.sort_array("__t"), start, step, lambda s: s["most"])
    own = F.filter("__t", lambda x: F.array_contains(query, x))
    counted = t.select("doc_id", F.size("__t").alias("n"), most.alias("most"), own.alias("own"))
    each = counted.select("doc_id", "n", "most", "own", F.explode(F.array_distinct("own")).alias("term"))
    tf = F.size(F.filter("own", lambda x: x == F.col("term")))
    weight = lambda tf: 1 + F.log1p(tf / F.col("n"))
    out = each.select("doc_id", "term", (weight(tf) / weight(F.col("most"))).alias("weight"))
    if many is None:
        return out
    w = many.withColumn("w", 1 + F.log1p(F.col("tf") / F.col("n_terms")))
    rest = w.withColumn("weight", F.col("w") / F.max("w").over(Window.partitionBy("doc_id"))).where(F.col("term").isin(sorted(set(query_terms))))
    return out.unionByName(rest.select("doc_id", "term", "weight"))


def parse_ranking(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank) from a model's answers (query_id, response) and its candidates (query_id, chunk_id, place).

    The answer's JSON names ids by their first eight characters or whole. Unknown ids are dropped, a repeated id keeps its
    first place, ids not named follow in their order; without readable JSON the order stays.
    """
    ranking = F.from_json(F.regexp_extract("response", r"(?s)\{.*\}", 0), "ranking array<string>")["ranking"]
    named = responses.select("query_id", F.posexplode(ranking).alias("at", "name"))
    short = candidates.groupBy("query_id", F.substring("chunk_id", 1, 8).alias("name")).agg(F.max_by("chunk_id", "place").alias("chunk_id"))
    exact = candidates.select("query_id", F.col("chunk_id").alias("name"), F.col("chunk_id").alias("exact"))
    found = named.join(short, ["query_id", "name"], "left").join(exact, ["query_id", "name"], "left")
    ranked = found.select("query_id", F.coalesce("chunk_id", "exact").alias("chunk_id"), "at").where("chunk_id is not null").groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
    both = candidates.join(ranked, ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("at").asc_nulls_last(), "place")
    return both.select("query_id", "chunk_id", F.row_number().over(order).alias("rank"))


def contributions(tf: DataFrame, query_terms: list[str]) -> DataFrame:
    """(doc_id, contributions): by query term, 1 + ln(1 + its share of the document's terms)."""
    own = tf.where(F.col("term").isin(sorted(set(query_terms))))
    pair = F.struct("term", (1 + F.log1p(F.col("tf") / F.col("n_terms"))).alias("w"))
    return own.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(pair)).alias("contributions"))


def reasons(ranked: DataFrame, response: str = "response") -> DataFrame:
    """``reason``: what a model's JSON says of each rank (query_id, rank, response), else that it was ranked there."""
    said = F.from_json(F.regexp_extract(response, r"(?s)\{.*\}", 0), "reasoning map<string,string>")["reasoning"]
    return ranked.withColumn("reason", F.coalesce(F.try_element_at(said, F.col("rank").cast("string")), F.concat(F.lit("Ranked at position "), F.col("rank").cast("string"))))


def by_rules(candidates: DataFrame, confidence: float = 0.5) -> DataFrame:
    """The order as it is, scored by place: what every ranker falls back to."""
    return candidates.withColumns({"rank": F.col("place"), "score": S.rank_score(F.col("place")), "confidence": F.lit(confidence)})


def by_listwise(candidates: DataFrame) -> DataFrame:
    """The listwise rules over each question's list (query_id, query, text, place)."""
    scored = candidates.withColumn("rules", S.listwise(F.col("query"), "text", F.col("place")))
    order = Window.partitionBy("query_id").orderBy(F.desc("rules"), "place")
    return scored.withColumn("rank", F.row_number().over(order)).withColumns({"score": S.rank_score(F.col("rank")), "confidence": S.rank_confidence(F.col("rank"), F.lit(""))})


#: Rankers by name; an unknown name takes the rules.
RANKERS: dict[str, Callable[[DataFrame], DataFrame]] = {"rules": by_listwise, "identity": by_rules}


def ranker(name: str) -> Callable[[DataFrame], DataFrame]:
    return RANKERS.get(name, by_listwise)
