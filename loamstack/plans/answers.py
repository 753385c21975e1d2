"""Queries on reranking, context packing, prompts, validation and the whole way from question to context."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import scores as S
from ..operators import chunking, context, rerank, search, validation
from .corpus import CHUNKS, good_chunks, words_sql
from .lexical import BM25, QLIST, QUESTION, TERMS, WORDS
from .registry import query, table

_Q = WORDS


def jaccard_sql(text: str) -> str:
    w = f"list_distinct({words_sql(f'lower({text})')})"
    return f"(len(list_intersect({QLIST}, {w})) / ({len(_Q)} + len({w}) - len(list_intersect({QLIST}, {w}))) + CASE WHEN contains(lower({text}), '{QUESTION}') THEN 0.3e0 ELSE 0e0 END)"


LEXICAL = f"lex AS (SELECT *, {jaccard_sql('text')} AS lexical_score FROM children), top AS (SELECT *, row_number() OVER (ORDER BY lexical_score DESC, chunk_id) AS place FROM lex QUALIFY place <= 100)"
_DENSITY = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)}" for w in _Q)
PAIR = f"""pr AS (SELECT *, CASE WHEN (SELECT count(*) FROM top) > 20 THEN len(list_intersect({QLIST}, dw)) / sqrt({len(_Q)} * len(dw)) END AS pair_score FROM (SELECT *, list_distinct({words_sql('lower(text)')}) AS dw FROM top)),
twenty AS (SELECT * EXCLUDE (place, np), np AS place FROM (SELECT *, row_number() OVER (ORDER BY pair_score DESC NULLS LAST, place) AS np FROM pr) WHERE np <= 20)"""
LISTWISE = PAIR + f""", lw AS (SELECT *, len(list_intersect({QLIST}, lw0)) / {len(_Q)} * 0.4e0 + (({_DENSITY}) / len(lw0)) * 0.3e0 + (1 / place) * 0.2e0 + least(1e0, len(lw0) / 100) * 0.1e0 AS listwise_score
 FROM (SELECT *, {words_sql('lower(text)')} AS lw0 FROM twenty)),
six AS (SELECT *, row_number() OVER (ORDER BY listwise_score DESC, place) AS np FROM lw), five AS (SELECT * EXCLUDE (place, np), np AS place FROM six WHERE np <= 5),
hits AS (SELECT *, greatest(0e0, 1 - (place - 1) * 0.1e0) AS final_score FROM five)"""
CONTEXT = """ctx0 AS (SELECT parent_id, max(final_score) AS relevance, max(position) AS last_position, count(*) AS n_children FROM hits GROUP BY parent_id),
ctx AS (SELECT c.*, p.doc_id, p.text, greatest(length(p.text) // 4, 1) AS tokens FROM ctx0 c JOIN parents p USING (parent_id)),
flag AS (SELECT *, row_number() OVER o AS pl, CASE WHEN doc_id = lag(doc_id) OVER o AND abs(last_position - lag(last_position) OVER o) <= 2 AND tokens + lag(tokens) OVER o <= 2000 THEN 0 ELSE 1 END AS nw
 FROM ctx WINDOW o AS (ORDER BY relevance DESC, parent_id)),
grp AS (SELECT *, sum(nw) OVER (ORDER BY pl ROWS UNBOUNDED PRECEDING) AS g FROM flag),
mrg AS (SELECT CASE WHEN count(*) > 1 THEN 'merged_' ELSE '' END || min_by(parent_id, pl) AS parent_id, min_by(doc_id, pl) AS doc_id, min(pl) AS place, max(relevance) AS relevance, CAST(sum(tokens) AS BIGINT) AS tokens,
 string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pl) AS text FROM grp GROUP BY g),
cum AS (SELECT *, sum(tokens) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS cum FROM mrg),
kept AS (SELECT *, 8000 - (cum - tokens) AS room FROM cum WHERE cum <= 8000 OR 8000 - (cum - tokens) >= 50),
fit AS (SELECT parent_id, doc_id, place, relevance, CASE WHEN cum > 8000 AND len(w) > room * 4 THEN room ELSE tokens END AS tokens,
 CASE WHEN cum > 8000 AND len(w) > room * 4 THEN array_to_string(w[1 : room * 4 - 10], ' ') || chr(10) || chr(10) || '[... content truncated ...]' ELSE text END AS text
 FROM (SELECT *, """ + words_sql("text") + """ AS w FROM kept))"""


def hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, c = good_chunks(spark, sf_dir)
    return p, rerank.cascade(c, QUESTION, ["chunk_id"])


def fitted(spark: SparkSession, sf_dir: str, budget: int = context.BUDGET) -> DataFrame:
    """Question to packed contexts: chunks, lexical list, listwise rules, parents, merging, budget."""
    h = hits(spark, sf_dir)[1].withColumnRenamed("final_score", "score")
    # Five rows at most, and several steps read them; in the plan, each of these would score all chunks again.
    rows = h.collect()
    few = spark.createDataFrame(rows, h.schema).coalesce(1)
    # Parents of the hits' documents alone; this filter stands before the quality rules, so that these are checked on few.
    named = table(spark, sf_dir, "documents").where(F.col("doc_id").isin(sorted({r["doc_id"] for r in rows} - {None})))
    grouped = context.group_parents(few, chunking.parents(chunking.good_documents(named)))
    return context.fit_budget(context.merge_neighbours(grouped), budget=budget)


@query(f"WITH {CHUNKS}, {LEXICAL} SELECT chunk_id, round(lexical_score, 6) AS score FROM top WHERE place <= 20")
def sparse_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.lexical(good_chunks(spark, sf_dir)[1], QUESTION, ["chunk_id"], 20).select("chunk_id", F.round("lexical_score", 6).alias("score"))


@query(f"WITH {CHUNKS}, {LEXICAL}, {LISTWISE} SELECT chunk_id, place, round(lexical_score, 6) AS lexical_score, round(pair_score, 6) AS pair_score, round(listwise_score, 6) AS listwise_score, round(final_score, 6) AS final_score FROM hits")
def cascade_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)[1].select("chunk_id", "place", *(F.round(c, 6).alias(c) for c in ("lexical_score", "pair_score", "listwise_score", "final_score")))


@query(f"WITH {CHUNKS}, {LEXICAL}, {LISTWISE}, {CONTEXT} SELECT parent_id, doc_id, place, round(relevance, 6) AS relevance, tokens, md5(text) AS text_md5 FROM fit")
def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fitted(spark, sf_dir)
    return out.select("parent_id", "doc_id", "place", F.round("relevance", 6).alias("relevance"), "tokens", F.md5("text").alias("text_md5"))


@query(f"""WITH {CHUNKS}, {LEXICAL}, {LISTWISE}, {CONTEXT}, o AS (SELECT *, coalesce(sum(length(text) + 7) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM fit)
SELECT parent_id, CAST(b AS BIGINT) AS start_pos, CAST(b + length(text) AS BIGINT) AS end_pos,
 round(CASE WHEN max(relevance) OVER () > min(relevance) OVER () THEN 0.3e0 + 0.7e0 * (relevance - min(relevance) OVER ()) / (max(relevance) OVER () - min(relevance) OVER ()) ELSE 1e0 END, 6) AS weight FROM o""")
def ctx_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.pack(fitted(spark, sf_dir)).select("parent_id", F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"), F.round("weight", 6).alias("weight"))


@query(f"""WITH {CHUNKS}, {LEXICAL}, {LISTWISE}, {CONTEXT} SELECT md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS text_md5, CAST(sum(tokens) AS BIGINT) AS total_tokens,
 count(*) AS n_sources, count(DISTINCT doc_id) AS n_documents, round(avg(relevance), 6) AS mean FROM fit""")
def ctx_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.packed_text(fitted(spark, sf_dir)).select(F.md5("text").alias("text_md5"), "total_tokens", "n_sources", "n_documents", F.round("mean", 6).alias("mean"))


@query(f"""WITH {CHUNKS}, {LEXICAL}, {LISTWISE}, {CONTEXT}, o AS (SELECT *, row_number() OVER (ORDER BY place) AS source_id, CAST(coalesce(sum(length(text) + 7) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM fit),
packed AS (SELECT string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS p FROM fit)
SELECT source_id, doc_id, 'Section ' || source_id AS section_title, round(relevance, 6) AS relevance_score, CAST(tokens AS BIGINT) AS token_count, p[b + 1 : b + 200] || '...' AS excerpt FROM o, packed""")
def ctx_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.sources(fitted(spark, sf_dir)).withColumn("relevance_score", F.round("relevance_score", 6)).drop("query_id")


_TERMS = TERMS
_TF = " + ".join(f"{S.TERM_WEIGHTS.get(w, 1.0)}e0 * ln(1e0 + len(list_filter(t, lambda x: x = '{w}')))" for w in _Q)


@query(f"SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, {_TF} AS s FROM (SELECT doc_id, {_TERMS} AS t FROM documents)) WHERE s > 0")
def sparse_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.weighted_tf(_Q, "text").alias("s")).where("s > 0").select("doc_id", F.round("s", 6).alias("score"))


@query(f"WITH {BM25} SELECT doc_id, round(bm, 6) AS score FROM bm25 WHERE bm > 0 ORDER BY bm DESC, doc_id LIMIT 100")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), QUESTION).orderBy(F.desc("score"), "doc_id").limit(100).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH b AS MATERIALIZED (SELECT doc_id, {_TERMS} AS ts FROM documents), t AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM b), f AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM t GROUP BY 1, 2),
w AS (SELECT doc_id, term, 1 + ln(1 + tf / n) AS weight FROM f), m AS (SELECT *, weight / max(weight) OVER (PARTITION BY doc_id) AS nw FROM w)
SELECT doc_id, round(sum(nw), 6) AS score FROM m WHERE list_contains({QLIST}, term) GROUP BY doc_id""")
def sparse_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = rerank.relative_weights(table(spark, sf_dir, "documents"), _Q).withColumn("pos", F.lit(0))
    q = spark.createDataFrame([(t, 1.0) for t in _Q], "term string, query_weight double")
    return rerank.sparse_dot(q, w).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT o_custkey AS query_id, CAST(o_orderkey + 100000000 AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders),
l AS (SELECT query_id, max(place) AS n FROM c GROUP BY 1), r AS (SELECT c.query_id, c.chunk_id, c.place, l.n FROM c JOIN l USING (query_id))
SELECT query_id, chunk_id, CASE WHEN place = n THEN 1 ELSE place + 1 END AS rank FROM r""")
def rank_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as candidates; the model's answer names the last one and an unknown id."""
    w = Window.partitionBy("query_id").orderBy("o_orderkey")
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey").select(
        "query_id", (F.col("o_orderkey") + 100000000).cast("string").alias("chunk_id"), F.row_number().over(w).alias("place")
    )
    answer = F.concat(F.lit('Sure: {"ranking": ["zzz", "'), F.max_by("chunk_id", "place"), F.lit('"], "reasoning": {}} done'))
    out = rerank.parse_ranking(c.groupBy("query_id").agg(answer.alias("response")), c)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


USERS = "u AS (SELECT conv_id, turn, text, lower(text) AS q FROM conversations WHERE role = 'user')"


def _has(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(q, '{p}')" for p in parts) + ")"


KIND_SQL = "CASE " + " ".join(f"WHEN {_has(p)} THEN '{k}'" for k, p in P.KINDS.items()) + " ELSE 'standard' END"


@query(f"""WITH {USERS} SELECT conv_id, turn, {KIND_SQL} AS kind, CASE {" ".join(f"WHEN {_has(p)} THEN '{k}'" for k, (p, _) in P.INTENTS.items())} ELSE 'general' END AS intent,
 CASE {" ".join(f"WHEN {_has(p)} THEN '{h}'" for p, h in P.INTENTS.values())} ELSE 'medium' END AS complexity, {_has(P.OPINION)} AS is_opinion FROM u""")
def prompt_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("i", P.intent(F.col("text")))
    return u.select("conv_id", "turn", P.kind(F.col("text")).alias("kind"), F.col("i.type").alias("intent"), "i.complexity", "i.is_opinion")


def template_sql(template: str, question: str, passage: str) -> str:
    parts = [p for p in re.split(r"(\{query\}|\{context\}|\n)", template) if p]
    return " || ".join({"{query}": question, "{context}": passage, "\n": "chr(10)"}.get(p, f"'{p}'") for p in parts)


_MESSAGE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {template_sql(u, 'text', 'ctx')}" for k, (_, u, _, _) in P.TEMPLATES.items()) + " END"


@query(f"""WITH {USERS}, k AS (SELECT u.*, {KIND_SQL} AS kind, d.text AS ctx FROM u JOIN documents d ON d.doc_id = u.conv_id) SELECT conv_id, turn, md5({_MESSAGE}) AS message_md5 FROM k""")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "conversations").where("role = 'user'")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("ctx"))
    return u.join(d, "conv_id").select("conv_id", "turn", F.md5(P.user_message(F.col("text"), F.col("ctx"))).alias("message_md5"))


@query("""SELECT conv_id, turn, md5('Query: ' || c.text || ' Document: ' || d.text[1 : greatest(512 - length(c.text) - 20, 0)] || ' Relevant:') AS input_md5 FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE role = 'user'""")
def pair_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "conversations").where("role = 'user'")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("ctx"))
    return u.join(d, "conv_id").select("conv_id", "turn", F.md5(P.pair_input(F.col("text"), F.col("ctx"))).alias("input_md5"))


@query("""SELECT conv_id, turn, md5('=== Context ===' || chr(10) || text || chr(10) || chr(10) || '=== Sources ===' || chr(10) || '[Source 1] | Document: ' || conv_id || ' | Section: ' || role || ' | Relevance: ' || printf('%.2f', turn / 4) || chr(10)) AS block_md5 FROM conversations""")
def prompt_sources_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    s = F.array(F.struct(F.col("conv_id").cast("string").alias("document_id"), F.col("role").alias("section_title"), (F.col("turn") / 4).alias("relevance_score")))
    return c.select("conv_id", "turn", F.md5(P.sources_block(F.col("text"), s)).alias("block_md5"))


VALIDATED = f"""qa AS (SELECT conv_id, turn, role, text AS answer, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations),
a AS (SELECT qa.conv_id, qa.turn, answer, question, d.text AS context, coalesce(length(d.text[1:8000]), 0) AS c FROM qa LEFT JOIN documents d ON d.doc_id = qa.conv_id WHERE role = 'assistant'),
b AS (SELECT *, c BETWEEN 50 AND 8000 AND answer IS NOT NULL AS ok FROM a),
r AS (SELECT *, CASE WHEN ok THEN least(0.3e0 * length(answer) / c, 0.9e0) ELSE 0.5e0 END AS risk, list_distinct({words_sql('lower(question)')}) AS qw, {words_sql('lower(context)')} AS cw FROM b),
s AS (SELECT *, CASE WHEN NOT ok THEN 'high' WHEN risk < 0.25 THEN 'low' WHEN risk < 0.5 THEN 'medium' WHEN risk < 0.75 THEN 'high' ELSE 'critical' END AS level, ok AND risk > 0.5 AS is_hallucination,
 CASE WHEN ok THEN 0.75e0 ELSE 0e0 END AS dc, CASE WHEN context IS NULL THEN 0 ELSE 1 END AS n_sources, CASE WHEN context IS NULL THEN 0.5e0 ELSE coalesce(len(list_intersect(qw, cw)) / nullif(len(qw), 0), 0) END AS sq,
 CASE WHEN coalesce(length(answer), 0) < 50 THEN 0.3e0 ELSE 0.5e0 + CASE WHEN length(answer) - length(replace(answer, '.', '')) >= 2 THEN 0.25e0 ELSE 0 END + CASE WHEN length(answer) BETWEEN 100 AND 2000 THEN 0.25e0 ELSE 0 END END AS completeness FROM r),
q AS (SELECT *, greatest(0e0, least(1e0, 0.4e0 * (1 - risk) + 0.2e0 * dc + 0.2e0 * sq + 0.2e0 * completeness)) AS quality FROM s),
f AS (SELECT *, greatest(0e0, least(1e0, dc * 0.3e0 + quality * 0.3e0 + least(n_sources / 3, 1e0) * 0.2e0 + least(n_sources / 5, 1e0) * 0.2e0)) AS confidence FROM q),
val AS (SELECT *, level <> 'critical' AND quality >= 0.5 AND confidence >= 0.5 AS valid FROM f)"""


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = validation.with_questions(table(spark, sf_dir, "conversations"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"))
    return validation.validate(answers.join(docs, "conv_id", "left"))


@query(f"WITH {VALIDATED} SELECT conv_id, turn, round(risk, 6) AS risk, level, is_hallucination, round(completeness, 6) AS completeness, round(quality, 6) AS quality, round(confidence, 6) AS confidence, valid, valid AND level <> 'critical' AND confidence >= 0.3 AS served FROM val")
def val_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select("conv_id", "turn", *(F.round(c, 6).alias(c) for c in ("risk", "completeness", "quality", "confidence")), "level", "is_hallucination", "valid", "served")


@query(f"""WITH {VALIDATED} SELECT conv_id, turn, concat_ws('|', CASE level WHEN 'high' THEN 'High hallucination risk detected' WHEN 'critical' THEN 'Critical hallucination risk - answer should not be served' END,
 CASE WHEN is_hallucination THEN 'Potential hallucination detected' END, CASE WHEN quality < 0.6 THEN 'Low quality score: ' || printf('%.2f', quality) END, CASE WHEN confidence < 0.6 THEN 'Low confidence: ' || printf('%.2f', confidence) END,
 CASE WHEN n_sources = 0 THEN 'No sources found for answer' ELSE 'Limited sources available' END, CASE WHEN n_sources = 0 THEN 'No results from retrieval pipeline' END) AS warnings,
 concat_ws('|', CASE WHEN NOT ok THEN 'Manual review recommended' END, CASE WHEN quality < 0.7 THEN 'Consider regenerating answer with different prompt' END, CASE WHEN n_sources = 0 THEN 'Retrieve more relevant sources before generating answer' END,
 CASE WHEN c // 4 < 100 THEN 'Insufficient context - expand search parameters' END) AS recommendations FROM val""")
def val_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select("conv_id", "turn", F.array_join("warnings", "|").alias("warnings"), F.array_join("recommendations", "|").alias("recommendations"))


@query(f"""WITH {VALIDATED}, k AS (SELECT *, unnest([1, 2]) AS attempt FROM val WHERE risk > 0.7) SELECT conv_id, turn, attempt, round(greatest(0.1e0, 0.7e0 - 0.1e0 * attempt), 6) AS temperature, round(greatest(0.7e0, 0.9e0 - 0.05e0 * attempt), 6) AS top_p FROM k""")
def regen_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validation.regeneration(validated(spark, sf_dir))
    return out.select("conv_id", "turn", "attempt", F.round("temperature", 6).alias("temperature"), F.round("top_p", 6).alias("top_p"))


@query("""WITH r AS (SELECT event_id, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events)
SELECT event_id, rank, round(greatest(0e0, 1 - (rank - 1) * 0.1e0), 6) AS score, round(least(1e0, greatest(0.5e0, 1 - (rank - 1) * 0.05e0) + CASE WHEN length(repeat(props, 6)) > 50 THEN 0.1e0 ELSE 0 END), 6) AS confidence FROM r""")
def rank_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a ranked list, their properties as the reasons given."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    ranked = table(spark, sf_dir, "events").select("event_id", "props", rank.alias("rank"))
    return ranked.select("event_id", "rank", F.round(S.rank_score(F.col("rank")), 6).alias("score"), F.round(S.rank_confidence(F.col("rank"), F.repeat("props", 6)), 6).alias("confidence"))


@query("SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS sigmoid, round(1 - 2 * abs(1 / (1 + exp(-value / 100)) - 0.5), 6) AS confidence FROM events")
def pair_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = 1 / (1 + F.exp(-F.col("value") / 100))
    return table(spark, sf_dir, "events").select("event_id", F.round(s, 6).alias("sigmoid"), F.round(1 - 2 * F.abs(s - 0.5), 6).alias("confidence"))
