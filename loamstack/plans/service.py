"""Queries on responses, requests, sections, ingestion and reads of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import scores as S
from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, ingestion, rerank, response
from .answers import LEXICAL, LISTWISE, VALIDATED, hits, validated
from .corpus import CHUNKS, DECORATED_SQL, REASON, decorated, good_chunks, windows_sql, words_sql
from .lexical import QLIST, QUESTION, TERMS
from .logs import LOG, log
from .registry import query, table

_NOTE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in response.NOTES.items())


@query(f"""WITH {VALIDATED}, sv AS (SELECT *, valid AND level <> 'critical' AND confidence >= 0.3 AS served FROM val)
SELECT conv_id, turn, CASE WHEN NOT served OR level IN ('high', 'critical') THEN level END AS note_level, CASE WHEN NOT served OR level IN ('high', 'critical') THEN CASE level {_NOTE} END END AS note FROM sv""")
def user_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = response.user_response(validated(spark, sf_dir))
    return out.select("conv_id", "turn", F.col("note.risk_level").alias("note_level"), F.col("note.message").alias("note"))


@query(f"""WITH {VALIDATED} SELECT conv_id, turn, question AS query, answer, coalesce(length(context), 0) // 4 AS prompt_tokens, coalesce(length(answer), 0) // 4 AS completion_tokens,
 coalesce(length(context), 0) // 4 + coalesce(length(answer), 0) // 4 AS total_tokens, level, valid FROM val""")
def query_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole responses as JSON, read back to compare."""
    out = response.query_response(validated(spark, sf_dir))
    kind = "query string, answer string, token_usage struct<prompt_tokens:bigint, completion_tokens:bigint, total_tokens:bigint>, validation struct<level:string, valid:boolean>"
    return out.select("conv_id", "turn", F.from_json("response", kind).alias("r")).select("conv_id", "turn", "r.query", "r.answer", "r.token_usage.*", "r.validation.*")


@query("""WITH e AS (SELECT event_id, value, event_id % 4 AS k FROM events), r AS (SELECT event_id, CASE WHEN k = 3 THEN 0.5 ELSE least(1.0, round(value / 500, 3)) END AS risk, k, value FROM e)
SELECT event_id, round(risk, 6) AS risk, CASE WHEN k = 1 THEN value > 100 ELSE risk > 0.5 END AS is_hallucination, CASE WHEN k = 2 THEN 0.9 ELSE 0.5 END AS confidence,
 CASE WHEN risk < 0.25 THEN 'low' WHEN risk < 0.5 THEN 'medium' WHEN risk < 0.75 THEN 'high' ELSE 'critical' END AS level, CASE WHEN k = 2 THEN 1 ELSE 0 END AS n_suggestions FROM r""")
def detection_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's raw answers, of four kinds by event: plain, with a verdict, with confidence and suggestions, unreadable."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    risk = F.concat(F.lit('{"risk_score": '), F.least(F.lit(1.0), T.rounded(F.col("value") / 500, 3)).cast("string"))
    verdict = F.concat(risk, F.lit(', "hallucination_detected": '), (F.col("value") > 100).cast("string"), F.lit("}"))
    sure = F.concat(risk, F.lit(', "confidence": 0.9, "suggestions": ["look again"]}'))
    raw = F.when(k == 0, F.concat(risk, F.lit("}"))).when(k == 1, verdict).when(k == 2, sure).otherwise("no json")
    d = e.select("event_id", response.parsed_detection(raw).alias("d"))
    return d.select("event_id", F.round("d.risk_score", 6).alias("risk"), "d.is_hallucination", "d.confidence", F.col("d.risk_level").alias("level"), F.size("d.suggestions").cast("bigint").alias("n_suggestions"))


def _json_sql(x: str) -> str:
    """A text as a JSON string, for texts whose only escapes are quotes, backslashes and line ends."""
    return f"""'"' || replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"'"""


@query(f"""SELECT conv_id, turn, role, sha256('{{"answer":' || {_json_sql('text')} || ',"backend":"default","context":' || {_json_sql('repeat(text, 20)[1:1000]')} || ',"model":"default","query":""}}') AS key FROM conversations""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", response.cache_key(F.col("text"), F.repeat("text", 20), F.lit(None).cast("string")).alias("key"))


@query("""SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 7 ELSE 1 END AS source_id, CASE WHEN turn % 2 = 0 THEN 'own' ELSE coalesce(CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(conv_id AS VARCHAR) END, 'unknown') END AS document_id,
 CASE WHEN turn % 2 = 0 THEN 'given' ELSE 'Section 1' END AS section_title, CASE WHEN turn % 2 = 0 THEN 0.9 ELSE 0.0 END AS relevance_score FROM conversations""")
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even turns have sources of their own; odd ones take their context's, with defaults."""
    c = table(spark, sf_dir, "conversations")
    even = F.col("turn") % 2 == 0
    own = F.when(even, F.array(F.struct(F.lit(7).alias("source_id"), F.lit("own").alias("document_id"), F.lit("given").alias("section_title"), F.lit(0.9).alias("relevance_score"), F.lit(3).alias("token_count"))))
    doc = F.when(F.col("turn") % 3 != 0, F.col("conv_id").cast("string"))
    context = F.array(F.struct(doc.alias("document_id"), F.lit(None).cast("string").alias("section_title"), F.lit(None).cast("double").alias("relevance_score"), F.lit(None).cast("int").alias("token_count")))
    s = response.sources_or_context(own, context)[0]
    return c.select("conv_id", "turn", "role", s.alias("s")).select("conv_id", "turn", "role", "s.source_id", "s.document_id", "s.section_title", "s.relevance_score")


@query("""SELECT event_id, CASE WHEN coalesce(length(event_type), 0) = 0 THEN 'empty_query' WHEN NOT value / 400 BETWEEN 0 AND 1 THEN 'temperature_out_of_range' WHEN NOT event_id % 3000 BETWEEN 50 AND 2048 THEN 'max_tokens_out_of_range'
 WHEN NOT value / 300 BETWEEN 0 AND 1 THEN 'score_out_of_range' WHEN NOT user_id % 400 BETWEEN 1 AND 365 THEN 'days_out_of_range' END AS problem FROM events""")
def request_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    problem = response.request_problem(F.col("event_type"), F.col("value") / 400, F.col("event_id") % 3000, F.col("value") / 300, F.col("user_id") % 400)
    return table(spark, sf_dir, "events").select("event_id", problem.alias("problem"))


@query(f"WITH {LOG} SELECT id, hallucination_score, level, quality_score, coalesce(quality_score >= 0.7 AND hallucination_score <= 0.3 AND level IN ('low', 'medium'), false) AS is_high_quality FROM lev WHERE id = 42")
def log_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response.hallucination_details(log(spark, sf_dir), 42)


@query("SELECT event_id, md5(event_type || '|' || CAST(floor(value) AS BIGINT) || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS row_md5, epoch_us(ts) // 1000 AS ts_ms FROM events")
def log_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in ISO 8601 and in milliseconds."""
    e = table(spark, sf_dir, "events")
    row = F.concat_ws("|", "event_type", F.floor("value").cast("bigint").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", F.md5(row).alias("row_md5"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


# Reads of the store.


@query(f"WITH {CHUNKS} SELECT chunk_id, position, length(text) AS n_chars FROM children WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def src_children_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of listed documents, by a semi-join with the list."""
    _, c = good_chunks(spark, sf_dir)
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return c.join(wanted, "doc_id", "left_semi").select("chunk_id", "position", F.length("text").cast("bigint").alias("n_chars"))


@query(f"WITH {CHUNKS} SELECT chunk_id, 1.0 AS score FROM children ORDER BY chunk_id LIMIT 10000")
def src_scan_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of at most 10000 chunks of one type, each with a score that stands for none."""
    return good_chunks(spark, sf_dir)[1].orderBy("chunk_id").limit(10_000).select("chunk_id", F.lit(1.0).alias("score"))


@query(f"WITH {CHUNKS} SELECT parent_id, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS place, md5(CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END) AS preview_md5 FROM parents")
def src_parents_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's parents in order, with previews of 200 characters."""
    p, _ = good_chunks(spark, sf_dir)
    preview = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return p.select("parent_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("position")).cast("bigint").alias("place"), F.md5(preview).alias("preview_md5"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 17")
def src_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document by its id: the filter reaches the scan."""
    return table(spark, sf_dir, "documents").where("doc_id = 17").select("doc_id", "source", "n_chars")


@query("SELECT 'doc_' || label || '_page_' || (vec_id // 10) AS page_key, count(*) AS n_patches FROM embeddings GROUP BY 1")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("doc_"), F.col("label").cast("string"), F.lit("_page_"), F.floor(F.col("vec_id") / 10).cast("bigint").cast("string"))
    return table(spark, sf_dir, "embeddings").groupBy(key.alias("page_key")).agg(F.count(F.lit(1)).alias("n_patches"))


@query(f"WITH {CHUNKS}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'parents', count(*) FROM parents WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'children', count(*) FROM children WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'relations', count(*) FROM parents WHERE doc_id NOT IN (SELECT doc_id FROM gone)")
def snk_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents go with their parents, children and relations."""
    p, c = good_chunks(spark, sf_dir)
    tables = {"documents": table(spark, sf_dir, "documents"), "parents": p, "children": c, "relations": chunking.relations(p, c)}
    return ingestion.table_counts(**ingestion.delete_document(tables, table(spark, sf_dir, "labels").where("toxic = 1")))


# Ingestion and sections.


@query(f"SELECT count(*) AS n, count(*) FILTER (r IS NULL) AS n_success, count(*) FILTER (r IS NOT NULL) AS n_error, CAST(0 AS BIGINT) AS n_partial FROM (SELECT {REASON} AS r FROM documents)")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion.summary(ingestion.with_status(table(spark, sf_dir, "documents")))


@query(f"WITH {CHUNKS} SELECT 'parents' AS name, count(*) AS n FROM parents UNION ALL SELECT 'children', count(*) FROM children UNION ALL SELECT 'documents', count(*) FROM documents")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = good_chunks(spark, sf_dir)
    return ingestion.table_counts(parents=p, children=c, documents=table(spark, sf_dir, "documents"))


PAPER = "Preface line of {d}\nAbstract\n{t}\n2. Results\n{t}\nIV. Further notes\nshort\nConclusion\n{t}\nend"
_SQL_PARTS = {"{d}": "CAST(doc_id AS VARCHAR)", "{t}": "text", "\n": "chr(10)"}


def _pieces() -> list[str]:
    import re

    return [p for p in re.split(r"(\{d\}|\{t\}|\n)", PAPER) if p]


PAPER_SQL = "papers AS (SELECT doc_id, " + " || ".join(_SQL_PARTS.get(p, f"'{p}'") for p in _pieces()) + " AS text FROM documents)"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [{"{d}": F.col("doc_id").cast("string"), "{t}": F.col("text")}.get(p, F.lit(p)) for p in _pieces()]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))


_HEAD = rf"(?i)^({chunking.NAMED}|\d+\.?\s+({chunking.NUMBERED})|[ivx]+\.?\s+[a-z][a-z\s]+)$"


@query(rf"""WITH {PAPER_SQL}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM papers),
h AS (SELECT *, CAST(i > 1 AND i < n AND regexp_matches(trim(line), '{_HEAD}') AS INT) AS head FROM l),
g AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM h),
s AS (SELECT doc_id, grp, regexp_replace(trim(max(CASE WHEN head = 1 THEN line END)), '(?i)^\d+\.?\s+({chunking.NUMBERED})$', '\1') AS title, trim(string_agg(line, chr(10) ORDER BY i)) AS text FROM g WHERE grp > 0 GROUP BY 1, 2),
k AS (SELECT doc_id, grp, title, text FROM s WHERE length(text) > 200),
w AS (SELECT doc_id, 0 AS grp, 'Full Document' AS title, text FROM papers WHERE doc_id NOT IN (SELECT doc_id FROM k))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS section, title, md5(text) AS text_md5 FROM (SELECT * FROM k UNION ALL SELECT * FROM w)""")
def paper_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by heading lines of papers; a document without any is one section."""
    out = chunking.paper_sections(papers(spark, sf_dir))
    return out.select("doc_id", F.col("section").cast("bigint").alias("section"), "title", F.md5("text").alias("text_md5"))


_SECTIONS_SQL = rf"""l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM decorated),
h AS (SELECT *, CAST(regexp_matches(line, '{T.HEADING}') AS INT) AS head FROM l),
g AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM h),
s AS (SELECT doc_id, grp, trim(string_agg(CASE WHEN head = 0 THEN line END, chr(10) ORDER BY i)) AS text FROM g GROUP BY doc_id, grp HAVING count(*) FILTER (head = 0) > 0),
secs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS section, {words_sql('text')} AS w FROM s)"""


@query(f"""WITH {DECORATED_SQL}, {_SECTIONS_SQL}, {windows_sql('pw', 'secs', 'doc_id, section', 'win', 1000, 50)},
p AS (SELECT doc_id || '_parent_' || section || '_' || win AS parent_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, win) - 1 AS position, {words_sql('text')} AS w FROM pw),
{windows_sql('cw', 'p', 'parent_id, position', 'child', 250, 50)}
SELECT parent_id || '_child_' || child AS chunk_id, parent_id, position AS parent_position, md5(text) AS text_md5 FROM cw""")
def chunk_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple chunker whole: sections, parents and children with the section in their ids."""
    _, c = chunking.section_chunks(chunking.sections(decorated(spark, sf_dir)))
    return c.select("chunk_id", "parent_id", F.col("parent_position").cast("bigint").alias("parent_position"), F.md5("text").alias("text_md5"))


@query()
def chunk_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchical chunker whole, over all documents."""
    _, c = chunking.hierarchical_chunks(table(spark, sf_dir, "documents").where("text is not null"))
    return c.select("chunk_id", "parent_id", "position", "n_words", F.md5("text").alias("text_md5"))


# Rankers and sparse encoders.


@query(f"""WITH {CHUNKS}, {LEXICAL}, {LISTWISE}, r AS (SELECT *, list_sort(list_intersect({QLIST}, {words_sql('lower(text)')}))[1:3] AS shared FROM hits)
SELECT chunk_id, place, (CASE WHEN place = 1 THEN 'Best match' WHEN place <= 3 THEN 'Strong match' ELSE 'Weaker match' END) || ' (score ' || printf('%.2f', final_score) || '); shared terms: ' || CASE WHEN len(shared) > 0 THEN array_to_string(shared, ', ') ELSE 'none' END AS reason FROM r""")
def rank_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)[1]
    return h.select("chunk_id", F.col("place").cast("bigint").alias("place"), S.rank_reason(QUESTION, "text", F.col("place"), F.col("final_score")).alias("reason"))


_FORM = '{"ranking": ["id", ...], "reasoning": {"1": "why"}}'


@query(f"""WITH {CHUNKS}, {LEXICAL}, l AS (SELECT string_agg('[' || chunk_id[1:8] || '] ' || text[1:500], chr(10) ORDER BY place) AS lines FROM top WHERE place <= 20),
t AS (SELECT 'Order these passages by how well they answer the question.' || chr(10) || 'Question: {QUESTION}' || chr(10) || chr(10) || lines || chr(10) || chr(10) || 'Answer as JSON: {_FORM}' AS t FROM l)
SELECT length(CASE WHEN length(t) > 4096 THEN t[1:3996] || chr(10) || chr(10) || 'Answer as JSON: {_FORM}' ELSE t END) AS n_chars, md5(CASE WHEN length(t) > 4096 THEN t[1:3996] || chr(10) || chr(10) || 'Answer as JSON: {_FORM}' ELSE t END) AS prompt_md5 FROM t""")
def ranking_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listwise prompt over the lexical top 20."""
    top = rerank.lexical(good_chunks(spark, sf_dir)[1], QUESTION, ["chunk_id"], 20)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("lexical_score")).alias("o"), "chunk_id", "text")))
    prompt = top.agg(rows.alias("r")).select(P.ranking_prompt(F.lit(QUESTION), F.col("r")).alias("p"))
    return prompt.select(F.length("p").cast("bigint").alias("n_chars"), F.md5("p").alias("prompt_md5"))


@query("""WITH t AS (SELECT label, vec_id // 50 AS g, list(CAST(embedding[1] AS DOUBLE) ORDER BY vec_id) AS a FROM embeddings GROUP BY 1, 2), m AS (SELECT label, g, a, list_max(a) AS m FROM t),
e AS (SELECT label, g, list_transform(a, lambda x: exp(x - m)) AS e FROM m) SELECT label, g, len(e) AS n, round(list_max(e) / list_sum(e), 6) AS largest, round(list_min(e) / list_sum(e), 6) AS least FROM e""")
def softmax_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    rows = F.array_sort(F.collect_list(F.struct("vec_id", F.element_at("embedding", 1).cast("double").alias("x"))))
    g = e.groupBy("label", F.floor(F.col("vec_id") / 50).cast("bigint").alias("g")).agg(F.transform(rows, lambda r: r["x"]).alias("a")).withColumn("s", V.softmax(F.col("a")))
    return g.select("label", "g", F.size("s").cast("bigint").alias("n"), F.round(F.array_max("s"), 6).alias("largest"), F.round(F.array_min("s"), 6).alias("least"))


@query(f"""WITH b AS MATERIALIZED (SELECT doc_id, {TERMS} AS ts FROM documents), t AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM b),
f AS (SELECT doc_id, term, 1 + ln(1 + count(*) / any_value(n)) AS w FROM t WHERE list_contains({QLIST}, term) GROUP BY 1, 2)
SELECT doc_id, string_agg(term || '=' || printf('%.4f', w), ',' ORDER BY term) AS contributions FROM f GROUP BY 1""")
def term_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the question's terms adds to a document's sparse score, as a map."""
    out = rerank.contributions(rerank.term_frequencies(table(spark, sf_dir, "documents")), S.query_words(QUESTION))
    entries = F.transform(F.array_sort(F.map_entries("contributions")), lambda e: F.concat(e["key"], F.lit("="), T.fixed(e["value"], 4)))
    return out.select("doc_id", F.array_join(entries, ",").alias("contributions"))
