"""Queries over documents: sources, quality, chunks and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from .registry import query, table


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


ALPHA = r"length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text)"
REASON = f"""CASE WHEN coalesce(length(text), 0) < 100 THEN 'too_short' WHEN length(text) > 1000000 THEN 'too_long'
 WHEN len({words_sql('text')}) < 50 THEN 'few_words' WHEN {ALPHA} < 0.5 THEN 'low_alpha' END"""
GOOD = f"good AS (SELECT doc_id, source, text, {words_sql('text')} AS w FROM documents WHERE {REASON} IS NULL)"


def windows_sql(name: str, of: str, keys: str, position: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""{name} AS (SELECT {keys}, i AS {position}, array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ') AS text FROM (
 SELECT *, unnest(range(0, CASE WHEN len(w) <= {size} THEN 1 ELSE 1 + CAST(ceil((len(w) - {size}) / {step}) AS BIGINT) END)) AS i FROM {of}))"""


CHUNKS = ", ".join((
    GOOD,
    windows_sql("pw", "good", "doc_id", "position", 1000, 50),
    "parents AS (SELECT doc_id || '_parent_' || position AS parent_id, doc_id, position, text FROM pw)",
    f"ps AS (SELECT parent_id, doc_id, position AS parent_position, {words_sql('text')} AS w FROM parents)",
    windows_sql("cw", "ps", "parent_id, doc_id, parent_position", "position", 250, 50),
    "children AS (SELECT parent_id || '_child_' || position AS chunk_id, * FROM cw)",
))


def good_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    good = chunking.good_documents(table(spark, sf_dir, "documents"))
    return chunking.parents(good), chunking.children_of(good)


@query("""SELECT coalesce(source || '-' || doc_id, 'Unknown') AS title, 'Unknown' AS author, coalesce(text, '') AS text, 1 AS page_count, 'manual' AS method,
 coalesce(length(text), 0) AS n_chars FROM documents""")
def src_dict_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.coalesce(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")), F.lit("Unknown"))
    return d.select(name.alias("title"), F.lit("Unknown").alias("author"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("page_count"),
                    F.lit("manual").alias("method"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))


def source_kind(x: str):
    c = F.col(x)
    return F.when(c.startswith("http"), "unsupported_url").when(c.startswith("arxiv:"), "unsupported_arxiv").when(c.isNull(), "error").otherwise("text")


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN starts_with(x, 'http') THEN 'unsupported_url' WHEN starts_with(x, 'arxiv:') THEN 'unsupported_arxiv'
 WHEN x IS NULL THEN 'error' ELSE 'text' END AS kind FROM (SELECT url AS x FROM pages UNION ALL SELECT text FROM documents)) GROUP BY kind""")
def src_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "pages").select(F.col("url").alias("x")).union(table(spark, sf_dir, "documents").select("text"))
    return both.groupBy(source_kind("x").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id OFFSET 20 LIMIT 50")
def src_paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").select("event_id", "user_id").offset(20).limit(50)


@query(f"SELECT doc_id, {REASON} AS reason FROM documents")
def flt_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.reject_reason("text").alias("reason"))


@query(f"WITH {GOOD} SELECT doc_id, len(w) AS n_words FROM good")
def flt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.good_documents(table(spark, sf_dir, "documents")).select("doc_id", T.n_words("text").cast("bigint").alias("n_words"))


@query(f"WITH {CHUNKS} SELECT parent_id, doc_id, position, md5(text) AS text_md5 FROM parents")
def chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return good_chunks(spark, sf_dir)[0].select("parent_id", "doc_id", "position", F.md5("text").alias("text_md5"))


@query(f"WITH {CHUNKS} SELECT chunk_id, parent_id, position, md5(text) AS text_md5 FROM children")
def chunk_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return good_chunks(spark, sf_dir)[1].select("chunk_id", "parent_id", "position", F.md5("text").alias("text_md5"))


@query(f"""WITH {CHUNKS} SELECT parent_id, string_agg(chunk_id, ',' ORDER BY position) AS child_ids FROM children GROUP BY parent_id""")
def chunk_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = good_chunks(spark, sf_dir)
    return chunking.relations(p, c).select("parent_id", F.array_join("child_ids", ",").alias("child_ids"))


@query(f"""WITH {CHUNKS}, u AS (SELECT 'parent' AS kind, length(text) // 4 AS tokens FROM parents UNION ALL SELECT 'child', length(text) // 4 FROM children)
SELECT count(*) FILTER (kind = 'parent') AS n_parents, count(*) FILTER (kind = 'child') AS n_children, min(tokens) FILTER (kind = 'parent') AS min_parent_tokens, max(tokens) FILTER (kind = 'parent') AS max_parent_tokens, min(tokens) FILTER (kind = 'child') AS min_child_tokens,
 round(avg(tokens) FILTER (kind = 'child'), 6) AS avg_child_tokens,
 max(tokens) FILTER (kind = 'child') AS max_child_tokens, round(avg(tokens) FILTER (kind = 'parent'), 6) AS avg_parent_tokens, CAST(sum(tokens) AS BIGINT) AS total_tokens,
 round(coalesce(count(*) FILTER (kind = 'child') / nullif(count(*) FILTER (kind = 'parent'), 0), 0), 6) AS children_per_parent FROM u""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c = good_chunks(spark, sf_dir)
    tokens = T.tokens_by_chars("text").alias("tokens")
    u = p.select(F.lit("parent").alias("kind"), tokens).unionByName(c.select(F.lit("child").alias("kind"), tokens))
    of = lambda k: F.when(F.col("kind") == k, F.col("tokens"))
    n_p, n_c = F.count(of("parent")), F.count(of("child"))
    return u.agg(n_p.alias("n_parents"), n_c.alias("n_children"), F.min(of("parent")).alias("min_parent_tokens"), F.max(of("parent")).alias("max_parent_tokens"),
                 F.min(of("child")).alias("min_child_tokens"), F.round(F.avg(of("child")), 6).alias("avg_child_tokens"), F.max(of("child")).alias("max_child_tokens"),
                 F.round(F.avg(of("parent")), 6).alias("avg_parent_tokens"), F.sum("tokens").alias("total_tokens"),
                 F.round(F.coalesce(F.try_divide(n_c, n_p), F.lit(0.0)), 6).alias("children_per_parent"))


TRIM = r"""CASE WHEN len(parts) <= 1 OR length(array_to_string(parts[1 : len(parts) - 1], ' ')) < length(text) * 0.7 THEN text ELSE array_to_string(parts[1 : len(parts) - 1], ' ') END"""
PARTS = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts"


@query(f"SELECT doc_id, md5({TRIM}) AS text_md5 FROM (SELECT doc_id, text, {PARTS} FROM documents)")
def sent_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.trim_sentence("text")).alias("text_md5"))


@query(f"""WITH {GOOD}, {windows_sql('raw', 'good', 'doc_id', 'i0', 150, 10)},
t AS (SELECT doc_id, i0, max(i0) OVER (PARTITION BY doc_id) AS last, text, {PARTS} FROM raw),
k AS (SELECT doc_id, i0, last, CASE WHEN i0 < last THEN {TRIM} ELSE text END AS text FROM t),
n AS (SELECT *, len({words_sql('text')}) AS n_words FROM k)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i0) - 1 AS position, n_words, md5(text) AS text_md5 FROM n WHERE n_words >= 100 OR i0 = last""")
def chunk_hier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.hierarchical(chunking.good_documents(table(spark, sf_dir, "documents")), "doc_id", 150, 10, 100)
    return out.select("doc_id", F.col("position").cast("bigint").alias("position"), F.col("n_words").cast("bigint").alias("n_words"), F.md5("text").alias("text_md5"))


@query(f"""SELECT doc_id, length(text) // 4 AS by_chars, greatest(length(text) // 4, 1) AS by_chars_least, CAST(floor(len({words_sql('text')}) * 1.3e0) AS BIGINT) AS by_words FROM documents""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens_by_chars("text").alias("by_chars"), T.tokens_by_chars("text", 1).alias("by_chars_least"),
                                                    F.floor(T.n_words("text") * 1.3).cast("bigint").alias("by_words"))


# Raw documents have no headings or metadata lines; these are put around each whole text alike in Spark and SQL.
HEAD = "# A report from {s} number {d}\nTitle: notes\nAuthors: Ada Byron, Carl Gauss and Emmy Noether\nAbstract: Document {d} of the collection {s}, with words enough to be taken as an abstract.\n\nKeywords: alpha, beta; gamma\n\nMAIN PART\n"
TAIL = "\n## Closing remarks\n1. Final Words here\nSee [1] and [23], (2023), Smith et al. Figure 1, Fig. 2, Table 3. Page 4 oneTwo.Three\n"


def _pieces() -> list[str]:
    import re

    return [p for p in re.split(r"(\{s\}|\{d\})", HEAD) if p]


DECORATED_SQL = "decorated AS (SELECT doc_id, " + " || ".join(
    {"{s}": "source", "{d}": "CAST(doc_id AS VARCHAR)"}.get(p) or "'" + p.replace("\n", "' || chr(10) || '") + "'" for p in _pieces()
) + " || text || '" + TAIL.replace("\n", "' || chr(10) || '") + "' AS text FROM documents)"


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [{"{s}": F.col("source"), "{d}": F.col("doc_id").cast("string")}.get(p, F.lit(p)) for p in _pieces()]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts, F.col("text"), F.lit(TAIL)).alias("text"))


def _sql_patterns(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in patterns)


_TITLES = [f"trim(regexp_extract(text, '{p}', 1))" for p in T.TITLES]
META_SQL = f"""WITH {DECORATED_SQL}, f AS (SELECT doc_id, text, coalesce({", ".join(f"CASE WHEN length({x}) BETWEEN 10 AND 200 THEN {x} END" for x in _TITLES)}) AS title,
 trim(regexp_extract(text, '{T.ABSTRACT}', 1)) AS a, {" , ".join(f"nullif(trim(regexp_extract(text, '{p}', 1)), '') AS au{i}" for i, p in enumerate(T.AUTHORS))},
 trim(regexp_extract(text, '{T.KEYWORDS}', 1)) AS kw FROM decorated)
SELECT doc_id, title, CASE WHEN length(a) BETWEEN 50 AND 2000 THEN a END AS abstract,
 array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(au0, au1, au2), ',\\s*|\\s+and\\s+|\\s*&\\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') AS authors,
 array_to_string(list_filter(list_transform(regexp_split_to_array(kw, ',\\s*|;\\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') AS keywords,
 least({_sql_patterns(T.REFERENCES)}, 500) AS n_references, {_sql_patterns(T.FIGURES)} AS n_figures, {_sql_patterns(T.TABLES)} AS n_tables FROM f"""


@query(META_SQL)
def meta_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select(
        "doc_id", T.title("text").alias("title"), T.abstract("text").alias("abstract"), F.array_join(T.authors("text"), "|").alias("authors"),
        F.array_join(T.keywords("text"), "|").alias("keywords"), T.references("text").alias("n_references"), T.matches("text", T.FIGURES).alias("n_figures"),
        T.matches("text", T.TABLES).alias("n_tables"),
    )


@query(rf"""WITH {DECORATED_SQL}, l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM decorated),
h AS (SELECT doc_id, i, CASE WHEN regexp_matches(line, '^#{{1,3}}\s+.+$') OR regexp_matches(line, '^[A-Z][A-Z\s]{{2,30}}[A-Z]$') THEN trim(replace(line, '#', ''))
 ELSE regexp_extract(line, '^\d+\.?\s+([A-Z][a-zA-Z\s]{{5,50}})$', 1) END AS title FROM l),
d AS (SELECT doc_id, title, min(i) AS i FROM h WHERE length(title) > 3 GROUP BY doc_id, title), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM d)
SELECT doc_id, string_agg(title, '|' ORDER BY i) AS sections FROM r WHERE rn <= 20 GROUP BY doc_id""")
def meta_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", F.array_join(T.headings("text"), "|").alias("sections")).where("sections <> ''")


@query(rf"""WITH {DECORATED_SQL}, a AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM decorated)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, 'Page \d+', '', 'gi'), '([a-z])([A-Z])', '\1 \2', 'g'), '(\.)([A-Z])', '\1 \2', 'g'))) AS text_md5 FROM a""")
def txt_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", F.md5(T.tidy("text")).alias("text_md5"))


@query(rf"""WITH {DECORATED_SQL}, l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM decorated),
h AS (SELECT *, CAST(regexp_matches(line, '{T.HEADING}') AS INT) AS head FROM l),
g AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM h),
s AS (SELECT doc_id, grp, coalesce(max(CASE WHEN head = 1 THEN trim(replace(line, '#', '')) END), 'Introduction') AS title,
 trim(string_agg(CASE WHEN head = 0 THEN line END, chr(10) ORDER BY i)) AS text FROM g GROUP BY doc_id, grp HAVING count(*) FILTER (head = 0) > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS section, title, md5(text) AS text_md5 FROM s""")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.sections(decorated(spark, sf_dir))
    return out.select("doc_id", F.col("section").cast("bigint").alias("section"), "title", F.md5("text").alias("text_md5"))
