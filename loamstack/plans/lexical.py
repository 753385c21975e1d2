"""The question that the single-question queries ask, and its BM25 scores as SQL."""

from __future__ import annotations

from ..functions import scores as S

QUESTION = "what is the water of the market and the city"
WORDS = S.query_words(QUESTION)
QLIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_SCORE = " + ".join(f"ln(1 + (n - d{i} + 0.5e0) / (d{i} + 0.5e0)) * f{i} * 2.2e0 / (f{i} + 1.2e0 * (0.25e0 + 0.75e0 * len / mean))" for i in range(len(WORDS)))
#: CTEs that end in bm25 (doc_id, bm) over all documents.
BM25 = f"""bt AS (SELECT doc_id, {TERMS} AS t FROM documents),
bf AS (SELECT doc_id, len(t) AS len, {", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(WORDS))} FROM bt),
bs AS (SELECT count(*) AS n, avg(len) AS mean, {", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(WORDS)))} FROM bf),
bm25 AS (SELECT doc_id, {_SCORE} AS bm FROM bf, bs)"""
