"""Formulas for lexical relevance and for the risk and quality of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, count_of, fixed, terms, words


def query_words(query: str) -> list[str]:
    return sorted(set(query.lower().split()))


def query_set(query: str | Column) -> Column:
    """A question's distinct lower-case words."""
    return F.array(*map(F.lit, query_words(query))) if isinstance(query, str) else F.array_distinct(words(F.lower(query)))


def text_set(text: str | Column) -> Column:
    """A text's distinct lower-case words."""
    return F.array_distinct(words(F.lower(col(text))))


def jaccard_with_phrase(query: str | Column, text: str | Column, q: Column | None = None, t: Column | None = None, lower: Column | None = None) -> Column:
    """Jaccard similarity of the word sets (q and t, if they are at hand, and the lower-case text), plus 0.3 if the text holds the whole query."""
    q, t = query_set(query) if q is None else q, text_set(text) if t is None else t
    both = F.size(F.array_intersect(q, t))
    share = F.try_divide(both, F.size(q) + F.size(t) - both)
    phrase = F.lit(query.lower()) if isinstance(query, str) else F.lower(query)
    return F.coalesce(share, F.lit(0.0)) + F.when((F.lower(col(text)) if lower is None else lower).contains(phrase), 0.3).otherwise(0.0)


def word_cosine(query: str | Column, text: str | Column) -> Column:
    """Cosine similarity of the two word sets: the default pair scorer, without leaving the JVM."""
    q, t = query_set(query), F.array_distinct(words(F.lower(col(text))))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.sqrt(F.size(q) * F.size(t))), F.lit(0.0))


def occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def listwise(query: str | Column, text: str | Column, place: Column) -> Column:
    """0.4 term overlap, 0.3 density, 0.2 for the place, 0.1 for a length of up to 100 words."""
    lower, qs = F.lower(col(text)), query_set(query)
    w = words(lower)
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(qs, w)), F.size(qs)), F.lit(0.0))
    each = F.transform(qs, lambda q: (F.length(lower) - F.length(F.replace(lower, q, F.lit("")))) / F.length(q))
    count = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    density = F.coalesce(F.try_divide(count, F.size(w)), F.lit(0.0))
    return overlap * 0.4 + density * 0.3 + (1 / place) * 0.2 + F.least(F.lit(1.0), F.size(w) / 100) * 0.1


#: Weights of common query terms; all others weigh 1.
TERM_WEIGHTS = dict.fromkeys(("what", "how", "why", "when", "where"), 2.0) | {"which": 1.8, "can": 1.5, "could": 1.5, "the": 0.1, "a": 0.1, "an": 0.1, "and": 0.2, "or": 0.3, "but": 0.4}


def weighted_tf(query_terms: list[str], text: str | Column) -> Column:
    """Sum over the distinct query terms of weight times ln(1 + occurrences)."""
    t = terms(text)
    total = F.lit(0.0)
    for q in sorted(set(query_terms)):
        total = total + TERM_WEIGHTS.get(q, 1.0) * F.log1p(count_of(t, q).cast("double"))
    return total


def rank_reason(query: str | Column, text: str | Column, rank: Column, score: Column) -> Column:
    """Why a passage has its rank, in words; of the shared terms the first three in the alphabet are named."""
    shared = F.slice(F.array_sort(F.array_intersect(query_set(query), words(F.lower(col(text))))), 1, 3)
    terms_of = F.when(F.size(shared) > 0, F.array_join(shared, ", ")).otherwise("none")
    how = F.when(rank == 1, "Best match").when(rank <= 3, "Strong match").otherwise("Weaker match")
    return F.format_string("%s (score %s); shared terms: %s", how, fixed(score, 2), terms_of)


def rank_score(rank: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - (rank - 1) * 0.1)


def rank_confidence(rank: Column, reasoning: Column) -> Column:
    base = F.greatest(F.lit(0.5), 1 - (rank - 1) * 0.05)
    return F.least(F.lit(1.0), base + F.when(F.length(reasoning) > 50, 0.1).otherwise(0.0))


def risk_level(score: Column) -> Column:
    return F.when(score < 0.25, "low").when(score < 0.5, "medium").when(score < 0.75, "high").otherwise("critical")


def completeness(answer: Column) -> Column:
    n, dots = F.length(answer), occurrences(answer, ".")
    rich = 0.5 + F.when(dots >= 2, 0.25).otherwise(0.0) + F.when(n.between(100, 2000), 0.25).otherwise(0.0)
    return F.when(F.coalesce(n, F.lit(0)) < 50, 0.3).otherwise(rich)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
