"""Text columns: words, quality, windows, token estimates and metadata patterns. All stay in the JVM.

Null texts count as empty in numbers (0 words, 0 tokens) and give null or empty results elsewhere.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CHARS, MAX_CHARS, MIN_WORDS, MIN_ALPHA = 100, 1_000_000, 50, 0.5


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, x being computed once: lambdas see a value, not an expression to compute again at each step."""
    return F.transform(F.array(x), f)[0]


def words(text: str | Column) -> Column:
    """Runs of non-blank characters."""
    return F.array_remove(F.split(col(text), r"\s+"), "")


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def has_words(text: str | Column, n: int) -> Column:
    """Whether a text has n words at least (n from 1); reads no further than these."""
    return col(text).rlike(rf"^\s*+(?:\S++\s++){{{n - 1}}}\S")


def alpha_ratio(text: str | Column) -> Column:
    """The share of letters among a text's characters."""
    return F.try_divide(F.length(F.regexp_replace(col(text), r"[^\p{L}]+", "")), F.length(col(text)))


def reject_reason(text: str | Column) -> Column:
    """Why a text fails the quality rules, in the order in which they apply; null if it passes."""
    n = F.coalesce(F.length(col(text)), F.lit(0))
    return (
        F.when(n < MIN_CHARS, "too_short")
        .when(n > MAX_CHARS, "too_long")
        .when(~has_words(text, MIN_WORDS), "few_words")
        .when(alpha_ratio(text) < MIN_ALPHA, "low_alpha")
    )


def n_windows(n: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")


def window_words(w: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of a word array. The array should be a column, so that it is computed once."""
    step = size - overlap
    numbers = F.sequence(F.lit(0), n_windows(F.size(w), size, overlap) - 1)
    return F.transform(numbers, lambda i: F.slice(w, i * step + 1, size))


def windows(w: Column, size: int, overlap: int) -> Column:
    """The same as texts."""
    step = size - overlap
    numbers = F.sequence(F.lit(0), n_windows(F.size(w), size, overlap) - 1)
    return F.transform(numbers, lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))


def tokens_by_chars(text: str | Column, least: int = 0) -> Column:
    return F.greatest(F.floor(F.length(col(text)) / 4), F.lit(least)).cast("bigint")


def fixed(x: Column, digits: int) -> Column:
    """x with so many decimals as C's printf writes it: from the exact binary value, ties to even. Spark's format_string rounds the shortest decimal form half up."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals, from the product in double precision, as DuckDB rounds; F.round takes the shortest decimal form, so that the two differ by ties."""
    return F.round(x * 10.0**digits) / 10.0**digits


def terms(text: str | Column) -> Column:
    """Lower-case runs of word characters: letters and digits of any script, and underscores."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def terms_among(text: str | Column, wanted: list[str]) -> Column:
    """``terms`` with an empty text for each that is not wanted; only those wanted are copied out of the text."""
    whole = [w for w in wanted if w and all(c == "_" or unicodedata.category(c)[0] in "LN" for c in w)]
    own = f"({'|'.join(whole)})(?![\\p{{L}}\\p{{N}}_])|" if whole else "()(?!)|"
    return F.regexp_extract_all(F.lower(col(text)), F.lit(own + r"[\p{L}\p{N}_]++"), 1)


def count_of(array: Column, value: str) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def tidy(text: str | Column) -> Column:
    """Blanks to single spaces, page numbers dropped, spaces put between joined words and sentences."""
    t = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    t = F.regexp_replace(t, r"(?i)Page \d+", "")
    t = F.regexp_replace(t, r"([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(t, r"(\.)([A-Z])", "$1 $2"))


def trim_sentence(text: str | Column) -> Column:
    """Without the last sentence, unless under 70 % would stay or there is but one."""
    t = col(text)
    parts = F.split(F.regexp_replace(t, r"([.!?])\s+", "$1\u0001"), "\u0001")
    short = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.when((F.size(parts) <= 1) | (F.length(short) < F.length(t) * 0.7), t).otherwise(short)


# Document metadata.

TITLES = (r"(?im)^(.+?)(?:\n|\r)", r"(?im)Title:\s*(.+?)(?:\n|\r)", r"(?im)title\s*[:=]\s*(.+?)(?:\n|\r)")
AUTHORS = (r"(?i)Authors?:\s*(.+?)(?:\n|\r)", r"(?i)By:\s*(.+?)(?:\n|\r)", r"(?i)^([A-Z][a-z]+\s+[A-Z][a-z]+(?:,\s*[A-Z][a-z]+\s+[A-Z][a-z]+)*)")
ABSTRACT = r"(?is)Abstract\s*:?\s*(.+?)(?:\n\n|\n[A-Z])"
KEYWORDS = r"(?i)Keywords?\s*:?\s*(.+?)(?:\n\n|\n[A-Z])"
TOPICS = ("machine learning", "deep learning", "neural network", "artificial intelligence", "natural language processing", "computer vision",
          "reinforcement learning", "transformer", "attention mechanism", "embedding", "classification", "regression")
REFERENCES = (r"\[\d+\]", r"\(\d{4}\)", r"et al\.")
FIGURES = (r"(?i)Figure\s+\d+", r"(?i)Fig\.\s+\d+", r"(?i)figure\s+\d+")
TABLES = (r"(?i)Table\s+\d+", r"(?i)table\s+\d+")
HEADING = r"^(#{1,3}\s+.+|[A-Z][A-Z\s]{2,20}[A-Z])$"


def _group(text: Column, pattern: str) -> Column:
    return F.trim(F.regexp_extract(text, pattern, 1))


def title(text: str | Column) -> Column:
    """The first of three patterns whose match has 10 to 200 characters."""
    found = [_group(col(text), p) for p in TITLES]
    return F.coalesce(*(F.when(F.length(x).between(10, 200), x) for x in found))


def authors(text: str | Column) -> Column:
    found = F.coalesce(*(F.nullif(_group(col(text), p), F.lit("")) for p in AUTHORS))
    parts = F.transform(F.split(found, r",\s*|\s+and\s+|\s*&\s*"), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def abstract(text: str | Column) -> Column:
    found = _group(col(text), ABSTRACT)
    return F.when(F.length(found).between(50, 2000), found)


def keywords(text: str | Column) -> Column:
    """The listed keywords, else known topics that the text names (ten at most)."""
    listed = F.transform(F.split(_group(col(text), KEYWORDS), r",\s*|;\s*"), lambda x: F.trim(x))
    listed = F.filter(listed, lambda x: x != "")
    known = F.filter(F.array(*map(F.lit, TOPICS)), lambda t: F.lower(col(text)).contains(t))
    return F.when(F.size(listed) > 0, listed).otherwise(F.slice(known, 1, 10))


def headings(text: str | Column) -> Column:
    """Distinct section headings in order, twenty at most."""
    lines = F.transform(F.split(col(text), "\n"), lambda x: F.trim(x))

    def heading(line: Column) -> Column:
        numbered = F.regexp_extract(line, r"^\d+\.?\s+([A-Z][a-zA-Z\s]{5,50})$", 1)
        marked = line.rlike(r"^#{1,3}\s+.+$") | line.rlike(r"^[A-Z][A-Z\s]{2,30}[A-Z]$")
        return F.when(marked, F.trim(F.replace(line, F.lit("#"), F.lit("")))).otherwise(numbered)

    return F.slice(F.array_distinct(F.filter(F.transform(lines, heading), lambda x: F.length(x) > 3)), 1, 20)


def matches(text: str | Column, patterns: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(col(text), F.lit(p))
    return total.cast("bigint")


def references(text: str | Column) -> Column:
    return F.least(matches(text, REFERENCES), F.lit(500))
