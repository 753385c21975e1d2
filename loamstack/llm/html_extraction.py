"""Operator 5: main text of web pages as the maximum-scoring run of tokens.

A page is a list of tokens: tags, and words of the text between them. Words score a positive weight and tags a
negative one; the run of tokens with the greatest sum is the content, found in one linear scan. Weights come from
labelled pages: a page is labelled if it holds one <article>, whose inside is content. Each tag name's weight is its log-odds
inside against outside, moved below zero; the words' weight is scaled so that on the labelled pages the extracted
words agree best with the labelled ones. The article tag itself is no feature.

Weights are fitted on ``pages`` labelled pages at most, those with the least hash of page_id; extraction covers every
page whole. Scripts, styles and comments are dropped; entities are decoded. Pages that are null, empty or without words
give a row with null text, score 0. Of runs with the same score the first is taken, and of those the shortest. Repeated
rows are judged one by one, those without page_id too; columns besides page_id and html are ignored, whatever their
names; without labelled pages DEFAULT weights hold. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, plain

#: What a markup token starts with; where it ends is looked for once, from there.
OPEN = re.compile(r"<!--|<(script|style|noscript|template)\b|<(/?)([a-zA-Z][a-zA-Z0-9]*)|<[!?]", re.I)
SCHEMA = "page_id bigint, start_char int, end_char int, n_words int, score double, content string"
#: Tokens of one page: (start, end, tag name or None for text, words).
Tokens = list[tuple[int, int, str | None, int]]
DEFAULT = {"": 1.0, "*": -3.0}
CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")}


def tokens(page: str) -> Tokens:
    """Dropped parts have the name ``!``; end tags the name with a slash before it.

    A comment, script, style or template without an end goes to the end of the page; a tag or declaration without ``>``
    is text. Linear in the page: once no ``>`` follows, none is looked for again.
    """
    out: Tokens = []
    at = look = 0
    last = page.rfind(">")
    while (m := OPEN.search(page, look)) is not None:
        name = "!"
        if m.group() == "<!--":
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        elif m.group(1):
            close = CLOSE[m.group(1).lower()].search(page, m.end())
            end = close.end() if close else len(page)
        else:
            if m.end() > last:
                look = m.end()
                continue
            end = page.find(">", m.end()) + 1
            if m.group(3):
                name = m.group(2) + m.group(3).lower()
        if m.start() > at:
            words = len(page[at : m.start()].split())
            if words:
                out.append((at, m.start(), None, words))
        out.append((m.start(), end, name, 0))
        at = look = end
    words = len(page[at:].split())
    if words:
        out.append((at, len(page), None, words))
    return out


def label(parts: Tokens) -> tuple[int, int] | None:
    """The token span inside the page's only <article>."""
    opened = [i for i, p in enumerate(parts) if p[2] == "article"]
    closed = [i for i, p in enumerate(parts) if p[2] == "/article"]
    return (opened[0] + 1, closed[0]) if len(opened) == len(closed) == 1 and opened[0] < closed[0] else None


def scores(parts: Tokens, weights: dict[str, float]) -> list[float]:
    other = weights["*"]
    return [weights[""] * p[3] if p[2] is None else 0.0 if p[2] in ("article", "/article") else weights.get(p[2], other) for p in parts]


def best_run(values: list[float]) -> tuple[int, int, float]:
    """[start, end) of the run with the greatest positive sum; (0, 0, 0.0) if there is none."""
    best, run, start = (0, 0, 0.0), 0.0, 0
    for i, v in enumerate(values):
        if run <= 0:
            run, start = 0.0, i
        run += v
        if run > best[2]:
            best = (start, i + 1, run)
    return best


def fit(pages: list[str]) -> dict[str, float]:
    labelled = []
    inside, outside = Counter(), Counter()
    for page in pages:
        parts = tokens(page)
        span = label(parts)
        if span:
            labelled.append((parts, span))
            for i, (_, _, name, _) in enumerate(parts):
                if name is not None:
                    (inside if span[0] <= i < span[1] else outside)[name] += 1
    if not labelled:
        return dict(DEFAULT)
    n_in, n_out = sum(inside.values()), sum(outside.values())
    names = set(inside) | set(outside)
    odds = {t: math.log((inside[t] + 0.5) / (n_in + 0.5 * len(names))) - math.log((outside[t] + 0.5) / (n_out + 0.5 * len(names))) for t in names}
    top = max(odds.values())
    weights = {t: min(o, 0.0) - 0.1 if o < 0 else -0.1 * (1 + top - o) for t, o in odds.items()}
    weights["*"] = min(weights.values())
    best = (-1.0, 0.1)
    for k in range(-8, 9):
        weights[""] = 2.0 ** (k / 2) * 0.1
        agreement = 0.0
        for parts, (a, b) in labelled:
            start, end, _ = best_run(scores(parts, weights))
            truth, got = sum(p[3] for p in parts[a:b]), sum(p[3] for p in parts[start:end])
            both = sum(p[3] for p in parts[max(a, start) : max(a, start, min(b, end))])
            agreement += 2 * both / (truth + got) if truth + got else 1.0
        best = max(best, (agreement / len(labelled), weights[""]))
    weights[""] = best[1]
    return weights


def train(pages: DataFrame, most: int = 300) -> dict[str, float]:
    """Weights from at most ``most`` labelled pages."""
    known = plain(pages, "page_id", "html").where(F.col("page_id").isNotNull() & F.col("html").contains("<article"))
    ids = [r[0] for r in known.select("page_id", F.xxhash64("page_id").alias("__h")).orderBy("__h", "page_id").limit(most).collect()]
    rows = known.where(F.col("page_id").isin(ids)).select("page_id", "html").collect() if ids else []
    return fit([r[1] for r in sorted({(r[0], r[1]) for r in rows})])


def text_of(page: str, parts: Tokens) -> str:
    """Words joined by blanks, with line breaks at the tags between."""
    lines, line = [], []
    for start, end, name, _ in parts:
        if name is None:
            line.append(page[start:end])
        elif name.lstrip("/") not in ("b", "i", "a", "em", "strong", "span", "u", "sup", "sub", "code", "small"):
            lines.append("".join(line))
            line = []
    lines.append("".join(line))
    done = (" ".join(entities.unescape(x).split()) for x in lines)
    return "\n".join(x for x in done if x)


def extract_page(page: str | None, weights: dict[str, float]) -> tuple[int | None, int | None, int, float, str | None]:
    parts = tokens(page) if page else []
    start, end, score = best_run(scores(parts, weights))
    if start == end:
        return None, None, 0, 0.0, None
    chosen = parts[start:end]
    return chosen[0][0], chosen[-1][1], sum(p[3] for p in chosen), round(score, 6), text_of(page, chosen)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The content of every page. Without weights, fits them on these pages."""
    weights = weights or train(pages)

    def make():
        return lambda ids, texts: ((i, *extract_page(t, weights)) for i, t in zip(ids, texts, strict=True))

    named = plain(pages, "page_id", "html").select(F.col("page_id").cast("bigint").alias("page_id"), "html")
    return map_rows(named, ["page_id", "html"], make, SCHEMA)
