"""The best run against all runs; tokens against a plain pattern; long and odd pages."""

import random
import re
import time

import pytest

from loamstack.llm import html_extraction as H

PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|<[!?][^>]*>", re.S | re.I)
PARTS = ["<a", ">", "<script", "</script>", "<!--", "-->", " x ", "</p", "<p ", "<p>", "<!", "<style ", "</style >", "y", "<", '="<b>"', "<article>", "</article>"]


def plain_tokens(page):
    out, at = [], 0
    for m in [*PLAIN.finditer(page), None]:
        end = m.start() if m else len(page)
        words = len(page[at:end].split())
        if words:
            out.append((at, end, None, words))
        if m:
            out.append((m.start(), m.end(), m.group(2) + m.group(3).lower() if m.group(3) else "!", 0))
            at = m.end()
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tokens_are_those_of_the_pattern(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        page = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        assert H.tokens(page) == plain_tokens(page)


@pytest.mark.parametrize("seed", range(30))
def test_best_run_is_the_best_of_all(seed):
    rng = random.Random(seed)
    values = [rng.choice((-2.0, -1.0, -0.5, 1.0, 2.0)) for _ in range(rng.randint(0, 25))]
    runs = [(sum(values[a:b]), -a, -b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)]
    top = max(runs, default=(0.0, 0, 0))
    start, end, score = H.best_run(values)
    assert score == max(0.0, top[0])
    if score:
        assert sum(values[start:end]) == score
        assert end == min(-b for s, _, b in runs if s == score)


def test_extraction_on_pages_that_were_not_labelled(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    pages = [r["html"] for r in table.collect() if r["html"]]
    weights = H.fit(pages[::2][:300])
    right = total = 0
    for page in pages[1::2]:
        parts = H.tokens(page)
        span = H.label(parts)
        if span:
            start, end, _ = H.best_run(H.scores(parts, weights))
            got, truth = {k for k in range(start, end) if parts[k][3]}, {k for k in range(*span) if parts[k][3]}
            words = lambda ks: sum(parts[k][3] for k in ks)
            right += 2 * words(got & truth)
            total += words(got) + words(truth)
    assert total and right / total > 0.9


@pytest.mark.parametrize("junk", ["<a ", "<!-- ", "<script ", "</script", "<", "<p>", "word ", "<style></style "])
def test_long_pages_take_linear_time(junk):
    began = time.perf_counter()
    H.extract_page(junk * (3_000_000 // len(junk)), H.DEFAULT)
    assert time.perf_counter() - began < 30


def test_odd_rows(spark):
    kind = "`a.b` int, page_id bigint, html string, Html int"
    assert H.extract(spark.createDataFrame([], kind)).count() == 0
    rows = [(0, 1, None, 0), (0, 2, "", 0), (0, 3, "<p></p>", 0), (0, None, "<p>a b</p>", 0), (0, 5, "a &amp; b", 0), (0, 5, "a &amp; b", 0)]
    got = sorted((str(r["page_id"]), r["content"], r["n_words"]) for r in H.extract(spark.createDataFrame(rows, kind)).collect())
    assert got == [("1", None, 0), ("2", None, 0), ("3", None, 0), ("5", "a & b", 3), ("5", "a & b", 3), ("None", "a b", 2)]
