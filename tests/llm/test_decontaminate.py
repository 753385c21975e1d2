"""Items of any length are found wherever they lie, whatever their ids."""

import random

import numpy as np
import pytest

from loamstack.llm import decontaminate as D

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def text(rng: random.Random, n: int) -> str:
    return " ".join(f"w{int(rng.random() ** 2 * 5000)}" for _ in range(n))


def index_of(items: list[tuple[int, str]]) -> D.Index:
    frequency: dict[str, int] = {}
    for _, t in items:
        for w in set(D.words(t)):
            frequency[w] = frequency.get(w, 0) + 1
    mean = sum(len(D.words(t)) for _, t in items) / len(items)
    return D.build([(i, *D.question_answer(t)) for i, t in items], frequency, len(items), mean)


def exhaustive(index: D.Index, terms: set[int], bar: float) -> dict[int, float]:
    """Every entry's score, one at a time."""
    scores = {e: sum(x for t in terms for d, x in zip(*index.postings[t][:2], strict=True) if d == e) for e in range(len(index.owner))}
    return {e: s for e, s in scores.items() if s >= bar - 1e-9}


@pytest.mark.parametrize("bar", [0.05, 0.2, 0.5])
def test_wand_is_exhaustive_scoring(bar):
    rng = random.Random(bar)
    index = index_of([(i, text(rng, rng.choice((1, 5, 30, 90)))) for i in range(60)])
    for _ in range(60):
        terms = set(rng.sample(range(len(index.vocabulary)), rng.randint(1, 80))) | set(rng.choices([t for t, p in enumerate(index.postings) if len(p[0]) > 3], k=20))
        got = dict(D.wand(index, sorted(terms), bar))
        want = exhaustive(index, terms, bar)
        assert got.keys() == want.keys()
        assert all(abs(got[e] - want[e]) < 1e-9 for e in got)
        assert {e for e, _ in D.wand(index, sorted(terms), bar, 8, 24)} == {e for e in want if 8 <= e < 24}


def test_batches_lose_no_passage():
    rng = random.Random(9)
    index = index_of([(i, text(rng, 30)) for i in range(40)])
    texts = [text(rng, n) for n in (0, 1, 63, 64, 127, 128, 129, 192, 193, 640, 3000)] + [None, "  ", "!!! ???"]
    ids = [np.array([i for w in D.words(t) for i in [index.vocabulary.get(w, -1)]], np.int64) for t in texts]
    find = D.Matcher(index, 0.1, 0.0)
    got = {}
    for doc, terms, blocks in find._passages(ids):
        got.setdefault(doc, {}).setdefault(tuple(sorted(terms)), set()).update(blocks)
    for doc, own in enumerate(ids):
        for at in range(0, max(1, len(own) - D.PASSAGE + D.STRIDE), D.STRIDE):
            terms = {int(t) for t in own[at : at + D.PASSAGE] if t >= 0}
            for entry in exhaustive(index, terms, 0.1):
                assert entry // D.BLOCK in got[doc][tuple(sorted(terms))]


def found(items: list[tuple[int, str]], doc: str) -> list[int]:
    return [m[0] for m in D.Matcher(index_of(items), D.THRESHOLD, D.OVERLAP)(doc)]


@pytest.mark.parametrize("length", [20, 64, 65, 100, 128, 256, 300, 500, 2000])
@pytest.mark.parametrize("offset", [0, 17, 40, 63])
def test_verbatim_item_of_any_length(length, offset):
    rng = random.Random(length)
    items = [(i, text(rng, 30)) for i in range(50)] + [(99, text(rng, length))]
    assert found(items, f"{text(rng, offset)} {items[-1][1]} {text(rng, 90)}") == [99]
    assert 99 not in found(items, text(rng, length + 90))


def test_entries_hold_the_whole_item():
    for n in (1, 64, 65, 96, 97, 500):
        whole = [str(i) for i in range(n)]
        pieces = D.entries(whole)
        assert pieces[0] == whole
        assert {w for p in pieces[1:] or pieces for w in p} == set(whole)
        assert all(len(p) <= D.PIECE for p in pieces[1:])


def test_long_item_is_reported_and_its_document_dropped(spark):
    rng = random.Random(1)
    items = [(i, text(rng, 30)) for i in range(20)] + [(500, text(rng, 500))]
    docs = spark.createDataFrame([(1, text(rng, 33) + " " + items[-1][1] + " " + text(rng, 70)), (2, text(rng, 600))], DOCS)
    benchmark = spark.createDataFrame(items, ITEMS)
    for shard_items in (20_000, 8):
        assert [(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, benchmark, shard_items=shard_items).collect()] == [(1, 500)]
        assert [r["doc_id"] for r in D.keep_clean(docs, benchmark, shard_items=shard_items).collect()] == [2]


def test_items_that_share_or_lack_an_id_are_all_searched(spark):
    rng = random.Random(2)
    a, b, c, d = (text(rng, 30) for _ in range(4))
    benchmark = spark.createDataFrame([(7, a), (7, b), (7, ""), (7, None), (None, c), (None, d), (None, d), (8, a)], ITEMS)
    held = [a, b, c, d, f"{a} {b}", text(rng, 30)]
    docs = spark.createDataFrame([(i, f"{text(rng, 20)} {t} {text(rng, 20)}") for i, t in enumerate(held)], DOCS)
    for shard_items in (20_000, 1):
        out = [(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, benchmark, shard_items=shard_items).collect()]
        assert sorted(out, key=str) == [(0, 7), (0, 8), (1, 7), (2, None), (3, None), (4, 7), (4, 8)]
        assert [r["doc_id"] for r in D.keep_clean(docs, benchmark, shard_items=shard_items).collect()] == [5]


def test_questions_and_answers_that_share_or_lack_an_id(spark):
    rng = random.Random(3)
    pairs = [(text(rng, 20), text(rng, 8)) for _ in range(3)]
    rows = [(7, *pairs[0]), (7, *pairs[1]), (7, None, ""), (None, *pairs[2])]
    benchmark = spark.createDataFrame(rows, "item_id bigint, question string, answer string")
    docs = spark.createDataFrame([(i, f"{q} {a}") for i, (q, a) in enumerate(pairs)] + [(3, text(rng, 28))], DOCS)
    out = [(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, benchmark).collect()]
    assert sorted(out, key=str) == [(0, 7), (1, 7), (2, None)]
    assert [r["doc_id"] for r in D.keep_clean(docs, benchmark).collect()] == [3]
