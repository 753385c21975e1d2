"""Links and classes against all pairs; ids that repeat with different texts; nulls, empty tables and clashing names."""

import random
from collections import defaultdict

import numpy as np
import pytest

from loamstack.llm import jaccard_join as J

DOCS = "doc_id bigint, text string, source string"


def text(rng: random.Random, n: int = 60) -> str:
    return " ".join(f"w{rng.randint(0, 99999)}" for _ in range(n))


def near(t: str, at: int) -> str:
    w = t.split()
    return " ".join([*w[:at], "changed", *w[at + 1 :]])


def grams(t: str | None) -> frozenset:
    w = (t or "").lower().split()
    n = min(J.N, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(rows) -> list[tuple[int, int, int, int]]:
    """linked(), by all pairs of sets."""
    members = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None and grams(t):
            members[grams(t)].add(i)
    sets = list(members)
    links = {s: {o for o in sets if o is not s and len(s & o) >= J.THRESHOLD * len(s | o)} for s in sets}
    out = []
    for s in sets:
        reached, todo = {s}, [s]
        while todo:
            for o in links[todo.pop()] - reached:
                reached.add(o)
                todo.append(o)
        if links[s] or len(members[s]) > 1:
            lead = min(min(members[o]) for o in reached)
            out += [(i, lead, len(links[s]), len(members[s]) - 1) for i in members[s]]
    return sorted(out)


def rows():
    rng = random.Random(5)
    a, b, c, d, e, f = (text(rng) for _ in range(6))
    kept = [(1, a), (1, b), (4, None), (4, c), (4, ""), (5, d), (7, e), (None, a), (None, a), (9, None)]
    gone = [(2, near(a, 30)), (3, near(b, 30)), (5, d), (6, d), (7, near(a, 3)), (8, near(d, 9)), (8, c)]
    either = [(10, f), (10, near(f, 20))]
    return kept, gone, either


def test_every_text_of_an_id_is_compared(spark):
    docs = [(*r, "s") for part in rows() for r in part]
    assert sorted(tuple(r) for r in J.linked(spark.createDataFrame(docs, DOCS).repartition(3)).collect()) == brute(docs)


def test_rows_go_only_if_their_own_text_is_a_copy(spark):
    kept, gone, either = rows()
    docs = spark.createDataFrame([(*r, "s") for r in (*gone, *either, *kept)], DOCS).repartition(3)
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    left = [tuple(r)[:2] for r in out.collect()]
    assert sum(r in left for r in either) == 1
    assert sorted((r for r in left if r not in either), key=str) == sorted(kept, key=str)


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_families_and_shared_passages_against_all_pairs(spark, monkeypatch, block):
    """Chains of near copies, a passage that many texts share, a hot group of copies; with units of one block and of many."""
    monkeypatch.setattr(J, "BLOCK_GRAMS", block)
    rng = random.Random(8)
    docs, passage = [], text(rng, 40)
    for k in range(6):
        t = text(rng, rng.choice((20, 80, 200)))
        for step in range(8):
            docs.append(t)
            w = t.split()
            at = rng.randrange(len(w) - 5)
            t = " ".join([*w[:at], *text(rng, 6).split(), *w[at + 4 :]])
    docs += [f"{text(rng, 20)} {passage} {text(rng, 15)}" for _ in range(40)]
    docs += [docs[0]] * 30 + ["two words", "two  WORDS", "one", "one", None, "", "   "]
    data = [(i, t, "s") for i, t in enumerate(docs)]
    out = sorted(tuple(r) for r in J.linked(spark.createDataFrame(data, DOCS).repartition(3), recall=0.99999).collect())
    assert out == brute(data)
    left = {r["doc_id"] for r in J.keep_one(spark.createDataFrame(data, DOCS), recall=0.99999).collect()}
    assert left == {i for i, t, _ in data} - {i for i, lead, *_ in brute(data) if i != lead}


def test_compare_is_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 400, 60)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.8], rng.integers(0, 4000, rng.integers(1, 60))])).astype(np.uint64) for _ in range(70)]
    own, block = rng.random(70) < 0.7, np.zeros(70, int)
    for block in (np.zeros(70, int), rng.integers(3, 5, 70)):
        degree, edges = J.compare(sets, own, block, 0.4)
        pairs = [
            (i, j)
            for i in range(70)
            for j in range(i + 1, 70)
            if (own[i] or own[j]) and (block.min() == block.max() or block[i] != block[j])
            and len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))
        ]
        assert degree.tolist() == [sum(i in p for p in pairs) for i in range(70)]
        assert set(edges) <= set(pairs) and len(edges) < 70
        label = list(range(70))
        for links in (pairs, edges):
            label = list(range(70))
            for i, j in links:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
            groups = frozenset(frozenset(k for k in range(70) if label[k] == x) for x in label)
            assert links is pairs or groups == want
            want = groups


def test_banding_reaches_its_recall():
    bands, per_band = J.bands_and_rows(J.THRESHOLD, J.RECALL)
    assert 1 - (1 - J.THRESHOLD**per_band) ** bands >= J.RECALL
    rng = np.random.default_rng(1)
    sign, met = J.Signer(bands, per_band), 0
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        b = np.concatenate([a[:200], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
        met += any(x == y for x, y in zip(sign(a), sign(b), strict=True))
    assert met >= 0.95 * 300


def test_a_long_text(spark):
    rng = random.Random(2)
    long = text(rng, 150_000)
    data = [(1, long, "s"), (2, long + " more", "s"), (3, text(rng, 9), "s")]
    assert {tuple(r) for r in J.linked(spark.createDataFrame(data, DOCS)).collect()} == {(1, 1, 1, 0), (2, 1, 1, 0)}


def test_empty_tables_and_clashing_names(spark):
    kind = "`a.b` string, TEXT string, doc_id bigint, text string, `__bits` int, `__maybe` int, `__key` int, `Doc_Id` string"
    empty = spark.createDataFrame([], kind)
    assert J.linked(empty).count() == 0
    assert J.keep_one(empty).columns == empty.columns
    t = text(random.Random(1))
    full = spark.createDataFrame([("x", "other", i, t, 1, None, 3, "q") for i in (2, 1)] + [(None,) * 8], kind)
    assert {tuple(r) for r in J.linked(full).collect()} == {(1, 1, 0, 1), (2, 1, 0, 1)}
    kept = J.keep_one(full)
    assert kept.columns == full.columns
    assert sorted(str(r[2]) for r in kept.collect()) == ["1", "None"]
