"""Edited trees against whole re-encoding; trees kept as a table; edge cases."""

import random

import pytest

from loamstack.llm import token_counts as C
from loamstack.llm import tokens

ALPHABET = ["a", "the", " ", "  ", "\n", "\t ", "é", "漢字", "'s", "123", "!?", " don't", "x" * 40, "", " "]


@pytest.fixture(scope="module")
def encoder():
    return tokens.RunEncoder()


def text(rng: random.Random, n: int) -> str:
    return "".join(rng.choices(ALPHABET, k=n))


def whole(t: str) -> int:
    return len(tokens.encoding(tokens.VOCABULARY).encode_ordinary(t))


@pytest.mark.parametrize("seed", range(60))
def test_edits_equal_whole_encoding(encoder, seed):
    rng = random.Random(seed)
    t = text(rng, rng.choice((0, 1, 5, 60)))
    tree = C.CountTree(t, encoder)
    for _ in range(12):
        a, b = sorted((rng.randint(0, len(t) + 2), rng.randint(0, len(t) + 2)))
        new = text(rng, rng.choice((0, 1, 3)))
        t = t[:a] + new + t[max(a, b) :]
        tree.edit(a, b, new)
        assert tree.text == t and tree.n_chars == len(t) and tree.n_tokens == whole(t)
        assert sum(tree.leaves) == whole(t)
        tree = C.CountTree(t, encoder, [encoder.count_run(r) for r in tokens.runs(t) if r]) if rng.random() < 0.3 else tree


def test_encodes_only_what_edits_touch(encoder):
    t = "some words of a long text. " * 20_000
    tree = C.CountTree(t, encoder)
    tree.edit(250_000, 250_004, "other")
    assert tree.n_tokens == whole(t[:250_000] + "other" + t[250_004:])
    assert tree.encoded < 100


def test_query_against_whole_encoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = C.count_with_redactions(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        edits = C.redactions(t)
        after = t
        for a, b, new in reversed(edits):
            after = after[:a] + new + after[b:]
        assert (r["n_tokens"], r["n_edits"], r["n_tokens_after"]) == (whole(t), len(edits), whole(after))


def test_kept_trees(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "x"), (None, "y y")], "doc_id bigint, text string")
    edits = spark.createDataFrame([(1, 4, 7, "2222"), (1, 0, 3, "eins"), (2, 0, 0, "new"), (9, 0, 1, "z"), (3, None, 1, "z"), (None, 0, 1, "q")], "doc_id bigint, start_pos int, end_pos int, replacement string")
    kept = C.trees(docs)
    got = {r["doc_id"]: r for r in C.edit_trees(kept, edits).collect()}
    assert {k: r["text"] for k, r in got.items()} == {1: "eins 2222 three", 2: "new", 3: "x", None: "y y"}
    for r in got.values():
        assert sum(r["run_tokens"]) == r["n_tokens"] == whole(r["text"])
    assert got[3]["n_chars_encoded"] == 0
    counted = {r["doc_id"]: r["n_tokens_after"] for r in C.count_with_edits(docs, edits).collect()}
    assert counted == {k: r["n_tokens"] for k, r in got.items()}


def test_odd_rows(spark):
    kind = "`a.b` int, doc_id bigint, text string, Text string, `__edits` int"
    assert C.count_with_redactions(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, 1, None, "t", 1), (1, 2, "", "t", 1), (1, 3, "same", "t", 1), (1, 3, "same", "t", 1), (1, None, "w " * 600_000, "t", 1)]
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in C.count_with_redactions(spark.createDataFrame(rows, kind)).collect())
    assert got == [("1", 0), ("2", 0), ("3", 1), ("3", 1), ("None", whole("w " * 600_000))]
