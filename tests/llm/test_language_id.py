"""Held-out accuracy, votes of more than one machine, and edge cases."""

import random

import numpy as np

from loamstack.llm import language_id as L

KIND = "doc_id bigint, text string, lang string"


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang in ('de', 'en', 'es', 'fr') and length(text) > 1")
    model = L.train(table.where("doc_id % 2 = 0"))
    held = table.where("doc_id % 2 = 1")
    truth = {r["doc_id"]: r["lang"] for r in held.select("doc_id", "lang").collect()}
    got = {r["doc_id"]: r for r in L.identify(held, model).collect()}
    assert got.keys() == truth.keys()
    judged = {i: r["predicted"] for i, r in got.items() if r["reason"] is None}
    assert len(judged) > 0.98 * len(truth)
    assert sum(judged[i] == truth[i] for i in judged) > 0.98 * len(judged)
    assert sorted(r["doc_id"] for r in L.keep_identified(held, model).select("doc_id").collect()) == sorted(judged)


def invented(rng: random.Random, letters: str, n: int) -> str:
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def test_three_languages_of_a_family_vote():
    """Every pair within a family has a machine; the language that wins most of them is taken."""
    rng = random.Random(1)
    letters = {"aa": "abcde", "ab": "abcfg", "ac": "abchi", "ba": "uvwxy", "bb": "uvwzq"}
    families = {"a": ("aa", "ab", "ac"), "b": ("ba", "bb")}
    texts = [(invented(rng, own, 40), name) for name, own in letters.items() for _ in range(40)]
    model = L.fit([t for t, _ in texts], [n for _, n in texts], families)
    assert model.pairs == [("aa", "ab"), ("aa", "ac"), ("ab", "ac"), ("ba", "bb")]
    fresh = [(invented(rng, own, 40), name) for name, own in letters.items() for _ in range(20)]
    got = L._judge(model, [t for t, _ in fresh], 0.0)
    assert sum(row[1] == name for row, (_, name) in zip(got, fresh, strict=True)) >= 0.97 * len(fresh)
    for text, _ in fresh[:20]:
        scores = model.score([text])[0]
        family, language, _ = model.decide(scores)
        wins = dict.fromkeys(model.languages[family], 0)
        for (a, b), s in zip(model.pairs, scores[2:], strict=True):
            if a in wins:
                wins[a if s >= 0 else b] += 1
        assert wins[language] == max(wins.values())


def test_scores_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [invented(rng, "abcde", 30) for _ in range(30)] + [invented(rng, "uvwxy", 30) for _ in range(30)]
    model = L.fit(texts, ["de"] * 30 + ["es"] * 30)
    mixed = [*texts[:5], texts[7] * 900, "", "q"]
    assert np.array_equal(model.score(mixed), np.concatenate([model.score([t]) for t in mixed]))


def test_odd_rows(spark):
    kind = "`a.b` int, doc_id bigint, text string, lang string, Lang int, `__h` int"
    empty = spark.createDataFrame([], kind)
    assert L.identify(empty).count() == 0
    assert L.keep_identified(empty).columns == empty.columns
    rng = random.Random(3)
    rows = [(0, i, invented(rng, "abcde" if i % 2 else "uvwxy", 30), "en" if i % 2 else "es", 1, 2) for i in range(60)]
    odd = [(0, 100, None, "en", 1, 2), (0, 101, "", None, 1, 2), (0, 102, "123 !", "es", 1, 2), (0, None, invented(rng, "abcde", 30), None, 1, 2), (0, 103, "ab cd " * 300_000, None, 1, 2)]
    docs = spark.createDataFrame(rows + odd + [rows[0]], kind)
    got = L.identify(docs).collect()
    assert len(got) == 66
    assert {r["doc_id"]: r["reason"] for r in got if r["doc_id"] in (100, 101, 102)} == dict.fromkeys((100, 101, 102), "no_text")
    assert [r["predicted"] for r in got if r["doc_id"] is None] == ["en"]
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r[1]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["reason"] is None)
    unknown = spark.createDataFrame([r for r in odd if r[3] is None and r[2]], kind)
    assert {r["reason"] for r in L.identify(unknown).collect()} == {"no_model"}
