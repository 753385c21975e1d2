"""The flow against every integer flow of small cases; picks against the flow, to one document; edge cases."""

import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from loamstack.llm import mixing as M

KIND = "doc_id bigint, text string, source string, lang string"


def optimum(capacity, quota, epochs):
    """(value, cost) by trying every split of every pattern's tokens over its sources and epochs."""
    patterns = sorted(capacity)
    choices = []
    for p in patterns:
        own = [s for s in p if s in quota]
        amounts = product(*(range(quota[s] + 1) for s in own))
        choices.append([dict(zip(own, a, strict=True)) for a in amounts if sum(a) <= epochs * capacity[p]])
    best = (0, 0)
    for pick in product(*choices):
        filled = Counter()
        for c in pick:
            filled.update(c)
        if all(filled[s] <= quota[s] for s in quota):
            cost = 0
            for p, c in zip(patterns, pick, strict=True):
                total = sum(c.values())
                cost += sum(e * e * min(capacity[p], max(0, total - e * capacity[p])) for e in range(epochs))
            best = max(best, (sum(filled.values()), -cost))
    return best[0], -best[1]


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_optimum(seed):
    rng = random.Random(seed)
    patterns = rng.sample([("a",), ("b",), ("a", "b"), ("a", "c"), ("a", "b", "c")], 3)
    capacity = {p: rng.randint(1, 3) for p in patterns}
    quota = {s: rng.randint(0, 4) for s in "abcd"}
    plan = M.route(capacity, quota, 3)
    assert (sum(plan.filled.values()), plan.cost) == optimum(capacity, quota, 3)
    for s in quota:
        assert plan.filled[s] == sum(n for by in plan.flows.values() for parts in by for x, n in parts if x == s) <= quota[s]
    for p, by_epoch in plan.flows.items():
        assert all(sum(n for _, n in parts) <= capacity[p] for parts in by_epoch)


def corpus(n: int, seed: int = 1):
    rng = random.Random(seed)
    return [(i, "word " * rng.choice((1, 3, 9, 40, rng.randint(1, 200))), f"s{min(3, int(rng.expovariate(1)))}", rng.choice(("en", "de"))) for i in range(n)]


@pytest.mark.parametrize("total", [0.4, 1.0, 2.5])
def test_picks_meet_the_flow_to_one_document(spark, total):
    rows = corpus(900)
    docs = spark.createDataFrame(rows, KIND).repartition(4)
    sized = M.sized(docs, M.by_source_and_language(), M.SEED)
    plan, _ = M.plan_mix(sized, M.tempered(total=total))
    tokens = {r[0]: len(r[1].split()) for r in rows}
    pattern = {r[0]: tuple(sorted((f"source:{r[2]}", f"lang:{r[3]}"))) for r in rows}
    got = M.mixed(docs, quota_of=M.tempered(total=total)).collect()
    assert len(got) == len({(r["doc_id"], r["epoch"]) for r in got})
    by = defaultdict(int)
    for r in got:
        by[pattern[r["doc_id"]], r["epoch"], r["mix_source"]] += tokens[r["doc_id"]]
    want = {(p, e, s): n for p, epochs in plan.flows.items() for e, parts in enumerate(epochs) for s, n in parts}
    largest = max(tokens.values())
    assert all(abs(by[k] - want.get(k, 0)) <= largest for k in by.keys() | want.keys())
    # Along the seeded order, an epoch's picks of a pattern come first, and all before those of the next epoch.
    at = {r["doc_id"]: r["at"] for r in sized.collect()}
    for p in set(pattern.values()):
        for e in range(M.EPOCHS):
            own = sorted(at[r["doc_id"]] for r in got if pattern[r["doc_id"]] == p and r["epoch"] == e)
            assert own == sorted(at[d] for d in at if pattern[d] == p)[: len(own)]


def test_kept_rows_are_the_mix(spark):
    docs = spark.createDataFrame(corpus(300, 2), KIND)
    kept = Counter(r["doc_id"] for r in M.keep_mixed(docs).collect())
    assert kept == Counter(r["doc_id"] for r in M.mixed(docs).collect())


def test_ends_are_nearest_to_the_goals(spark):
    rows = [(i, ["p"], (i * 7919 % 97) << 50, 1 + i % 5) for i in range(60)] + [(99, ["p"], 3 << 50, 4)]
    sized = spark.createDataFrame(rows, "doc_id bigint, pattern array<string>, at bigint, tokens bigint")
    goals = [0, 1, 2, 3, 7, 50, 100, 101, 1000]
    end = M.ends(sized, {("p",): goals}, M.by_pattern(M.sums(sized, 1), lambda p, at: p))
    by_hash = Counter()
    for _, _, at, n in rows:
        by_hash[at] += n
    for goal in goals:
        reached = 0
        for at in sorted(by_hash):
            if reached + by_hash[at] / 2 > goal:
                break
            reached += by_hash[at]
        assert sum(n for at, n in by_hash.items() if at < end[("p",), goal]) == reached


def test_overlapping_sources_and_hot_one(spark):
    """Two sources share documents; one holds a third of all rows."""
    docs = spark.createDataFrame(corpus(600, 3), KIND)
    members = F.array(F.when(F.col("doc_id") % 3 == 0, "hot"), F.when(F.col("doc_id") % 2 == 0, "even"), F.when(F.col("doc_id") % 5 == 0, "five"))
    got = M.mixed(docs, members, lambda held: {s: min(n, 2000) for s, n in held.items()}).collect()
    assert {r["mix_source"] for r in got} == {"hot", "even", "five"}
    for r in got:
        assert r["doc_id"] % {"hot": 3, "even": 2, "five": 5}[r["mix_source"]] == 0


def test_odd_rows(spark):
    rows = [(1, "a b c", "s", "en"), (1, "a b c", "s", "en"), (None, "d e", "s", None), (2, None, "s", "en"), (3, "", "s", "en"), (4, "  ", "s", "en"), (5, "x", None, None), (6, "w " * 300_000, "t", "en")]
    got = Counter(r["doc_id"] for r in M.mixed(spark.createDataFrame(rows, KIND), quota_of=lambda held: dict(held), epochs=1).collect())
    assert got == {1: 2, None: 1, 6: 1}
    assert M.mixed(spark.createDataFrame(rows, KIND), quota_of=lambda held: dict.fromkeys(held, 0)).count() == 0


def test_empty_table_and_clashing_names(spark):
    kind = f"`a.b` int, {KIND}, Text string, pattern int, `at` int, epoch int, list int"
    empty = spark.createDataFrame([], kind)
    assert M.mixed(empty).count() == 0
    assert M.keep_mixed(empty).columns == empty.columns and M.keep_mixed(empty).count() == 0
    full = spark.createDataFrame([(7, i, "some words", "s", "en", "T", 1, 2, 3, 4) for i in range(9)], kind)
    assert M.mixed(full).count() > 0
    assert all(tuple(r)[5:] == ("T", 1, 2, 3, 4) and r[0] == 7 for r in M.keep_mixed(full).collect())
