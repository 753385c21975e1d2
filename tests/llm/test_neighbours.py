"""Trees and the whole search against brute force; recall and share scanned; edge cases."""

import numpy as np
import pytest

from loamstack.llm import neighbours as N

KIND = "vec_id bigint, embedding array<float>"


def clustered(n: int, width: int = 16, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(40, width))[rng.integers(0, 40, n)] * 2 + rng.normal(size=(n, width))).astype(np.float32).astype(float)


def brute(x: np.ndarray, ids: list[int], k: int, every: int) -> dict[int, list[int]]:
    out = {}
    for i, own in enumerate(ids):
        if own % every == 0:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1)).round(9)
            out[own] = [j for _, j in sorted((d[r], j) for r, j in enumerate(ids) if j != own)][:k]
    return out


def frame(spark, x, ids):
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], KIND).repartition(3)


def collected(df) -> dict[int, list[int]]:
    out: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r["vec_id"], r["rank"])):
        out.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    return out


@pytest.mark.parametrize("shard_rows,query_rows", [(10_000, 10_000), (150, 10)])
def test_factor_one_is_exact(spark, shard_rows, query_rows):
    x = clustered(1200)
    x[5:9] = x[4]
    ids = [3 * i - 300 for i in range(len(x))]
    got = N.neighbours(frame(spark, x, ids), factor=1, every=6, shard_rows=shard_rows, query_rows=query_rows)
    assert collected(got) == brute(x, ids, N.K, 6)


def test_tree_prunes_and_reaches_its_recall(capsys):
    """On rows that the factor wasn't fitted on, too."""
    x = clustered(30_000)
    factor = N.fit_factor(x[:8000], N.K, N.RECALL)
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 50)
    tree = N.Tree(x)
    shares, recalls = [], []
    far = N.distances(x[asked], x)
    far[np.arange(len(asked)), asked] = np.inf
    limit = np.partition(far, N.K - 1, axis=1)[:, N.K - 1]
    for f in (1, factor):
        found, _ = tree.search(x[asked], N.K, f, ids, asked, np.full(len(asked), np.inf))
        shares.append(tree.scanned / len(asked) / len(x))
        recalls.append((found <= limit[:, None] + 1e-9).mean())
    with capsys.disabled():
        print(f"\nfactor 1 and {factor}: share scanned {shares[0]:.3f}, {shares[1]:.3f}; recall {recalls[0]:.3f}, {recalls[1]:.3f}")
    assert recalls[0] == 1 and recalls[1] >= 0.9
    assert factor > 1 and shares[1] < shares[0] < 0.9


def test_recall_of_the_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r[0], r[1]) for r in table.select("vec_id", "embedding").collect())
    want = brute(np.array([r[1] for r in rows]), [r[0] for r in rows], N.K, N.EVERY)
    got = collected(N.neighbours(table, shard_rows=500))
    assert got.keys() == want.keys()
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [0.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, [nan, 0.0]), (5, [None, 0.0]), (6, [1.0]), (7, []), (-50, [3.0, 3.0])]
    got = collected(N.neighbours(spark.createDataFrame(rows, KIND)))
    assert got == {0: [1, 2, -50], -50: [1, 2, 0]}
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(700)], KIND)
    assert collected(N.neighbours(equal, shard_rows=100))[50] == list(range(10))


def test_empty_table_and_clashing_names(spark):
    kind = "`a.b` int, vec_id bigint, embedding array<float>, Embedding int, cell int, vector string, bound int"
    assert N.neighbours(spark.createDataFrame([], kind)).count() == 0
    got = N.neighbours(spark.createDataFrame([(1, i, [float(i)], 2, 3, "x", None) for i in (0, 50, 60)], kind))
    assert collected(got) == {0: [50, 60], 50: [60, 0]}
