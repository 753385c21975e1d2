"""The schedule against longest processing time, one group at a time."""

import hashlib
import heapq
import random
from collections import Counter

import pytest

from loamstack.llm import sharding


def brute(sizes: dict[str, int], shards: int) -> dict[str, int]:
    heap, out = [(0, k) for k in range(shards)], {}
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + sizes[key], shard))
        out[key] = shard
    return out


@pytest.mark.parametrize("shards", [1, 2, 7, 64])
@pytest.mark.parametrize("seed", range(8))
def test_turns_are_longest_processing_time(shards, seed):
    rng = random.Random(seed)
    classes = {rng.choice((rng.randint(1, 9), rng.randint(1, 5000))): rng.choice((1, 3, 64, 65, rng.randint(1, 3000))) for _ in range(30)}
    if seed % 2:
        classes[10**6] = 1
    heap = [(0, k) for k in range(shards)]
    want = brute({f"{s:09d}-{k:09d}": s for s, n in classes.items() for k in range(n)}, shards)
    for size, n in sorted(classes.items(), reverse=True):
        found = sharding.turns(heap, size, n)
        assert len(found) <= shards + 1
        for k in range(n):
            start, turn = max((s, t) for s, t in found if s <= k)
            assert turn[(k - start) % len(turn)] == want[f"{size:09d}-{k:09d}"]
        assert heap[0] == min(heap)


@pytest.mark.parametrize("shards", [3, 64])
def test_every_group_is_scheduled_by_its_size(spark, shards):
    rng = random.Random(4)
    texts = ["x" * rng.choice((5, 6, rng.randint(1, 400))) + str(rng.randint(0, 2000)) for _ in range(3000)] + ["y" * 9000, "", "", None, None, "ä"]
    docs = spark.createDataFrame([(None if i == 3004 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    sizes: Counter = Counter()
    for i, t in enumerate(texts):
        key = hashlib.md5(t.encode()).hexdigest() if t is not None else f"null-{'' if i == 3004 else i}"
        sizes[key] += max(1, len((t or "").encode()))
    rows = sharding.assign(docs, shards).collect()
    assert len(rows) == len(texts)
    assert {r["group_key"]: r["shard"] for r in rows} == brute(sizes, shards)
    assert sharding.assign(docs.limit(0), shards).count() == 0


def test_clashing_names(spark):
    kind = "`a.b` int, doc_id bigint, text string, Text int, size int, group_key int"
    rows = sharding.assign(spark.createDataFrame([(1, 2, "x", 3, 4, 5), (1, 3, "x", 3, 4, 5), (1, 4, "y" * 3_000_000, 3, 4, 5)], kind), 2).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["shard"]) for r in rows) == [(2, 1, 1), (3, 1, 1), (4, 3_000_000, 0)]
    assert sharding.assign(spark.createDataFrame([], kind)).count() == 0
