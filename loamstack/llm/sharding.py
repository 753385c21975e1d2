"""Operator 6: sharding by longest processing time.

Groups that must stay together (here exact copies of a text) go, largest first, to the least-loaded shard, through a
heap, every group on its own. Groups of one size differ by their key only, so the driver gets the number of groups of
each size and schedules a size at a time: the shards that its groups go to, in turn. While no other shard becomes as
low, the shards of a round come in the same order in the next, so a size needs at most one turn for each shard, however
many groups it has. A group's place among those of its size then gives its shard. The driver holds an entry for each
size (a corpus of n bytes has at most sqrt(2n) of them), not for each group, and documents are never shuffled with
their texts, only their keys are.

Sizes are bytes of UTF-8, one at least, so that empty documents spread too. Null texts are groups of their own by
doc_id (those with a null doc_id form one group). Ties in size go by the group's key, ties in load to the lowest shard. Repeated rows are
copies like others. Columns besides doc_id and text are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, plain

SHARDS = 64


def turns(heap: list[tuple[int, int]], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Longest processing time for ``count`` groups of one size, on a heap of (load, shard), which is brought up to date.

    (start, shards) of each turn: from its start on, groups go to its shards over and over, until the next turn starts.
    """
    if count <= len(heap):
        turn = []
        for _ in range(count):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            turn.append(shard)
        return [(0, turn)]
    out: list[tuple[int, list[int]]] = []
    start = 0
    while start < count:
        heap.sort()
        low = heap[0][0]
        n = bisect.bisect_left(heap, (low + size, -1))
        turn = [shard for _, shard in heap[:n]]
        rounds = (count - start) // n
        if n < len(heap):
            rounds = min(rounds, (heap[n][0] - low) // size)
        if not out or out[-1][1] != turn:
            out.append((start, turn))
        placed = n if rounds else count - start
        heap[:placed] = [(load + max(1, rounds) * size, shard) for load, shard in heap[:placed]]
        start += max(1, rounds) * placed
    heap.sort()
    return out


def keyed(docs: DataFrame) -> DataFrame:
    docs = plain(docs, "doc_id", "text")
    key = F.coalesce(F.md5(F.col("text")), F.concat(F.lit("null-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        key.alias("group_key"),
        F.greatest(F.lit(1), F.coalesce(F.octet_length("text"), F.lit(0))).cast("bigint").alias("n_bytes"),
    )


def plan(runs: list[tuple[int, int, int, int]], shards: int) -> pa.Table:
    """For each run of groups of one size in one partition (partition, size, first, groups): its offset among the groups of that size, and the size's turns."""
    runs = sorted(runs, key=lambda r: (-r[1], r[0]))
    heap = [(0, k) for k in range(shards)]
    columns: tuple[list, ...] = ([], [], [], [], [], [])
    at = 0
    while at < len(runs):
        size, end = runs[at][1], at
        while end < len(runs) and runs[end][1] == size:
            end += 1
        found = turns(heap, size, sum(r[3] for r in runs[at:end]))
        offset = 0
        for partition, _, first, groups in runs[at:end]:
            for column, value in zip(columns, (partition, size, first, offset, [s for s, _ in found], [t for _, t in found]), strict=True):
                column.append(value)
            offset += groups
        at = end
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())))
    names = ["part", "size", "first", "offset", "starts", "turns"]
    return pa.table([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, group_key, n_bytes, shard) of every row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = keyed(docs)
    groups = rows.groupBy("group_key").agg(F.sum("n_bytes").alias("size"))
    # In order over all partitions, so that a group's number less that of its run's first is its place in the run.
    ordered = groups.repartitionByRange(F.desc("size"), "group_key").sortWithinPartitions(F.desc("size"), "group_key")
    placed = cut(ordered.withColumns({"part": F.spark_partition_id(), "number": F.monotonically_increasing_id()}), "groups")
    runs = placed.groupBy("part", "size").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("groups")).select("part", "size", "first", "groups")
    table = plan([tuple(r) for r in runs.toLocalIterator()], shards)
    if not table.num_rows:
        return rows.withColumn("shard", F.lit(0))
    place = F.col("number") - F.col("first") + F.col("offset")
    ranked = placed.join(docs.sparkSession.createDataFrame(table), ["part", "size"]).withColumn("place", place)
    turn = F.expr("size(filter(starts, s -> s <= place)) - 1")
    own = ranked.withColumn("turn", turn).select(
        "group_key", F.expr("turns[turn][cast((place - starts[turn]) % size(turns[turn]) as int)]").alias("shard")
    )
    return rows.join(own, "group_key").select("doc_id", "group_key", "n_bytes", "shard")
