"""Operator 4: mixing overlapping sources to target weights.

A document may belong to several mixing sources. Documents are aggregated by membership pattern; on that small table the
driver solves a min-cost flow: start -> pattern (one arc an epoch, each with the pattern's tokens as capacity and a cost
that grows with the square of the repetition, so that costs are convex) -> the pattern's sources -> end (each source's
quota). The flow of greatest value and least cost says how many tokens of a pattern serve which source in which epoch.
Documents are then picked in the order of a seeded hash, as far as the flow goes; a document is picked again for each
further epoch that reaches it.

Where in that order a flow ends is found to one document: by the tokens of ranges of the hash, first all, then those of
the range that holds the end, and so on, until it holds one hash. So the driver sees ``2 ** BITS`` sums a pattern and
then a few for each end, and no pattern's documents are ever gathered or sorted. Texts are read once for their hash and
length, which are kept in the shared folder; the rest goes by these.

Tokens are words here: runs of non-blank characters. Null members belong to no source and are never picked, nor are
documents without words (null, empty, blank texts); ids don't matter, null ones included: repeated rows share their hash
and are picked alike, ties in the hash likewise. Sources without documents, or with weight 0, get nothing; what can't be
filled stays unfilled. An empty table gives no rows. Other columns are ignored, or passed through, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, plain, word_count

#: A hash has 63 bits; each round of the search for an end splits a range by so many of them.
BITS, HASH_BITS = 9, 63
EPOCHS = 4
SEED = 17


class Flow:
    """Successive shortest paths with potentials over integer capacities."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, start: int, end: int) -> tuple[int, int]:
        """Sends the most flow at the least cost; returns both. Needs costs that aren't negative."""
        n, value, total = len(self.out), 0, 0
        height = [0] * n
        while True:
            far: list[float] = [float("inf")] * n
            far[start], via = 0, [-1] * n
            heap = [(0, start)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    new = d + self.cost[e] + height[x] - height[y]
                    if self.room[e] and new < far[y]:
                        far[y], via[y] = new, e
                        heapq.heappush(heap, (new, y))
            if via[end] < 0:
                return value, total
            for x in range(n):
                if far[x] < float("inf"):
                    height[x] += int(far[x])
            push, x = None, end
            while x != start:
                push = self.room[via[x]] if push is None else min(push, self.room[via[x]])
                x = self.to[via[x] ^ 1]
            x = end
            while x != start:
                self.room[via[x]] -= push
                self.room[via[x] ^ 1] += push
                total += push * self.cost[via[x]]
                x = self.to[via[x] ^ 1]
            value += push


@dataclass
class Plan:
    """flows: pattern -> for each epoch, (source, tokens) in source order; filled and quota by source."""

    flows: dict[tuple[str, ...], list[list[tuple[str, int]]]]
    filled: dict[str, int]
    quota: dict[str, int]
    cost: int


def route(capacity: dict[tuple[str, ...], int], quota: dict[str, int], epochs: int = EPOCHS) -> Plan:
    """The min-cost flow of pattern capacities to source quotas; repetition k costs k squared a token."""
    patterns = sorted(p for p in capacity if capacity[p] > 0 and p)
    sources = sorted(quota)
    flow = Flow(2 + len(patterns) + len(sources))
    at = {s: 2 + len(patterns) + k for k, s in enumerate(sources)}
    starts, serving = {}, {}
    for k, p in enumerate(patterns):
        starts[p] = [flow.arc(0, 2 + k, capacity[p], e * e) for e in range(epochs)]
        serving[p] = [(s, flow.arc(2 + k, at[s], epochs * capacity[p], 0)) for s in p if s in at]
    ends = {s: flow.arc(at[s], 1, max(0, quota[s]), 0) for s in sources}
    _, cost = flow.solve(0, 1)
    flows = {}
    for p in patterns:
        left = {s: flow.room[e ^ 1] for s, e in serving[p]}
        by_epoch = []
        for e in starts[p]:
            amount, parts = flow.room[e ^ 1], []
            for s, _ in serving[p]:
                take = min(amount, left[s])
                if take:
                    parts.append((s, take))
                    left[s] -= take
                    amount -= take
            by_epoch.append(parts)
        flows[p] = by_epoch
    return Plan(flows, {s: flow.room[e ^ 1] for s, e in ends.items()}, quota, cost)


def place(members: Column, seed: int) -> dict[str, Column]:
    """The pattern of a row of ``doc_id`` and ``text`` with its sources, and its place in the seeded order."""
    named = F.array_sort(F.array_distinct(F.array_compact(members)))
    return {"pattern": named, "at": F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)}


def sized(docs: DataFrame, members: Column, seed: int) -> DataFrame:
    """(doc_id, pattern, at, tokens) of the documents that can be picked; docs has plain names."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(c.alias(name) for name, c in place(members, seed).items()), word_count().alias("tokens"))
    return rows.where("tokens > 0 and size(pattern) > 0")


def sums(rows: DataFrame, level: int) -> DataFrame:
    """Tokens and distinct hashes (one, or more) of each range of ``level`` * BITS bits of the hash."""
    held = F.shiftright("at", HASH_BITS - BITS * level)
    return rows.groupBy("pattern", held.alias("range")).agg(F.sum("tokens").alias("tokens"), F.min("at").alias("low"), F.max("at").alias("high"))


def ends(rows: DataFrame, goals: dict[tuple[str, ...], list[int]], first: dict[tuple[str, ...], list[tuple]]) -> dict[tuple[tuple[str, ...], int], int]:
    """For each pattern and goal, the hash up to which (exclusive) the pattern's tokens come nearest to the goal.

    first: by pattern, the sums of its ranges at level 1, in order.
    """
    out: dict[tuple[tuple[str, ...], int], int] = {}
    held, level = {(p, None): parts for p, parts in first.items()}, 1
    searched = [(p, goal, None, goal) for p, own in goals.items() for goal in sorted(set(own))]
    while searched:
        after = []
        for p, goal, within, left in searched:
            reached, parts = 0, held[p, within]
            k = 0
            while k < len(parts) and reached + parts[k][1] <= left:
                reached += parts[k][1]
                k += 1
            if k == len(parts):
                out[p, goal] = parts[-1][3] + 1 if parts else 0
                continue
            at, tokens, low, high = parts[k]
            if low == high:
                out[p, goal] = high + 1 if reached + tokens / 2 <= left else low
            else:
                after.append((p, goal, at, left - reached))
        searched = after
        if searched:
            level += 1
            wanted = sorted({(p, at) for p, _, at, _ in searched})
            inside = rows.sparkSession.createDataFrame([(list(p), at) for p, at in wanted], "pattern array<string>, outer bigint")
            inside = F.broadcast(inside) if len(wanted) <= 100_000 else inside
            near = rows.withColumn("outer", F.shiftright("at", HASH_BITS - BITS * (level - 1))).join(inside, ["pattern", "outer"], "left_semi")
            held = by_pattern(sums(near, level), lambda p, at: (p, at >> BITS))
    return out


def by_pattern(found: DataFrame, key: Callable) -> dict:
    """The sums as lists in the order of the ranges, under a key made of pattern and range."""
    out: dict = defaultdict(list)
    for r in sorted((tuple(r[0]), *r[1:]) for r in found.collect()):
        out[key(r[0], r[1])].append(r[1:])
    return out


def plan_mix(rows: DataFrame, quota_of: Callable, epochs: int = EPOCHS) -> tuple[Plan, dict]:
    """The flow, and the sums of each pattern's ranges. quota_of makes quotas from {source: tokens it can hold}."""
    first = by_pattern(sums(rows, 1), lambda p, at: p)
    capacity = {p: sum(r[1] for r in parts) for p, parts in first.items()}
    held: dict[str, int] = defaultdict(int)
    for p, tokens in capacity.items():
        for s in p:
            held[s] += tokens
    return route(capacity, quota_of(dict(held)), epochs), first


def picks(rows: DataFrame, quota_of: Callable, epochs: int = EPOCHS) -> list[tuple[list[str], int, int, int, str]]:
    """(pattern, epoch, first hash, hash after the last, source) of all that is picked."""
    plan, first = plan_mix(rows, quota_of, epochs)
    goals: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for p, by_epoch in plan.flows.items():
        for parts in by_epoch:
            total = 0
            for _, amount in parts:
                total += amount
                goals[p].append(total)
    end = ends(rows, goals, first)
    out = []
    for p, by_epoch in plan.flows.items():
        for epoch, parts in enumerate(by_epoch):
            total = start = 0
            for source, amount in parts:
                total += amount
                if end[p, total] > start:
                    out.append((list(p), epoch, start, end[p, total], source))
                start = max(start, end[p, total])
    return out


def picked(placed: DataFrame, chosen: list[tuple]) -> DataFrame:
    """``placed`` (with pattern and at) and epoch and mix_source: a row for each time that a row is picked."""
    table = placed.sparkSession.createDataFrame(chosen, "pattern array<string>, epoch int, start bigint, after bigint, source string")
    # One row for each pattern, as small as the flow's own table; sent only while that is sure to be small.
    lists = table.groupBy("pattern").agg(F.collect_list(F.struct("epoch", "start", "after", "source")).alias("list"))
    joined = placed.join(F.broadcast(lists) if len(chosen) <= 100_000 else lists, "pattern")
    hit = F.filter("list", lambda x: (x["start"] <= F.col("at")) & (F.col("at") < x["after"]))
    return joined.withColumn("pick", F.explode(hit)).withColumns({"epoch": F.col("pick.epoch"), "mix_source": F.col("pick.source")})


def by_source_and_language() -> Column:
    """Each source and each language is a mixing source; a document belongs to one of either."""
    return F.array(*(F.concat(F.lit(f"{c}:"), F.col(c)) for c in ("source", "lang")))


def tempered(language_share: float = 0.3, power: float = 0.5, total: float = 1.0):
    """Quotas by temperature: ``total`` times the corpus's tokens, ``language_share`` of them for languages; within either, in proportion to a power of size."""

    def quota_of(held: dict[str, int]) -> dict[str, int]:
        out: dict[str, int] = {}
        for prefix, share in (("source:", 1 - language_share), ("lang:", language_share)):
            own = {s: n for s, n in sorted(held.items()) if s.startswith(prefix) and n > 0}
            weight = {s: n**power for s, n in own.items()}
            for s, w in weight.items():
                out[s] = int(total * share * sum(own.values()) * w / sum(weight.values()))
        return out

    return quota_of


NEEDED = ("doc_id", "text", "source", "lang")


def mixed(docs: DataFrame, members: Column | None = None, quota_of: Callable | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix, by default that of production: (doc_id, epoch, mix_source) for each pick. members: an array of source names."""
    rows = cut(sized(plain(docs, *NEEDED), by_source_and_language() if members is None else members, seed), "sized")
    return picked(rows, picks(rows, quota_of or tempered(), epochs)).select("doc_id", "epoch", "mix_source")


def keep_mixed(docs: DataFrame, members: Column | None = None, quota_of: Callable | None = None, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix with the columns of ``docs``; a document picked in several epochs is several rows."""
    names, docs = docs.columns, plain(docs, *NEEDED)
    members = by_source_and_language() if members is None else members
    rows = cut(sized(docs, members, seed), "sized")
    placed = docs.where(F.col("text").rlike(r"\S")).withColumns(place(members, seed))
    return picked(placed, picks(rows, quota_of or tempered(), epochs)).select(*docs.columns).toDF(*names)
