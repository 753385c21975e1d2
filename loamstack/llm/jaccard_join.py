"""Operator 9: join of documents by the Jaccard similarity of their word n-gram sets.

MinHash banding with bands and rows chosen for a target recall, a shuffle on band hashes, and verification on full
n-gram sets. No bucket is capped, and no list of pairs is ever shuffled:

1. Documents with the same n-gram set become one node.
2. In each band bucket the lowest node leads. A node's home is the lowest of its leaders, so that a large family of
   near copies shares one home: a home compares all its members.
3. Where a bucket holds nodes of several homes, each node is also a guest at the lower homes of that bucket, and is
   compared with their members there. So every two nodes of a bucket meet exactly once: at home, or at the lower home.
4. Homes are cut into blocks of bounded n-gram count, and each pair of blocks is one unit of work, so that no task
   holds more than two blocks. A unit gives each node's number of links, and of the links themselves only a spanning
   forest, as many as it has nodes at most; the sums of the one are exact and the other joins the same classes.

``linked`` has a row for each document that has a link: (doc_id, class_id, n_links, n_copies). n_links counts the other
n-gram sets at or above the threshold, n_copies the other documents with the same set, class_id is the lowest doc_id
that can be reached over links and copies. Documents without either have no row.

Words are runs of non-blank characters, in lower case. A text of fewer words than n is one n-gram of all its words; a
text without words (null, empty, blank) has no n-grams and joins nothing. Rows with a null id are left out, repeated
rows of one id count once. Each distinct set is compared under a key of its own (in the order of its lowest id, then of
its hash), so different texts under one id are all compared, and such an id has a row for each set of it that is linked.
Columns besides doc_id and text are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, cut, map_rows, maybe_in, nullable, pieces, plain, release, to_arrow

N, THRESHOLD, RECALL = 3, 0.5, 0.98
#: Either a node and its links in one unit, or (links null) an edge of the spanning forest.
LINKS = "node bigint, other bigint, links bigint"


def bands_and_rows(threshold: float, recall: float, most_bands: int = 32) -> tuple[int, int]:
    """The most rows a band for which some number of bands, at most ``most_bands``, finds a pair at the threshold with the wanted probability."""
    best = (1, max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(threshold, 0.999999)))))
    for rows in range(2, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - min(threshold, 0.999999) ** rows))
        if bands <= most_bands:
            best = (rows, bands)
    return best[1], best[0]


_MIX1, _MIX2, _SHIFT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(29)


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")


class Shingler:
    """Sorted 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int = N):
        self.n, self.words = n, Memo(_word_hash)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        grams = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            grams ^= grams >> _SHIFT
            grams *= _MIX1
            grams += h[j : len(h) - n + 1 + j]
        grams ^= grams >> _SHIFT
        grams *= _MIX2
        grams += np.uint64(n)
        return np.unique(grams)


class Signer:
    """MinHash of a set, folded to one hash a band."""

    def __init__(self, bands: int, rows: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.xor = rng.integers(0, 1 << 32, k, dtype=np.uint32)[:, None]
        self.mul = (rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1))[:, None]

    def __call__(self, grams: np.ndarray) -> list[int]:
        low = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.xor), 0xFFFFFFFF, np.uint32)
        for start in range(0, len(low), 2048):
            x = low[None, start : start + 2048] ^ self.xor
            x *= self.mul
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(least, x.min(axis=1), out=least)
        folded = np.zeros(self.bands, np.uint64)
        for row in least.reshape(self.bands, self.rows).T:
            folded ^= row
            folded *= _MIX1
            folded ^= folded >> _SHIFT
        return folded.view(np.int64).tolist()


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, set_key, n_grams, bands) of each document that has n-grams."""

    def make():
        shingle, sign = Shingler(n), Signer(bands, rows)

        def work(ids, texts):
            for i, text in zip(ids, texts, strict=True):
                grams = shingle(text)
                if len(grams):
                    yield i, hashlib.blake2b(grams.tobytes(), digest_size=12).digest(), len(grams), sign(grams)

        return work

    named = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    return map_rows(named, ["doc_id", "text"], make, "doc_id bigint, set_key binary, n_grams int, bands array<bigint>")


BLOCK_GRAMS = 1 << 20


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Each document's class and links, in the form that the module describes."""
    signed, sets, links = set_links(docs, n, threshold, recall)
    degree = links.where("links is not null").groupBy("node").agg(F.sum("links").alias("n_links"))
    label = components(links).withColumnsRenamed({"doc_id": "node", "group_id": "lead"})
    lead = label.join(sets.select(F.col("node").alias("lead"), F.col("rep").alias("class_id")), "lead").select("node", "class_id")
    found = (
        sets.select("node", "set_key", "rep", "rows")
        .join(degree, "node", "left")
        .join(lead, "node", "left")
        .where("rows > 1 or n_links > 0")
        .select("set_key", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("rows") - 1).alias("n_copies"))
    )
    return signed.select("doc_id", "set_key").distinct().join(found, "set_key").select("doc_id", "class_id", "n_links", "n_copies")


def set_links(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, set_key) of the rows; (node, set_key, rep, rows) of the distinct sets, rows counting documents; and LINKS."""
    bands, rows = bands_and_rows(threshold, recall)
    signed = cut(signatures(docs, n, bands, rows), "signatures")
    # Nodes are in the order of (rep, set_key), so what leads a bucket doesn't depend on the partitions.
    once = signed.groupBy("set_key", "doc_id").agg(F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    sets = once.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first(F.struct("n_grams", "bands")).alias("sign"), F.count(F.lit(1)).alias("rows"))
    sets = cut(sets.repartitionByRange("rep", "set_key").sortWithinPartitions("rep", "set_key").withColumn("node", F.monotonically_increasing_id()), "sets")

    # A bucket's lead and size come from an aggregate and a join, not from a window, so that a hot bucket is split.
    seen = sets.select("node", F.posexplode("sign.bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket"))
    leads = seen.groupBy("bucket").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket", "lead")
    crowded = cut(seen.join(leads, "bucket"), "buckets")
    homes = crowded.groupBy("node").agg(F.min("lead").alias("home"))
    homes = cut(homes.join(sets.select("node", "sign.n_grams"), "node"), "homes")
    settled = crowded.select("bucket", "node").join(homes.select("node", "home"), "node")
    mixed = settled.groupBy("bucket").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo < hi").select("bucket")
    settled = cut(settled.join(mixed, "bucket"), "mixed")
    hosts = settled.select("bucket", F.col("home").alias("host")).distinct()
    guests = settled.join(hosts, "bucket").where("host < home").select(F.col("host").alias("home"), "node").distinct()

    seats = homes.select("home", "node", "n_grams", F.lit(True).alias("own")).unionByName(
        guests.join(homes.select("node", "n_grams"), "node").select("home", "node", "n_grams", F.lit(False).alias("own"))
    )
    seats = cut(seats, "seats")
    sizes = seats.groupBy("home").agg(F.ceil(F.sum("n_grams") / F.lit(BLOCK_GRAMS)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("seats")).where("seats > 1")
    placed = seats.join(sizes.select("home", "blocks"), "home").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A unit is a pair of blocks; each seat goes to the units of its own block.
    units = placed.select(
        "home", "node", "own", "block",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))).alias("unit"),
    ).select("home", "unit.x", "unit.y", "node", "own", "block")
    key_of = cut(placed.select("node").distinct().join(sets.select("node", "rep", "set_key"), "node"), "keys")
    named = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    likely = gram_sets(maybe_in(named, key_of.select("rep")).where("__maybe"), n)
    grams = likely.join(key_of, (F.col("doc_id") == F.col("rep")) & (F.col("key") == F.col("set_key"))).select("node", "grams").dropDuplicates(["node"])
    seated = units.join(grams, "node").select("home", "x", "y", "node", "own", "block", "grams")
    links = seated.groupBy("home", "x", "y").applyInArrow(_verifier(threshold), T.StructType.fromDDL(LINKS))
    return signed, sets, cut(links, "links")


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, grams) of each row: the key of its n-gram set, and the sorted hashes."""

    def make():
        shingle = Shingler(n)

        def work(ids, texts):
            for i, text in zip(ids, texts, strict=True):
                data = shingle(text).tobytes()
                yield i, hashlib.blake2b(data, digest_size=12).digest(), data

        return work

    return map_rows(docs, ["doc_id", "text"], make, "doc_id bigint, key binary, grams binary")


def _verifier(threshold: float):
    kind = to_arrow(T.StructType.fromDDL(LINKS))

    def verify(seats: pa.Table) -> pa.Table:
        node = np.array(seats["node"].to_pylist(), np.int64)
        order = np.argsort(node)
        sets = seats["grams"].to_pylist()
        degree, edges = compare(
            [np.frombuffer(sets[i], np.uint64) for i in order],
            np.array(seats["own"].to_pylist(), bool)[order],
            np.array(seats["block"].to_pylist())[order],
            threshold,
        )
        node = node[order]
        if seats.nbytes > 4 << 20:
            del sets
            release()
        some = np.flatnonzero(degree)
        a, b = (node[np.array([e[k] for e in edges], np.int64)] for k in (0, 1))
        columns = (
            pa.array(np.concatenate([node[some], a])),
            pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b)]),
            pa.concat_arrays([pa.array(degree[some]), pa.nulls(len(b), pa.int64())]),
        )
        return pa.table(list(columns), schema=kind)

    return verify


def compare(sets: list[np.ndarray], own: np.ndarray, block: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each set in one unit, and a spanning forest of them. Compared are members with each other and with guests, across the unit's two blocks, or within its one."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    # Postings: the sets that hold each gram, in order.
    holder = np.repeat(np.arange(m), size)[np.argsort(flat, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(vocabulary)))])
    across = block.min() != block.max()
    degree, label = np.zeros(m, np.int64), np.arange(m)
    edges: list[tuple[int, int]] = []
    mark = np.zeros(len(vocabulary), bool)
    for i in range(m - 1):
        partner = np.arange(m) > i
        partner &= own | own[i]
        if across:
            partner &= block != block[i]
        partner &= np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i])
        if not partner.any():
            continue
        mine = flat[start[i] : start[i] + size[i]]
        low, many = first[mine], first[mine + 1] - first[mine]
        if 4 * many.sum() < len(flat):
            where = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
            both = np.bincount(holder[where], minlength=m)
        else:
            mark[mine] = True
            both = np.add.reduceat(mark[flat].astype(np.int32), start)
            mark[mine] = False
        good = np.flatnonzero(partner & (both >= threshold * (size + size[i] - both)))
        if not len(good):
            continue
        degree[i] += len(good)
        degree[good] += 1
        for other, at in zip(*np.unique(label[good], return_index=True), strict=True):
            if other != label[i]:
                edges.append((i, int(good[at])))
                label[label == other] = label[i]
    return degree, edges


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(doc_id, group_id) of every node in an edge of LINKS: the lowest that it is linked to, over any number of edges.

    Hash-to-min with each round cut into the shared folder, until nothing changes.
    """
    edges = links.where("links is null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    both = cut(edges.union(edges.select("b", "a")).distinct(), name)
    label = cut(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("group_id")), name)
    while True:
        spread = both.join(label.withColumnRenamed("doc_id", "b"), "b").select(F.col("a").alias("doc_id"), "group_id")
        jump = label.join(label.select(F.col("doc_id").alias("group_id"), F.col("group_id").alias("higher")), "group_id").select("doc_id", F.col("higher").alias("group_id"))
        new = cut(spread.union(jump).union(label).groupBy("doc_id").agg(F.min("group_id").alias("group_id")), name)
        changed = new.join(label, ["doc_id", "group_id"], "left_anti").limit(1).count()
        label = new
        if not changed:
            return label


def with_keys(docs: DataFrame, n: int) -> DataFrame:
    """All columns, and ``__key``: the key of a row's n-gram set, null without n-grams."""
    at = docs.columns.index("text")
    fields = T.StructType([*nullable(docs.schema).fields, T.StructField("__key", T.BinaryType())])
    kind = to_arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            for part in pieces(batch):
                sets = [shingle(text) for text in part.column(at).to_pylist()]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=12).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, kind, strict=False)] + [pa.array(keys, pa.binary())], schema=kind)

    return docs.mapInArrow(run, fields)


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Documents without their near copies, with all their columns: of each linked group of texts, a row with the lowest text stays
    (that of the lowest doc_id; of several under it, that of the least set hash).

    Rows are judged by their own text, so other texts under the id of a copy stay. Of rows that repeat a doc_id and its n-gram set
    one with the least text stays. Rows with a null id or without n-grams are no copies and stay.
    Only rows that may be copies are shuffled with their texts, and no more than one of equal rows of an id goes to one task.
    """
    names, docs = docs.columns, plain(docs, "doc_id", "text")
    signed, sets, links = set_links(docs, n, threshold, recall)
    lost = components(links).where("doc_id <> group_id").select(F.col("doc_id").alias("node"), F.lit(True).alias("lost"))
    judged = sets.join(lost, "node", "left").where("lost or rows > 1").select("set_key", "rep", F.coalesce("lost", F.lit(False)).alias("lost"))
    gone = signed.select("doc_id", "set_key").join(judged, "set_key").where("lost or doc_id <> rep")
    losers = cut(gone.select(F.col("doc_id").alias("__loser"), F.col("set_key").alias("__lost")).distinct(), "losers")
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("__twice")).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select("__twice")
    twice = cut(twice, "twice")
    doc = F.col("doc_id").cast("bigint")
    flagged = maybe_in(docs, losers.select("__loser").union(twice))
    doubtful = flagged.where("__maybe").drop("__maybe")
    # An id of one row goes by its id alone; where an id has several rows, each goes by its own text.
    single = doubtful.join(twice, doc == F.col("__twice"), "left_anti").join(losers, doc == F.col("__loser"), "left_anti")
    several = with_keys(doubtful.join(twice, doc == F.col("__twice"), "left_semi"), n)
    left = several.join(losers, (doc == F.col("__loser")) & (F.col("__key") == F.col("__lost")), "left_anti")
    row = F.struct(*docs.columns)
    kept = left.where("__key is not null").groupBy("doc_id", "__key").agg(F.min_by(row, F.struct("text")).alias("__row")).select("__row.*")
    bare = left.where("__key is null").select(*docs.columns)
    return flagged.where("not __maybe").drop("__maybe").unionByName(single).unionByName(kept).unionByName(bare).toDF(*names)
