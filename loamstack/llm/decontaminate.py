"""Operator 3: benchmark decontamination by BM25 retrieval.

The test items form an inverted index with block maxima: entries lie in blocks of ``BLOCK``, and each term keeps its
greatest impact in each block. Each training passage (128 words, one every 64, so that any 64 words in a row lie within
one) is a query. An item's score is its BM25 score under the passage, as a share of its score under its own text; all
items at or above ``threshold`` are retrieved by block-max WAND, with that threshold in place of a top-k bar. As a
passage can't hold much of a long item, one of more than ``PIECE`` words is also indexed by its pieces (64 words, one
every 32, and the last 64), each scored as a share of its own; an item is retrieved if it or any piece is, and the best
of these is its score. As the bar is fixed, the block test doesn't depend on what was found before, so it is made for
all passages of a batch at once, on arrays: a block whose maxima add up to less than the bar is skipped by all, and only
passages with a block left go through WAND's cursors, over these blocks. Nothing is lost by it. Retrieved items are
verified: the shares of the question's and of the answer's word 3-grams that the document holds must both reach
``overlap``.

Items: item_id and text, or question and answer where the table has these. Of a text, the last quarter of its words
(three at least) is the answer, the rest the question; with under six words, the whole is both. Words are runs of
non-blank characters, in lower case, without non-alphanumeric characters at either end; empty ones are dropped.

The driver reads the items' words (a benchmark is of a size that one machine can hold) and builds the index of
``shard_items`` entries (items and their pieces) at a time; each is broadcast, so a broadcast has a fixed bound (one
item's entries stay together), and more shards make more passes over the documents. BM25 statistics cover all items.
Null or empty texts and items without words match nothing. Each distinct text under an item_id, null ids included, is an
item of its own and is searched for; the result has one row for a doc_id and item_id (null for items without one), that
of the best score. Rows with a null doc_id are not reported, but ``keep_clean`` judges them too. Repeated rows of
documents give one row of the result. An empty table gives no rows, an empty benchmark finds nothing. Other columns are
ignored, or passed through, whatever their names.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, keep_rows, map_rows, plain

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.5, 0.5
PASSAGE, STRIDE = 128, 64
BLOCK = 4
PIECE, PIECE_STRIDE = 64, 32
SCHEMA = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
EMPTY, UNKNOWN = -2, -1


def clean_word(word: str) -> str:
    word = word.lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end]


def words(text: str | None) -> list[str]:
    return [w for w in map(clean_word, (text or "").split()) if w]


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    all_words = words(text)
    if len(all_words) < 6:
        return all_words, all_words
    k = max(3, len(all_words) // 4)
    return all_words[:-k], all_words[-k:]


def entries(whole: list[str]) -> list[list[str]]:
    """What an item is indexed by: all its words, and its pieces if it is long. Any PIECE words in a row lie within one passage."""
    if len(whole) <= PIECE:
        return [whole]
    last = len(whole) - PIECE
    return [whole, *(whole[at : at + PIECE] for at in (*range(0, last, PIECE_STRIDE), last))]


@dataclass
class Index:
    """Postings of normalised BM25 impacts of entries, with block maxima, the item of each entry, and what verification needs.

    postings: by term, the entries that hold it, its impact in each, and its greatest impact by block. The block maxima
    of term t also lie in maxima[starts[t] : starts[t + 1]], their blocks in blocks.
    """

    ids: list[int | None]
    vocabulary: dict[str, int]
    owner: list[int]
    postings: list[tuple[list[int], list[float], dict[int, float]]]
    tops: list[float] = field(default_factory=list)
    parts: list[list[tuple[int, np.ndarray]]] = field(default_factory=list)
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    blocks: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    maxima: np.ndarray = field(default_factory=lambda: np.empty(0))

    @property
    def n_blocks(self) -> int:
        return -(-len(self.owner) // BLOCK)


def codes(ids: np.ndarray, size: int, n: int) -> np.ndarray:
    """The distinct n-grams of word ids as numbers; those with an unknown word are left out."""
    if n == 0 or len(ids) < n:
        return np.empty(0, np.int64)
    out = np.zeros(len(ids) - n + 1, np.int64)
    good = np.ones(len(out), bool)
    for j in range(n):
        part = ids[j : len(ids) - n + 1 + j]
        out = out * size + part
        good &= part >= 0
    return np.unique(out[good])


def build(items: list[tuple[int | None, list[str], list[str]]], frequency: dict[str, int], n_items: int, mean_length: float) -> Index:
    """items: (item_id, question words, answer words); frequency: items that hold each word, over all shards."""
    vocabulary: dict[str, int] = {}
    index = Index([], vocabulary, [], [])
    parts = []
    for item_id, question, answer in items:
        whole = question if question == answer else question + answer
        index.ids.append(item_id)
        for entry in entries(whole):
            counts: dict[str, int] = {}
            for w in entry:
                counts[w] = counts.get(w, 0) + 1
            weights = {}
            for w, tf in counts.items():
                idf = math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(entry) / mean_length))
            total = sum(weights.values())
            at = len(index.owner)
            index.owner.append(len(index.ids) - 1)
            for w, weight in weights.items():
                t = vocabulary.setdefault(w, len(vocabulary))
                if t == len(index.postings):
                    index.postings.append(([], [], {}))
                held, impacts, maxima = index.postings[t]
                held.append(at)
                impacts.append(weight / total)
                maxima[at // BLOCK] = max(maxima.get(at // BLOCK, 0.0), weight / total)
        parts.append([np.array([vocabulary[w] for w in side], np.int64) for side in (question, answer)])
    index.tops = [max(impacts) for _, impacts, _ in index.postings]
    index.parts = [[(n := min(3, len(ids)), codes(ids, len(vocabulary), n)) for ids in pair] for pair in parts]
    index.starts = np.cumsum([0] + [len(maxima) for _, _, maxima in index.postings])
    index.blocks = np.array([b for _, _, maxima in index.postings for b in maxima], np.int64)
    index.maxima = np.array([x for _, _, maxima in index.postings for x in maxima.values()], float)
    return index


def wand(index: Index, terms: list[int], threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
    """Every entry in [low, high) whose score under these distinct terms reaches the threshold: block-max WAND with a fixed bar."""
    bar = threshold - 1e-9
    high = len(index.owner) if high is None else high
    # A cursor is [entry, place in the list, term].
    cursors = []
    for t in terms:
        held = index.postings[t][0]
        at = bisect.bisect_left(held, low) if low else 0
        if at < len(held) and held[at] < high:
            cursors.append([held[at], at, t])
    found = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, -1
        for k, (_, _, t) in enumerate(cursors):
            bound += index.tops[t]
            if bound >= bar:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        block = item // BLOCK
        if sum(index.postings[t][2].get(block, 0.0) for _, _, t in cursors[: pivot + 1]) >= bar:
            score = 0.0
            for entry, at, t in cursors[: pivot + 1]:
                held, impacts, _ = index.postings[t]
                if entry < item:
                    at = bisect.bisect_left(held, item, at)
                if at < len(held) and held[at] == item:
                    score += impacts[at]
            if score >= bar:
                found.append((item, score))
            skip = item + 1
        else:
            # No entry of this block can reach the bar by these lists, nor any before the next list's entry.
            skip = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                skip = min(skip, cursors[pivot + 1][0])
            skip = max(skip, item + 1)
        for cursor in cursors[: pivot + 1]:
            held = index.postings[cursor[2]][0]
            cursor[1] = bisect.bisect_left(held, skip, cursor[1])
            cursor[0] = held[cursor[1]] if cursor[1] < len(held) else high
        cursors = [c for c in cursors if c[0] < high]
    return found


class Matcher:
    """Finds the contaminating items of texts, with one index."""

    def __init__(self, index: Index, threshold: float, overlap: float):
        self.index, self.threshold, self.overlap = index, threshold, overlap

        def lookup(word: str) -> int:
            w = clean_word(word)
            return index.vocabulary.get(w, UNKNOWN) if w else EMPTY

        self.memo = Memo(lookup)

    def word_ids(self, text: str | None) -> np.ndarray:
        """The vocabulary's number of each word of a text that isn't empty, UNKNOWN for those that it lacks."""
        raw = (text or "").lower().split()
        ids = np.fromiter(map(self.index.vocabulary.get, raw, repeat(UNKNOWN)), np.int64, len(raw))
        for i in np.flatnonzero(ids == UNKNOWN).tolist():
            w = raw[i]
            if not (w[-1].isalnum() and w[0].isalnum()):
                ids[i] = self.memo[w]
        return ids[ids != EMPTY]

    def __call__(self, text: str | None) -> list[tuple[int | None, float, float, float]]:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[list[tuple[int | None, float, float, float]]]:
        """For each text (item_id, score, question overlap, answer overlap), each item once, with its best passage's score."""
        out: list[list] = [[] for _ in texts]
        if not self.index.ids:
            return out
        ids = [self.word_ids(text) for text in texts]
        best: list[dict[int, float]] = [{} for _ in texts]
        for doc, terms, blocks in self._passages(ids):
            for block in blocks:
                for entry, score in wand(self.index, terms, self.threshold, block * BLOCK, (block + 1) * BLOCK):
                    item = self.index.owner[entry]
                    best[doc][item] = max(best[doc].get(item, 0.0), score)
        for doc, scores in enumerate(best):
            if scores:
                out[doc] = self._verified(ids[doc], scores)
        return out

    def _passages(self, ids: list[np.ndarray]) -> Iterator[tuple[int, list[int], list[int]]]:
        """(text, distinct known terms, blocks whose maxima reach the bar) of each passage that has such blocks."""
        lengths = np.array([len(x) for x in ids], np.int64)
        counts = np.where(lengths > PASSAGE, -(-(lengths - PASSAGE) // STRIDE) + 1, 1)
        first = np.concatenate([[0], np.cumsum(counts)])
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(ids)), lengths)
        step = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // STRIDE
        known = np.flatnonzero(flat >= 0)
        flat, doc, step = flat[known], doc[known], step[known]
        # A word lies in the passage that starts in its own stride and in the one before; both lists are in passage order.
        sides = []
        for back in (0, 1):
            good = (step >= back) & (step - back < counts[doc])
            sides.append(((first[doc] + step - back)[good], flat[good]))
        at_once = max(1, (1 << 18) // max(1, self.index.n_blocks, PASSAGE))
        for low in range(0, int(first[-1]), at_once):
            cut = [(p[a:b], t[a:b]) for p, t in sides for a, b in [np.searchsorted(p, (low, low + at_once))]]
            passage, term = np.concatenate([c[0] for c in cut]) - low, np.concatenate([c[1] for c in cut])
            size = len(self.index.vocabulary)
            pairs = np.sort(passage * size + term)
            if not len(pairs):
                continue
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
            passage, term = pairs // size, pairs % size
            open_blocks = self.bounds(passage, term, at_once) >= self.threshold - 1e-9
            for hit in np.flatnonzero(open_blocks.any(axis=1)).tolist():
                a, b = np.searchsorted(passage, (hit, hit + 1))
                doc_at = int(np.searchsorted(first, hit + low, side="right")) - 1
                yield doc_at, term[a:b].tolist(), np.flatnonzero(open_blocks[hit]).tolist()

    def bounds(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """n passages x blocks: the sums of the block maxima of each passage's terms."""
        index = self.index
        many = (index.starts[1:] - index.starts[:-1])[term]
        where = np.arange(many.sum()) + np.repeat(index.starts[term] - (np.cumsum(many) - many), many)
        keys = np.repeat(passage, many) * index.n_blocks + index.blocks[where]
        return np.bincount(keys, index.maxima[where], n * index.n_blocks).reshape(n, -1)

    def _verified(self, ids: np.ndarray, scores: dict[int, float]) -> list[tuple[int | None, float, float, float]]:
        grams: dict[int, np.ndarray] = {}
        out = []
        for item, score in sorted(scores.items()):
            shares = [self._share(ids, grams, *part) for part in self.index.parts[item]]
            if min(shares) >= self.overlap:
                out.append((self.index.ids[item], round(score, 6), round(shares[0], 6), round(shares[1], 6)))
        return out

    def _share(self, ids: np.ndarray, grams: dict[int, np.ndarray], n: int, part: np.ndarray) -> float:
        """The share of an item's n-grams in the text; a side without words counts as held."""
        if n not in grams:
            grams[n] = codes(ids, len(self.index.vocabulary), n)
        return float(np.isin(part, grams[n]).mean()) if len(part) else 1.0


def load_items(benchmark: DataFrame) -> list[tuple[int | None, list[str], list[str]]]:
    """Each distinct item; several may share an id, or have none."""
    sides = ["question", "answer"] if {"question", "answer"} <= set(benchmark.columns) else ["text"]
    rows = plain(benchmark, "item_id", *sides).select("item_id", *(F.coalesce(c, F.lit("")).alias(c) for c in sides)).distinct()
    read = [(r[0], *((words(r[1]), words(r[2])) if len(sides) == 2 else question_answer(r[1]))) for r in rows.toLocalIterator()]
    return list({(i, tuple(q), tuple(a)): (i, q, a) for i, q, a in read if q or a}.values())


def indexes(benchmark: DataFrame, shard_items: int = 20_000) -> Iterator[Index]:
    """The items as indexes of at most ``shard_items`` entries each (more only if one item has more), under statistics of all."""
    items = sorted(load_items(benchmark), key=lambda i: (i[0] is None, i[0] or 0, i[1], i[2]))
    frequency: dict[str, int] = {}
    length = 0
    for _, question, answer in items:
        whole = question if question == answer else question + answer
        length += len(whole)
        for w in set(whole):
            frequency[w] = frequency.get(w, 0) + 1
    shard: list = []
    room = shard_items
    for item in items:
        n = len(entries(item[1] if item[1] == item[2] else item[1] + item[2]))
        if shard and n > room:
            yield build(shard, frequency, len(items), length / len(items))
            shard, room = [], shard_items
        shard.append(item)
        room -= n
    if shard:
        yield build(shard, frequency, len(items), length / len(items))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int = 20_000) -> DataFrame:
    """Documents with the test items that they hold."""
    named = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for index in indexes(benchmark, shard_items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def make(sent=sent):
            find = Matcher(sent.value, threshold, overlap)
            return lambda ids, texts: ((i, *m) for i, found in zip(ids, find.batch(texts), strict=True) for m in found)

        out = out.unionByName(map_rows(named, ["doc_id", "text"], make, SCHEMA))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_items: int = 20_000) -> DataFrame:
    """The documents that hold no test item, with all their columns; no shuffle."""
    for index in indexes(benchmark, shard_items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def make(sent=sent):
            find = Matcher(sent.value, threshold, overlap)
            return lambda texts: [not found for found in find.batch(texts)]

        docs = keep_rows(docs, ["text"], make)
    return docs
