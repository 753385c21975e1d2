"""Operator 1: edit-aware token counts.

Each document has a segment tree over its pre-token runs; inner nodes hold sums of characters and tokens. An edit
re-encodes only the runs that it touches and one run of context at either side, then updates the sums above them. Trees
are kept as a table (``trees``: text and the tokens of each run, from which sums are made without encoding), so that
later edits (``edit_trees``) encode nothing but what they touch.

Null and empty texts have 0 tokens. Null edits are no edits. Repeated rows are counted one by one, rows with a null
doc_id too; columns besides doc_id and text are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, plain
from .tokens import VOCABULARY, RunEncoder, runs

#: Redactions applied to a text before it is tokenized: e-mail addresses, IPv4 addresses, card numbers, 40-digit hex keys.
REDACTIONS = re.compile(
    r"(?P<EMAIL>(?<![\w.+-])[\w+-][\w.+-]{0,63}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8})"
    r"|(?P<IP>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]))"
    r"|(?P<CARD>(?<!\d)\d{16}(?!\d))"
    r"|(?P<KEY>(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f]))",
    re.ASCII,
)


class CountTree:
    """The runs of one text under a segment tree of (characters, tokens) sums."""

    def __init__(self, text: str, encoder: RunEncoder, counts: list[int] | None = None):
        """counts: the tokens of each run, as ``leaves`` gives them; else the runs are encoded."""
        self.encoder = encoder
        self.encoded = 0
        self._build(runs(text), counts)

    def _build(self, parts: list[str], counts: list[int] | None = None) -> None:
        self.slots = [[p] for p in parts if p] or [[]]
        size = 1
        while size < len(self.slots):
            size *= 2
        self.size = size
        self.chars = [0] * (2 * size)
        self.tokens = [0] * (2 * size)
        for i, slot in enumerate(self.slots):
            if counts:
                self.chars[size + i], self.tokens[size + i] = sum(map(len, slot)), counts[i]
            else:
                self._measure(i, slot)
        for node in range(size - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _measure(self, i: int, slot: list[str]) -> None:
        self.chars[self.size + i] = sum(map(len, slot))
        self.tokens[self.size + i] = sum(map(self.encoder.count_run, slot))

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(p for slot in self.slots for p in slot)

    @property
    def leaves(self) -> list[int]:
        """The tokens of each run of the text."""
        return [self.encoder.count_run(p) if len(slot) > 1 else self.tokens[self.size + i] for i, slot in enumerate(self.slots) for p in slot]

    def _find(self, at: int) -> tuple[int, int]:
        """The slot that holds a character, and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces characters [start, end), clipped to the text."""
        n = self.n_chars
        start = max(0, min(start, n))
        end = max(start, min(end, n))
        if n == 0:
            self._build(runs(replacement))
            self.encoded += len(replacement)
            return
        first, begin = self._find(min(start, n - 1))
        last, _ = self._find(max(start, min(end, n - 1)) if start < n else n - 1)
        low = first - 1
        while low > 0 and not self.chars[self.size + low]:
            low -= 1
        if low >= 0:
            begin -= sum(self.chars[self.size + i] for i in range(low, first))
        low = max(low, 0)
        high = last + 1
        while high < len(self.slots) - 1 and not self.chars[self.size + high]:
            high += 1
        high = min(high, len(self.slots) - 1)
        region = "".join(p for slot in self.slots[low : high + 1] for p in slot)
        region = region[: start - begin] + replacement + region[end - begin :]
        fresh = [p for p in runs(region) if p]
        self.encoded += len(region)
        for i in range(low, high + 1):
            self.slots[i] = []
        spread = high - low + 1
        for i, p in enumerate(fresh):
            self.slots[low + min(i, spread - 1)].append(p)
        changed = set()
        for i in range(low, high + 1):
            self._measure(i, self.slots[i])
            changed.add((self.size + i) // 2)
        while changed and 0 not in changed:
            for node in changed:
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            changed = {node // 2 for node in changed}
        if len(self.slots[high]) > 256:
            self._build([p for slot in self.slots for p in slot])


def apply_edits(tree: CountTree, edits: Iterable[tuple[int, int, str]]) -> int:
    """Applies edits given in offsets of the original text, last first; overlapping ones: the later start wins. Returns how many."""
    done, bound = 0, tree.n_chars
    for start, end, replacement in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        if end <= bound:
            tree.edit(start, end, replacement)
            bound, done = start, done + 1
    return done


def redactions(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in REDACTIONS.finditer(text)]


SCHEMA = "doc_id bigint, n_tokens bigint, n_edits int, n_tokens_after bigint, n_chars_encoded bigint"


def _row(encoder: RunEncoder, doc_id, text, edits) -> tuple:
    text = text or ""
    if not edits:
        n = encoder.count(text)
        return doc_id, n, 0, n, 0
    tree = CountTree(text, encoder)
    before = tree.n_tokens
    done = apply_edits(tree, edits)
    return doc_id, before, done, tree.n_tokens, tree.encoded


def count_with_redactions(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each document before and after its redactions, and the characters that had to be encoded again."""

    def make():
        encoder = RunEncoder(vocabulary)
        return lambda ids, texts: (_row(encoder, i, t, redactions(t) if t else None) for i, t in zip(ids, texts, strict=True))

    named = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_rows(named, ["doc_id", "text"], make, SCHEMA)


TREES = "doc_id bigint, text string, run_tokens array<int>, n_tokens bigint, n_chars_encoded bigint"


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The tree of each document as a row: its text, the tokens of each run, and their sum."""

    def make():
        encoder = RunEncoder(vocabulary)

        def work(ids, texts):
            for i, text in zip(ids, texts, strict=True):
                counts = [encoder.count_run(r) for r in runs(text or "") if r]
                yield i, text, counts, sum(counts), len(text or "")

        return work

    named = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_rows(named, ["doc_id", "text"], make, TREES)


def edit_trees(kept: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The trees after a table of edits as for count_with_edits; only what an edit touches is encoded."""

    def make():
        encoder = RunEncoder(vocabulary)

        def work(ids, texts, counts, lists):
            for i, text, own, changes in zip(ids, texts, counts, lists, strict=True):
                if not changes:
                    yield i, text, own, sum(own), 0
                    continue
                tree = CountTree(text or "", encoder, own)
                apply_edits(tree, [(e["start_pos"], e["end_pos"], e["replacement"]) for e in changes])
                yield i, tree.text, tree.leaves, tree.n_tokens, tree.encoded

        return work

    return map_rows(_with_edits(kept.select("doc_id", "text", "run_tokens"), edits), ["doc_id", "text", "run_tokens", "__edits"], make, TREES)


def _with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    by_doc = (
        edits.where("doc_id is not null and start_pos is not null and end_pos is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("__doc"))
        .agg(F.collect_list(F.struct("start_pos", "end_pos", F.coalesce("replacement", F.lit("")).alias("replacement"))).alias("__edits"))
    )
    return docs.join(by_doc, F.col("doc_id") == F.col("__doc"), "left")


def count_with_edits(docs: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The same with a table of edits (doc_id, start_pos, end_pos, replacement). Edits of unknown documents, or with a null offset, are ignored."""
    both = _with_edits(plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), edits)

    def make():
        encoder = RunEncoder(vocabulary)
        return lambda ids, texts, lists: (
            _row(encoder, i, t, [(e["start_pos"], e["end_pos"], e["replacement"]) for e in es or []])
            for i, t, es in zip(ids, texts, lists, strict=True)
        )

    return map_rows(both, ["doc_id", "text", "__edits"], make, SCHEMA)
