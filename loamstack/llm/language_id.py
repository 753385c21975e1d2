"""Operator 7: hierarchical language identification.

A text's features are its hashed byte trigrams (lower case), as shares of the text. One-versus-rest linear machines
give the language family; within it, one-versus-one linear support vector machines vote for the language. All of them
are trained here by gradient descent on the squared hinge, on a bounded sample of the rows whose ``lang`` is known:
``per_language`` documents of each language, those with the lowest hash of doc_id (less those of them that have under
two characters). The bound is the only limit; each text is scored whole. Training reads ids and languages once, and
then the texts of the sample.

A text is rejected (language null) with a reason: ``no_text`` for null, empty or nearly letterless texts (under two
letters); ``no_model`` if there was nothing to learn from; ``ambiguous`` if the winning machine's margin is below
``min_margin``. Ties go to the language first in the alphabet. Repeated rows are judged one by one and alike, rows with
a null doc_id too. An empty table gives no rows. Columns besides doc_id, text and lang are ignored by ``identify`` and
passed through by ``keep_identified``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, map_rows, plain

FAMILIES = {"germanic": ("de", "en"), "romance": ("es", "fr")}
BITS = 13
SCHEMA = "doc_id bigint, family string, predicted string, margin double, reason string"


def trigram_slots(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The feature slot of the trigram at each byte but the last two."""
    b = data.astype(np.uint32)
    mixed = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761)
    return mixed >> np.uint32(32 - bits)


def prepared(text: str) -> bytes:
    return (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace")


def features(texts: list[str], bits: int = BITS) -> np.ndarray:
    out = np.zeros((len(texts), 1 << bits), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        slots = trigram_slots(np.frombuffer(prepared(text), dtype=np.uint8), bits)
        if len(slots):
            row += np.bincount(slots, minlength=1 << bits) / len(slots)
    return out


@dataclass
class Model:
    """weights: slots x machines; the first machines are the families (one versus rest), the others pairs of languages."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray
    bits: int

    def decide(self, scores: np.ndarray) -> tuple[str, str, float]:
        """Family, language and the smallest margin on the way, from one row of scores."""
        k = len(self.families)
        order = np.argsort(-scores[:k], kind="stable")
        family = self.families[order[0]]
        margin = float(scores[order[0]] - scores[order[1]]) / 2 if k > 1 else 1.0
        votes = {name: [0, 0.0] for name in self.languages[family]}
        for j, (a, b) in enumerate(self.pairs):
            if a in votes and b in votes:
                s = float(scores[k + j])
                winner = a if s >= 0 else b
                votes[winner][0] += 1
                votes[winner][1] += abs(s)
                if len(votes) == 2:
                    margin = min(margin, abs(s))
        best = max(sorted(votes), key=lambda name: tuple(votes[name]))
        return family, best, margin

    def score(self, texts: list[str]) -> np.ndarray:
        parts = [prepared(t) for t in texts]
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        out = np.empty((len(texts), self.weights.shape[1]), dtype=np.float64)
        start = 0
        for i, end in enumerate(ends):
            slots = trigram_slots(data[start:end], self.bits)
            out[i] = np.bincount(slots, minlength=1 << self.bits).astype(np.float32) @ self.weights / max(1, len(slots)) + self.bias
            start = end
        return out


def fit_machine(x: np.ndarray, sign: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear machine on the squared hinge, by accelerated gradient descent; classes weigh alike."""
    n = len(sign)
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    b = 0.0
    v, vb = w.copy(), b
    step = 0.5 / (float((weight * (x * x).sum(axis=1)).sum()) + 1.0 + penalty)
    for k in range(rounds if n else 0):
        gap = np.maximum(0, 1 - sign * (x @ v + vb)) * weight
        pull = (sign * gap).astype(np.float32)
        new_w = v + 2 * step * (pull @ x) - step * penalty * v
        new_b = vb + 2 * step * float(pull.sum())
        v = new_w + (k / (k + 3)) * (new_w - w)
        vb = new_b + (k / (k + 3)) * (new_b - b)
        w, b = new_w, new_b
    return w, b


def fit(texts: list[str], langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES, bits: int = BITS) -> Model | None:
    seen = set(langs)
    known = {f: sorted(name for name in names if name in seen) for f, names in sorted(families.items())}
    known = {f: names for f, names in known.items() if names}
    if not known:
        return None
    x = features(texts, bits)
    scale = (1 / np.sqrt(x.mean(axis=0) + 1e-6)).astype(np.float32)
    x *= scale
    langs_at = np.array(langs)
    columns, biases, pairs = [], [], []
    for names in known.values():
        sign = np.where(np.isin(langs_at, names), 1.0, -1.0).astype(np.float32)
        w, b = fit_machine(x, sign) if len(known) > 1 else (np.zeros(x.shape[1], np.float32), 1.0)
        columns.append(w)
        biases.append(b)
    for names in known.values():
        for i, a in enumerate(names):
            for c in names[i + 1 :]:
                rows = np.isin(langs_at, (a, c))
                w, b = fit_machine(x[rows], np.where(langs_at[rows] == a, 1.0, -1.0).astype(np.float32))
                columns.append(w)
                biases.append(b)
                pairs.append((a, c))
    weights = np.stack(columns, axis=1) * scale[:, None]
    return Model(list(known), known, pairs, weights.astype(np.float32), np.array(biases), bits)


def train(docs: DataFrame, families: dict[str, tuple[str, ...]] = FAMILIES, per_language: int = 400, bits: int = BITS) -> Model | None:
    """Fits on ``per_language`` labelled documents of each language."""
    wanted = [name for names in families.values() for name in names]
    docs = plain(docs, "doc_id", "text", "lang")
    labelled = docs.where(F.col("lang").isin(wanted) & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    first = labelled.select("lang", "doc_id").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    ids = [r[0] for r in first.select("doc_id").distinct().collect()]
    rows = labelled.where(F.col("doc_id").isin(ids) & (F.length("text") > 1)).select("doc_id", "text", "lang").collect() if ids else []
    rows = sorted({(r[0], r[1], r[2]) for r in rows})
    return fit([r[1] for r in rows], [r[2] for r in rows], families, bits)


def _judge(model: Model | None, texts: list[str | None], min_margin: float) -> list[tuple]:
    """(family, language, margin, reason) of each text."""
    out: list[tuple] = [(None, None, None, "no_text" if model else "no_model")] * len(texts)
    at = [i for i, t in enumerate(texts) if t and _letters(t)]
    if model and at:
        for i, row in zip(at, model.score([texts[i] for i in at]), strict=True):
            family, language, margin = model.decide(row)
            sure = margin >= min_margin
            out[i] = (family, language if sure else None, round(margin, 6), None if sure else "ambiguous")
    return out


def _letters(text: str) -> bool:
    seen = 0
    for c in text:
        seen += c.isalpha()
        if seen > 1:
            return True
    return False


MIN_MARGIN = 0.01


def identify(docs: DataFrame, model: Model | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The language of each document, or why there is none. Without a model, trains one on these documents."""
    model = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(ids, texts):
            return ((i, *row) for i, row in zip(ids, _judge(sent.value, texts, min_margin), strict=True))

        return work

    named = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_rows(named, ["doc_id", "text"], make, SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents that ``identify`` doesn't reject, with all their columns."""
    model = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [row[1] is not None for row in _judge(sent.value, texts, min_margin)]

    return keep_rows(docs, ["text"], make)
