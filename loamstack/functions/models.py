"""Places for models: token encoders and pair scorers as Arrow functions, with defaults that need no network."""

from __future__ import annotations

import itertools
import math
import time
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """A matrix of token vectors for each text."""


class PairScorer(Protocol):
    def __call__(self, queries: list[str], texts: list[str]) -> list[float]: ...


_U, _M128 = np.uint32, 2**128 - 1


def _powers(first: int, by: int, n: int) -> np.ndarray:
    out = [first]
    for _ in range(n):
        out.append(out[-1] * by & 0xFFFFFFFF)
    return np.array(out, _U)[:, None]


#: numpy's SeedSequence and PCG64: the hash constants of its 16 steps of mixing and 8 of output, by which 32-bit seeds become states.
_MIX, _OUT = _powers(0x43B0D7E5, 0x931E8875, 16), _powers(0x8B51F9DD, 0x58F38DED, 8)
_OTHERS = [[j for j in range(4) if j != i] for i in range(4)]
_STEP = 0x2360ED051FC65DA44385DF649FCCF645


def _hashed(x: np.ndarray, constants: np.ndarray) -> np.ndarray:
    x = (x ^ constants[:-1]) * constants[1:]
    return x ^ (x >> _U(16))


def generator_states(seeds: list[int]) -> list[tuple[int, int]]:
    """(state, increment) of ``np.random.PCG64(seed)`` for each 32-bit seed, all at once: a tenth of the time that as many generators take."""
    pool = np.zeros((4, len(seeds)), _U)
    pool[0] = seeds
    pool = _hashed(pool, _MIX[:5])
    for i, others in enumerate(_OTHERS):
        x = _U(0xCA01F9DD) * pool[others] - _U(0x4973F715) * _hashed(pool[i], _MIX[4 + 3 * i : 8 + 3 * i])
        pool[others] = x ^ (x >> _U(16))
    words = _hashed(np.concatenate([pool, pool]), _OUT).astype(np.uint64)
    out = []
    for a, b, c, d in (words[::2] | words[1::2] << np.uint64(32)).T.tolist():
        inc = ((c << 64 | d) << 1 | 1) & _M128
        out.append((((inc + (a << 64 | b)) * _STEP + inc) & _M128, inc))
    return out


class HashingEncoder:
    """Each word is a unit vector drawn from its checksum; the same on every machine.

    Vectors are drawn once while a word is known; of too many words those found in most texts stay known.
    """

    MOST = 200_000

    def __init__(self, width: int = 64, marker: str = "[D]"):
        self.width, self.marker = width, marker
        #: Words in the order of their rows in the table of vectors, and in how many texts each was found.
        self.known, self.table, self.found = {}, np.empty((1024, width)), np.zeros(1024, np.int64)
        self.bits = np.random.PCG64(0)
        self.draw = np.random.Generator(self.bits).standard_normal

    def learn(self, words: Iterable[str]) -> None:
        if len(self.known) > self.MOST:
            best = np.argsort(-self.found[: len(self.known)], kind="stable")[: self.MOST // 2]
            names = list(self.known)
            self.known = {names[i]: at for at, i in enumerate(best)}
            self.table[: len(best)], self.found[: len(best)], self.found[len(best) :] = self.table[best], self.found[best] // 2, 0
        new = [w for w in set(words) if w not in self.known]
        at, end = len(self.known), len(self.known) + len(new)
        while end > len(self.table):
            self.table, self.found = np.concatenate([self.table, np.empty_like(self.table)]), np.concatenate([self.found, np.zeros_like(self.found)])
        rows = self.table[at:end]
        for v, (state, inc) in zip(rows, generator_states([zlib.crc32(w.encode("utf-8", "replace")) for w in new]), strict=True):
            self.bits.state = {"bit_generator": "PCG64", "state": {"state": state, "inc": inc}, "has_uint32": 0, "uinteger": 0}
            self.draw(out=v)
        rows /= np.array([math.sqrt(v.dot(v)) for v in rows])[:, None]
        self.known.update(zip(new, range(at, end), strict=True))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        lists = [[self.marker, *(t or "").lower().split()] for t in texts]
        self.learn(itertools.chain.from_iterable(lists))
        out = []
        for words in lists:
            rows = np.fromiter(map(self.known.__getitem__, words), np.intp, len(words))
            self.found[rows] += 1
            out.append(self.table.take(rows, axis=0))
        return out


class OverlapScorer:
    """Cosine similarity of the two word sets."""

    def __call__(self, queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts, strict=True):
            a, b = set((q or "").lower().split()), set((t or "").lower().split())
            out.append(len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0)
        return out


#: What encode gives of each text, with the types.
ENCODED = {"vectors": "array<array<double>>", "n_vectors": "int", "pooled": "array<double>"}


def _nested(offsets: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *offsets]), pa.int32()), values)


def encode(chunks: DataFrame, make: Callable[[], Encoder] = HashingEncoder, batch: int = 64, parts: tuple[str, ...] = ("vectors", "pooled")) -> DataFrame:
    """(chunk_id and ``parts``, of ENCODED) of (chunk_id, text); a text that fails gets no vectors and a pool of zeros.

    ``make`` runs once a task; texts of a batch in which one fails are encoded one at a time. Every text is encoded, but matrices go back to the JVM only if ``vectors`` is among the parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        none = np.zeros((0, getattr(encoder, "width", 0)))
        for frame in batches:
            for start in range(0, frame.num_rows, batch):
                part = frame.slice(start, batch)
                matrices, pools = [], []
                texts = part["text"].to_pylist()
                try:
                    made = encoder(texts)
                    if len(made) != len(texts):
                        raise ValueError(f"{len(made)} matrices of {len(texts)} texts")
                except (ValueError, RuntimeError):
                    made = None
                for i, text in enumerate(texts):
                    try:
                        m = made[i] if made else encoder([text])[0]
                        mean = m.mean(axis=0)
                        matrices.append(np.asarray(m, np.float64) if "vectors" in parts else m)
                        pools.append(np.asarray(mean / max(float(np.linalg.norm(mean)), 1e-12), np.float64))
                    except (ValueError, RuntimeError):
                        matrices, pools = [*matrices[: len(pools)], none], [*pools, np.zeros(none.shape[1])]
                out = {"chunk_id": part["chunk_id"], "pooled": _nested([len(x) for x in pools], pa.array(np.concatenate(pools)))}
                out["n_vectors"] = pa.array([len(m) for m in matrices], pa.int32())
                if "vectors" in parts:
                    each = _nested([m.shape[1] for m in matrices for _ in m], pa.array(np.concatenate([m.ravel() for m in matrices])))
                    out["vectors"] = _nested([len(m) for m in matrices], each)
                yield pa.RecordBatch.from_pydict({c: out[c] for c in ("chunk_id", *parts)})

    kinds = ", ".join(f"{c} {ENCODED[c]}" for c in parts)
    return chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text").mapInArrow(run, f"chunk_id string, {kinds}")


class PageEncoder(Protocol):
    def __call__(self, image: bytes) -> np.ndarray:
        """A matrix of patch vectors."""


class HashingPageEncoder:
    """Each slice of an image's bytes is a unit vector drawn from its checksum; the same on every machine."""

    def __init__(self, width: int = 128, patches: int = 32):
        self.width, self.patches = width, patches

    def __call__(self, image: bytes) -> np.ndarray:
        step = max(1, -(-len(image) // self.patches))
        parts = [image[i : i + step] for i in range(0, len(image), step)] or [b""]
        m = np.stack([np.random.default_rng(zlib.crc32(p)).standard_normal(self.width) for p in parts])
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def encode_pages(pages: DataFrame, make: Callable[[], PageEncoder] = HashingPageEncoder) -> DataFrame:
    """(page_id, patch, e) of (page_id, image); null images and pages that fail have no patches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for frame in frames:
            rows = []
            for key, image in zip(frame["page_id"], frame["image"], strict=True):
                try:
                    rows += [(key, i, v.tolist()) for i, v in enumerate(encoder(bytes(image)))] if image is not None else []
                except (ValueError, RuntimeError):
                    continue
            yield pd.DataFrame(rows, columns=["page_id", "patch", "e"])

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "image").mapInPandas(run, "page_id string, patch int, e array<double>")


def pair_score(query: Column, text: Column, make: Callable[[], PairScorer] = OverlapScorer) -> Column:
    """A pair scorer as an Arrow function over two text columns."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make()
        for q, t in batches:
            yield pd.Series(scorer(q.tolist(), t.tolist()))

    return score(query, text)


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class ListwiseRanker(Protocol):
    def __call__(self, query: str, texts: list[str]) -> list[int]:
        """The texts' places, best first."""


class ExtractiveGenerator:
    """The first passage line of a prompt that shares most words with its question line."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            lines = [x for x in (p or "").splitlines() if x.strip()]
            asked = set(next((x for x in reversed(lines) if ": " in x), "").lower().split())
            out.append(max(lines[1:-2] or lines or [""], key=lambda x: len(asked & set(x.lower().split()))))
        return out


def generate(prompts: DataFrame, make: Callable[[], Generator] = ExtractiveGenerator, attempts: int = 3, delay: float = 1.0, batch: int = 8) -> DataFrame:
    """``prompts`` (prompt_id, prompt) with answer, tries and error: a failing batch is tried again after a delay that grows with each try, then row by row gives an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                for k in range(1, attempts + 1):
                    try:
                        answers, error = generator(part["prompt"].tolist()), None
                        break
                    except Exception as e:  # the model's own errors, whatever they are
                        answers, error = [None] * len(part), f"{type(e).__name__}: {e}"
                        if k < attempts:
                            time.sleep(delay * k)
                yield pd.DataFrame({"prompt_id": part["prompt_id"], "answer": answers, "tries": k, "error": error})

    return prompts.select(F.col("prompt_id").cast("string").alias("prompt_id"), "prompt").mapInPandas(run, "prompt_id string, answer string, tries int, error string")


def rank_lists(candidates: DataFrame, make: Callable[[], ListwiseRanker]) -> DataFrame:
    """(query_id, chunk_id, rank, confidence) of short lists (query_id, query, chunk_id, text, place) by a ranker; where it fails, the order stays, with confidence 0.5."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        try:
            order = list(dict.fromkeys(i for i in make()(frame["query"].iloc[0], frame["text"].tolist()) if 0 <= i < len(frame)))
            sure = 0.6
        except Exception:  # the model's own errors, whatever they are
            order, sure = [], 0.5
        order += [i for i in range(len(frame)) if i not in order]
        ranked = frame.iloc[order]
        return pd.DataFrame({"query_id": ranked["query_id"], "chunk_id": ranked["chunk_id"], "rank": range(1, len(ranked) + 1), "confidence": sure})

    return candidates.select("query_id", "query", "chunk_id", "text", "place").groupBy("query_id").applyInPandas(run, "query_id bigint, chunk_id string, rank int, confidence double")


def term_weights(docs: DataFrame, make: Callable[[], Callable[[str], dict[str, float]]] | None = None) -> DataFrame:
    """(doc_id, term, weight): a learned sparse encoder's weights, or by default 1 + ln(1 + share of the document's terms), relative to its greatest."""
    if make is None:
        t = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1).alias("t"))
        tf = t.select("doc_id", F.size("t").alias("n"), F.explode("t").alias("term")).groupBy("doc_id", "term").agg((1 + F.log1p(F.count(F.lit(1)) / F.first("n"))).alias("w"))
        return tf.select("doc_id", "term", (F.col("w") / F.max("w").over(Window.partitionBy("doc_id"))).alias("weight"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_one = make()
        for frame in frames:
            rows = [(i, term, float(w)) for i, text in zip(frame["doc_id"], frame["text"], strict=True) for term, w in sorted(encode_one(text or "").items())]
            yield pd.DataFrame(rows, columns=["doc_id", "term", "weight"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, term string, weight double")


def about(*models: object) -> list[dict]:
    """What there is to say of models: their class and plain settings."""
    return [{"model": type(m).__name__} | {k: v for k, v in vars(m).items() if isinstance(v, (int, float, str, bool))} for m in models]


def extractive_answer(context: Column, question: Column) -> Column:
    """The context's sentence that shares most words with the question; the first of equals."""
    sentences = F.filter(F.split(F.regexp_replace(context, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.length(s) > 0)
    q = F.array_distinct(F.split(F.lower(question), r"\s+"))
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(q, F.split(F.lower(s), r"\s+"))).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.coalesce(F.array_max(scored)["s"], F.lit(""))
