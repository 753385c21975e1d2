"""Pre-token runs of a byte-level BPE tokenizer, the unit that counts and sequences are built from.

A run starts at a space that follows a non-blank character. No pre-token crosses such a place and none looks
beyond it, so runs are encoded on their own and their tokens add up to those of the whole text.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

from .common import Memo

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANK_THEN_SPACE = re.compile(r"\s |^ ")


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer in a vocabulary file; the file must be at the same path on every executor."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def runs(text: str) -> list[str]:
    """The runs of a text, which joined give the text again."""
    parts = text.split(" ")
    if not _BLANK_THEN_SPACE.search(text):
        return [parts[0], *(" " + p for p in parts[1:])]
    out = [parts[0]]
    for p in parts[1:]:
        if out[-1] and not out[-1][-1].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


class RunEncoder:
    """Encodes texts run by run, with a memory of runs seen before."""

    def __init__(self, path: str = VOCABULARY):
        self.tokenizer = encoding(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.n_vocab <= 1 << 16 else np.dtype("<u4")
        self._counts = Memo(lambda part: self._count(" " + part))
        self._bytes = Memo(lambda part: self._encode(" " + part))

    def _count(self, text: str) -> int:
        return len(self.tokenizer.encode_ordinary(text))

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_ordinary(text), dtype=self.dtype).tobytes()

    def count(self, text: str) -> int:
        if _BLANK_THEN_SPACE.search(text):
            return sum(map(self.count_run, runs(text)))
        first, *rest = text.split(" ")
        return (self._count(first) if first else 0) + sum(map(self._counts.__getitem__, rest))

    def count_run(self, run: str) -> int:
        return self._counts[run[1:]] if run[:1] == " " else self._count(run) if run else 0

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian integers of ``dtype``."""
        if _BLANK_THEN_SPACE.search(text):
            return b"".join(self._bytes[r[1:]] if r[:1] == " " else self._encode(r) for r in runs(text))
        first, *rest = text.split(" ")
        return self._encode(first) + b"".join(map(self._bytes.__getitem__, rest))
