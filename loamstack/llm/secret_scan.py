"""Operator 2: secret scan with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must hold. A task indexes the
documents of an Arrow batch: from trigram to the documents that hold it, for the trigrams that the queries name.
Postings are intersected and united as the query says, and the candidates are verified with the regular expression.
A rule whose query is empty (no mandatory trigram) scans every document. Trigrams are of bytes, ASCII letters folded to
lower case; that may add candidates and never loses one.

The result has one row for each document and rule that matches: how often (matches don't overlap) and the SHA-256 of
the first match, so that secrets aren't copied. Null and empty texts match nothing. Repeated rows are scanned one by one.
Columns besides doc_id and text are ignored, whatever their names; a null doc_id is reported as null. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as parser
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, plain

#: Written in the syntax that Python's re (with ASCII classes) and RE2 share; without upper bounds that a secret could exceed.
RULES: dict[str, str] = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "json_web_token": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "assigned_secret": r"(?i:\b(?:api_?key|token|secret|passwd|password)[ \t]*[:=][ \t]*[\"'][^\"' \n]{8,}[\"'])",
    "url_password": r"[a-z]{2,12}://[^/ :@\n]+:[^/ :@\n]{3,}@",
    "hex_key": r"\b[0-9a-f]{40}\b",
    "card_number": r"\b[3-6][0-9]{15}\b",
}
SCHEMA = "doc_id bigint, rule string, n_matches int, first_sha256 string"

#: A query is True (anything may match), a frozenset of bytes (one trigram), or ("and" | "or", queries).
MOST = 32


def _all(*queries):
    parts = {q for q in queries if q is not True}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _any(*queries):
    parts = set(queries)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _grams_of(text: bytes):
    return _all(*(frozenset([text[i : i + 3]]) for i in range(len(text) - 2)))


def _either(texts):
    return _any(*(_grams_of(t) for t in texts))


class _Part:
    """What is known of a part of an expression: all its texts (exact, or None), texts it must start and end with, and a query."""

    def __init__(self, exact=None, prefix=frozenset([b""]), suffix=frozenset([b""]), query=True):
        self.exact, self.query = exact, query
        self.prefix = exact if exact is not None else prefix
        self.suffix = exact if exact is not None else suffix
        if self.exact is not None and (len(self.exact) > MOST or max(map(len, self.exact), default=0) > 64):
            self.query, self.exact = _all(self.query, _either(self.exact)), None
        self.prefix = self._short(self.prefix, lambda t, n: t[:n])
        self.suffix = self._short(self.suffix, lambda t, n: t[-n:] if n else b"")

    def _short(self, texts, end):
        if self.exact is not None:
            return texts
        for n in (16, 8, 4, 3, 2, 1, 0):
            if max(map(len, texts), default=0) > n:
                self.query = _all(self.query, _either(texts))
                texts = frozenset(end(t, n) for t in texts)
            if len(texts) <= MOST:
                return texts
        return frozenset([b""])

    def final(self):
        if self.exact is not None:
            return _all(self.query, _either(self.exact))
        return _all(self.query, _either(self.prefix), _either(self.suffix))


def _then(a: _Part, b: _Part) -> _Part:
    joined = frozenset(x + y for x, y in product(a.suffix, b.prefix)) if len(a.suffix) * len(b.prefix) <= MOST * 4 else None
    query = _all(a.query, b.query)
    if a.exact is not None and b.exact is not None and joined is not None:
        return _Part(joined, query=query)
    if joined is not None:
        query = _all(query, _either(joined))
    prefix = joined if a.exact is not None and joined is not None else a.prefix
    suffix = joined if b.exact is not None and joined is not None else b.suffix
    if a.exact is not None and joined is None:
        query = _all(query, _either(a.exact))
    if b.exact is not None and joined is None:
        query = _all(query, _either(b.exact))
    return _Part(None, prefix, suffix, query)


def _or(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        return _Part(frozenset().union(*(p.exact for p in parts)), query=_any(*(p.query for p in parts)))
    return _Part(None, frozenset().union(*(p.prefix for p in parts)), frozenset().union(*(p.suffix for p in parts)), _any(*(p.final() for p in parts)))


def _fold(code: int) -> bytes:
    return chr(code).encode("utf-8", "replace").lower() if code < 128 else chr(code).encode("utf-8", "replace")


def _walk(items, ignore_case: bool) -> _Part:
    out = _Part(frozenset([b""]))
    for op, arg in items:
        if op is C.LITERAL:
            part = _Part() if ignore_case and arg >= 128 else _Part(frozenset([_fold(arg)]))
        elif op is C.IN:
            part = _class(arg, ignore_case)
        elif op is C.SUBPATTERN:
            _, add, drop, inner = arg
            part = _walk(inner, (ignore_case or bool(add & re.I)) and not drop & re.I)
        elif op is C.BRANCH:
            part = _or([_walk(x, ignore_case) for x in arg[1]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = _walk(inner, ignore_case)
            if low == 0:
                part = _or([_Part(frozenset([b""])), one]) if high == 1 else _Part()
            else:
                part = one
                for _ in range(min(low, 4) - 1):
                    part = _then(part, one)
                if high != low or low > 4:
                    part = _then(_Part(None, part.prefix, frozenset([b""]), part.final()), _Part(None, frozenset([b""]), one.suffix))
        elif op is C.ATOMIC_GROUP:
            part = _walk(arg, ignore_case)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = _Part(frozenset([b""]))
        else:
            part = _Part()
        out = _then(out, part)
    return out


def _class(members, ignore_case: bool) -> _Part:
    texts = set()
    for op, arg in members:
        if op is C.LITERAL and (arg < 128 or not ignore_case):
            texts.add(_fold(arg))
        elif op is C.RANGE and arg[1] - arg[0] < MOST and (arg[1] < 128 or not ignore_case):
            texts |= {_fold(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return _Part()
    return _Part(frozenset(texts)) if texts and len(texts) <= MOST else _Part()


def trigram_query(pattern: str):
    """The Boolean trigram query that every match's text satisfies; True if there is none."""
    parsed = parser.parse(pattern, re.A)
    return _walk(parsed, bool(parsed.state.flags & re.I)).final()


def grams_in(query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, frozenset):
        return set(query)
    return set().union(*(grams_in(q) for q in query[1]))


def evaluate(query, postings: dict[bytes, set[int]]) -> set[int]:
    """Documents that satisfy a query other than True."""
    if isinstance(query, frozenset):
        return postings.get(next(iter(query)), set())
    kind, parts = query
    if kind == "or":
        return set().union(*(evaluate(q, postings) for q in parts))
    out = None
    for found in sorted((evaluate(q, postings) for q in parts), key=len):
        out = set(found) if out is None else out & found
        if not out:
            break
    return out or set()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Scanner:
    def __init__(self, rules: dict[str, str]):
        self.rules = {name: re.compile(p, re.A) for name, p in sorted(rules.items())}
        self.queries = {name: trigram_query(p) for name, p in sorted(rules.items())}
        needed = sorted(set().union(*map(grams_in, self.queries.values())))
        self.grams = needed
        # A bitmap over all 24-bit trigrams of those that queries name, and the rank of each.
        self.codes = np.array([g[0] | g[1] << 8 | g[2] << 16 for g in needed], np.int64)
        order = np.argsort(self.codes)
        self.sorted_codes, self.rank = self.codes[order], order
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True

    def index(self, texts: list[bytes]) -> dict[bytes, set[int]]:
        """Postings of the named trigrams over a batch of texts."""
        postings: dict[bytes, set[int]] = {}
        data = _LOWER[np.frombuffer(b"\0".join(texts), np.uint8)]
        if len(data) < 3 or not len(self.codes):
            return postings
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        code = data[:-2].astype(np.int32)
        code |= data[1:-1].astype(np.int32) << 8
        code |= data[2:].astype(np.int32) << 16
        at = np.flatnonzero(self.wanted[code])
        doc = np.searchsorted(starts, at, side="right") - 1
        gram = self.rank[np.searchsorted(self.sorted_codes, code[at])]
        for pair in np.unique(gram * len(texts) + doc).tolist():
            postings.setdefault(self.grams[pair // len(texts)], set()).add(pair % len(texts))
        return postings

    def candidates(self, texts: list[str]) -> dict[str, list[int]]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        postings: dict[bytes, set[int]] = {}
        start = 0
        while start < len(raw):
            end, size = start, 0
            while end < len(raw) and (end == start or size + len(raw[end]) < 2 << 20):
                size += len(raw[end])
                end += 1
            for gram, docs in self.index(raw[start:end]).items():
                postings.setdefault(gram, set()).update(d + start for d in docs)
            start = end
        everyone = [i for i, t in enumerate(texts) if t]
        return {name: everyone if q is True else sorted(evaluate(q, postings)) for name, q in self.queries.items()}

    def __call__(self, ids: list, texts: list[str | None]):
        texts = [t or "" for t in texts]
        for name, docs in self.candidates(texts).items():
            rule = self.rules[name]
            for d in docs:
                first, n = None, 0
                for m in rule.finditer(texts[d]):
                    if m.group():
                        first = m.group() if first is None else first
                        n += 1
                if n:
                    yield ids[d], name, n, hashlib.sha256(first.encode("utf-8", "replace")).hexdigest()


def scan(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    rules = dict(rules or RULES)
    named = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_rows(named, ["doc_id", "text"], lambda: Scanner(rules), SCHEMA)


def oracle(rules: dict[str, str] | None = None) -> str:
    """The same result as SQL."""
    parts = []
    for name, pattern in sorted((rules or RULES).items()):
        quoted = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{name}' AS rule, regexp_extract_all(text, '{quoted}') AS found FROM documents")
    return f"SELECT doc_id, rule, CAST(len(found) AS INTEGER) AS n_matches, sha256(found[1]) AS first_sha256 FROM ({' UNION ALL '.join(parts)}) WHERE len(found) > 0"
