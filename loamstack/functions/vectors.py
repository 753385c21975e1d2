"""Arithmetic on array columns, in double precision and inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 1e-12) -> Column:
    """a at length 1; its norm is computed once, as the one element that the outer lambda sees."""
    return F.transform(F.array(F.greatest(norm(a), F.lit(eps))), lambda n: F.transform(a, lambda x: x / n))[0]


def truncated(a: Column, width: int = 128) -> Column:
    return F.slice(a, 1, width)


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dense(weights: Column, width: int) -> Column:
    """A sparse map from index (below width) to weight as an array: its entries in order, each after the zeros before it."""
    entries = F.array_sort(F.map_entries(weights))

    def part(e: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(entries, i - 1)["key"] + 1).otherwise(0)
        return F.concat(F.array_repeat(F.lit(0.0), e["key"] - before), F.array(e["value"]))

    filled = F.flatten(F.transform(entries, part))
    return F.concat(filled, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(filled)))


def softmax(a: Column) -> Column:
    """Exponentials of a's elements as shares of their sum, relative to the greatest."""
    raised = F.transform(F.array(F.array_max(a)), lambda top: F.transform(a, lambda x: F.exp(x - top)))[0]
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.array(total), lambda t: F.transform(raised, lambda x: x / t))[0]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
