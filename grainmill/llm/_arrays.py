"""Running values over arrays within a row, native and in near-linear time.

An array that grows element by element inside a fold is copied at every step. Cut into pieces of PIECE, only short arrays
grow: n elements cost about n * PIECE / 2 + (n / PIECE) ** 2 / 2 copies of references.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(values: Column, size: int = PIECE) -> Column:
    """Slices of an array column; of an empty one, none."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, F.lit(size)))


def running(values: Column, kind: str, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each value, step folded over all values up to it, from `start`; step is associative and `start` its neutral
    element. kind: type of the results."""
    start = start.cast(kind)
    none = F.array().cast(f"array<{kind}>")
    grow = lambda acc, x: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), start), x)))

    def whole(inside: Column) -> Column:
        before = F.aggregate(inside, F.array(start), lambda acc, p: F.concat(acc, F.array(step(F.element_at(acc, -1), F.element_at(p, -1)))))
        return F.flatten(F.zip_with(inside, before, lambda p, b: F.when(p.isNotNull(), F.transform(p, lambda x: step(b, x))).otherwise(none)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(F.transform(pieces(v), lambda p: F.aggregate(p, none, grow)), whole)).otherwise(none))
