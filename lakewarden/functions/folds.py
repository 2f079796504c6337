"""Folds over long arrays: what a plain fold appends to an array it copies at every step, so long arrays are folded in parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a part.
PART = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What ``body`` makes of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(items: Column) -> Column:
    """An array cut into arrays of at most :data:`PART` items."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int"))
    return F.when(F.size(items) <= PART, F.array(items)).otherwise(F.transform(numbers, lambda k: F.slice(items, k * PART + 1, F.lit(PART))))


def collected(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What a fold puts out, in order: ``step`` takes the state and an item and returns the next state and an array of what it adds.

    ``out`` is the type of what is put out. The work grows with the number of
    items (and the square of the number of parts).
    """
    empty = F.array().cast(f"array<{out}>")

    def within(acc: Column, item: Column) -> Column:
        after, added = step(acc["at"], item)
        return F.struct(after.alias("at"), F.concat(acc["out"], added).alias("out"))

    def part(acc: Column, some: Column) -> Column:
        begin = F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], state)
        return F.array_append(acc, F.aggregate(some, F.struct(begin.alias("at"), empty.alias("out")), within))

    kind = f"array<struct<at:int,out:array<{out}>>>"
    folded = lambda x: F.flatten(F.transform(F.aggregate(parts(x), F.array().cast(kind), part), lambda r: r["out"]))
    return let(items, lambda x: F.when(F.size(x) == 0, empty).otherwise(folded(x)))
