"""Array expressions that compute a value once and run in time that hardly grows faster than the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(values: Column, width: Column) -> Column:
    """values in runs of width; an empty array has none."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), width), lambda i: F.slice(values, i, width))
    return F.filter(some, lambda r: F.size(r) > 0)


def root_width(values: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))


def running(values: Column, together: Callable[[Column, Column], Column]) -> Column:
    """values[0], together(values[0], values[1]), ... of an int array; together is a sum or a maximum.

    Built in runs of the array's square root: appending entry by entry to one array would cost the square of its length.
    """
    none = F.array().cast("array<int>")

    def fold(some: Column) -> Column:
        return F.aggregate(some, none, lambda all_, x: F.concat(all_, F.array(F.when(F.size(all_) == 0, x).otherwise(together(F.element_at(all_, -1), x)))))

    def joined(inner: Column) -> Column:
        last = F.transform(inner, lambda r: F.element_at(r, -1))
        return let(fold(last), lambda ends: F.flatten(F.transform(inner, lambda r, i: F.when(i == 0, r).otherwise(F.transform(r, lambda x: together(F.get(ends, i - 1), x))))))

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(let(F.transform(cut(v, root_width(v)), fold), joined)))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def replaced_by(text: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """text with each match m of pattern as body(m)."""

    def joined(found: Column) -> Column:
        gaps = F.split(text, pattern)
        pieces = F.zip_with(gaps, F.concat(F.transform(found, body), F.array(F.lit(""))), lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit(""))))
        return F.array_join(pieces, "")

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), joined)
