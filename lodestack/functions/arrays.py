"""Running passes over arrays as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, start: Column, state: Callable, emit: Callable, keep: Callable, kind: str) -> Column:
    """Emitted elements of a running pass over an array.

    ``state(s, x)`` is the state after element x, ``emit(s, x)`` what is emitted if
    ``keep(s, x)``, in the state before it.  Appending copies an array, so the pass is
    made in runs of about the root of the length, whose outputs are joined at the end.
    ``kind`` is the type of what is emitted.
    """
    none = F.array().cast(f"array<{kind}>")
    step = lambda a, x: F.struct(state(a["s"], x).alias("s"), F.when(keep(a["s"], x), F.array_append(a["out"], emit(a["s"], x))).otherwise(a["out"]).alias("out"))

    def passed(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")

        def run(n: Column) -> Column:
            def part(a: Column, i: Column) -> Column:
                done = F.aggregate(F.slice(xs, i * n + 1, n), F.struct(a["s"].alias("s"), none.alias("out")), step)
                return let(done, lambda d: F.struct(d["s"].alias("s"), F.array_append(a["out"], d["out"]).alias("out")))

            return F.flatten(F.aggregate(F.sequence(F.lit(0), F.ceil(F.size(xs) / n).cast("int") - 1), F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out")), part)["out"])

        return F.when(F.size(xs) > 0, let(size, run)).otherwise(none)

    return let(items, passed)


def places(xs: Column, holds: Callable[[Column, Column], Column]) -> Column:
    """Ascending indexes (from 0) of the elements for which ``holds(element, index)``."""
    marked = F.transform(xs, lambda x, i: F.when(holds(x, i), i))
    return F.array_compact(marked)


def runs(xs: Column, starts: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of each part of an array that begins at one of ``starts`` and ends before the next."""
    end = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(xs))
    return let(starts, lambda s: F.transform(s, lambda a, k: use(F.slice(xs, a + 1, end(s, k) - a))))


def shared_prefix(a: Column, b: Column) -> Column:
    """The longest common beginning of two arrays."""
    both = F.least(F.size(a), F.size(b))
    pairs = F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(1), both)
    unlike = places(pairs, lambda p, _: p["x"] != p["y"])
    return F.slice(a, F.lit(1), F.coalesce(F.get(unlike, F.lit(0)), both))
