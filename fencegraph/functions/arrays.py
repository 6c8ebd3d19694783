"""Array helpers that stay linear in the array length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = 64


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` names it."""
    return F.transform(F.array(value), fn)[0]


def running_starts(lengths: Column) -> Column:
    """Start position of each element when elements of these lengths are laid end to end.

    Two levels (runs of 64), because appending to one long array copies it every time.
    """
    return bind(lengths, _running_starts)  # else they are computed again for every run


def _running_starts(lengths: Column) -> Column:
    n = F.size(lengths)
    runs = F.when(n == 0, F.array().cast("array<array<int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _RUN).cast("int")), lambda r: F.slice(lengths, r * _RUN + 1, _RUN))
    )
    run_sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(runs, _starts(run_sums), lambda r, base: F.transform(_starts(r), lambda s: s + base)))


def _starts(lengths: Column) -> Column:
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        lengths,
        zero,
        lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
        lambda s: s["out"],
    )
