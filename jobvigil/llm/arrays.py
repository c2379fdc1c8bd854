"""Array expressions that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are gone through one by one between two stored sums.
STEP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, wherever the optimiser moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element, ``start`` merged with all elements before it.

    Two levels, so that an array of n takes n * STEP / 2 + (n / STEP)^2 / 2 steps and no list is built up.
    """
    fold = lambda some: F.aggregate(some, start, merge)
    blocks = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int"))).otherwise(F.array().cast("array<int>"))
    sums = lambda v: F.transform(blocks, lambda b: fold(F.slice(v, b * STEP + 1, F.lit(STEP))))
    bases = lambda s: F.transform(s, lambda _, b: fold(F.slice(s, F.lit(1), b)))
    return let(values, lambda v: let(sums(v), lambda s: let(bases(s), lambda base: F.transform(v, lambda _, i: F.aggregate(
        F.slice(v, i - i % STEP + 1, i % STEP), F.get(base, F.floor(i / STEP).cast("int")), merge)))))


def running_sum(values: Column) -> Column:
    return running(values, F.lit(0).cast("long"), lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))


def place_of(value: Column, bounds: Column, n: int) -> Column:
    """How many of the ``n`` sorted ``bounds`` are at most ``value``, by halving."""
    zero = F.lit(0)
    halves = F.sequence(zero, F.lit(max(1, n).bit_length()))
    seek = lambda s, _: let(F.floor((s["low"] + s["high"]) / 2).cast("int"), lambda m: F.when(s["low"] >= s["high"], s).when(
        F.get(bounds, m) <= value, F.struct((m + 1).alias("low"), s["high"].alias("high"))).otherwise(
        F.struct(s["low"].alias("low"), m.alias("high"))))
    return F.aggregate(halves, F.struct(zero.alias("low"), F.lit(n).alias("high")), seek, lambda s: s["low"])
