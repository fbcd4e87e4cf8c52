"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-3


def float_eq(x: Column, v: Column, epsilon: float = EPSILON) -> Column:
    """Whether ``x`` lies within ``epsilon`` of ``v``; false, not NULL or NaN, for two infinities."""
    return F.coalesce((x > v - epsilon) & (x < v + epsilon), F.lit(False))


def log2up(i: Column) -> Column:
    """The number of binary digits of ``i``: the smallest power of two above ``i`` is ``2 ** log2up(i)``."""
    return F.when(i <= 0, F.lit(0)).otherwise(F.length(F.bin(i)))


def segment(vid: Column, capacity: int) -> Column:
    """The range segment of an id."""
    return F.floor(vid / capacity).cast("long")


def lane(vid: Column, lanes: int) -> Column:
    """The residue lane of an id."""
    return F.pmod(vid, F.lit(lanes))


def round_up(x: Column, to: int) -> Column:
    return (F.ceil(x / to) * to).cast("long")


def round_down(x: Column, to: int) -> Column:
    return (F.floor(x / to) * to).cast("long")
