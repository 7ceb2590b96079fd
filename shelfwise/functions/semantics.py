"""Expressions whose results must not depend on the engine: rounding, guarded ratios, null order, checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Scale, round half away from zero, scale back; decimal literals never enter, so no digits are lost."""
    scale = float(10**digits)
    return F.round(x.cast("double") * F.lit(scale), 0) / F.lit(scale)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is zero or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return F.lit(100.0) * ratio(a, b)


def long(x: Column) -> Column:
    return x.cast("long")


def ones(condition: Column) -> Column:
    """1.0 where the condition holds and 0.0 elsewhere, nulls included."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


class CardinalityError(ValueError):
    """A join's right side holds a key more than once, or a row has no partner."""


def join_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", complete: bool = False) -> DataFrame:
    """left joined to right, whose keys must be unique; with `complete` every left row must find a partner.

    The check is one aggregation of the right side by key, and one semi join if `complete`.
    """
    if not right.groupBy(*keys).count().where("count > 1").isEmpty():
        raise CardinalityError(f"the right side repeats a key of {keys}")
    if complete and not left.join(right, keys, "left_anti").isEmpty():
        raise CardinalityError(f"rows without a partner by {keys}")
    return left.join(right, keys, how)
