"""Rolling figures over calendar days: right for series that lack days, where frames of rows reach too far back.

Frames are ranges over the day number. Where a check finds a row for each day of each series, frames of rows say the same
and are taken instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

WINDOWS = (7, 28)


def is_continuous(df: DataFrame, keys: list[str], day: str = "date") -> bool:
    """Whether each series has exactly one row for every day from its first to its last, in one aggregation by series. A
    row without a day, or a day that repeats, breaks it; an empty table is continuous."""
    spans = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(day).alias("days"), (F.datediff(F.max(day), F.min(day)) + 1).alias("span"))
    return spans.where("NOT (n <=> span AND n = days)").isEmpty()


def by_day(keys: list[str], day: str = "date") -> WindowSpec:
    """Series in order of the day's number, so that ranges count days. Rows without a day see only each other."""
    return Window.partitionBy(*keys).orderBy(F.unix_date(day))


def rolling_days(df: DataFrame, keys: list[str], value: str, windows: tuple[int, ...] = WINDOWS, day: str = "date", continuous: bool | None = None) -> DataFrame:
    """df with, for the w days up to and with each row's day: sum_{w}d, mean_{w}d and sd_{w}d of the rows there are, and
    days_{w}d, their number; and {value}_week_before, the value seven days before (null where that day has no row).

    `continuous` tells whether every day has a row; None checks it. Nulls of the value are left out of sums, means and
    deviations, and still count in days_{w}d. Several rows of a day are all taken, and the largest is the one of a week before.
    """
    if is_continuous(df, keys, day) if continuous is None else continuous:
        own = Window.partitionBy(*keys).orderBy(day)
        frame, before = lambda w: own.rowsBetween(1 - w, 0), F.lag(value, 7).over(own)
    else:
        own = by_day(keys, day)
        frame, before = lambda w: own.rangeBetween(1 - w, 0), F.max(value).over(own.rangeBetween(-7, -7))
    out: dict[str, Column] = {f"{value}_week_before": before}
    for w in windows:
        past = frame(w)
        out |= {f"sum_{w}d": F.sum(value).over(past), f"mean_{w}d": F.avg(value).over(past), f"sd_{w}d": F.stddev_samp(value).over(past), f"days_{w}d": F.count(F.lit(1)).over(past)}
    return df.withColumns(out)
