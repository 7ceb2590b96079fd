"""Places and running sums over all rows, without a window that gathers them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import stored


def in_order(df: DataFrame, order: list[Column], total: str | None = None) -> DataFrame:
    """df with place (from 1), n_rows, and running and grand (sums of `total`) in this order, which should leave no ties.

    A range partition deals the rows into ranges, ties by the later keys too, so a value that fills a third of the data is
    spread. Windows run inside the ranges; what lies before a range is a sum over a row for each range.
    """
    ranges = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "in-order")
    amount = F.col(total) if total else F.lit(0)
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.sum(amount).alias("__s"))
    before, all_ = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sizes = sizes.select("__range", zero("__n", before).alias("__n0"), zero("__s", before).alias("__s0"), zero("__n", all_).alias("n_rows"), zero("__s", all_).alias("grand"))
    own = Window.partitionBy("__range").orderBy(*order)
    placed = ranges.join(F.broadcast(sizes), "__range").withColumn("place", F.col("__n0") + F.row_number().over(own))
    if total:
        placed = placed.withColumn("running", F.col("__s0") + F.sum(amount).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.drop("__range", "__n0", "__s0", *([] if total else ["grand"]))


def quantile_group(groups: int) -> Column:
    """The group from 1 to `groups` of in_order's place: sizes differ by one at most, larger groups first."""
    size, more = F.floor(F.col("n_rows") / groups), F.col("n_rows") % groups
    long = more * (size + 1)
    at = F.col("place") - 1
    return F.when(at < long, F.floor(at / (size + 1)) + 1).otherwise(more + F.floor((at - long) / F.greatest(size, F.lit(1))) + 1).cast("long")


def mid_ranks(df: DataFrame, x: str) -> DataFrame:
    """x and rank of each distinct value: the mean of the places that its rows take."""
    counts = in_order(df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("__c")), [F.col(x)], "__c")
    return counts.select(x, (F.col("running") - (F.col("__c") - 1) / 2.0).alias("rank"))
