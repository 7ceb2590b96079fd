"""The driver's queries over the retail model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.semantics import rounded
from shelfwise.plans.binding import retail
from shelfwise.plans.named import REGISTRY
from shelfwise.plans.oracle import STATEMENTS

#: Parameters at which the driver's tables give rows.
SHOWN = {"persistent_low_demand": {"max_mean_daily": 9.0, "min_zero_share": 0.7}}


def _named(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: REGISTRY[name].run(retail(spark, sf_dir), **SHOWN.get(name, {}))


def v_sales_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.sum(c).cast("long")
    return retail(spark, sf_dir).v_sales.groupBy("store_id", "cat_id", "dept_id", "state_id", "year").agg(
        F.count(F.lit(1)).alias("n"), total("sales").alias("units"), total("revenue_cents").alias("revenue_cents"), total("snap_active").alias("snap_rows"), total("is_event_day").alias("event_rows"), total("wday").alias("wdays"), total("wm_yr_wk").alias("weeks")
    )


def _money(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col("revenue_cents") / F.lit(100.0)).drop("revenue_cents")


def v_store_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(retail(spark, sf_dir).v_store_daily, "revenue")


def v_store_cat_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(retail(spark, sf_dir).v_store_cat_daily, "revenue")


def v_series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _money(retail(spark, sf_dir).v_series_summary, "total_revenue")
    return df.withColumns({c: rounded(F.col(c), 6) for c in ("mean_daily_units", "sd_daily_units", "cv_daily_units", "zero_share")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    views = {f.__name__: f for f in (v_sales_totals, v_store_daily, v_store_cat_daily, v_series_summary)}
    return views | {name: _named(name) for name in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return dict(STATEMENTS)
