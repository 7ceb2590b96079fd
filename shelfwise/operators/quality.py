"""Checks of a long table and of the model's aggregates, as rows (check, passed, detail)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.plans.binding import Retail
from shelfwise.plans.named import run

KEYS = ["store_id", "item_id"]


def _rows(one: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row of figures as a row for each check."""
    entries = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), d.cast("string").alias("detail")) for n, p, d in checks])
    return one.select(F.explode(entries).alias("r")).select("r.*")


def quality_checks(long: DataFrame, max_unpriced: float = 0.01) -> DataFrame:
    """Seven checks in two aggregations: by row, and by series."""
    core = F.col("store_id").isNull() | F.col("item_id").isNull() | F.col("date").isNull() | F.col("sales").isNull()
    rows = long.agg(
        (F.count(F.lit(1)) - F.countDistinct(*KEYS, "date")).alias("repeated"), F.count_if(core).alias("nulls"), F.count_if(F.col("sales") < 0).alias("negative"), F.count_if(F.col("sell_price") <= 0).alias("priceless"),
        F.coalesce(F.avg(F.when(F.col("is_active"), F.when(F.col("sell_price").isNull(), 1.0).otherwise(0.0))), F.lit(0.0)).alias("unpriced"),
    )
    series = long.groupBy(*KEYS).agg((F.datediff(F.max("date"), F.min("date")) + 1 != F.count(F.lit(1))).alias("gap"), (F.sum("sales") == 0).alias("silent")).agg(F.count_if("gap").alias("gaps"), F.count_if("silent").alias("silent"))
    return _seven(rows.crossJoin(series), max_unpriced)  # one row each


def observed_checks(spark: SparkSession, observed: dict[str, Any], max_unpriced: float = 0.01) -> DataFrame:
    """The same seven checks from what the table's own write observed: the table is not read."""
    names = {"repeated": "repeated_rows", **{c: c for c in ("nulls", "negative", "priceless", "unpriced", "gaps", "silent")}}
    return _seven(spark.range(1).select(*[F.lit(observed[c]).alias(n) for n, c in names.items()]), max_unpriced)


def _seven(one: DataFrame, max_unpriced: float) -> DataFrame:
    zero = lambda c: (F.col(c) == 0, F.col(c))
    checks = [
        ("no_duplicate_series_dates", *zero("repeated")), ("no_nulls_in_core_columns", *zero("nulls")), ("no_negative_sales", *zero("negative")), ("series_are_contiguous_daily", *zero("gaps")),
        ("prices_positive", *zero("priceless")), ("active_rows_mostly_priced", F.col("unpriced") < max_unpriced, F.round("unpriced", 4)), ("few_all_zero_series", *zero("silent")),
    ]
    return _rows(one, checks)


def _structure(model: Retail) -> DataFrame:
    """One row: units, n, duplicate_keys, series_with_gaps, inactive_rows of the facts."""
    if model.observed:
        names = {"units": "units", "n": "n", "duplicate_keys": "repeated_keys", "series_with_gaps": "gaps", "inactive_rows": "inactive"}
        return model.fact_sales.sparkSession.range(1).select(*[F.lit(model.observed[c]).alias(n) for n, c in names.items()])
    one = model.fact_sales.agg(F.sum("sales").alias("units"), F.count(F.lit(1)).alias("n"))
    return one.crossJoin(run(model, "grain_uniqueness")).crossJoin(run(model, "series_date_continuity").select("series_with_gaps")).crossJoin(run(model, "active_flag_check").select("inactive_rows"))


def validate(model: Retail) -> DataFrame:
    """Structure and reconciliation: headline figures reached in two ways must agree. What the facts' own write observed
    is not computed again."""
    view = model.v_sales
    sums = (
        _structure(model)
        .crossJoin(view.agg(F.sum("sales").alias("view_units"), F.count(F.lit(1)).alias("view_n")))
        .crossJoin(run(model, "dimension_key_uniqueness").agg(F.sum(F.col("n_rows") - F.col("n_keys")).alias("repeated_keys")))
        .crossJoin(run(model, "kpi_by_category").agg(F.sum("total_units").alias("category_units"), F.sum("pct_of_total_units").alias("category_share")))
        .crossJoin(model.v_store_daily.agg(F.sum("units").alias("store_units"))).crossJoin(run(model, "abc_classification").agg(F.sum("total_units").alias("abc_units"), F.sum("pct_of_units").alias("abc_share")))
        .crossJoin(view.groupBy("state_id", "date").agg((F.min("snap_active") != F.max("snap_active")).alias("mixed")).agg(F.count_if("mixed").alias("mixed_snap")))
    ).withColumn("fanout_delta", F.col("view_n") - F.col("n"))  # fmt: skip  each side is one row
    same = lambda a, b: (F.col(a) == F.col(b), F.concat_ws(" and ", a, b))
    zero = lambda c: (F.col(c) == 0, F.col(c))
    near = lambda c: (F.abs(F.col(c) - 100) <= 0.5, F.round(c, 2))
    checks = [
        ("grain_is_unique", *zero("duplicate_keys")), ("no_join_fanout", *zero("fanout_delta")), ("dimension_keys_unique", *zero("repeated_keys")), ("series_contiguous", *zero("series_with_gaps")), ("all_rows_active", *zero("inactive_rows")),
        ("view_units_match_fact", *same("view_units", "units")), ("view_rows_match_fact", *same("view_n", "n")), ("category_units_reconcile", *same("category_units", "units")), ("store_units_reconcile", *same("store_units", "units")),
        ("abc_units_reconcile", *same("abc_units", "units")), ("category_shares_sum_to_100", *near("category_share")), ("abc_shares_sum_to_100", *near("abc_share")), ("snap_consistent_within_state", *zero("mixed_snap")),
    ]
    return _rows(sums, checks)
