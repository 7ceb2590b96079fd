"""Features that know nothing after a cutoff: rows are cut first, windows see only what is left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["store_id", "item_id"]
LAGS, WINDOWS = (1, 7, 14, 28), (7, 28)
CALENDAR = ["wday", "month", "year", "week_of_year", "is_weekend", "snap_active", "is_event"]
#: What models see: trees cannot extend a year beyond those they have met.
MODEL_CALENDAR = [c for c in CALENDAR if c != "year"]


@dataclass(frozen=True)
class FeatureSet:
    df: DataFrame
    historical_cols: list[str]
    known_future_cols: list[str]

    @property
    def all_feature_cols(self) -> list[str]:
        return [*self.historical_cols, *self.known_future_cols]


def lag_columns(y: str = "sales", lags: tuple[int, ...] = LAGS, keys: list[str] = KEYS) -> dict[str, Column]:
    own = Window.partitionBy(*keys).orderBy("date")
    return {f"lag_{k}": F.lag(y, k).over(own) for k in lags}


def rolling_columns(y: str = "sales", windows: tuple[int, ...] = WINDOWS, keys: list[str] = KEYS) -> dict[str, Column]:
    """Mean, standard deviation and zero share of the w rows before each row. The zero share's divisor counts the row
    before the first too, so a series' second row divides by its place and not by what it has observed."""
    own = Window.partitionBy(*keys).orderBy("date")
    out = {}
    for w in windows:
        past = own.rowsBetween(-w, -1)
        out[f"rolling_mean_{w}"] = F.avg(y).over(past)
        out[f"rolling_std_{w}"] = F.stddev_samp(y).over(past)
        place = F.row_number().over(own)
        out[f"rolling_zero_rate_{w}"] = F.when(place > 1, F.sum(F.when(F.col(y) == 0, 1.0).otherwise(0.0)).over(past) / F.least(place, F.lit(w)))
    return out


def make_lag_features(facts: DataFrame, cutoff, lags: tuple[int, ...] = LAGS) -> DataFrame:
    return facts.where(F.col("date") <= F.lit(cutoff)).select(*KEYS, "date", *[c.alias(n) for n, c in lag_columns(lags=lags).items()])


def make_rolling_features(facts: DataFrame, cutoff, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    return facts.where(F.col("date") <= F.lit(cutoff)).select(*KEYS, "date", *[c.alias(n) for n, c in rolling_columns(windows=windows).items()])


def known_future(calendar: DataFrame, stores: DataFrame) -> DataFrame:
    """Calendar features of each store and day; `wday` counts from Saturday here as everywhere."""
    snap = F.when(F.col("state_id") == "CA", F.col("snap_CA")).when(F.col("state_id") == "TX", F.col("snap_TX")).when(F.col("state_id") == "WI", F.col("snap_WI"))
    days = calendar.crossJoin(F.broadcast(stores.select("store_id", "state_id")))  # stores x days, both dimensions
    return days.select("store_id", "date", "wday", "month", "year", F.weekofyear("date").alias("week_of_year"), F.col("wday").isin(1, 2).cast("int").alias("is_weekend"), F.coalesce(snap, F.lit(0)).alias("snap_active"), F.col("event_name_1").isNotNull().cast("int").alias("is_event"))


def build_fold_features(facts: DataFrame, calendar: DataFrame, stores: DataFrame, cutoff, horizon: int, lags: tuple[int, ...] = LAGS, windows: tuple[int, ...] = WINDOWS) -> tuple[FeatureSet, FeatureSet]:
    """(training set, forecast set): one projection holds all windows; the forecast set carries each series' last row.

    The forecast rows are every training series on each of the `horizon` days, with y null and the lags as they stood at
    the cutoff (so lag_1 there is the day before the cutoff).
    """
    historic = [*lag_columns(lags=lags), *rolling_columns(windows=windows)]
    past = facts.where(F.col("date") <= F.lit(cutoff)).select(*KEYS, "date", F.col("sales").alias("y"), F.col("sales"))
    past = past.withColumns(lag_columns(lags=lags) | rolling_columns(windows=windows)).drop("sales")
    known = known_future(calendar, stores)
    train = past.join(known, ["store_id", "date"], "left")
    last = past.where(F.col("date") == F.lit(cutoff)).select(*KEYS, *historic)
    series = facts.where(F.col("date") <= F.lit(cutoff)).select(*KEYS).distinct()
    days = F.explode(F.sequence(F.date_add(F.lit(cutoff).cast("date"), 1), F.date_add(F.lit(cutoff).cast("date"), horizon)))
    future = series.join(last, KEYS, "left").select("*", days.alias("date"), F.lit(None).cast("int").alias("y")).join(known, ["store_id", "date"], "left")
    return FeatureSet(train, historic, MODEL_CALENDAR), FeatureSet(future.select(train.columns), historic, MODEL_CALENDAR)
