"""Demand profiles: statistics and segments of series, distributions, concentration and price moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.semantics import ratio
from shelfwise.operators.ranking import in_order

KEYS = ["store_id", "item_id"]
ADI, CV2 = 1.32, 0.49


def series_stats(facts: DataFrame) -> DataFrame:
    """A row for each series: days, selling days, zero share, units, mean, demand interval, squared variation of demand.

    One aggregation. The interval is null for a series that never sells, the variation for fewer than two selling days.
    """
    sold = F.when(F.col("sales") > 0, F.col("sales"))
    n, hits = F.count(F.lit(1)), F.count(sold)
    return facts.groupBy(*KEYS).agg(
        n.alias("n_days"), hits.alias("n_nonzero_days"), (F.lit(1.0) - hits / n).alias("zero_share"), F.sum("sales").alias("total_units"), F.avg("sales").alias("mean_daily"),
        ratio(n, hits).alias("adi"), F.pow(F.stddev_samp(sold) / F.avg(sold), 2.0).alias("cv2"),
    )


def classify_demand(stats: DataFrame, adi: float = ADI, cv2: float = CV2) -> DataFrame:
    """Adds segment: smooth, erratic, intermittent or lumpy; unknown where either axis is undefined."""
    rare, varied = F.col("adi") >= adi, F.col("cv2") >= cv2
    known = F.when(rare & varied, "lumpy").when(rare, "intermittent").when(varied, "erratic").otherwise("smooth")
    return stats.withColumn("segment", F.when(F.col("adi").isNull() | F.col("cv2").isNull(), "unknown").otherwise(known))


def segments(facts: DataFrame, adi: float = ADI, cv2: float = CV2) -> DataFrame:
    return classify_demand(series_stats(facts), adi, cv2)


def segment_summary(stats: DataFrame) -> DataFrame:
    """Series, units and zero share of each segment."""
    return stats.groupBy("segment").agg(F.count(F.lit(1)).alias("n_series"), F.sum("total_units").alias("units"), F.avg("zero_share").alias("zero_share"), F.avg("mean_daily").alias("mean_daily"))


def overall_profile(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(*KEYS).alias("n_series"), F.countDistinct("item_id").alias("n_items"), F.countDistinct("store_id").alias("n_stores"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.sum("sales").alias("total_units"), (F.count_if(F.col("sales") == 0) / F.count(F.lit(1))).alias("zero_share"), (F.count_if(F.col("sell_price").isNull()) / F.count(F.lit(1))).alias("unpriced_share"),
    )


def category_summary(facts: DataFrame) -> DataFrame:
    """Items, units and zero share of each category."""
    return facts.groupBy("cat_id").agg(F.countDistinct("item_id").alias("series"), F.sum("sales").alias("units"), F.avg(F.when(F.col("sales") == 0, 1.0).otherwise(0.0)).alias("zero_share"))


def store_summary(facts: DataFrame) -> DataFrame:
    return facts.groupBy("store_id").agg(F.countDistinct("item_id").alias("series"), F.sum("sales").alias("units"))


def regimes(series: DataFrame, stats: DataFrame) -> DataFrame:
    """Demand regimes: of each segment its series, zero share, means, median units, and shares of all series and units."""
    zero = stats.select(*KEYS, "segment", "adi", "cv2", "total_units", "mean_daily").join(series.select(*KEYS, F.col("zero_share").alias("zeros")), KEYS)
    by = zero.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_series"), F.avg("zeros").alias("mean_zero_share"), F.avg("mean_daily").alias("mean_daily_units"), F.percentile("total_units", F.lit(0.5)).alias("median_total_units"),
        F.sum("total_units").alias("total_units"), F.avg("adi").alias("mean_adi"), F.avg("cv2").alias("mean_cv2"),
    )
    all_ = Window.partitionBy()  # a row for each segment
    return by.withColumns({"pct_of_series": 100.0 * F.col("n_series") / F.sum("n_series").over(all_), "pct_of_units": 100.0 * F.col("total_units") / F.sum("total_units").over(all_)})


def composition(stats: DataFrame, series: DataFrame, by: str) -> DataFrame:
    """Series of each segment in each category or store, and their share of the segment."""
    found = stats.select(*KEYS, "segment").join(series.select(*dict.fromkeys([*KEYS, by])), KEYS).groupBy("segment", by).agg(F.count(F.lit(1)).alias("n_series"))
    return found.withColumn("pct_within_segment", 100.0 * F.col("n_series") / F.sum("n_series").over(Window.partitionBy("segment")))


def demand_by(days: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, deviation and number of store-days' units, and the mean's distance from that of all."""
    overall = days.agg(F.avg("units").alias("overall"))
    found = days.groupBy(*by).agg(F.avg("units").alias("mean"), F.percentile("units", F.lit(0.5)).alias("median"), F.stddev_samp("units").alias("sd"), F.count("units").alias("n"), F.sum("units").alias("units"))
    return found.crossJoin(F.broadcast(overall)).withColumn("pct_vs_overall", 100.0 * (F.col("mean") - F.col("overall")) / F.col("overall")).drop("overall")  # one row


def describe(df: DataFrame, x: Column, by: list[str] | None = None) -> DataFrame:
    """Moments and exact percentiles of x, all and where positive; nulls are left out."""
    pos = F.when(x > 0, x)
    at = lambda p: F.percentile(x, F.lit(p))
    return df.where(x.isNotNull()).groupBy(*(by or [])).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), at(0.5).alias("median"), F.stddev_samp(x).alias("sd"), F.min(x).cast("double").alias("min"), at(0.25).alias("p25"), at(0.75).alias("p75"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(x).cast("double").alias("max"),
        (at(0.75) - at(0.25)).alias("iqr"), (F.count_if(x == 0) / F.count(x)).alias("zero_share"), F.when(F.count(x) > 2, F.skewness(x)).alias("skewness"), F.when(F.avg(x) > 0, F.stddev_samp(x) / F.avg(x)).alias("cv"),
        F.count(pos).alias("nonzero_n"), F.avg(pos).alias("nonzero_mean"), F.percentile(pos, F.lit(0.5)).alias("nonzero_median"), F.when(F.avg(pos) > 0, F.stddev_samp(pos) / F.avg(pos)).alias("nonzero_cv"),
    )


def gini(df: DataFrame, x: Column, by: list[str] | None = None) -> DataFrame:
    """Gini coefficient of non-negative x. Equal values are counted together, so the ranking sorts distinct values only."""
    keys = by or []
    if not df.where(x < 0).isEmpty():
        raise ValueError("gini is defined for values that are not negative")
    counts = df.where(x.isNotNull()).groupBy(*keys, x.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("ranks", F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2.0)
    n, total = F.sum("c"), F.sum(F.col("c") * F.col("x"))
    return ranked.groupBy(*keys).agg((2.0 * F.sum(F.col("ranks") * F.col("x")) / F.nullif(n * total.cast("double"), F.lit(0.0)) - (n + 1) / F.when(total != 0, n)).alias("gini"))


def concentration(series: DataFrame, shares: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Share of units that the top p % of series sell (at least one series)."""
    ranked = in_order(series.select("total_units", *KEYS), [F.desc("total_units"), *map(F.col, KEYS)])
    tops = series.sparkSession.createDataFrame([(p,) for p in shares], "top_pct int")
    inside = F.when(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n_rows") * F.col("top_pct") / 100)), F.col("total_units"))
    return ranked.crossJoin(F.broadcast(tops)).groupBy("top_pct").agg((100.0 * F.sum(inside) / F.sum("total_units")).alias("pct_of_units"))


def price_changes(sales: DataFrame) -> DataFrame:
    """Weeks of each series whose price and units have a positive predecessor: percentage moves, and the kind of move."""
    weekly = sales.where(F.col("sell_price").isNotNull()).groupBy(*KEYS, "cat_id", "wm_yr_wk").agg(F.sum("sales").alias("units"), F.avg("sell_price").alias("price"))
    own = Window.partitionBy(*KEYS).orderBy("wm_yr_wk")
    both = weekly.withColumns({"prev_price": F.lag("price").over(own), "prev_units": F.lag("units").over(own)}).where("prev_price > 0 and prev_units > 0")
    move = 100.0 * (F.col("price") / F.col("prev_price") - 1)
    return both.withColumns({"price_pct": move, "units_pct": 100.0 * (F.col("units") / F.col("prev_units") - 1), "price_move": F.when(move < -2, "decrease").when(move > 2, "increase").otherwise("stable")})
