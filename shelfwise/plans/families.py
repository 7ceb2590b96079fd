"""Queries of the operator families over the retail model, with SQL to check those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.semantics import join_to_one, long, rounded
from shelfwise.operators import backtest, calendar_frames, features, profile, quality, replenishment, stats
from shelfwise.plans import oracle, tablefunctions
from shelfwise.plans.binding import retail
from shelfwise.plans.catalog import bucketed
from shelfwise.plans.oracle import sql
from shelfwise.session import stored
from shelfwise.sources import ingest

KEYS = ["store_id", "item_id"]
ALL = [*backtest.BASELINES, *backtest.SMOOTHERS]


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retail(spark, sf_dir).v_sales


def _bounds(facts: DataFrame) -> tuple[date, date]:
    return tuple(facts.agg(F.min("date"), F.max("date")).first())


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.folds_frame(spark, backtest.generate_folds(*_bounds(retail(spark, sf_dir).dim_calendar)))


def demand_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.segments(_facts(spark, sf_dir)), 6, "zero_share", "mean_daily", "adi", "cv2")


def demand_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.overall_profile(_facts(spark, sf_dir)), 6, "zero_share", "unpriced_share")


def segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.segment_summary(profile.segments(_facts(spark, sf_dir))), 6, "zero_share", "mean_daily")


def sales_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.describe(_facts(spark, sf_dir), F.col("sales"), ["cat_id"])
    return _round(df, 6, *[c for c in df.columns if c not in ("cat_id", "n", "nonzero_n")])


def sales_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.gini(_facts(spark, sf_dir), F.col("sales"), ["store_id"]), 6, "gini")


def sales_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.concentration(retail(spark, sf_dir).v_series_summary), 4, "pct_of_units")


def weekly_price_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = profile.price_changes(_facts(spark, sf_dir))
    by = moves.groupBy("price_move").agg(F.count(F.lit(1)).alias("n"), F.percentile("units_pct", F.lit(0.5)).alias("median_units_pct"), F.avg("price_pct").alias("mean_price_pct"))
    return _round(by, 4, "median_units_pct", "mean_price_pct")


def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.make_lag_features(_facts(spark, sf_dir), _bounds(retail(spark, sf_dir).dim_calendar)[1])


def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.make_rolling_features(_facts(spark, sf_dir), _bounds(retail(spark, sf_dir).dim_calendar)[1])
    return _round(df, 4, *[c for c in df.columns if c.startswith("rolling")])


def forecast_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast set of the last fold: the carried lags and windows on every day of the horizon."""
    m = retail(spark, sf_dir)
    fold = backtest.generate_folds(*_bounds(m.dim_calendar))[-1]
    _, future = features.build_fold_features(m.v_sales, m.dim_calendar, m.dim_store, fold.train_end, 28)
    return _round(future.df.drop("y"), 4, *[c for c in future.historical_cols if c.startswith("rolling")])


def backtest_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir)


_PREDICTED: dict[tuple[str, str], DataFrame] = {}


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest of a folder's model, written once for an application as the model itself is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PREDICTED:
        facts = _facts(spark, sf_dir)
        _PREDICTED[key] = stored(backtest.run_backtest(facts, _folds(spark, sf_dir), profile.segments(facts)), "backtest")
    return _PREDICTED[key]


def backtest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_predictions(spark, sf_dir).drop("state_id", "cat_id"), 6, *ALL)


def _cut(by: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _round(backtest.metric_cut(_predictions(spark, sf_dir), [by], ALL), 5, *backtest.METRICS)


def weekend_and_snap_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.benjamini_hochberg(stats.mann_whitney(stats.demand_tests(retail(spark, sf_dir)), "test", "grp", "x", stats.UNDEFINED))
    found = found.withColumn("effect", stats.effect_label(F.col("delta"))).withColumn("n_x", long(F.col("n_x"))).withColumn("n_y", long(F.col("n_y")))
    return _round(found.drop("p_value", "p_fdr", "significant_fdr"), 6, "u", "delta", "relative_difference", "z")


def demand_test_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tests of demand with one false discovery rate."""
    return _round(stats.test_family(retail(spark, sf_dir)), 5, "statistic", "effect", "p_value", "p_fdr")


def store_kruskal_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = retail(spark, sf_dir).v_store_cat_daily
    found = stats.kruskal(cat.select(F.col("cat_id").alias("test"), F.col("store_id").alias("grp"), F.col("units").alias("x")), "test", "grp", "x", stats.UNDEFINED)
    return _round(found.withColumn("effect", stats.epsilon_label(F.col("epsilon_squared"))), 5, "h", "epsilon_squared", "p_value")


def price_move_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of price and unit moves over the weeks whose price moved."""
    moves = profile.price_changes(_facts(spark, sf_dir)).where("price_move <> 'stable'").select(rounded(F.col("price_pct"), 6).alias("price_pct"), rounded(F.col("units_pct"), 6).alias("units_pct"))
    return _round(stats.spearman(moves, "price_pct", "units_pct"), 6, "rho")


def demand_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir, ["wday"])


def demand_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir, ["month"])


def demand_by_store_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir, ["store_id", "year"])


def _days(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    m = retail(spark, sf_dir)
    return _round(profile.demand_by(m.v_store_daily.join(m.dim_calendar.select("date", "wday", "month", "year"), "date"), by), 4, "mean", "median", "sd", "pct_vs_overall")


def demand_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = retail(spark, sf_dir)
    df = profile.regimes(m.v_series_summary, profile.segments(m.v_sales))
    return _round(df, 5, *[c for c in df.columns if c not in ("segment", "n_series", "total_units")])


def regimes_of_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = retail(spark, sf_dir)
    return _round(profile.composition(profile.segments(m.v_sales), m.v_series_summary, "cat_id"), 5, "pct_within_segment")


def regimes_of_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = retail(spark, sf_dir)
    return _round(profile.composition(profile.segments(m.v_sales), m.v_series_summary.withColumn("at_store", F.col("store_id")), "at_store"), 5, "pct_within_segment")


def category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.category_summary(_facts(spark, sf_dir)), 6, "zero_share")


def store_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.store_summary(_facts(spark, sf_dir))


def best_methods_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(backtest.best_methods(_predictions(spark, sf_dir), ALL), 5, "mae_1", "mae_2", "mae_3")


def cold_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a range that a store takes up after the third training end: its series are cold in that fold."""
    folds = _folds(spark, sf_dir)
    third = folds.where("fold_id = 3").first()
    facts = _facts(spark, sf_dir)
    late = (F.col("store_id") == "ASIA") & (F.col("date") <= F.lit(third.train_end)) if third else F.lit(False)
    return backtest.cold_series(facts.where(~late), folds)


def _model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest with the global model beside the other methods; written once for an application."""
    from shelfwise.plans.forecast import global_backtest

    key = (spark.sparkContext.applicationId, f"{sf_dir} model")
    if key not in _PREDICTED:
        m = retail(spark, sf_dir)
        folds = backtest.generate_folds(*_bounds(m.dim_calendar))
        found = _predictions(spark, sf_dir).join(global_backtest(m.v_sales, m.dim_calendar, m.dim_store, folds), ["fold_id", *KEYS, "date"], "left")
        _PREDICTED[key] = stored(found, "model-backtest")
    return _PREDICTED[key]


def global_model_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the global model beside the baselines: in each fold, a model of the fold's training days."""
    return backtest.metric_cut(_model_predictions(spark, sf_dir), ["fold_id"], [*backtest.BASELINES, "global_model"])


def model_replenishment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain with one model: its forecast, its error in each segment of the backtest as risk, and the orders that follow."""
    report = backtest.metric_cut(_model_predictions(spark, sf_dir), ["segment"], ["global_model"])
    return replenishment.recommendations(global_model_forecast(spark, sf_dir), replenishment.Policy(), risk=replenishment.segment_risk(report, "global_model"), history=_history(spark, sf_dir))


def category_mean_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the mean daily sale of each category, over all facts."""
    return _round(stats.poisson_bootstrap(_facts(spark, sf_dir), ["cat_id"], "sales", ["store_id", "item_id", "date"]), 5, "estimate", "low", "high")


def weekend_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a category sells otherwise at weekends, over all facts."""
    facts = _facts(spark, sf_dir).withColumn("weekend", F.col("wday").isin(1, 2))
    return _round(stats.hashed_permutations(facts, "cat_id", "weekend", "sales", ["store_id", "item_id", "date"]), 5, "difference", "p_permutation")


def store_mean_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_ci(retail(spark, sf_dir).v_store_daily, ["store_id"], "units", "date")


def weekend_difference_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = stats.demand_tests(retail(spark, sf_dir)).where(F.col("test").startswith("weekend"))
    return stats.two_group_resampling(tests, "test", "grp", "x", "date")


def long_table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_checks(retail(spark, sf_dir).fact_sales)


def written_table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of `long_table_checks` from what the write of the star schema observed: the facts are not read."""
    return quality.observed_checks(spark, retail(spark, sf_dir).observed)


def rolling_sold_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling sales over calendar days of series that have rows only where something was sold."""
    sold = _facts(spark, sf_dir).where("sales > 0").select(*KEYS, "date", "sales")
    df = calendar_frames.rolling_days(sold, KEYS, "sales")
    return _round(df, 4, *[c for c in df.columns if c.startswith(("mean_", "sd_"))])


def bucketed_lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lag_features` over the catalog's buckets."""
    m = bucketed(spark, sf_dir)
    return features.make_lag_features(m.v_sales, _bounds(m.dim_calendar)[1])


def bucketed_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`rolling_features` over the catalog's buckets."""
    m = bucketed(spark, sf_dir)
    df = features.make_rolling_features(m.v_sales, _bounds(m.dim_calendar)[1])
    return _round(df, 4, *[c for c in df.columns if c.startswith("rolling")])


def bucketed_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`backtest_predictions` over the catalog's buckets."""
    facts = bucketed(spark, sf_dir).v_sales
    return _round(backtest.run_backtest(facts, _folds(spark, sf_dir), profile.segments(facts)).drop("state_id", "cat_id"), 6, *ALL)


def _function(name: str, **given: float) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tablefunctions.call(retail(spark, sf_dir), spark, name, **given)


#: Table functions with other arguments than the registry's defaults.
CALLS = {
    "function_top_products": ("top_products_per_store", {"top_n": 5}), "function_declining": ("declining_products", {"min_prior_units": 10, "top_n": 25}), "function_volatility": ("product_volatility", {"min_total_units": 50, "top_n": 40}),
    "function_low_demand": ("persistent_low_demand", {"max_mean_daily": 6.0, "min_zero_share": 0.6}), "function_event_impact": ("named_event_impact", {"min_occurrences": 2}),
}


def model_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate(retail(spark, sf_dir))


def ingested_long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales of the model made wide, a column for each day (0 before a series begins), and brought back by the ingestion:
    unpivot, calendar, prices, active days from the first priced one."""
    m = retail(spark, sf_dir)
    days = [r[0] for r in m.dim_calendar.select("d").orderBy("date").collect()]  # column names
    calendar = m.dim_calendar.withColumn("weekday", F.date_format("date", "EEEE"))
    wide = m.fact_sales.join(m.dim_product, "item_id").join(m.dim_store, "store_id").withColumn("id", F.concat_ws("_", "item_id", "store_id")).groupBy(*ingest.IDS).pivot("d", days).agg(F.first("sales")).fillna(0)
    prices = m.dim_price.select("store_id", "item_id", "wm_yr_wk", "sell_price")
    table = ingest.build_long_table(stored(wide, "wide-sales"), calendar, prices)
    return table.select("store_id", "item_id", "date", "d", "sales", "sell_price", "active_from", "wday", "event_name_1")


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast that SQL can say too: the mean of the last 28 days on each of 28 days."""
    facts = _facts(spark, sf_dir)
    last = _bounds(retail(spark, sf_dir).dim_calendar)[1]
    means = facts.where(F.col("date") > F.date_sub(F.lit(last), 28)).groupBy(*KEYS).agg(F.avg("sales").alias("forecast_units"))
    return join_to_one(means, profile.segments(facts).select(*KEYS, "segment"), KEYS).select("*", F.explode(F.sequence(F.lit(1), F.lit(28))).alias("horizon_day"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).groupBy(*KEYS).agg(F.avg("sales").alias("historical_mean_sales"))


def replenishment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with an inventory of nine days of history, none for one store and backorders for an item."""
    stock = _history(spark, sf_dir).where("store_id <> 'ASIA'").select(*KEYS, F.when(F.col("item_id") == "M2", -5.0).otherwise(rounded(F.col("historical_mean_sales") * 9, 2)).alias("inventory_position"))
    out = replenishment.recommendations(_forecast(spark, sf_dir), replenishment.Policy(outlier_multiplier=1.05), stock, history=_history(spark, sf_dir))
    return _round(out, 4, "forecast_daily_mean", "safety_stock", "reorder_point", "recommended_order_qty")


def replenishment_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the scenario without an inventory table, with the error of each segment's backtest as its risk."""
    report = backtest.metric_cut(_predictions(spark, sf_dir), ["segment"], ALL)
    out = replenishment.recommendations(_forecast(spark, sf_dir), replenishment.Policy(), risk=replenishment.segment_risk(report, "ses"), history=_history(spark, sf_dir))
    return _round(out, 3, "forecast_daily_mean", "inventory_position", "safety_stock", "reorder_point", "recommended_order_qty")


def forecast_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replenishment.risk_summary(_forecast(spark, sf_dir), replenishment.Policy(), history=_history(spark, sf_dir))
    return _round(out, 4, "forecast_daily_mean", "safety_stock_z", "safety_stock", "reorder_point_demand_only")


def global_model_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfwise.plans.forecast import production_forecast

    m = retail(spark, sf_dir)
    return production_forecast(m.v_sales, m.dim_calendar, m.dim_store, profile.segments(m.v_sales))[0]


STATS = """, k AS (SELECT store_id, item_id, count(*) AS n_days, count(*) FILTER (sales > 0) AS n_nonzero_days, CAST(sum(sales) AS BIGINT) AS total_units, avg(sales) AS mean_daily,
  avg(sales) FILTER (sales > 0) AS ym, stddev_samp(sales) FILTER (sales > 0) AS ys FROM v_sales GROUP BY 1, 2),
seg AS (SELECT *, 1 - n_nonzero_days / n_days AS zero_share, n_days / nullif(n_nonzero_days, 0) AS adi, (ys / ym) ** 2 AS cv2 FROM k),
segs AS (SELECT *, CASE WHEN adi IS NULL OR cv2 IS NULL THEN 'unknown' WHEN adi >= 1.32::DOUBLE AND cv2 >= 0.49::DOUBLE THEN 'lumpy' WHEN adi >= 1.32::DOUBLE THEN 'intermittent' WHEN cv2 >= 0.49::DOUBLE THEN 'erratic' ELSE 'smooth' END AS segment FROM seg)
"""
FOLDS = """, folds AS (SELECT CAST(5 - i AS INT) AS fold_id, lo AS train_start, hi - 28 - 28 * i AS train_end FROM (SELECT lo, hi, CAST(unnest(range(5)) AS INT) AS i FROM span) WHERE hi - 28 - 28 * i - lo >= 730)
"""
PREDICTIONS = (
    STATS
    + FOLDS
    + """, tr AS (SELECT f.fold_id, f.train_end, s.store_id, s.item_id, s.date, s.sales AS y, row_number() OVER w AS rn, count(*) OVER p AS n, row_number() OVER (w2) AS back,
    count(*) FILTER (s.sales > 0) OVER p AS m, count(*) FILTER (s.sales > 0) OVER w AS j FROM v_sales s JOIN folds f ON s.date <= f.train_end
    WINDOW p AS (PARTITION BY f.fold_id, s.store_id, s.item_id), w AS (PARTITION BY f.fold_id, s.store_id, s.item_id ORDER BY s.date), w2 AS (PARTITION BY f.fold_id, s.store_id, s.item_id ORDER BY s.date DESC)),
nz AS (SELECT *, rn - coalesce(lag(rn) OVER (PARTITION BY fold_id, store_id, item_id ORDER BY date), 0) AS gap FROM tr WHERE y > 0),
nzs AS (SELECT fold_id, store_id, item_id, sum(CASE WHEN j = 1 THEN 0.9::DOUBLE ** (m - 1) ELSE 0.1::DOUBLE * 0.9::DOUBLE ** (m - j) END * y) AS z, sum(CASE WHEN j = 1 THEN 0.9::DOUBLE ** (m - 1) ELSE 0.1::DOUBLE * 0.9::DOUBLE ** (m - j) END * gap) AS p,
    0.9::DOUBLE ** any_value(m) * avg(y) + sum(0.1::DOUBLE * 0.9::DOUBLE ** (m - j) * y) AS tz, 0.9::DOUBLE ** any_value(n) * any_value(m) / any_value(n) + sum(0.1::DOUBLE * 0.9::DOUBLE ** (n - rn)) AS tp FROM nz GROUP BY 1, 2, 3),
mod AS (SELECT t.fold_id, t.store_id, t.item_id, max(y) FILTER (back = 1)::DOUBLE AS naive, avg(y) FILTER (back <= 7) AS ma7, avg(y) FILTER (back <= 28) AS ma28,
    0.9::DOUBLE ** any_value(n) * avg(y) FILTER (rn <= 10) + sum(0.1::DOUBLE * 0.9::DOUBLE ** (n - rn) * y) AS ses FROM tr t GROUP BY 1, 2, 3),
pred AS (SELECT f.fold_id, s.store_id, s.item_id, s.date, s.sales AS actual, s.cat_id, CAST(s.date - f.train_end AS INT) AS horizon_day, coalesce(g.segment, 'unknown') AS segment, m.naive, w.y::DOUBLE AS seasonal_naive, m.ma7, m.ma28, 0.0::DOUBLE AS zero, m.ses,
    CASE WHEN m.store_id IS NOT NULL THEN coalesce(z.z / z.p, 0) END AS croston, CASE WHEN m.store_id IS NOT NULL THEN coalesce(z.z / z.p, 0) * 0.95::DOUBLE END AS sba, CASE WHEN m.store_id IS NOT NULL THEN coalesce(z.tz * z.tp, 0) END AS tsb
  FROM v_sales s JOIN folds f ON s.date > f.train_end AND s.date <= f.train_end + 28 LEFT JOIN mod m USING (fold_id, store_id, item_id) LEFT JOIN nzs z USING (fold_id, store_id, item_id)
    LEFT JOIN tr w ON w.fold_id = f.fold_id AND w.store_id = s.store_id AND w.item_id = s.item_id AND w.date = s.date - 7 LEFT JOIN segs g ON g.store_id = s.store_id AND g.item_id = s.item_id)
"""
)
METRICS = """, mel AS (SELECT fold_id, segment, horizon_day, store_id, cat_id, method, CAST(actual AS DOUBLE) AS a, forecast AS f FROM (UNPIVOT (FROM pred) ON naive, seasonal_naive, ma7, ma28, zero, ses, croston, sba, tsb INTO NAME method VALUE forecast)),
full_n AS (SELECT {by}, method, count(*) FILTER (a > 0) AS n_nonzero_actual FROM (SELECT {by}, actual AS a, unnest(['naive', 'seasonal_naive', 'ma7', 'ma28', 'zero', 'ses', 'croston', 'sba', 'tsb']) AS method FROM pred) GROUP BY 1, 2)
SELECT {by}, method, CAST(coalesce(n, 0) AS BIGINT) AS n_obs, n_nonzero_actual, mae, wape, rmse, bias, smape, mape FROM full_n LEFT JOIN (
SELECT {by}, method, count(*) AS n, round(avg(abs(f - a)), 5) AS mae, round(sum(abs(f - a)) / nullif(sum(abs(a)), 0), 5) AS wape, round(sqrt(avg((f - a) ** 2)), 5) AS rmse, round(avg(f - a), 5) AS bias,
round(avg(CASE WHEN abs(a) + abs(f) = 0 THEN 0 ELSE 2 * abs(f - a) / (abs(a) + abs(f)) END), 5) AS smape, round(avg(abs(f - a) / a) FILTER (a > 0), 5) AS mape FROM mel GROUP BY 1, 2) USING ({by}, method)"""
TESTS = """, cal AS (SELECT date, CAST(wday <= 2 AS INT) AS weekend, event_name_1 FROM dim_calendar),
obs AS (
  SELECT 'weekend ' || store_id AS test, weekend AS g, units AS x FROM v_store_daily JOIN cal USING (date)
  UNION ALL SELECT 'snap ' || store_id, snap_active, units FROM v_store_daily
  UNION ALL SELECT 'snap ' || c.cat_id, d.snap_active, c.units FROM v_store_cat_daily c JOIN v_store_daily d USING (store_id, date)
  UNION ALL SELECT 'event ' || store_id, CAST(event_name_1 IS NOT NULL AS INT), units FROM v_store_daily JOIN cal USING (date) WHERE event_name_1 IS DISTINCT FROM 'Christmas'),
rk AS (SELECT *, rank() OVER (PARTITION BY test ORDER BY x) + (count(*) OVER (PARTITION BY test, x) - 1) / 2 AS r FROM obs),
tie AS (SELECT test, sum(c::DOUBLE ** 3 - c) AS t FROM (SELECT test, x, count(*) AS c FROM obs GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT test, count(*) FILTER (g = 1) AS a, count(*) FILTER (g = 0) AS b, sum(r) FILTER (g = 1) AS r, avg(x) FILTER (g = 1) AS mx, avg(x) FILTER (g = 0) AS my FROM rk GROUP BY 1),
u AS (SELECT *, r - a * (a + 1) / 2 AS u, a + b AS n FROM s JOIN tie USING (test))
SELECT test, a AS n_x, b AS n_y, round(u, 6) AS u, round(2 * u / (a * b) - 1, 6) AS delta, round(100 * (mx - my) / my, 6) AS relative_difference,
round(greatest(0, abs(u - a * b / 2) - 0.5::DOUBLE) / sqrt(a * b / 12 * (n + 1 - t / (n * (n - 1)))), 6) AS z,
CASE WHEN abs(2 * u / (a * b) - 1) < 0.147::DOUBLE THEN 'negligible' WHEN abs(2 * u / (a * b) - 1) < 0.33::DOUBLE THEN 'small' WHEN abs(2 * u / (a * b) - 1) < 0.474::DOUBLE THEN 'medium' ELSE 'large' END AS effect FROM u"""
#: P-values in SQL, by the same finite sums and the same polynomial as in `operators.stats`.
ERFC = ["0.17087277", "-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368", "-1.26551223"]


def _normal_tail(z: str) -> str:
    x, t = f"(({z}) / sqrt(2.0::DOUBLE))", f"(1 / (1 + 0.5::DOUBLE * ({z}) / sqrt(2.0::DOUBLE)))"
    poly = f"{ERFC[0]}::DOUBLE"
    for c in ERFC[1:]:
        poly = f"({c}::DOUBLE + {t} * {poly})"
    return f"({t} * exp(-{x} * {x} + {poly}))"


def _chi_square_tail(x: str, df: str) -> str:
    even = f"exp(-{x} / 2) * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda i: pow({x} / 2, i) / gamma(i + 1)))"
    odd = f"coalesce(exp(-{x} / 2) * list_sum(list_transform(range(1, CAST({df} // 2 AS BIGINT) + 1), lambda i: pow({x} / 2, i - 0.5::DOUBLE) / gamma(i + 0.5::DOUBLE))), 0)"
    return f"CASE WHEN {x} <= 0 THEN 1 WHEN {df} % 2 = 0 THEN {even} ELSE {odd} + {_normal_tail(f'sqrt({x})')} END"


FORECAST = """, fc AS (SELECT store_id, item_id, avg(sales) AS mean FROM v_sales WHERE date > (SELECT hi FROM span) - 28 GROUP BY 1, 2), past AS (SELECT store_id, item_id, avg(sales) AS past FROM v_sales GROUP BY 1, 2),
base AS (SELECT f.store_id, f.item_id, f.mean, p.past, s.segment FROM fc f JOIN past p USING (store_id, item_id) JOIN segs s USING (store_id, item_id)), c AS (SELECT 1.6448536269514722::DOUBLE AS z)
"""
DECIDE = """SELECT store_id, item_id, segment, 28::BIGINT AS forecast_horizon, round(mean, {d}) AS forecast_daily_mean, {inv} AS inventory_position, 7.0::DOUBLE AS lead_time_days, round(ss, {d}) AS safety_stock, round(mean * 7 + ss, {d}) AS reorder_point,
CASE WHEN inv IS NULL THEN NULL ELSE round(CASE WHEN mean = 0 THEN greatest(ss - inv, 0) WHEN inv < mean * 7 + ss THEN greatest(mean * 14 + ss - inv, 0) ELSE 0 END, {d}) END AS recommended_order_qty,
CASE WHEN inv IS NULL THEN 'missing_inventory_data' WHEN mean = 0 AND inv >= ss THEN 'zero_forecast_no_order' WHEN mean = 0 OR inv < mean * 7 + ss THEN 'inventory_position_below_reorder_point' ELSE 'inventory_position_at_or_above_target' END AS decision_reason,
CASE WHEN inv IS NULL THEN 'INSUFFICIENT_DATA' WHEN past > 0 AND mean > {k}::DOUBLE * past THEN 'HIGH_FORECAST_OUTLIER' WHEN inv <= 0 OR inv < ss THEN 'STOCKOUT_RISK' WHEN segment IN ('intermittent', 'lumpy', 'unknown') THEN 'HIGH_UNCERTAINTY_SEGMENT' ELSE 'LOW_RISK' END AS risk_flag FROM dec"""
ROLL = "round(avg(sales) OVER {w}, 4) AS rolling_mean_{n}, round(stddev_samp(sales) OVER {w}, 4) AS rolling_std_{n}, round(CASE WHEN row_number() OVER o > 1 THEN count(*) FILTER (sales = 0) OVER {w} / least(row_number() OVER o, {n}) END, 4) AS rolling_zero_rate_{n}"
ROLLS = ROLL.format(w="a", n=7) + ", " + ROLL.format(w="b", n=28)
WINDOWS = "WINDOW o AS (PARTITION BY store_id, item_id ORDER BY date), a AS (PARTITION BY store_id, item_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY store_id, item_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)"
LAGGED = "lag(sales, 1) OVER o AS lag_1, lag(sales, 7) OVER o AS lag_7, lag(sales, 14) OVER o AS lag_14, lag(sales, 28) OVER o AS lag_28"
Q = "quantile_cont(sales, {})"

TESTED = TESTS.rpartition("\nSELECT test, a AS n_x")[0].replace("u AS (SELECT *, r - a", "mw AS (SELECT *, r - a")
OMNIBUS = """, ob AS (SELECT 'stores' AS test, store_id AS g, units::DOUBLE AS x FROM v_store_daily UNION ALL SELECT 'categories', cat_id, units FROM v_store_cat_daily UNION ALL SELECT 'zero share of categories', cat_id, zero_share FROM v_series_summary),
okr AS (SELECT *, rank() OVER (PARTITION BY test ORDER BY x) + (count(*) OVER (PARTITION BY test, x) - 1) / 2 AS r FROM ob WHERE (test, g) IN (SELECT (test, g) FROM ob GROUP BY test, g HAVING count(*) >= 2)),
ot AS (SELECT test, sum(c::DOUBLE ** 3 - c) AS t FROM (SELECT test, count(*) AS c FROM okr GROUP BY test, x) GROUP BY 1),
og AS (SELECT test, count(*) AS k, sum(n)::DOUBLE AS n, sum(s * s / n) AS q FROM (SELECT test, g, count(*) AS n, sum(r) AS s FROM okr GROUP BY 1, 2) GROUP BY 1),
oh AS (SELECT test, k, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) AS h FROM og JOIN ot USING (test)),
oe AS (SELECT *, greatest(0, (h - k + 1) / (n - k)) AS e FROM oh)"""
FAMILY = TESTED + OMNIBUS + f""", fz AS (SELECT test, u, 2 * u / (a * b) - 1 AS d, greatest(0, abs(u - a * b / 2) - 0.5::DOUBLE) / sqrt(a * b / 12 * (n + 1 - t / (n * (n - 1)))) AS z FROM mw),
fam AS (SELECT test, 'mann_whitney' AS kind, u AS statistic, d AS effect, CASE WHEN abs(d) < 0.147::DOUBLE THEN 'negligible' WHEN abs(d) < 0.33::DOUBLE THEN 'small' WHEN abs(d) < 0.474::DOUBLE THEN 'medium' ELSE 'large' END AS label, {_normal_tail('z')} AS p FROM fz
  UNION ALL SELECT test, 'kruskal', h, e, CASE WHEN e < 0.01::DOUBLE THEN 'negligible' WHEN e < 0.06::DOUBLE THEN 'small' WHEN e < 0.14::DOUBLE THEN 'medium' ELSE 'large' END, {_chi_square_tail('h', '(k - 1)')} FROM oe),
raw AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q FROM fam), adj AS (SELECT *, least(1.0::DOUBLE, min(q) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f FROM raw)
SELECT test, kind, round(statistic, 5) AS statistic, round(effect, 5) AS effect, label, round(p, 5) AS p_value, round(f, 5) AS p_fdr, f <= 0.05::DOUBLE AS significant_fdr FROM adj"""
VALIDATION = """, q AS (SELECT
  (SELECT count(*) FROM (SELECT 1 FROM fact_sales GROUP BY item_id, store_id, date HAVING count(*) > 1)) AS dup, (SELECT count(*) FROM v_sales) - (SELECT count(*) FROM fact_sales) AS fan,
  (SELECT count(*) - count(DISTINCT item_id) FROM dim_product) + (SELECT count(*) - count(DISTINCT store_id) FROM dim_store) + (SELECT count(*) - count(DISTINCT date) FROM dim_calendar) + (SELECT count(*) - count(DISTINCT (store_id, item_id, wm_yr_wk)) FROM dim_price) AS rep,
  (SELECT count(*) FILTER (n <> d) FROM (SELECT count(*) AS n, max(date) - min(date) + 1 AS d FROM fact_sales GROUP BY item_id, store_id)) AS gaps, (SELECT count(*) FILTER (NOT is_active) FROM fact_sales) AS off,
  CAST((SELECT sum(sales) FROM fact_sales) AS BIGINT) AS units, (SELECT count(*) FROM fact_sales) AS n, CAST((SELECT sum(sales) FROM v_sales) AS BIGINT) AS vu, (SELECT count(*) FROM v_sales) AS vn, CAST((SELECT sum(units) FROM v_store_daily) AS BIGINT) AS su,
  (SELECT count(*) FROM (SELECT 1 FROM v_sales GROUP BY state_id, date HAVING min(snap_active) <> max(snap_active))) AS mixed,
  (SELECT sum(round(100 * u / t, 2)) FROM (SELECT cat_id, sum(sales) AS u, (SELECT sum(sales) FROM v_sales) AS t FROM v_sales GROUP BY 1)) AS cs,
  (SELECT sum(round(100 * u / t, 2)) FROM (SELECT c, sum(total_units) AS u, any_value(t) AS t FROM (SELECT total_units, t, CASE WHEN x / t <= 0.8::DOUBLE THEN 'A' WHEN x / t <= 0.95::DOUBLE THEN 'B' ELSE 'C' END AS c
    FROM (SELECT total_units, sum(total_units) OVER (ORDER BY total_units DESC, item_id, store_id ROWS UNBOUNDED PRECEDING) AS x, (SELECT sum(total_units) FROM v_series_summary)::DOUBLE AS t FROM v_series_summary)) GROUP BY 1)) AS abs_)
SELECT 'grain_is_unique' AS "check", dup = 0 AS passed, dup::VARCHAR AS detail FROM q UNION ALL SELECT 'no_join_fanout', fan = 0, fan::VARCHAR FROM q UNION ALL SELECT 'dimension_keys_unique', rep = 0, rep::VARCHAR FROM q UNION ALL SELECT 'series_contiguous', gaps = 0, gaps::VARCHAR FROM q
UNION ALL SELECT 'all_rows_active', off = 0, off::VARCHAR FROM q UNION ALL SELECT 'view_units_match_fact', vu = units, vu || ' and ' || units FROM q UNION ALL SELECT 'view_rows_match_fact', vn = n, vn || ' and ' || n FROM q UNION ALL SELECT 'category_units_reconcile', vu = units, vu || ' and ' || units FROM q
UNION ALL SELECT 'store_units_reconcile', su = units, su || ' and ' || units FROM q UNION ALL SELECT 'abc_units_reconcile', vu = units, vu || ' and ' || units FROM q UNION ALL SELECT 'category_shares_sum_to_100', abs(cs - 100) <= 0.5, round(cs, 2)::DOUBLE::VARCHAR FROM q
UNION ALL SELECT 'abc_shares_sum_to_100', abs(abs_ - 100) <= 0.5, round(abs_, 2)::DOUBLE::VARCHAR FROM q UNION ALL SELECT 'snap_consistent_within_state', mixed = 0, mixed::VARCHAR FROM q"""
DAYS = """, dd AS (SELECT * FROM v_store_daily JOIN (SELECT date, wday, month, year FROM dim_calendar) USING (date))
SELECT {by}, round(avg(units), 4) AS mean, round(median(units), 4) AS median, round(stddev_samp(units), 4) AS sd, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, round(100 * (avg(units) - (SELECT avg(units) FROM dd)) / (SELECT avg(units) FROM dd), 4) AS pct_vs_overall FROM dd GROUP BY {by}"""
REGIMES = STATS + ", both_ AS (SELECT s.segment, s.adi, s.cv2, s.total_units, s.mean_daily, v.zero_share AS zs, v.cat_id, v.store_id FROM segs s JOIN v_series_summary v USING (store_id, item_id)) "

SEED = "('0x' || substr(md5({}), 1, 7))::BIGINT"


def _draw(seed: str, replicate: str) -> str:
    """`operators.stats.draw` in SQL, as nested selects: h3 of the last one is what was drawn."""
    p = stats.PRIME
    step = lambda h, k: f"({h} * {h} + {k} * {h} + {replicate} + {seed} // {p}) % {p}"
    return f"(SELECT *, {step('h2', 15_485_863 % p)} AS h3 FROM (SELECT *, {step('h1', 611_953)} AS h2 FROM (SELECT *, {step('h0', 104_729)} AS h1 FROM (SELECT *, ({seed} % {p} + {replicate} * 7919) % {p} AS h0 FROM rep))))"


RESAMPLED = f""", seeds AS (SELECT cat_id, sales::DOUBLE AS x, CAST(wday <= 2 AS INT) AS g, {SEED.format("{key}")} AS s FROM v_sales),
rep AS (SELECT cat_id, x, g, s, r FROM seeds, (SELECT unnest(range(0, 101)) AS r)), drawn AS (SELECT cat_id, x, g, r, h3 / {stats.PRIME}::DOUBLE AS u FROM {_draw('s', 'r')})"""

BODIES = {
    "category_mean_intervals": RESAMPLED.replace("{key}", "store_id || '|' || item_id || '|' || date") + f""", w AS (SELECT cat_id, r, x, CASE WHEN r = 0 THEN 1 ELSE {' + '.join(f'CAST(u >= {t!r}::DOUBLE AS INT)' for t in stats.POISSON)} END AS w FROM drawn),
        m AS (SELECT cat_id, r, sum(w * x) / sum(w) AS mean, sum(w) AS n FROM w GROUP BY 1, 2)
        SELECT cat_id, CAST(max(n) FILTER (r = 0) AS BIGINT) AS n, round(max(mean) FILTER (r = 0), 5) AS estimate, round(quantile_cont(mean, 0.025) FILTER (r > 0), 5) AS low, round(quantile_cont(mean, 0.975) FILTER (r > 0), 5) AS high FROM m GROUP BY 1""",
    "weekend_permutations": RESAMPLED.replace("{key}", "cat_id || '|' || store_id || '|' || item_id || '|' || date") + """, c AS (SELECT cat_id, avg(g) AS share FROM seeds GROUP BY 1),
        o AS (SELECT cat_id, r, x, CASE WHEN r = 0 THEN g = 1 ELSE u < share END AS one FROM drawn JOIN c USING (cat_id)),
        m AS (SELECT cat_id, r, count(*) FILTER (one) AS a, count(*) FILTER (NOT one) AS b, avg(x) FILTER (one) - avg(x) FILTER (NOT one) AS d FROM o GROUP BY 1, 2),
        t AS (SELECT cat_id, a, b, d FROM m WHERE r = 0)
        SELECT t.cat_id AS test, t.a AS n_x, t.b AS n_y, round(t.d, 5) AS difference, round((1 + count(*) FILTER (abs(m.d) >= abs(t.d) - 1e-9)) / 101.0::DOUBLE, 5) AS p_permutation FROM t JOIN m ON m.cat_id = t.cat_id AND m.r > 0 GROUP BY ALL""",
    "demand_test_family": FAMILY,
    "model_validation": VALIDATION,
    "demand_by_weekday": DAYS.format(by="wday"),
    "demand_by_month": DAYS.format(by="month"),
    "demand_by_store_year": DAYS.format(by="store_id, year"),
    "demand_regimes": REGIMES + """SELECT segment, count(*) AS n_series, round(avg(zs), 5) AS mean_zero_share, round(avg(mean_daily), 5) AS mean_daily_units, round(median(total_units), 5) AS median_total_units, CAST(sum(total_units) AS BIGINT) AS total_units, round(avg(adi), 5) AS mean_adi,
        round(avg(cv2), 5) AS mean_cv2, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 5) AS pct_of_series, round(100.0::DOUBLE * sum(total_units) / sum(sum(total_units)) OVER (), 5) AS pct_of_units FROM both_ GROUP BY 1""",
    **{f"regimes_of_{n}": REGIMES + f"SELECT segment, {c} AS {name}, count(*) AS n_series, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY segment), 5) AS pct_within_segment FROM both_ GROUP BY segment, {c}" for n, c, name in (("categories", "cat_id", "cat_id"), ("stores", "store_id", "at_store"))},
    "category_profile": "SELECT cat_id, count(DISTINCT item_id) AS series, CAST(sum(sales) AS BIGINT) AS units, round(count(*) FILTER (sales = 0) / count(*), 6) AS zero_share FROM v_sales GROUP BY 1",
    "store_profile": "SELECT store_id, count(DISTINCT item_id) AS series, CAST(sum(sales) AS BIGINT) AS units FROM v_sales GROUP BY 1",
    "price_move_correlation": """, w AS (SELECT store_id, item_id, wm_yr_wk, sum(sales) AS u, avg(sell_price) AS p FROM v_sales WHERE sell_price IS NOT NULL GROUP BY 1, 2, 3),
        k AS (SELECT u, p, lag(p) OVER o AS pp, lag(u) OVER o AS pu FROM w WINDOW o AS (PARTITION BY store_id, item_id ORDER BY wm_yr_wk)), d AS (SELECT 100 * (p / pp - 1) AS dp, 100 * (u / pu - 1) AS du FROM k WHERE pp > 0 AND pu > 0),
        e AS (SELECT round(dp, 6) AS dp, round(du, 6) AS du FROM d WHERE dp < -2 OR dp > 2), rr AS (SELECT rank() OVER (ORDER BY dp) + (count(*) OVER (PARTITION BY dp) - 1) / 2 AS a, rank() OVER (ORDER BY du) + (count(*) OVER (PARTITION BY du) - 1) / 2 AS b FROM e)
        SELECT round(corr(a, b), 6) AS rho FROM rr""",
    "best_methods_by_horizon": PREDICTIONS + """, mel AS (SELECT fold_id, horizon_day, method, abs(forecast - CAST(actual AS DOUBLE)) AS e FROM (UNPIVOT (FROM pred) ON naive, seasonal_naive, ma7, ma28, zero, ses, croston, sba, tsb INTO NAME method VALUE forecast)),
        o AS (SELECT method, row_number() OVER (ORDER BY round(m, 9), method) AS k FROM (SELECT method, avg(mae) AS m FROM (SELECT fold_id, method, avg(e) AS mae FROM mel GROUP BY 1, 2) GROUP BY 1) QUALIFY k <= 3),
        b AS (SELECT horizon_day, k, method, avg(mae) AS mae FROM (SELECT fold_id, horizon_day, method, avg(e) AS mae FROM mel GROUP BY 1, 2, 3) JOIN o USING (method) GROUP BY 1, 2, 3)
        SELECT horizon_day, """ + ", ".join(f"max(method) FILTER (k = {k}) AS method_{k}, round(max(mae) FILTER (k = {k}), 5) AS mae_{k}" for k in (1, 2, 3)) + " FROM b GROUP BY 1",
    "cold_series": FOLDS + ", taken AS (SELECT * FROM v_sales WHERE NOT (store_id = 'ASIA' AND date <= (SELECT train_end FROM folds WHERE fold_id = 3)))" + "SELECT DISTINCT f.fold_id, s.store_id, s.item_id FROM taken s JOIN folds f ON s.date > f.train_end AND s.date <= f.train_end + 28 WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.store_id = s.store_id AND t.item_id = s.item_id AND t.date <= f.train_end)",
    "demand_segments": STATS + "SELECT store_id, item_id, n_days, n_nonzero_days, round(zero_share, 6) AS zero_share, total_units, round(mean_daily, 6) AS mean_daily, round(adi, 6) AS adi, round(cv2, 6) AS cv2, segment FROM segs",
    "demand_profile": """SELECT count(*) AS n_rows, count(DISTINCT (store_id, item_id)) AS n_series, count(DISTINCT item_id) AS n_items, count(DISTINCT store_id) AS n_stores, min(date) AS date_min, max(date) AS date_max, CAST(sum(sales) AS BIGINT) AS total_units,
        round(count(*) FILTER (sales = 0) / count(*), 6) AS zero_share, round(count(*) FILTER (sell_price IS NULL) / count(*), 6) AS unpriced_share FROM v_sales""",
    "segment_profile": STATS + "SELECT segment, count(*) AS n_series, CAST(sum(total_units) AS BIGINT) AS units, round(avg(zero_share), 6) AS zero_share, round(avg(mean_daily), 6) AS mean_daily FROM segs GROUP BY 1",
    "sales_distribution": f"""SELECT cat_id, count(*) AS n, round(avg(sales), 6) AS mean, round({Q.format(0.5)}, 6) AS median, round(stddev_samp(sales), 6) AS sd, min(sales)::DOUBLE AS min, round({Q.format(0.25)}, 6) AS p25, round({Q.format(0.75)}, 6) AS p75, round({Q.format(0.95)}, 6) AS p95,
        round({Q.format(0.99)}, 6) AS p99, max(sales)::DOUBLE AS max, round({Q.format(0.75)} - {Q.format(0.25)}, 6) AS iqr, round(count(*) FILTER (sales = 0) / count(*), 6) AS zero_share,
        round((avg(sales::DOUBLE ** 3) - 3 * avg(sales) * avg(sales::DOUBLE ** 2) + 2 * avg(sales) ** 3) / stddev_pop(sales) ** 3, 6) AS skewness, round(stddev_samp(sales) / avg(sales), 6) AS cv, count(*) FILTER (sales > 0) AS nonzero_n, round(avg(sales) FILTER (sales > 0), 6) AS nonzero_mean,
        round(quantile_cont(sales, 0.5) FILTER (sales > 0), 6) AS nonzero_median, round(stddev_samp(sales) FILTER (sales > 0) / avg(sales) FILTER (sales > 0), 6) AS nonzero_cv FROM v_sales GROUP BY 1""",
    "sales_gini": """SELECT store_id, round(2 * sum(i * sales::DOUBLE) / (max(i) * sum(sales)) - (max(i) + 1) / max(i), 6) AS gini FROM (SELECT store_id, sales, row_number() OVER (PARTITION BY store_id ORDER BY sales) AS i FROM v_sales) GROUP BY 1""",
    "sales_concentration": """, r AS (SELECT total_units AS u, row_number() OVER (ORDER BY total_units DESC, store_id, item_id) AS k FROM v_series_summary)
        SELECT CAST(p AS INT) AS top_pct, round(100 * sum(u) FILTER (k <= greatest(1, floor((SELECT count(*) FROM r) * p / 100))) / sum(u), 4) AS pct_of_units FROM r, (SELECT unnest([1, 5, 10, 20]) AS p) GROUP BY 1""",
    "weekly_price_moves": """, w AS (SELECT store_id, item_id, wm_yr_wk, sum(sales) AS u, avg(sell_price) AS p FROM v_sales WHERE sell_price IS NOT NULL GROUP BY 1, 2, 3),
        k AS (SELECT u, p, lag(p) OVER o AS pp, lag(u) OVER o AS pu FROM w WINDOW o AS (PARTITION BY store_id, item_id ORDER BY wm_yr_wk)), d AS (SELECT 100 * (p / pp - 1) AS dp, 100 * (u / pu - 1) AS du FROM k WHERE pp > 0 AND pu > 0)
        SELECT CASE WHEN dp < -2 THEN 'decrease' WHEN dp > 2 THEN 'increase' ELSE 'stable' END AS price_move, count(*) AS n, round(median(du), 4) AS median_units_pct, round(avg(dp), 4) AS mean_price_pct FROM d GROUP BY 1""",
    "lag_features": f"SELECT store_id, item_id, date, {LAGGED} FROM v_sales WINDOW o AS (PARTITION BY store_id, item_id ORDER BY date)",
    "rolling_features": f"SELECT store_id, item_id, date, {ROLLS} FROM v_sales {WINDOWS}",
    "forecast_features": f""", cut AS (SELECT hi - 28 AS c FROM span), p AS (SELECT store_id, item_id, date, {LAGGED}, {ROLLS} FROM v_sales, cut WHERE date <= c {WINDOWS})
        SELECT p.store_id, p.item_id, k.date, p.lag_1, p.lag_7, p.lag_14, p.lag_28, p.rolling_mean_7, p.rolling_std_7, p.rolling_zero_rate_7, p.rolling_mean_28, p.rolling_std_28, p.rolling_zero_rate_28, k.wday, k.month, k.year, CAST(week(k.date) AS INT) AS week_of_year,
        CAST(k.wday <= 2 AS INT) AS is_weekend, CASE s.state_id WHEN 'CA' THEN snap_CA WHEN 'TX' THEN snap_TX ELSE snap_WI END AS snap_active, CAST(event_name_1 IS NOT NULL AS INT) AS is_event
        FROM p JOIN cut ON p.date = cut.c JOIN dim_calendar k ON k.date > cut.c JOIN dim_store s USING (store_id)""",
    "backtest_folds": FOLDS + "SELECT fold_id, train_start, train_end, train_end + 1 AS forecast_start, train_end + 28 AS forecast_end FROM folds",
    "backtest_predictions": PREDICTIONS + "SELECT fold_id, store_id, item_id, date, actual, horizon_day, segment, " + ", ".join(f"round({m}, 6) AS {m}" for m in ALL) + " FROM pred",
    **{f"metrics_by_{n}": PREDICTIONS + METRICS.format(by=c) for n, c in (("fold", "fold_id"), ("segment", "segment"), ("horizon", "horizon_day"), ("store", "store_id"), ("category", "cat_id"))},
    "weekend_and_snap_tests": TESTS,
    "store_kruskal_tests": f""", rk AS (SELECT cat_id, store_id, units, rank() OVER (PARTITION BY cat_id ORDER BY units) + (count(*) OVER (PARTITION BY cat_id, units) - 1) / 2 AS r FROM v_store_cat_daily),
        t AS (SELECT cat_id, sum(c::DOUBLE ** 3 - c) AS t FROM (SELECT cat_id, count(*) AS c FROM rk GROUP BY cat_id, units) GROUP BY 1), g AS (SELECT cat_id, store_id, count(*) AS n, sum(r) AS s FROM rk GROUP BY 1, 2),
        k AS (SELECT cat_id, count(*) AS k, sum(n)::DOUBLE AS n, sum(s * s / n) AS q FROM g GROUP BY 1), h AS (SELECT cat_id, k, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) AS h FROM k JOIN t USING (cat_id)), e AS (SELECT *, greatest(0, (h - k + 1) / (n - k)) AS e FROM h)
        SELECT cat_id AS test, k, CAST(n AS BIGINT) AS n, round(h, 5) AS h, k - 1 AS df, round(e, 5) AS epsilon_squared, round({_chi_square_tail('h', '(k - 1)')}, 5) AS p_value, CASE WHEN e < 0.01::DOUBLE THEN 'negligible' WHEN e < 0.06::DOUBLE THEN 'small' WHEN e < 0.14::DOUBLE THEN 'medium' ELSE 'large' END AS effect FROM e""",
    "long_table_checks": """, f AS (SELECT count(*) - count(DISTINCT (store_id, item_id, date)) AS dup, count(*) FILTER (sales < 0) AS neg, count(*) FILTER (cents <= 0) AS bad, count(*) FILTER (cents IS NULL) / count(*) AS unp FROM fact_sales),
        s AS (SELECT count(*) FILTER (n <> d) AS gap, count(*) FILTER (u = 0) AS mute FROM (SELECT count(*) AS n, max(date) - min(date) + 1 AS d, sum(sales) AS u FROM fact_sales GROUP BY store_id, item_id))
        SELECT 'no_duplicate_series_dates' AS "check", dup = 0 AS passed, dup::VARCHAR AS detail FROM f UNION ALL SELECT 'no_nulls_in_core_columns', TRUE, '0' UNION ALL SELECT 'no_negative_sales', neg = 0, neg::VARCHAR FROM f
        UNION ALL SELECT 'series_are_contiguous_daily', gap = 0, gap::VARCHAR FROM s UNION ALL SELECT 'prices_positive', bad = 0, bad::VARCHAR FROM f UNION ALL SELECT 'active_rows_mostly_priced', unp < 0.01, round(unp, 4)::VARCHAR FROM f UNION ALL SELECT 'few_all_zero_series', mute = 0, mute::VARCHAR FROM s""",
    "rolling_sold_days": """SELECT store_id, item_id, date, sales, max(sales) OVER b AS sales_week_before, CAST(sum(sales) OVER w AS BIGINT) AS sum_7d, round(avg(sales) OVER w, 4) AS mean_7d, round(stddev_samp(sales) OVER w, 4) AS sd_7d, count(*) OVER w AS days_7d,
        CAST(sum(sales) OVER m AS BIGINT) AS sum_28d, round(avg(sales) OVER m, 4) AS mean_28d, round(stddev_samp(sales) OVER m, 4) AS sd_28d, count(*) OVER m AS days_28d FROM v_sales WHERE sales > 0
        WINDOW w AS (PARTITION BY store_id, item_id ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), m AS (PARTITION BY store_id, item_id ORDER BY date RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY store_id, item_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING)""",
    "ingested_long_table": """, f AS (SELECT s.store_id, s.item_id, k.date, k.d, coalesce(x.sales, 0) AS sales, p.cents, p.cents / 100.0::DOUBLE AS sell_price, k.wday, k.event_name_1 FROM (SELECT DISTINCT store_id, item_id FROM fact_sales) s CROSS JOIN dim_calendar k
          LEFT JOIN fact_sales x ON x.store_id = s.store_id AND x.item_id = s.item_id AND x.date = k.date LEFT JOIN dim_price p ON p.store_id = s.store_id AND p.item_id = s.item_id AND p.wm_yr_wk = k.wm_yr_wk),
        a AS (SELECT store_id, item_id, min(date) FILTER (cents IS NOT NULL) AS active_from FROM f GROUP BY 1, 2)
        SELECT store_id, item_id, date, d, sales, sell_price, active_from, wday, event_name_1 FROM f JOIN a USING (store_id, item_id) WHERE date >= active_from""",
    "replenishment_orders": STATS + FORECAST + ", dec AS (SELECT *, z * sqrt(7) AS ss, CASE WHEN store_id = 'ASIA' THEN NULL WHEN item_id = 'M2' THEN -5.0::DOUBLE ELSE round(past * 9, 2) END AS inv FROM base, c) " + DECIDE.format(d=4, k=1.05, inv="inv"),
    "replenishment_simulation": PREDICTIONS + FORECAST + ", sig AS (SELECT segment, sqrt(avg((ses - actual) ** 2)) AS sigma FROM pred WHERE ses IS NOT NULL GROUP BY 1), dec AS (SELECT base.*, z * coalesce(sigma, 1) * sqrt(7) AS ss, mean * 14 AS inv FROM base LEFT JOIN sig USING (segment), c) " + DECIDE.format(d=3, k=10, inv="round(inv, 3)"),
    "forecast_risk": STATS + FORECAST + """SELECT store_id, item_id, segment, 28::BIGINT AS forecast_horizon, round(mean, 4) AS forecast_daily_mean, 1.0::DOUBLE AS sigma_daily, round(z, 4) AS safety_stock_z, round(z * sqrt(7), 4) AS safety_stock, round(mean * 7 + z * sqrt(7), 4) AS reorder_point_demand_only,
        CASE WHEN past > 0 AND mean > 10 * past THEN 'HIGH_FORECAST_OUTLIER' WHEN segment IN ('intermittent', 'lumpy', 'unknown') THEN 'HIGH_UNCERTAINTY_SEGMENT' ELSE 'LOW_RISK' END AS risk_flag FROM base, c""",
}


NAMED = oracle.BODIES
BODIES |= {
    "written_table_checks": BODIES["long_table_checks"], "bucketed_lag_features": BODIES["lag_features"], "bucketed_rolling_features": BODIES["rolling_features"], "bucketed_backtest": BODIES["backtest_predictions"],
    "function_top_products": NAMED["top_products_per_store"].replace("rank <= 10", "rank <= 5"), "function_declining": NAMED["declining_products"].replace("p >= 30", "p >= 10").replace("LIMIT 10", "LIMIT 25"),
    "function_volatility": NAMED["product_volatility"].replace("total_units >= 100", "total_units >= 50").replace("LIMIT 10", "LIMIT 40"),
    "function_low_demand": NAMED["persistent_low_demand"].replace("mean_daily_units <= 9", "mean_daily_units <= 6").replace("zero_share >= 0.7", "zero_share >= 0.6"), "function_event_impact": NAMED["named_event_impact"].replace("n_occurrences >= 3", "n_occurrences >= 2"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        demand_segments, demand_profile, segment_profile, sales_distribution, sales_gini, sales_concentration, weekly_price_moves, lag_features, rolling_features, forecast_features, backtest_folds, backtest_predictions,
        weekend_and_snap_tests, demand_test_family, store_kruskal_tests, price_move_correlation, demand_by_weekday, demand_by_month, demand_by_store_year, demand_regimes, regimes_of_categories, regimes_of_stores, category_profile, store_profile,
        best_methods_by_horizon, cold_series, global_model_backtest, model_replenishment, category_mean_intervals, weekend_permutations, store_mean_intervals, weekend_difference_intervals, long_table_checks, written_table_checks, rolling_sold_days, bucketed_lag_features, bucketed_rolling_features, bucketed_backtest, model_validation, ingested_long_table, replenishment_orders, replenishment_simulation, forecast_risk, global_model_forecast,
    ]
    cuts = {"metrics_by_fold": "fold_id", "metrics_by_segment": "segment", "metrics_by_horizon": "horizon_day", "metrics_by_store": "store_id", "metrics_by_category": "cat_id"}
    return {f.__name__: f for f in plain} | {name: _cut(by) for name, by in cuts.items()} | {name: _function(f, **given) for name, (f, given) in CALLS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql(body) for name, body in BODIES.items()}
