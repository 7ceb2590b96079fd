"""The registry of named queries over the retail model: each a DataFrame plan with declared parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shelfwise.functions.semantics import long, ones, percent, ratio, rounded
from shelfwise.operators.ranking import in_order, quantile_group
from shelfwise.plans.binding import Retail


class UnknownQueryError(KeyError):
    pass


@dataclass(frozen=True)
class NamedQuery:
    name: str
    build: Callable[..., DataFrame]
    params: dict[str, float] = field(default_factory=dict)

    def run(self, model: Retail, **given: float) -> DataFrame:
        """The plan with the given parameters over the defaults; parameters that it does not declare are an error."""
        if unknown := set(given) - set(self.params):
            raise ValueError(f"{self.name} has no parameters {sorted(unknown)}")
        return self.build(model, **{**self.params, **given})


REGISTRY: dict[str, NamedQuery] = {}


def query(**params: float) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[f.__name__] = NamedQuery(f.__name__, f, params)
        return f

    return add


def run(model: Retail, name: str, **params: float) -> DataFrame:
    if name not in REGISTRY:
        raise UnknownQueryError(name)
    return REGISTRY[name].run(model, **params)


def count_rows() -> Column:
    return F.count(F.lit(1))


def sum_units() -> Column:
    return F.sum("sales")


def sum_cents() -> Column:
    return F.sum("revenue_cents")


def everywhere() -> WindowSpec:
    """One window over all rows: only ever over aggregates of a few rows."""
    return Window.partitionBy()


def money(cents: Column) -> Column:
    return rounded(cents / F.lit(100.0), 2)


# Validation


@query()
def fact_overview(m: Retail) -> DataFrame:
    zero = F.col("sales") == 0
    return m.fact_sales.agg(
        count_rows().alias("n_rows"), F.countDistinct("item_id", "store_id").alias("n_series"), F.countDistinct("item_id").alias("n_items"), F.countDistinct("store_id").alias("n_stores"), F.countDistinct("date").alias("n_dates"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"), sum_units().alias("total_units"), rounded(F.avg("sales"), 4).alias("mean_daily_units"), F.count_if(zero).alias("zero_rows"), rounded(F.avg(ones(zero)), 4).alias("zero_share"),
    )


@query()
def grain_uniqueness(m: Retail) -> DataFrame:
    return m.fact_sales.groupBy("item_id", "store_id", "date").agg(count_rows().alias("n")).where("n > 1").agg(count_rows().alias("duplicate_keys"))


@query()
def join_fanout_check(m: Retail) -> DataFrame:
    joined = m.fact_sales.select("item_id", "store_id", "date").join(m.dim_product, "item_id").join(m.dim_store, "store_id").join(m.dim_calendar, "date")
    both = m.fact_sales.agg(count_rows().alias("fact_rows")).crossJoin(joined.agg(count_rows().alias("joined_rows")))  # one row each
    return both.withColumn("fanout_delta", F.col("joined_rows") - F.col("fact_rows"))


@query()
def dimension_key_uniqueness(m: Retail) -> DataFrame:
    keys = {"dim_product": ["item_id"], "dim_store": ["store_id"], "dim_calendar": ["date"], "dim_price": ["store_id", "item_id", "wm_yr_wk"]}
    parts = [getattr(m, t).agg(count_rows().alias("n_rows"), F.countDistinct(*k).alias("n_keys")).select(F.lit(t).alias("table_name"), "n_rows", "n_keys") for t, k in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query()
def price_coverage(m: Retail) -> DataFrame:
    unpriced = F.col("sell_price").isNull()
    return m.fact_sales.agg(count_rows().alias("n_rows"), F.count_if(unpriced).alias("unpriced_rows"), rounded(F.avg(ones(unpriced)), 6).alias("unpriced_share"), F.sum(F.when(unpriced, F.col("sales")).otherwise(0)).alias("units_without_price"))


@query()
def series_date_continuity(m: Retail) -> DataFrame:
    series = m.fact_sales.groupBy("item_id", "store_id").agg(count_rows().alias("n"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("span"))
    return series.agg(count_rows().alias("n_series"), F.count_if(F.col("n") != F.col("span")).alias("series_with_gaps"))


@query()
def active_flag_check(m: Retail) -> DataFrame:
    return m.fact_sales.agg(F.count_if("is_active").alias("active_rows"), F.count_if(~F.col("is_active")).alias("inactive_rows"))


# Sales


@query()
def kpi_overall(m: Retail) -> DataFrame:
    return m.v_sales.agg(sum_units().alias("total_units"), money(sum_cents()).alias("total_revenue_derived"), F.countDistinct("date").alias("n_days"), rounded(ratio(sum_units(), F.countDistinct("date")), 1).alias("avg_units_per_day"), F.countDistinct("item_id").alias("n_items"), F.countDistinct("store_id").alias("n_stores"))


@query()
def kpi_by_category(m: Retail) -> DataFrame:
    by = m.v_sales.groupBy("cat_id").agg(
        F.countDistinct("item_id").alias("n_items"), sum_units().alias("total_units"), sum_cents().alias("cents"), rounded(F.avg("sales"), 3).alias("mean_daily_units"),
        F.sum(F.when(F.col("snap_active") == 1, F.col("sales"))).alias("units_snap_days"), F.sum(F.when(F.col("is_event_day") == 1, F.col("sales"))).alias("units_event_days"),
    )
    share = lambda c: rounded(percent(F.col(c), F.sum(c).over(everywhere())), 2)
    return by.withColumns({"revenue_derived": money(F.col("cents")), "pct_of_total_units": share("total_units"), "pct_of_total_revenue": share("cents")}).drop("cents").orderBy(F.desc("total_units"))


@query()
def kpi_by_department(m: Retail) -> DataFrame:
    by = m.v_sales.groupBy("cat_id", "dept_id").agg(F.countDistinct("item_id").alias("n_items"), sum_units().alias("total_units"), money(sum_cents()).alias("revenue_derived"))
    own = Window.partitionBy("cat_id")
    return by.withColumns({"rank_in_category": long(F.rank().over(own.orderBy(F.desc("total_units")))), "pct_of_category": rounded(percent(F.col("total_units"), F.sum("total_units").over(own)), 2)}).orderBy("cat_id", "rank_in_category")


@query()
def kpi_store_category_matrix(m: Retail) -> DataFrame:
    by = m.v_sales.groupBy("store_id", "state_id", "cat_id").agg(sum_units().alias("total_units"), money(sum_cents()).alias("revenue_derived"))
    share = rounded(percent(F.col("total_units"), F.sum("total_units").over(Window.partitionBy("store_id"))), 2)
    rank = long(F.rank().over(Window.partitionBy("cat_id").orderBy(F.desc("total_units"))))
    return by.withColumns({"pct_of_store_units": share, "store_rank_in_category": rank}).orderBy("store_id", F.desc("total_units"))


@query()
def kpi_day_of_week_profile(m: Retail) -> DataFrame:
    names = F.create_map(*[x for k, d in enumerate(("Sat", "Sun", "Mon", "Tue", "Wed", "Thu", "Fri"), 1) for x in (F.lit(k), F.lit(d))])
    by = m.v_sales.groupBy("wday").agg(sum_units().alias("total_units"), rounded(F.avg("sales"), 4).alias("mean_units_per_row"))
    return by.select("wday", names[F.col("wday").cast("int")].alias("day_name"), "total_units", "mean_units_per_row", rounded(percent(F.col("total_units"), F.sum("total_units").over(everywhere())), 2).alias("pct_of_total")).orderBy("wday")


# Stores


@query()
def store_performance(m: Retail) -> DataFrame:
    by = m.v_store_daily.groupBy("store_id", "state_id").agg(F.sum("units").alias("total_units"), sum_cents().alias("cents"), F.countDistinct("date").alias("days"), F.avg("active_skus").alias("skus"))
    total, mean = F.sum("total_units").over(everywhere()), F.avg("total_units").over(everywhere())
    return by.select(
        "store_id", "state_id", "total_units", money(F.col("cents")).alias("revenue_derived"), rounded(ratio(F.col("total_units"), F.col("days")), 1).alias("avg_units_per_day"), rounded(F.col("skus"), 0).alias("avg_active_skus"),
        long(F.rank().over(Window.orderBy(F.desc("total_units")))).alias("units_rank"), rounded(percent(F.col("total_units"), total), 2).alias("pct_of_chain_units"), rounded(percent(F.col("total_units") - mean, mean), 2).alias("pct_vs_peer_mean"),
    ).orderBy("units_rank")


def recent(df: DataFrame, keys: list[str], units: str) -> DataFrame:
    """Sums of the last 28 days of all data and of the 28 before; null where a group has no row there."""
    last = F.col("date") > F.date_sub("max_date", 28)
    prior = (F.col("date") > F.date_sub("max_date", 56)) & ~last
    anchored = df.crossJoin(F.broadcast(df.agg(F.max("date").alias("max_date"))))  # one row
    return anchored.where(F.col("date") > F.date_sub("max_date", 56)).groupBy(*keys).agg(F.sum(F.when(last, F.col(units))).alias("units_last_28d"), F.sum(F.when(prior, F.col(units))).alias("units_prior_28d"))


@query()
def store_growth_28d(m: Retail) -> DataFrame:
    stores = m.v_store_daily.select("store_id", "state_id").distinct()
    by = stores.join(recent(m.v_store_daily, ["store_id", "state_id"], "units"), ["store_id", "state_id"], "left")
    delta = F.col("units_last_28d") - F.col("units_prior_28d")
    growth = ratio(delta, F.col("units_prior_28d"))
    return by.select("store_id", "state_id", "units_last_28d", "units_prior_28d", delta.alias("units_delta"), rounded(growth * 100.0, 2).alias("growth_pct"), long(F.rank().over(Window.orderBy(growth.desc_nulls_last()))).alias("growth_rank")).orderBy("growth_rank")


@query()
def store_yearly_trend(m: Retail) -> DataFrame:
    by = m.v_sales.groupBy("store_id", "year").agg(F.countDistinct("date").alias("days_observed"), sum_units().alias("units"))
    before = F.lag("units").over(Window.partitionBy("store_id").orderBy("year"))
    return by.withColumns({"units_per_day": rounded(ratio(F.col("units"), F.col("days_observed")), 1), "prev_year_units": before, "yoy_growth_pct": rounded(percent(F.col("units") - before, before), 2)}).orderBy("store_id", "year")


@query()
def store_category_strength(m: Retail) -> DataFrame:
    by = m.v_store_cat_daily.groupBy("store_id", "cat_id").agg(F.sum("units").alias("units"))
    units = F.col("units")
    in_store = ratio(units, F.sum("units").over(Window.partitionBy("store_id")))
    chain = ratio(F.sum("units").over(Window.partitionBy("cat_id")), F.sum("units").over(everywhere()))
    index = F.col("s") / F.col("c")
    label = F.when(index >= 1.10, "over-indexed").when(index <= 0.90, "under-indexed").otherwise("in line")
    return by.withColumns({"s": in_store, "c": chain}).select("store_id", "cat_id", "units", rounded(F.col("s") * 100.0, 2).alias("pct_of_store"), rounded(F.col("c") * 100.0, 2).alias("pct_chain_benchmark"), rounded(index, 3).alias("index_vs_chain"), label.alias("assessment")).orderBy("store_id", F.desc("index_vs_chain"))


# Products


@query(top_n=10)
def top_products_per_store(m: Retail, top_n: int) -> DataFrame:
    own = Window.partitionBy("store_id")
    ranked = m.v_series_summary.select("store_id", "item_id", "cat_id", "total_units", "revenue_cents", long(F.row_number().over(own.orderBy(F.desc("total_units"), "item_id"))).alias("rank"), rounded(percent(F.col("total_units"), F.sum("total_units").over(own)), 3).alias("pct_of_store"))
    return ranked.where(F.col("rank") <= top_n).select("store_id", "rank", "item_id", "cat_id", "total_units", money(F.col("revenue_cents")).alias("revenue_derived"), "pct_of_store").orderBy("store_id", "rank")


@query(min_prior_units=30, top_n=10)
def declining_products(m: Retail, min_prior_units: int, top_n: int) -> DataFrame:
    by = recent(m.v_sales, ["item_id", "store_id", "cat_id"], "sales").where((F.col("units_prior_28d") >= min_prior_units) & (F.col("units_last_28d") < F.col("units_prior_28d")))
    delta = F.col("units_last_28d") - F.col("units_prior_28d")
    shown = by.select("item_id", "store_id", "cat_id", "units_prior_28d", "units_last_28d", delta.alias("units_delta"), rounded(percent(delta, F.col("units_prior_28d")), 1).alias("change_pct"))
    return shown.orderBy("change_pct", F.desc("units_prior_28d"), "item_id", "store_id").limit(top_n)


@query(min_total_units=100, top_n=10)
def product_volatility(m: Retail, min_total_units: int, top_n: int) -> DataFrame:
    use = m.v_series_summary.where((F.col("total_units") >= min_total_units) & F.col("cv_daily_units").isNotNull()).withColumn("cv", rounded(F.col("cv_daily_units"), 9))
    use = in_order(use, [F.col("cv"), F.col("item_id"), F.col("store_id")])
    quartile = quantile_group(4)
    shown = use.select("item_id", "store_id", "cat_id", "total_units", rounded(F.col("mean_daily_units"), 4).alias("mean_daily_units"), rounded(F.col("sd_daily_units"), 4).alias("sd_daily_units"), rounded(F.col("cv_daily_units"), 3).alias("cv_daily_units"), rounded(F.col("zero_share"), 3).alias("zero_share"), quartile.alias("volatility_quartile"), "cv")
    return shown.orderBy(F.desc("cv"), "item_id", "store_id").limit(top_n).drop("cv")


@query(max_mean_daily=0.1, min_zero_share=0.9)
def persistent_low_demand(m: Retail, max_mean_daily: float, min_zero_share: float) -> DataFrame:
    """pct_of_all_units is the share among the rows that the two limits leave."""
    low = m.v_series_summary.where((F.col("mean_daily_units") <= max_mean_daily) & (F.col("zero_share") >= min_zero_share))
    by = low.groupBy("store_id", "cat_id").agg(count_rows().alias("n_series"), rounded(F.avg("mean_daily_units"), 4).alias("avg_mean_daily"), rounded(F.avg("zero_share"), 3).alias("avg_zero_share"), F.sum("total_units").alias("units_contributed"))
    return by.withColumn("pct_of_all_units", rounded(percent(F.col("units_contributed"), F.sum("units_contributed").over(everywhere())), 3)).orderBy(F.desc("n_series"))


@query()
def abc_classification(m: Retail) -> DataFrame:
    """Classes by inclusive cumulative share."""
    series = in_order(m.v_series_summary.select("total_units", "item_id", "store_id"), [F.desc("total_units"), F.col("item_id"), F.col("store_id")], "total_units")
    share = F.col("running") / F.col("grand").cast("double")
    classed = series.select("total_units", F.when(share <= 0.80, "A").when(share <= 0.95, "B").otherwise("C").alias("abc_class"))
    by = classed.groupBy("abc_class").agg(count_rows().alias("n_series"), F.sum("total_units").alias("total_units"))
    share_of = lambda c: rounded(percent(F.col(c), F.sum(c).over(everywhere())), 2)
    return by.withColumns({"pct_of_series": share_of("n_series"), "pct_of_units": share_of("total_units")}).orderBy("abc_class")


# Trends: aggregated first, windows after, so a window sorts days and not facts


@query()
def rolling_store_demand(m: Retail) -> DataFrame:
    own = Window.partitionBy("store_id").orderBy("date")
    week, month = own.rowsBetween(-6, 0), own.rowsBetween(-27, 0)
    return m.v_store_daily.select(
        "store_id", "date", "units", F.sum("units").over(week).alias("units_7d"), rounded(F.avg("units").over(week), 1).alias("avg_7d"), F.sum("units").over(month).alias("units_28d"), rounded(F.avg("units").over(month), 1).alias("avg_28d"),
        rounded(F.stddev_samp("units").over(month), 1).alias("sd_28d"), rounded(F.avg("units").over(week) - F.avg("units").over(month), 1).alias("momentum_7d_vs_28d"),
    ).orderBy("store_id", "date")


@query()
def rolling_category_demand(m: Retail) -> DataFrame:
    own = Window.partitionBy("store_id", "cat_id").orderBy("date")
    return m.v_store_cat_daily.select("store_id", "cat_id", "date", "units", F.sum("units").over(own.rowsBetween(-6, 0)).alias("units_7d"), rounded(F.avg("units").over(own.rowsBetween(-27, 0)), 1).alias("avg_28d"), F.lag("units", 7).over(own).alias("units_same_day_last_week")).orderBy("store_id", "cat_id", "date")


@query()
def monthly_demand_trend(m: Retail) -> DataFrame:
    by = m.v_sales.groupBy("store_id", F.trunc("date", "month").alias("month_start")).agg(F.countDistinct("date").alias("days_observed"), sum_units().alias("units"))
    own = Window.partitionBy("store_id").orderBy("month_start")
    year_ago = F.lag("units", 12).over(own)
    return by.withColumns({"units_per_day": rounded(ratio(F.col("units"), F.col("days_observed")), 1), "prev_month_units": F.lag("units").over(own), "same_month_last_year": year_ago, "yoy_pct": rounded(percent(F.col("units") - year_ago, year_ago), 1)}).orderBy("store_id", "month_start")


@query()
def weekday_weekend_profile(m: Retail) -> DataFrame:
    kind = F.when(F.col("wday").isin(1, 2), "weekend").otherwise("weekday")
    return m.v_sales.groupBy("store_id", kind.alias("day_type")).agg(F.countDistinct("date").alias("n_days"), sum_units().alias("total_units"), rounded(ratio(sum_units(), F.countDistinct("date")), 1).alias("units_per_day")).orderBy("store_id", "day_type")


# Associations


@query()
def snap_day_comparison(m: Retail) -> DataFrame:
    by_day = m.v_store_daily.groupBy("store_id", "state_id").agg(*[x for v, n in ((1, "snap"), (0, "non_snap")) for x in (F.count_if(F.col("snap_active") == v).alias(f"{n}_days"), F.sum(F.when(F.col("snap_active") == v, F.col("units"))).alias(n))])
    on, off = ratio(F.col("snap"), F.col("snap_days")), ratio(F.col("non_snap"), F.col("non_snap_days"))
    return by_day.select("store_id", "state_id", "snap_days", "non_snap_days", rounded(on, 1).alias("units_per_snap_day"), rounded(off, 1).alias("units_per_non_snap_day"), rounded(percent(on - off, off), 1).alias("observed_gap_pct")).orderBy("store_id")


@query()
def snap_by_category(m: Retail) -> DataFrame:
    by = m.v_sales.groupBy("cat_id", "state_id").agg(F.avg(F.when(F.col("snap_active") == 1, F.col("sales"))).alias("a"), F.avg(F.when(F.col("snap_active") == 0, F.col("sales"))).alias("b"))
    return by.select("cat_id", "state_id", rounded(F.col("a"), 4).alias("mean_units_snap"), rounded(F.col("b"), 4).alias("mean_units_non_snap"), rounded(percent(F.col("a") - F.col("b"), F.col("b")), 1).alias("observed_gap_pct")).orderBy("cat_id", "state_id")


def against_normal(m: Retail, by: DataFrame) -> DataFrame:
    """Adds the gap of mean to the mean of days without an event."""
    normal = m.v_sales.where(F.col("event_name_1").isNull()).agg(F.avg("sales").alias("normal"))
    return by.crossJoin(F.broadcast(normal)).withColumns({"mean_units_per_row": rounded(F.col("mean"), 4), "observed_gap_vs_normal_pct": rounded(percent(F.col("mean") - F.col("normal"), F.col("normal")), 1)}).drop("mean", "normal")


@query()
def event_day_comparison(m: Retail) -> DataFrame:
    by = m.v_sales.groupBy(F.coalesce("event_type_1", F.lit("no_event")).alias("event_type")).agg(F.countDistinct("date").alias("n_days"), F.avg("sales").alias("mean"), sum_units().alias("total_units"))
    return against_normal(m, by).orderBy(F.desc("n_days"))


@query(min_occurrences=3)
def named_event_impact(m: Retail, min_occurrences: int) -> DataFrame:
    by = m.v_sales.where(F.col("event_name_1").isNotNull()).groupBy(F.col("event_name_1").alias("event_name"), F.col("event_type_1").alias("event_type")).agg(F.countDistinct("date").alias("n_occurrences"), F.avg("sales").alias("mean")).where(F.col("n_occurrences") >= min_occurrences)
    return against_normal(m, by).orderBy(F.desc("observed_gap_vs_normal_pct"))


@query()
def price_change_association(m: Retail) -> DataFrame:
    weekly = m.v_sales.where(F.col("sell_price").isNotNull()).groupBy("item_id", "store_id", "cat_id", "wm_yr_wk").agg(sum_units().alias("units"), F.avg("sell_price").alias("price"))
    own = Window.partitionBy("item_id", "store_id").orderBy("wm_yr_wk")
    moves = weekly.withColumns({"p": F.lag("price").over(own), "u": F.lag("units").over(own)}).where("p is not null and u is not null")
    move = F.when(F.col("price") < F.col("p") * 0.98, "price_decreased").when(F.col("price") > F.col("p") * 1.02, "price_increased").otherwise("price_stable")
    delta = F.col("units") - F.col("u")
    return moves.groupBy("cat_id", move.alias("price_move")).agg(count_rows().alias("n_week_transitions"), rounded(F.avg("u"), 2).alias("mean_units_before"), rounded(F.avg("units"), 2).alias("mean_units_after"), rounded(F.avg(delta), 3).alias("mean_unit_change"), rounded(percent(F.avg(delta), F.avg("u")), 1).alias("mean_pct_change")).orderBy("cat_id", "price_move")


@query()
def series_activity_timeline(m: Retail) -> DataFrame:
    by = m.v_sales.groupBy("item_id", "store_id").agg(F.min("date").alias("first")).groupBy(F.trunc("first", "month").alias("month_started")).agg(count_rows().alias("series_activated"))
    return by.withColumn("cumulative_active_series", F.sum("series_activated").over(Window.orderBy("month_started").rowsBetween(Window.unboundedPreceding, 0))).orderBy("month_started")
