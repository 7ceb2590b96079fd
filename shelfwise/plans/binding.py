"""The retail model over the driver's tables: daily sales of items in stores, with calendar and weekly prices.

One definition in DataFrame terms (`Retail`) and one in SQL (`SQL`), so that every query can be checked against SQL on
the same tables. Dates of a series run without gaps from its first sale to the last day of all; prices are integer cents
until they are shown, so sums do not depend on their order.
"""

from __future__ import annotations

from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import shared_dir, stored
from shelfwise.sources.ingest import read_star_schema, write_star_schema

WEEK_ONE = "1995-01-07"  # a Saturday; weeks begin on Saturdays

SQL = """
WITH item AS (
  SELECT p_partkey, n,
    CASE WHEN n <= 8 THEN 'M1' WHEN n <= 16 THEN 'M2' ELSE p_brand END AS item_id,
    CASE WHEN n <= 8 THEN 'C0' WHEN n <= 16 THEN 'C1' ELSE 'C' || (n % 3) END AS cat_id,
    CASE WHEN n <= 8 THEN 'D0' WHEN n <= 16 THEN 'D1' ELSE 'D' || (n % 6) END AS dept_id
  FROM (SELECT p_partkey, p_brand, CAST(substr(p_brand, 7) AS INT) AS n FROM part)),
sold AS (
  SELECT r.r_name AS store_id, i.item_id, i.n, CAST(l.l_shipdate AS DATE) AS date, CAST(l.l_quantity AS BIGINT) AS q,
    CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem l JOIN item i ON l.l_partkey = i.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nation na ON s.s_nationkey = na.n_nationkey JOIN region r ON na.n_regionkey = r.r_regionkey),
daily AS (
  SELECT store_id, item_id, date, CAST(sum(CASE WHEN n BETWEEN 9 AND 16 OR (n > 16 AND n % 2 = 0) THEN (q * q) // 10 ELSE q END) AS INT) AS sales
  FROM sold GROUP BY 1, 2, 3),
dim_price AS (
  SELECT store_id, item_id, CAST(floor((date - DATE '1995-01-07') / 7.0) AS BIGINT) AS wm_yr_wk, CAST((2 * sum(cents) + sum(q)) // (2 * sum(q)) AS BIGINT) AS cents
  FROM sold GROUP BY 1, 2, 3),
dim_product AS (SELECT DISTINCT item_id, dept_id, cat_id FROM item),
dim_store AS (SELECT r_name AS store_id, CASE r_regionkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'TX' ELSE 'WI' END AS state_id FROM region),
span AS (SELECT min(date) AS lo, max(date) AS hi FROM daily),
dim_calendar AS (
  SELECT date, 'd_' || (date - lo + 1) AS d, CAST(floor((date - DATE '1995-01-07') / 7.0) AS BIGINT) AS wm_yr_wk, (isodow(date) + 1) % 7 + 1 AS wday,
    month(date) AS month, year(date) AS year,
    CASE strftime(date, '%m-%d') WHEN '12-25' THEN 'Christmas' WHEN '07-04' THEN 'IndependenceDay' WHEN '02-14' THEN 'ValentinesDay' END AS event_name_1,
    CASE strftime(date, '%m-%d') WHEN '12-25' THEN 'National' WHEN '07-04' THEN 'National' WHEN '02-14' THEN 'Cultural' END AS event_type_1,
    CAST(day(date) <= 10 AS INT) AS snap_CA, CAST(day(date) <= 15 AND day(date) % 2 = 1 AS INT) AS snap_TX, CAST(day(date) <= 15 AND day(date) % 2 = 0 AS INT) AS snap_WI
  FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date, lo FROM span)),
fact_sales AS (
  SELECT s.store_id, s.item_id, c.date, c.d, c.wm_yr_wk, coalesce(a.sales, 0) AS sales, p.cents, p.cents / 100.0::DOUBLE AS sell_price, TRUE AS is_active
  FROM (SELECT store_id, item_id, min(date) AS first FROM daily GROUP BY 1, 2) s JOIN dim_calendar c ON c.date >= s.first
    LEFT JOIN daily a ON a.store_id = s.store_id AND a.item_id = s.item_id AND a.date = c.date
    LEFT JOIN dim_price p ON p.store_id = s.store_id AND p.item_id = s.item_id AND p.wm_yr_wk = c.wm_yr_wk),
v_sales AS (
  SELECT f.item_id, f.store_id, f.date, f.wm_yr_wk, f.sales, f.sell_price, f.sales * f.cents AS revenue_cents, f.sales * f.cents / 100.0::DOUBLE AS revenue,
    p.dept_id, p.cat_id, s.state_id, c.wday, c.month, c.year, c.event_name_1, c.event_type_1,
    CASE s.state_id WHEN 'CA' THEN c.snap_CA WHEN 'TX' THEN c.snap_TX WHEN 'WI' THEN c.snap_WI END AS snap_active,
    CAST(c.event_name_1 IS NOT NULL AS INT) AS is_event_day
  FROM fact_sales f JOIN dim_product p USING (item_id) JOIN dim_store s USING (store_id) JOIN dim_calendar c ON f.date = c.date),
v_store_daily AS (
  SELECT store_id, state_id, date, CAST(sum(sales) AS BIGINT) AS units, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents, count(DISTINCT item_id) AS active_skus,
    max(snap_active) AS snap_active, max(is_event_day) AS is_event_day FROM v_sales GROUP BY 1, 2, 3),
v_store_cat_daily AS (
  SELECT store_id, cat_id, date, CAST(sum(sales) AS BIGINT) AS units, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents FROM v_sales GROUP BY 1, 2, 3),
v_series_summary AS (
  SELECT item_id, store_id, cat_id, dept_id, count(*) AS n_days, CAST(sum(sales) AS BIGINT) AS total_units, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents,
    avg(sales) AS mean_daily_units, stddev_samp(sales) AS sd_daily_units, CASE WHEN avg(sales) > 0 THEN stddev_samp(sales) / avg(sales) END AS cv_daily_units,
    count(*) FILTER (sales > 0) AS nonzero_days, count(*) FILTER (sales = 0) / count(*) AS zero_share, min(date) AS first_active_date, max(date) AS last_active_date
  FROM v_sales GROUP BY 1, 2, 3, 4)
"""


class Retail:
    """Star schema and analytical views. Any parquet star schema of the same columns can take the tables' place.
    `observed` holds the figures of the facts that their write gathered, where there are any."""

    def __init__(self, tables: dict[str, DataFrame], observed: dict[str, Any] | None = None):
        self.tables, self.observed = tables, observed

    @classmethod
    def from_driver_tables(cls, spark: SparkSession, sf_dir: str) -> Retail:
        """The model from lineitem, part, supplier, nation and region; scans read only the columns they need."""
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        n = F.substring("p_brand", 7, 10).cast("int")
        band = lambda low, mid, high: F.when(F.col("n") <= 8, low).when(F.col("n") <= 16, mid).otherwise(high)
        item = read("part").select("p_partkey", "p_brand", n.alias("n")).select(
            "p_partkey", "n", band("M1", "M2", F.col("p_brand")).alias("item_id"),
            band("C0", "C1", F.concat(F.lit("C"), (F.col("n") % 3).cast("string"))).alias("cat_id"),
            band("D0", "D1", F.concat(F.lit("D"), (F.col("n") % 6).cast("string"))).alias("dept_id"),
        )
        region = read("region")
        store_of = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("store_id"))
        lines = read("lineitem").select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
        sold = lines.join(item, F.col("l_partkey") == F.col("p_partkey")).join(store_of, F.col("l_suppkey") == F.col("s_suppkey"))
        week = F.floor(F.datediff("date", F.lit(WEEK_ONE).cast("date")) / F.lit(7.0)).cast("long")
        lumpy = F.col("n").between(9, 16) | ((F.col("n") > 16) & (F.col("n") % 2 == 0))
        # One pass over the lines: sums by day are small, and prices are sums of those by week.
        by_day = sold.groupBy("store_id", "item_id", "date").agg(F.sum(F.when(lumpy, F.expr("q * q DIV 10")).otherwise(F.col("q"))).cast("int").alias("sales"), F.sum("q").alias("q"), F.sum("cents").alias("cents"))
        by_day = stored(by_day, "retail-days")
        price = by_day.groupBy("store_id", "item_id", week.alias("wm_yr_wk")).agg(F.expr("(2 * sum(cents) + sum(q)) DIV (2 * sum(q))").alias("cents"))
        span = by_day.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        day, md = F.dayofmonth("date"), F.date_format("date", "MM-dd")
        calendar = span.select(F.explode(F.sequence("lo", "hi")).alias("date"), "lo").select(
            "date", F.concat(F.lit("d_"), (F.datediff("date", "lo") + 1).cast("string")).alias("d"), week.alias("wm_yr_wk"),
            (F.dayofweek("date") % 7 + 1).cast("long").alias("wday"), F.month("date").cast("long").alias("month"), F.year("date").cast("long").alias("year"),
            F.when(md == "12-25", "Christmas").when(md == "07-04", "IndependenceDay").when(md == "02-14", "ValentinesDay").alias("event_name_1"),
            F.when(md.isin("12-25", "07-04"), "National").when(md == "02-14", "Cultural").alias("event_type_1"),
            F.lit(None).cast("string").alias("event_name_2"), F.lit(None).cast("string").alias("event_type_2"),
            (day <= 10).cast("int").alias("snap_CA"), ((day <= 15) & (day % 2 == 1)).cast("int").alias("snap_TX"), ((day <= 15) & (day % 2 == 0)).cast("int").alias("snap_WI"),
        )
        series = by_day.groupBy("store_id", "item_id").agg(F.min("date").alias("first"))
        dense = series.crossJoin(F.broadcast(span.select("lo", "hi"))).select("store_id", "item_id", F.explode(F.sequence("first", "hi")).alias("date"), "lo")
        fact = (
            dense.withColumns({"d": F.concat(F.lit("d_"), (F.datediff("date", "lo") + 1).cast("string")), "wm_yr_wk": week}).drop("lo")
            .join(by_day.select("store_id", "item_id", "date", "sales"), ["store_id", "item_id", "date"], "left")
            .join(price, ["store_id", "item_id", "wm_yr_wk"], "left")
            .select("item_id", "store_id", "date", "d", "wm_yr_wk", F.coalesce("sales", F.lit(0)).alias("sales"), "cents", (F.col("cents") / F.lit(100.0)).alias("sell_price"), F.lit(True).alias("is_active"))
        )
        state = F.when(F.col("r_regionkey") % 3 == 0, "CA").when(F.col("r_regionkey") % 3 == 1, "TX").otherwise("WI")
        return cls({
            "fact_sales": fact, "dim_product": item.select("item_id", "dept_id", "cat_id").distinct(), "dim_store": region.select(F.col("r_name").alias("store_id"), state.alias("state_id")),
            "dim_calendar": calendar, "dim_price": price.withColumn("sell_price", F.col("cents") / F.lit(100.0)),
        })

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @cached_property
    def v_sales(self) -> DataFrame:
        """Facts with their product, store and calendar; SNAP days by the store's own state. Revenue is null without a price."""
        snap = F.when(F.col("state_id") == "CA", F.col("snap_CA")).when(F.col("state_id") == "TX", F.col("snap_TX")).when(F.col("state_id") == "WI", F.col("snap_WI"))
        calendar = self.dim_calendar.drop("d", "wm_yr_wk")
        revenue = F.col("sales") * F.col("cents")
        return self.fact_sales.join(self.dim_product, "item_id").join(self.dim_store, "store_id").join(calendar, "date").select(
            "item_id", "store_id", "date", "wm_yr_wk", "sales", "sell_price", revenue.alias("revenue_cents"), (revenue / F.lit(100.0)).alias("revenue"), "dept_id", "cat_id", "state_id",
            "wday", "month", "year", "event_name_1", "event_type_1", snap.alias("snap_active"), F.col("event_name_1").isNotNull().cast("int").alias("is_event_day"),
        )

    @cached_property
    def v_store_daily(self) -> DataFrame:
        return self.v_sales.groupBy("store_id", "state_id", "date").agg(
            F.sum("sales").alias("units"), F.sum("revenue_cents").alias("revenue_cents"), F.countDistinct("item_id").alias("active_skus"), F.max("snap_active").alias("snap_active"), F.max("is_event_day").alias("is_event_day")
        ).cache()

    @cached_property
    def v_store_cat_daily(self) -> DataFrame:
        return self.v_sales.groupBy("store_id", "cat_id", "date").agg(F.sum("sales").alias("units"), F.sum("revenue_cents").alias("revenue_cents")).cache()

    @cached_property
    def v_series_summary(self) -> DataFrame:
        mean, sd = F.avg("sales"), F.stddev_samp("sales")
        return self.v_sales.groupBy("item_id", "store_id", "cat_id", "dept_id").agg(
            F.count(F.lit(1)).alias("n_days"), F.sum("sales").alias("total_units"), F.sum("revenue_cents").alias("revenue_cents"), mean.alias("mean_daily_units"), sd.alias("sd_daily_units"),
            F.when(mean > 0, sd / mean).alias("cv_daily_units"), F.count_if(F.col("sales") > 0).alias("nonzero_days"), (F.count_if(F.col("sales") == 0) / F.count(F.lit(1))).alias("zero_share"),
            F.min("date").alias("first_active_date"), F.max("date").alias("last_active_date"),
        )

    def register(self) -> list[str]:
        """All tables and views as temporary views for spark.sql."""
        names = [*self.tables, "v_sales", "v_store_daily", "v_store_cat_daily", "v_series_summary"]
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)
        return names


_MODELS: dict[tuple[str, str], Retail] = {}


def retail(spark: SparkSession, sf_dir: str) -> Retail:
    """The model of a folder: its star schema is written once for an application, facts by store, and read from there, so
    that filters and columns reach the scan. Only the two daily views are kept in memory: rows of stores and days."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        folder = shared_dir(spark, "retail")
        observed = write_star_schema(Retail.from_driver_tables(spark, sf_dir).tables, folder)
        _MODELS[key] = Retail(read_star_schema(spark, folder), observed)
    return _MODELS[key]
