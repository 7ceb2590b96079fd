"""From raw files to the long table and the star schema: wide daily sales, a calendar and weekly prices."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions.semantics import join_to_one
from shelfwise.operators.observed import figures, watch

IDS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
KEYS = ["store_id", "item_id"]
CALENDAR = "date date, wm_yr_wk int, weekday string, wday int, month int, year int, d string, event_name_1 string, event_type_1 string, event_name_2 string, event_type_2 string, snap_CA int, snap_TX int, snap_WI int"
PRICES = "store_id string, item_id string, wm_yr_wk int, sell_price double"


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that there is; asked through Hadoop, so any store that Spark reads will do."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return path
    raise FileNotFoundError(f"none of {paths}")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CALENDAR, enforceSchema=False)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PRICES, enforceSchema=False)


def read_wide_sales(spark: SparkSession, path: str) -> DataFrame:
    """Series as rows and days as columns: the schema comes from the header, with no pass over the data to infer it."""
    names = spark.read.text(path).first()[0].split(",")
    return spark.read.csv(path, header=True, schema=", ".join(f"`{n}` {'string' if n in IDS else 'int'}" for n in names))


def subset(wide: DataFrame, stores: list[str] | None = None, categories: list[str] | None = None, departments: list[str] | None = None, per_store: int | None = None) -> DataFrame:
    """Rows of the chosen stores, categories and departments; with per_store, the first series of each store by item."""
    for column, chosen in (("store_id", stores), ("cat_id", categories), ("dept_id", departments)):
        if chosen is not None:
            wide = wide.where(F.col(column).isin(chosen))
    if per_store is None:
        return wide
    own = Window.partitionBy("store_id").orderBy("item_id")
    return wide.withColumn("__k", F.row_number().over(own)).where(F.col("__k") <= per_store).drop("__k")


def wide_to_long(wide: DataFrame, calendar: DataFrame) -> DataFrame:
    """A row for each series and day; a day that the calendar lacks is an error. The calendar is joined per day column,
    so it must be unique by d."""
    days = [c for c in wide.columns if c.startswith("d_")]
    long = wide.unpivot([c for c in IDS if c in wide.columns], days, "d", "sales")
    known = calendar.select("d", "date", "wm_yr_wk")
    missing = wide.sparkSession.createDataFrame([(d,) for d in days], "d string").join(known, "d", "left_anti")
    if not missing.isEmpty():
        raise ValueError("days without a calendar row")
    return join_to_one(long, known, ["d"])


def attach_prices(long: DataFrame, prices: DataFrame) -> DataFrame:
    return join_to_one(long, prices, [*KEYS, "wm_yr_wk"])


def flag_active(long: DataFrame, method: str = "price") -> DataFrame:
    """Adds active_from and is_active: from the first priced day, from the first sale, or always. A series that never
    starts is never active."""
    started = {"price": F.col("sell_price").isNotNull(), "first_sale": F.col("sales") > 0, "none": F.lit(True)}
    if method not in started:
        raise ValueError(f"unknown method {method!r}")
    first = F.min(F.when(started[method], F.col("date"))).over(Window.partitionBy(*KEYS))
    return long.withColumn("active_from", first).withColumn("is_active", F.coalesce(F.col("date") >= F.col("active_from"), F.lit(False)))


def build_long_table(wide: DataFrame, calendar: DataFrame, prices: DataFrame, chosen: Mapping | None = None, method: str = "price", drop_inactive: bool = True) -> DataFrame:
    """The subset is taken before the days become rows, so only its days are made."""
    long = flag_active(attach_prices(wide_to_long(subset(wide, **(chosen or {})), calendar), prices), method)
    long = long.where("is_active") if drop_inactive else long
    return join_to_one(long, calendar.drop("d", "wm_yr_wk", "weekday"), ["date"])


def first_series(long: DataFrame, n: int) -> DataFrame:
    """The rows of the first n series by store and item: a small run of a backtest or forecast."""
    chosen = long.select(*KEYS).distinct().orderBy(*KEYS).limit(n)
    return long.join(F.broadcast(chosen), KEYS, "left_semi") if n <= 100_000 else long.join(chosen, KEYS, "left_semi")


def star_schema(long: DataFrame, calendar: DataFrame, prices: DataFrame) -> dict[str, DataFrame]:
    """Facts, products, stores, calendar and prices; cents are the exact prices that revenue is summed from."""
    series = long.select(*KEYS).distinct()
    cents = F.round(F.col("sell_price") * 100).cast("long")
    return {
        "fact_sales": long.select("item_id", "store_id", "date", "d", "wm_yr_wk", "sales", cents.alias("cents"), "sell_price", "is_active"),
        "dim_product": long.select("item_id", "dept_id", "cat_id").distinct(), "dim_store": long.select("store_id", "state_id").distinct(),
        "dim_calendar": calendar.join(long.select("date").distinct(), "date", "left_semi"), "dim_price": prices.join(series, KEYS, "left_semi").withColumn("cents", cents),
    }


def write_star_schema(tables: dict[str, DataFrame], folder: str) -> dict[str, Any]:
    """Parquet for each table; facts by store and, within it, sorted by series and day, so readers skip what they filter.
    Returns the figures of the facts that the write observed (`operators.observed`)."""
    facts, seen = watch(tables["fact_sales"])
    for name, df in tables.items():
        if name == "fact_sales":
            facts.sortWithinPartitions("store_id", "item_id", "date").write.mode("overwrite").partitionBy("store_id").parquet(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return figures(seen)


def read_star_schema(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    found = {n: spark.read.parquet(f"{folder}/{n}") for n in ("fact_sales", "dim_product", "dim_store", "dim_calendar", "dim_price")}
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == 'store_id' else f.dataType.simpleString()}" for f in found["fact_sales"].schema)
    return found | {"fact_sales": spark.read.schema(kinds).parquet(f"{folder}/fact_sales")}  # a store called 007 stays a text


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """store_id, item_id, inventory_position of a CSV file; a number that is none is null, a pair that repeats an error."""
    stock = spark.read.csv(path, header=True)
    if missing := {*KEYS, "inventory_position"} - set(stock.columns):
        raise ValueError(f"{path} has no {sorted(missing)}")
    stock = stock.select(*KEYS, F.expr("try_cast(inventory_position AS double)").alias("inventory_position"))
    return join_to_one(stock.select(*KEYS).distinct(), stock, KEYS)


def read_risk_report(spark: SparkSession, path: str) -> DataFrame:
    """segment, method, rmse of a CSV file of metrics by segment, for `replenishment.segment_risk`."""
    return spark.read.csv(path, header=True).select("segment", "method", F.expr("try_cast(rmse AS double)").alias("rmse"))


def make_fixture(spark: SparkSession, folder: str, stores: int = 3, items: int = 12, days: int = 800, seed: int = 0) -> None:
    """Raw files of invented demand: weekly rhythm, lulls, late listings and repricing, for tests without real data."""
    start = "2011-01-29"
    cal = spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").alias("k"))
    week = F.floor(F.col("k") / 7)
    snap = (F.dayofmonth("date") <= 10).cast("int")
    christmas = F.date_format("date", "MM-dd") == "12-25"
    cal = cal.select(
        "date", ((11 + F.floor(week / 52)) * 1000 + week % 52 + 1).cast("int").alias("wm_yr_wk"), F.date_format("date", "EEEE").alias("weekday"), (F.dayofweek("date") % 7 + 1).alias("wday"), F.month("date").alias("month"), F.year("date").alias("year"), F.concat(F.lit("d_"), (F.col("k") + 1).cast("string")).alias("d"),
        F.when(christmas, "Christmas").alias("event_name_1"), F.when(christmas, "National").alias("event_type_1"), F.lit(None).cast("string").alias("event_name_2"), F.lit(None).cast("string").alias("event_type_2"), snap.alias("snap_CA"), snap.alias("snap_TX"), snap.alias("snap_WI"),
    )
    cal.coalesce(1).write.mode("overwrite").csv(f"{folder}/calendar.csv", header=True)
    group = F.element_at(F.array(*map(F.lit, ("FOODS", "HOUSEHOLD", "HOBBIES"))), (F.col("i") % 3 + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, ("CA", "TX", "WI"))), (F.col("s") % 3 + 1).cast("int"))
    series = spark.range(stores * items).select((F.col("id") % stores).alias("s"), F.floor(F.col("id") / stores).alias("i"), F.floor(F.rand(seed) * 120).alias("quiet"))
    series = series.select(F.concat(group, F.lit("_1_"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("item_id"), F.concat(group, F.lit("_1")).alias("dept_id"), group.alias("cat_id"), F.concat(state, F.lit("_1")).alias("store_id"), state.alias("state_id"), "i", "quiet")
    level = F.when(F.col("cat_id") == "FOODS", 8.0).when(F.col("cat_id") == "HOUSEHOLD", 2.0).otherwise(0.5)
    draws = series.crossJoin(cal.select("date", "d", "wm_yr_wk", "wday")).select("*", (-F.log(1 - F.rand(seed + 1)) * level * F.when(F.col("wday") <= 2, 1.35).otherwise(1.0)).alias("x"), F.rand(seed + 2).alias("u"))
    sold = F.when((F.col("cat_id") == "HOBBIES") & (F.col("u") > 0.35), 0).when(F.substring("d", 3, 9).cast("int") <= F.col("quiet"), 0).otherwise(F.round("x")).cast("int")
    wide = draws.withColumn("sales", sold).withColumn("id", F.concat_ws("_", "item_id", "store_id")).groupBy(*IDS).pivot("d", [f"d_{k}" for k in range(1, days + 1)]).agg(F.first("sales"))
    wide.coalesce(1).write.mode("overwrite").csv(f"{folder}/sales_train_evaluation.csv", header=True)
    listed = draws.where(F.substring("d", 3, 9).cast("int") > F.col("quiet")).select(*KEYS, "wm_yr_wk", "i").distinct()
    price = F.round(1.5 + F.col("i") % 7 + 0.05 * F.floor(F.rand(seed + 3) * 1.03 * 2), 2)
    listed.select(*KEYS, "wm_yr_wk", price.alias("sell_price")).coalesce(1).write.mode("overwrite").csv(f"{folder}/sell_prices.csv", header=True)
