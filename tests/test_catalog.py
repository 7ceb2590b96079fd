"""Table functions, bucketed tables, checks observed by a write, calendar frames and lookups by file ranges."""

import os
from datetime import date, timedelta
from statistics import mean, stdev

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfwise.operators import calendar_frames, quality
from shelfwise.operators.observed import figures, watch
from shelfwise.plans import catalog, families, tablefunctions
from shelfwise.plans.binding import Retail, retail
from shelfwise.plans.named import REGISTRY, UnknownQueryError, run
from shelfwise.serving.store import ForecastStore, NotFound, publish
from shelfwise.session import shared_dir

SF = "/root/testdata/sf0.001"
DAY = date(2020, 1, 1)
with_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_every_parameterised_query_has_a_function_with_its_defaults():
    assert {f.name: set(f.types) for f in tablefunctions.FUNCTIONS} == {n: set(q.params) for n, q in REGISTRY.items() if q.params}
    assert all(set(f.checks) == set(f.types) for f in tablefunctions.FUNCTIONS)


@with_tables
@pytest.mark.parametrize("name, given", [*families.CALLS.values(), *[(f.name, {}) for f in tablefunctions.FUNCTIONS], ("product_volatility", {"min_total_units": 0, "top_n": 3}), ("product_volatility", {"top_n": 100_000})])
def test_function_equals_registry(spark, name, given):
    m = retail(spark, SF)
    got, want = tablefunctions.call(m, spark, name, **given), run(m, name, **given)
    assert got.schema.simpleString() == want.schema.simpleString() and rows(got) == rows(want)


@with_tables
def test_functions_by_place_and_with_bad_arguments(spark):
    m = retail(spark, SF)
    tablefunctions.create_functions(m, spark)
    assert rows(spark.sql("SELECT * FROM top_products_per_store(2)")) == rows(run(m, "top_products_per_store", top_n=2))
    assert rows(spark.sql("SELECT t.item_id FROM declining_products(top_n => 2, min_prior_units => 0) t")) == rows(run(m, "declining_products", min_prior_units=0, top_n=2).select("item_id"))
    for bad in ("top_products_per_store(0)", "product_volatility(-1, 5)", "persistent_low_demand(1, 1.5)", "named_event_impact(0)"):
        with pytest.raises(PySparkException, match="must hold"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    with pytest.raises(ValueError):
        tablefunctions.call(m, spark, "top_products_per_store", n=1)
    with pytest.raises(UnknownQueryError):
        tablefunctions.call(m, spark, "kpi_overall")


@with_tables
def test_a_row_limit_takes_first_rows_of_each_task(spark):
    assert "TakeOrderedAndProject(limit=3" in plan_of(tablefunctions.call(retail(spark, SF), spark, "declining_products", top_n=3))


def test_quartiles_of_tied_series(spark):
    """More ties than the limit shows: the place of a shown row counts the ties that are not shown."""
    start = [(f"i{k:02d}", "s", DAY + timedelta(days=d), 1, (d + (k > 8)) % 2 * (2 + (k > 11)), 100, "d", "c", 1.0) for k in range(14) for d in range(6 + (k > 12))]
    sales = spark.createDataFrame(start, "item_id string, store_id string, date date, wm_yr_wk long, sales int, cents long, dept_id string, cat_id string, sell_price double")
    cal = sales.select("date", F.lit("d_1").alias("d"), "wm_yr_wk").distinct().select("*", *[F.lit(1).cast("long").alias(c) for c in ("wday", "month", "year")], *[F.lit(None).cast("string").alias(c) for c in ("event_name_1", "event_type_1", "event_name_2", "event_type_2")], *[F.lit(0).alias(c) for c in ("snap_CA", "snap_TX", "snap_WI")])
    m = Retail({"fact_sales": sales.drop("dept_id", "cat_id").withColumns({"d": F.lit("d_1"), "is_active": F.lit(True)}), "dim_product": sales.select("item_id", "dept_id", "cat_id").distinct(), "dim_store": sales.select("store_id", F.lit("CA").alias("state_id")).distinct(), "dim_calendar": cal})
    for n in (1, 2, 5, 9, 13, 14, 50):
        assert rows(tablefunctions.call(m, spark, "product_volatility", min_total_units=0, top_n=n)) == rows(run(m, "product_volatility", min_total_units=0, top_n=n))


FACTS = "store_id string, item_id string, date date, sales int, cents long, sell_price double, is_active boolean, extra string"


def facts(spark, values):
    return spark.createDataFrame([(s, i, d if d is None else DAY + timedelta(days=d), q, None if p is None else int(p * 100), p, a, "x") for s, i, d, q, p, a in values], FACTS)


@pytest.mark.parametrize("values", [
    [("a", "x", d, d, 1.5, True) for d in range(5)] + [("a", "y", d, 0, None, True) for d in (0, 1, 3)] + [("b", "x", 0, -2, 0.0, False)],
    [("a", "x", 0, 1, 1.0, True)] * 3 + [("a", "x", 1, 1, 1.0, True)] * 2 + [("a", "x", 2, 0, 1.0, True)],
    [(None, "x", 0, 1, 1.0, True), (None, "x", 0, 1, 1.0, True), ("a", None, 1, 1, 1.0, None), ("a", "x", None, 1, 1.0, True), ("a", "x", None, None, 1.0, True), ("a", "x", 4, 0, None, True), ("c", "z", None, 0, 1.0, True)],
    [],
])
def test_observed_figures_are_those_of_the_checks(spark, values):
    df = facts(spark, values)
    watched, seen = watch(df)
    folder = shared_dir(spark, "observed")
    watched.sortWithinPartitions("store_id", "item_id", "date").write.mode("overwrite").parquet(folder)
    got = figures(seen)
    assert rows(quality.observed_checks(spark, got)) == rows(quality.quality_checks(df))
    assert rows(spark.read.parquet(folder)) == rows(df) and watched.columns == df.columns
    assert got["n"] == len(values) and got["units"] == sum(v[3] or 0 for v in values) and got["series"] == len({v[:2] for v in values})
    repeated = df.groupBy("store_id", "item_id", "date").count().where("count > 1").count()
    assert got["repeated_keys"] == repeated and got["inactive"] == sum(v[5] is False for v in values)


@with_tables
def test_the_write_has_one_exchange_and_validation_scans_less(spark):
    m = retail(spark, SF)
    watched, _ = watch(m.fact_sales)
    plan = watched.sortWithinPartitions("store_id", "item_id", "date")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and plan.count("Sort [") == 1
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("/fact_sales")
    assert scans(quality.observed_checks(spark, m.observed)) == 0 and scans(quality.validate(m)) < scans(quality.validate(Retail(m.tables)))
    assert rows(quality.validate(m)) == rows(quality.validate(Retail(m.tables)))


SERIES = "k string, date date, x int, date_ string"


def test_calendar_frames_against_brute_force(spark):
    given = [("a", d, d % 5) for d in (0, 1, 2, 7, 8, 15, 16, 16, 40)] + [("b", d, d) for d in range(12)] + [("c", 3, None), ("c", 9, 4), ("c", 10, None)] + [("n", None, 1), ("n", None, 5), ("n", 2, 7), (None, 0, 1), (None, 7, 2)]
    df = spark.createDataFrame([(k, d if d is None else DAY + timedelta(days=d), x, "own") for k, d, x in given], SERIES)
    assert not calendar_frames.is_continuous(df, ["k"]) and calendar_frames.is_continuous(df.where("k = 'b'"), ["k"]) and calendar_frames.is_continuous(df.limit(0), ["k"])
    got = calendar_frames.rolling_days(df, ["k"], "x", (7,))
    want = []
    for k, d, x in given:
        own = [(e, y) for j, e, y in given if j == k and ((e is None) if d is None else (e is not None and d - 6 <= e <= d))]
        held = [y for _, y in own if y is not None]
        week = [y for j, e, y in given if j == k and y is not None and ((e is None) if d is None else (e == d - 7))]
        want.append((k, d if d is None else DAY + timedelta(days=d), x, "own", max(week, default=None), sum(held) if held else None, mean(held) if held else None, stdev(held) if len(held) > 1 else None, len(own)))
    same = lambda r: tuple(round(float(v), 9) if i in (6, 7) and v is not None else v for i, v in enumerate(r))
    assert sorted(map(same, map(tuple, got.collect())), key=str) == sorted(map(same, want), key=str)


def test_frames_of_rows_where_no_day_lacks(spark):
    df = spark.createDataFrame([("b", DAY + timedelta(days=d), d * d % 7, "") for d in range(60)], SERIES)
    by_rows, by_range = calendar_frames.rolling_days(df, ["k"], "x"), calendar_frames.rolling_days(df, ["k"], "x", continuous=False)
    assert "RowFrame" in plan_of(by_rows) and "RangeFrame" in plan_of(by_range) and rows(by_rows) == rows(by_range)


@with_tables
@pytest.mark.parametrize("name", ["bucketed_lag_features", "bucketed_rolling_features", "bucketed_backtest"])
def test_no_exchange_over_bucketed_facts(spark, name):
    plan = plan_of(families.queries()[name](spark, SF))
    assert "Exchange hashpartitioning" not in plan and "SelectedBucketsCount" in plan


def test_tables_are_made_anew(spark):
    def model(n):
        sales = spark.createDataFrame([("s", f"i{k}", DAY, k, 100, 1.0, True, "x") for k in range(n)], FACTS)
        return {"fact_sales": sales, "dim_price": sales.select("store_id", "item_id", F.lit(1).alias("wm_yr_wk"), "cents"), "dim_store": sales.select("store_id").distinct()}

    for n in (50, 20, 0):
        names = catalog.create_tables(spark, model(n), shared_dir(spark, "catalog"), "made_", buckets=4)
        assert names == ["made_fact_sales", "made_dim_price", "made_dim_store"] and catalog.catalog_model(spark, names, "made_").fact_sales.count() == n
    names = catalog.create_tables(spark, model(50), shared_dir(spark, "catalog"), "made_", buckets=4)
    joined = spark.table("made_fact_sales").join(spark.table("made_dim_price").hint("merge"), ["store_id", "item_id"])
    assert "Exchange" not in plan_of(joined) and len(spark.table("made_fact_sales").inputFiles()) <= 4
    assert catalog.bucket_count(0) == 8 and catalog.bucket_count(10**9) == 128
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def scanned(df):
    """Rows that the scans of a plan put out, after row groups were skipped."""
    df.collect()

    def walk(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if p.nodeName().startswith("Scan"):
            return p.metrics().apply("numOutputRows").value()
        return sum(walk(p.children().apply(k)) for k in range(p.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_lookup_opens_the_file_of_its_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("shelfwise.serving.store.ROW_GROUP", 4096)
    days = spark.range(28).select(F.col("id").cast("int").alias("horizon_day"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("forecast_date"))
    series = spark.range(3000).select(F.when(F.col("id") < 2500, "big").otherwise("small").alias("store_id"), F.format_string("i%05d", "id").alias("item_id"))
    odd = spark.createDataFrame([(None, "i1"), ("big", None)], "store_id string, item_id string")
    forecast = series.unionByName(odd).crossJoin(days).withColumns({"forecast_units": F.rand(3), "segment": F.lit("smooth")})
    risk = series.withColumn("risk_flag", F.lit("LOW_RISK"))
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        publish(f"{tmp_path}/s", forecast, risk, None, {"model": "m"})
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    store = ForecastStore(spark, f"{tmp_path}/s")
    assert store.forecast.count() == 3002 * 28
    held = {r[0] for r in store.forecast.where("store_id = 'big'").select(F.col("_metadata.file_name")).distinct().collect()}
    assert len(held) >= 5  # no task held the store
    for item in ("i00000", "i01234", "i02499"):
        assert len(store.files_of("forecast", "big", item)) in (1, 2)
        assert store.get_forecast("big", item)["forecast_horizon"] == 28
        assert 28 <= scanned(store._of("forecast", store.forecast, "big", item)) < 3002 * 28 // 8
    assert store.files_of("forecast", "zzz", "i1") == [] and store.get_forecast("small", "i02999")["risk_flag"] == "LOW_RISK"
    with pytest.raises(NotFound):
        store.get_forecast("big", "none")
