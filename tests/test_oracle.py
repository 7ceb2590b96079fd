"""Every query with SQL against that SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from shelfwise.operators import stats
from shelfwise.plans import families, queries

SF = "/root/testdata/sf0.001"
PLANS = queries.queries() | families.queries()
SQL = queries.oracle_sql() | families.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def texts(df):
    """Rows as sorted tuples of text: dates by day, numbers as floats, nulls alike."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if s.dtype == object and len(s.dropna()) and hasattr(s.dropna().iloc[0], "isoformat"):
            s = pd.to_datetime(s)
        if str(s.dtype).startswith("datetime"):
            s = s.dt.strftime("%Y-%m-%d")
        elif s.dtype != object and s.dtype != bool:
            s = s.astype("float64")
        df[c] = s.astype(object).where(s.notna(), None).map(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = PLANS[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = texts(got), texts(want)
    assert len(a) == len(b) and a.equals(b), a.compare(b).head() if a.shape == b.shape else (a.shape, b.shape)


def test_every_query_is_checked_or_listed():
    assert set(PLANS) - set(SQL) == {"store_mean_intervals", "weekend_difference_intervals", "global_model_forecast", "global_model_backtest", "model_replenishment"}


def test_a_family_with_a_test_whose_values_are_all_equal(spark, tmp_path):
    """Every series sells on every day, so all shares of days without sales are 0 and their test has no statistic."""
    con = duckdb.connect()
    for name in ("nation", "region"):
        con.execute(f"create table {name} as select * from '{SF}/{name}.parquet'")
    con.execute("create table supplier as select n_nationkey::bigint as s_suppkey, n_nationkey as s_nationkey from nation")
    con.execute("create table part as select p::bigint as p_partkey, 'Brand#' || p as p_brand from (select unnest(range(1, 26)) as p)")
    con.execute(
        "create table lineitem as select p_partkey as l_partkey, s_suppkey as l_suppkey, d as l_shipdate, (10 + (day(d) * (1 + s_suppkey % 7) + p_partkey) % 5)::double as l_quantity, 10.0::double as l_extendedprice"
        " from part, supplier, (select unnest(generate_series(timestamp '1995-01-07', timestamp '1995-07-31', interval 1 day)) as d)"
    )
    for name in ("nation", "region", "supplier", "part", "lineitem"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet'")
    for name in ("demand_test_family", "weekend_and_snap_tests", "store_kruskal_tests"):
        got, want = PLANS[name](spark, str(tmp_path)).toPandas(), con.execute(SQL[name]).df()
        assert texts(got).equals(texts(want)), texts(got).compare(texts(want))
        if name == "demand_test_family":
            assert want.set_index("test").statistic.isna()["zero share of categories"] and got.p_fdr.notna().all()


def test_values_that_are_all_equal_make_a_test_without_a_statistic(spark):
    same = spark.createDataFrame([("t", g, 2.0) for g in (0, 0, 0, 1, 1)], "test string, g int, x double")
    h, z = (f(same, "test", "g", "x", stats.UNDEFINED).first() for f in (stats.kruskal, stats.mann_whitney))
    assert all(v is not None and math.isnan(v) for v in (h.h, h.epsilon_squared, h.p_value, z.z, z.p_value)) and z.delta == 0
    got = {r.t: (r.p_fdr, r.significant_fdr) for r in stats.benjamini_hochberg(spark.createDataFrame([("a", 0.01), ("b", float("nan")), ("c", None)], "t string, p_value double")).collect()}
    assert got == {"a": (0.02, True), "b": (1.0, False), "c": (None, False)}
