"""From raw files to answers: ingestion, star schema, queries, forecast, decisions, serving; and the registry and entry."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwise.config import load_config
from shelfwise.operators import backtest, profile, replenishment
from shelfwise.plans import named, sqlfiles
from shelfwise.plans.binding import Retail
from shelfwise.plans.forecast import GlobalForecaster, NotFitted, global_backtest, historical_mean, production_forecast
from shelfwise.plans.reports import export_kpis, markdown
from shelfwise.serving import cli
from shelfwise.serving.store import ForecastStore, InvalidRequest, NotFound, publish
from shelfwise.session import new_folder, shared_dir
from shelfwise.sources import ingest


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw"))
    ingest.make_fixture(spark, folder, items=4, days=120)
    path = ingest.first_existing(spark, [f"{folder}/absent.csv", f"{folder}/sales_train_evaluation.csv"])
    wide, calendar, prices = ingest.read_wide_sales(spark, path), ingest.read_calendar(spark, f"{folder}/calendar.csv"), ingest.read_prices(spark, f"{folder}/sell_prices.csv")
    long = ingest.build_long_table(wide, calendar, prices)
    assert long.agg(F.sum("sales")).first()[0] == ingest.flag_active(ingest.attach_prices(ingest.wide_to_long(wide, calendar), prices)).where("is_active").agg(F.sum("sales")).first()[0]
    ingest.write_star_schema(ingest.star_schema(long, calendar, prices), f"{folder}/star")
    return Retail(ingest.read_star_schema(spark, f"{folder}/star"))


def test_ingestion_rules(spark, model):
    wide = spark.createDataFrame([("a", "i1", "d", "c", "s", "CA", 0, 2), ("b", "i2", "d", "c", "s", "CA", 1, 0)], "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string, d_1 int, d_2 int")
    calendar = spark.sql("select d, date, 1 wm_yr_wk from values ('d_1', date'2020-01-01'), ('d_2', date'2020-01-02') t(d, date)")
    long = ingest.wide_to_long(wide, calendar)
    assert long.count() == 4 and ingest.subset(wide, per_store=1).first().item_id == "i1" and ingest.subset(wide, stores=["x"]).isEmpty()
    with pytest.raises(ValueError):
        ingest.wide_to_long(wide, calendar.limit(1))
    assert ingest.first_series(long, 1).select("item_id").distinct().collect()[0][0] == "i1" and ingest.first_series(long, 9).count() == 4
    prices = spark.createDataFrame([("s", "i1", 1, 2.5)], ingest.PRICES)
    with pytest.raises(ValueError):
        ingest.attach_prices(long, prices.unionAll(prices))
    priced = ingest.attach_prices(long, prices)
    active = {m: ingest.flag_active(priced, m).where("is_active").count() for m in ("price", "first_sale", "none")}
    assert active == {"price": 2, "first_sale": 3, "none": 4}
    with pytest.raises(ValueError):
        ingest.flag_active(priced, "guess")
    with pytest.raises(FileNotFoundError):
        ingest.first_existing(spark, ["/nowhere/at/all"])


def test_registry(spark, model):
    assert len(named.REGISTRY) == 31
    assert named.run(model, "top_products_per_store", top_n=2).count() == 6
    with pytest.raises(named.UnknownQueryError):
        named.run(model, "nothing")
    with pytest.raises(ValueError):
        named.run(model, "kpi_overall", top_n=1)


def test_reports(spark, model, tmp_path):
    assert len(export_kpis(model, str(tmp_path))) == 13
    assert "total_units" in markdown(named.run(model, "kpi_overall"), "Overall")


def test_sql_files(spark, tmp_path):
    (tmp_path / "a.sql").write_text("-- intro\n-- name: v\nCREATE OR REPLACE TEMP VIEW nums AS SELECT id FROM range(10);\n-- name: top\n-- params: n\nSELECT id FROM nums WHERE id >= :low ORDER BY id DESC LIMIT :n\n".replace("params: n", "params: n, low"))
    layer = sqlfiles.SqlLayer(spark, sqlfiles.load(str(tmp_path)), {"low": 3})
    assert layer.create_views() == ["v"] and layer.analytical_queries() == ["top"]
    assert [r.id for r in layer.run("top", n=2).collect()] == [9, 8]
    with pytest.raises(ValueError):
        layer.run("top")
    with pytest.raises(KeyError):
        layer.run("none")
    (tmp_path / "b.sql").write_text("-- name: top\nSELECT 1")
    with pytest.raises(ValueError):
        sqlfiles.load(str(tmp_path))


def test_forecast_to_answers(spark, model, tmp_path, capsys):
    with pytest.raises(NotFitted):
        GlobalForecaster().predict(model.v_sales)
    segments = profile.segments(model.v_sales)
    forecast, notes = production_forecast(model.v_sales, model.dim_calendar, model.dim_store, segments, 7, f"{tmp_path}/m")
    forecast = forecast.cache()
    assert forecast.count() == 12 * 7 and forecast.where("forecast_units < 0 or horizon_day not between 1 and 7").isEmpty()
    again, noted = production_forecast(model.v_sales, model.dim_calendar, model.dim_store, segments, 7, f"{tmp_path}/m")
    assert noted["reused_existing_model"] and sorted(map(tuple, again.collect())) == sorted(map(tuple, forecast.collect()))
    policy = replenishment.Policy.from_config(load_config())
    history = historical_mean(model.v_sales)
    publish(f"{tmp_path}/s", forecast, replenishment.risk_summary(forecast, policy, history=history), replenishment.recommendations(forecast, policy, history=history), notes | {"model": "trees", "inventory_source": "simulated"})
    store = ForecastStore(spark, f"{tmp_path}/s")
    row = forecast.first()
    got = store.get_forecast(row.store_id, row.item_id)
    assert got["forecast_horizon"] == 7 and len(got["predicted_units"]) == 7 and store.health()["status"] == "ok"
    assert store.get_replenishment(row.store_id, row.item_id)["explanation"] and store.get_summary()["n_recommendations"] == 12
    assert len(store.get_risk(5)) == 5 and [r["store_id"] for r in store.get_risk(99, row.store_id)] == [row.store_id] * 4
    for bad, error in ((("no", "no"), NotFound), (("a b", "x"), InvalidRequest), (("a'; drop", "x"), InvalidRequest)):
        with pytest.raises(error):
            store.get_forecast(*bad)
    with pytest.raises(InvalidRequest):
        store.get_risk(0)
    assert cli.main(["summary"], store) == 0 and json.loads(capsys.readouterr().out)["n_series"] == 12
    assert cli.main(["forecast", "no", "no"], store) == 1
    said = capsys.readouterr()
    assert said.out == "" and json.loads(said.err)["error"] == "NotFound"
    assert cli.answer(lambda: 1 / 0) == 1 and json.loads(capsys.readouterr().err) == {"error": "InternalError", "message": "division by zero"}
    assert ForecastStore(spark, f"{tmp_path}/empty").health()["status"] == "degraded"


def test_global_model_in_every_fold(spark, model):
    """A model for each fold, of its training days alone: what follows them changes nothing."""
    first, last = model.v_sales.agg(F.min("date"), F.max("date")).first()
    folds = backtest.generate_folds(first, last, backtest.Scheme(7, 2, 7, 60))
    assert len(folds) == 2
    for kind in ("tweedie", "trees", "boosted"):
        small = {"tweedie": {}, "trees": {"maxIter": 3}, "boosted": {"trees": 3, "depth": 3}}[kind]
        found = global_backtest(model.v_sales, model.dim_calendar, model.dim_store, folds, kind, **small)
        rows = {(r.fold_id, r.store_id, r.item_id, r.date): r.global_model for r in found.collect()}
        trained = sum(model.v_sales.where(F.col("date") <= F.lit(f.train_end)).select("store_id", "item_id").distinct().count() for f in folds)
        assert len(rows) == trained * 7 and min(rows.values()) >= 0
        changed = model.v_sales.withColumn("sales", F.when(F.col("date") > F.lit(folds[0].train_end), 999).otherwise(F.col("sales")))
        again = {(r.fold_id, r.store_id, r.item_id, r.date): r.global_model for r in global_backtest(changed, model.dim_calendar, model.dim_store, folds[:1], kind, **small).collect()}
        assert again == pytest.approx({k: v for k, v in rows.items() if k[0] == 1}, rel=1e-6)
    metrics = backtest.metric_cut(backtest.run_backtest(model.v_sales, backtest.folds_frame(spark, folds), smoothers=False).join(found, ["fold_id", "store_id", "item_id", "date"]), ["fold_id"], ["ma7", "global_model"])
    assert metrics.count() == 4 and metrics.where("wape is null").isEmpty()
    with pytest.raises(ValueError):
        global_backtest(model.v_sales, model.dim_calendar, model.dim_store, [])


def test_filters_and_columns_reach_the_scan(model):
    plan = model.v_sales.where("store_id = 'CA_1' and date > '2011-04-01'").groupBy("item_id").agg(F.sum("sales"))._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "PartitionFilters: [isnotnull(store_id" in plan and "GreaterThan(date" in plan
    scan = next(line for line in plan.splitlines() if "fact_sales" in line)
    assert "sell_price" not in scan.rpartition("ReadSchema")[2]


def test_inventory_and_risk_files(spark, tmp_path):
    (tmp_path / "i.csv").write_text("store_id,item_id,inventory_position,note\ns,a,5,x\ns,b,many,\ns,c,,\n")
    assert sorted(map(tuple, ingest.read_inventory(spark, f"{tmp_path}/i.csv").collect())) == [("s", "a", 5.0), ("s", "b", None), ("s", "c", None)]
    (tmp_path / "bad.csv").write_text("store_id,stock\ns,1\n")
    (tmp_path / "twice.csv").write_text("store_id,item_id,inventory_position\ns,a,5\ns,a,6\n")
    for name in ("bad", "twice"):
        with pytest.raises(ValueError):
            ingest.read_inventory(spark, f"{tmp_path}/{name}.csv")
    (tmp_path / "r.csv").write_text("fold_id,segment,method,rmse\n1,smooth,ses,2.0\n2,smooth,ses,4.0\n1,lumpy,naive,9\n")
    assert [tuple(r) for r in replenishment.segment_risk(ingest.read_risk_report(spark, f"{tmp_path}/r.csv"), "ses").collect()] == [("smooth", 3.0)]


def test_serving_does_not_import_the_model():
    code = "import sys, shelfwise.serving.cli, shelfwise.operators.replenishment; sys.exit(any('forecast' in m and 'shelfwise' in m for m in sys.modules) or 'pyspark.ml' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1]).returncode == 0


def test_a_cluster_must_name_its_shared_folder(spark):
    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return None

        class sparkContext:
            master, applicationId = "spark://far:7077", "x"

    for master in ("spark://far:7077", "local-cluster[2,1,1024]", "yarn"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError):
            shared_dir(Session, "x")


def test_shared_folders_carry_their_scheme(spark, tmp_path):
    assert shared_dir(spark, "x").startswith("file:///")
    for k, named in enumerate((f"{tmp_path}/a", f"file://{tmp_path}/b", f"file:{tmp_path}/c")):
        made = new_folder(spark, named)
        assert made == f"file://{tmp_path}/{'abc'[k]}" and Path(made.removeprefix("file://")).is_dir()
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    own = hadoop.get("fs.defaultFS")
    try:  # another default file system takes paths without a scheme
        hadoop.set("fs.defaultFS", "viewfs://elsewhere/")
        hadoop.set("fs.viewfs.mounttable.elsewhere.link./shared", f"file://{tmp_path}")
        assert new_folder(spark, "/shared/y") == "viewfs://elsewhere/shared/y" and (tmp_path / "y").is_dir()
    finally:
        hadoop.set("fs.defaultFS", own)


def test_entry_works_without_the_subpackage():
    code = "import sys; sys.modules['shelfwise.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and not [k for k in q if k[:2] == 'op' or k == 'pipeline']"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1]).returncode == 0
