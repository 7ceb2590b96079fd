"""The global model, its backtest and the production forecast.

One model for all series, the same for backtest and production: boosted trees with a Tweedie loss ("boosted", see
`operators.boosting`), which suit counts with many zeros, know missing lags from zero sales and split stores by sets. Spark
ML's generalised linear regression of the Tweedie family ("tweedie") and its trees with squared loss ("trees") are there
to compare; both take missing features as 0. Errors are these models' own and not those of another library.
"""

from __future__ import annotations

import json
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import boosting
from shelfwise.operators.backtest import Fold
from shelfwise.operators.features import FeatureSet, build_fold_features

PARAMS = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.15, "seed": 42, "subsamplingRate": 0.8}
BOOSTED = {"trees": 12, "depth": 4, "rate": 0.4, "power": 1.5, "bins": 32}
#: Days at the end of the training that judge how many trees are enough, if the training is at least four times as long.
JUDGED = 28
TWEEDIE = {"family": "tweedie", "variancePower": 1.5, "linkPower": 0.0, "regParam": 0.01, "maxIter": 25}


class NotFitted(RuntimeError):
    pass


class GlobalForecaster:
    """One model for all series; predictions are never negative."""

    def __init__(self, kind: str = "boosted", **params: float):
        self.kind, self.params = kind, {**{"boosted": BOOSTED, "trees": PARAMS, "tweedie": TWEEDIE}[kind], **params}
        self.model: PipelineModel | boosting.Model | None = None
        self.features: list[str] = []

    def fit(self, train: DataFrame, features: list[str], target: str = "y") -> GlobalForecaster:
        if self.kind == "boosted":
            first, last = train.agg(F.min("date"), F.max("date")).first()
            rows = train.withColumns({"__fit": F.lit(0), "__held": judging(first, F.lit(last))})
            self.features, self.model = list(features), boosting.fit(rows, list(features), ["store_id"], target, "__fit", "__held", boosting.Settings(**self.params))[0]
            return self
        stages = [
            StringIndexer(inputCol="store_id", outputCol="__store", handleInvalid="keep"),
            *([OneHotEncoder(inputCol="__store", outputCol="__one", handleInvalid="keep")] if self.kind == "tweedie" else []),
            VectorAssembler(inputCols=[*features, "__one" if self.kind == "tweedie" else "__store"], outputCol="__x"),
            (GBTRegressor if self.kind == "trees" else GeneralizedLinearRegression)(featuresCol="__x", labelCol=target, predictionCol="__p", **self.params),
        ]
        rows = train.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("double"))
        self.features, self.model = list(features), Pipeline(stages=stages).fit(self._filled(rows, features))
        return self

    def predict(self, rows: DataFrame, out: str = "forecast_units") -> DataFrame:
        if self.model is None:
            raise NotFitted("fit the model first")
        if self.kind == "boosted":
            return self.model.predict(rows, out)
        return self.model.transform(self._filled(rows, self.features)).withColumn(out, F.greatest(F.lit(0.0), F.col("__p"))).drop("__store", "__one", "__x", "__p", *[f"__{c}" for c in self.features])

    def _filled(self, rows: DataFrame, features: list[str]) -> DataFrame:
        """Missing features are 0. Under the log link, past sales enter by their logarithm: they act on it in proportion."""
        past = lambda c: self.kind == "tweedie" and c.startswith(("lag_", "rolling_mean", "rolling_std"))
        value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return rows.withColumns({c: F.log1p(F.greatest(value(c), F.lit(0.0))) if past(c) else value(c) for c in features})

    def save(self, path: str, meta: dict) -> None:
        if self.kind == "boosted":
            meta = meta | {"model": self.model.as_dict()}
        else:
            self.model.write().overwrite().save(f"{path}/model")
        SparkSession.active().createDataFrame([(json.dumps(meta | {"params": self.params, "kind": self.kind, "features": self.features}, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def judging(first: date, last: Column) -> Column:
    """Whether a row's date is among the last days of a training from first to last."""
    return (F.col("date") > F.date_sub(last, JUDGED)) & (F.datediff(last, F.lit(first)) >= 4 * JUDGED)


def global_backtest(facts: DataFrame, calendar: DataFrame, stores: DataFrame, folds: list[Fold], kind: str = "boosted", name: str = "global_model", **params: float) -> DataFrame:
    """fold_id, keys, date and the global model's forecast of every fold: a model for each, fitted on the features of its
    training days alone.

    Boosted models of all folds grow side by side, in the same jobs: features look back only, so those of the last fold's
    training days hold those of all others. Bins come from the days that every fold knows. Other kinds take a fit for each
    of the folds, which are a handful.
    """
    if not folds:
        raise ValueError("no fold has enough days to train on")
    horizon = {f.fold_id: (f.forecast_end - f.train_end).days for f in folds}
    sets = {f.fold_id: build_fold_features(facts, calendar, stores, f.train_end, horizon[f.fold_id]) for f in folds}
    if kind == "boosted":
        longest, shortest = max(folds, key=lambda f: f.train_end), min(folds, key=lambda f: f.train_end)
        train = sets[longest.fold_id][0]
        each = F.explode(F.array(*[F.struct(F.lit(f.fold_id).alias("fold_id"), F.lit(f.train_end).alias("end")) for f in folds]))
        rows = train.df.select("*", each.alias("f")).where(F.col("date") <= F.col("f.end")).withColumns({"__fit": F.col("f.fold_id"), "__held": judging(shortest.train_start, F.col("f.end"))})
        found = boosting.fit(rows, train.all_feature_cols, ["store_id"], "y", "__fit", "__held", boosting.Settings(**{**BOOSTED, **params}), known=train.df.where(F.col("date") <= F.lit(shortest.train_end)))
        models = {k: m.predict for k, m in found.items()}
    else:
        models = {k: GlobalForecaster(kind, **params).fit(t.df, t.all_feature_cols).predict for k, (t, _) in sets.items()}
    out = None
    for k, (_, future) in sets.items():
        found = models[k](future.df, name).select(F.lit(k).alias("fold_id"), "store_id", "item_id", "date", name)
        out = found if out is None else out.unionByName(found)
    return out


def train_or_load(path: str, train: FeatureSet, cutoff: date, force: bool = False, kind: str = "boosted", **params: float) -> tuple[GlobalForecaster, dict, bool]:
    """(model, its notes, whether it was loaded): reused only where parameters, features and cutoff are the same."""
    spark = SparkSession.active()
    wanted = {"params": GlobalForecaster(kind, **params).params, "kind": kind, "features": train.all_feature_cols, "training_cutoff": str(cutoff)}
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    if not force and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/meta").collect()))  # one small file
        if all(meta.get(k) == v for k, v in wanted.items()):
            known = GlobalForecaster(kind, **params)
            known.features, known.model = meta["features"], boosting.Model.from_dict(meta.pop("model")) if kind == "boosted" else PipelineModel.load(f"{path}/model")
            return known, meta, True
    made = GlobalForecaster(kind, **params).fit(train.df, train.all_feature_cols)
    made.save(path, {"training_cutoff": str(cutoff)})
    return made, wanted, False


def production_forecast(facts: DataFrame, calendar: DataFrame, stores: DataFrame, segments: DataFrame, horizon: int = 28, model_path: str | None = None, force: bool = False) -> tuple[DataFrame, dict]:
    """(forecast, notes): store_id, item_id, forecast_date, forecast_units, horizon_day, segment for the days after the last."""
    cutoff = facts.agg(F.max("date")).first()[0]
    train, future = build_fold_features(facts, extended(calendar, cutoff, horizon), stores, cutoff, horizon)
    if model_path is None:
        model = GlobalForecaster().fit(train.df, train.all_feature_cols)
        meta, reused = {"training_cutoff": str(cutoff), "kind": model.kind, "params": model.params}, False
    else:
        model, meta, reused = train_or_load(model_path, train, cutoff, force)
    out = model.predict(future.df).join(segments.select("store_id", "item_id", "segment"), ["store_id", "item_id"], "left")
    forecast = out.select("store_id", "item_id", F.col("date").alias("forecast_date"), "forecast_units", F.datediff("date", F.lit(cutoff)).alias("horizon_day"), F.coalesce("segment", F.lit("unknown")).alias("segment"))
    return forecast, meta | {"reused_existing_model": reused, "horizon_days": horizon}


def extended(calendar: DataFrame, cutoff: date, horizon: int) -> DataFrame:
    """The calendar with the days after the cutoff that it lacks: week days, months and years; no event, no SNAP."""
    spark = calendar.sparkSession
    days = spark.range(1, horizon + 1).select(F.date_add(F.lit(cutoff).cast("date"), F.col("id").cast("int")).alias("date")).join(calendar.select("date"), "date", "left_anti")
    more = days.select("date", (F.dayofweek("date") % 7 + 1).cast("long").alias("wday"), F.month("date").cast("long").alias("month"), F.year("date").cast("long").alias("year"))
    return calendar.unionByName(more, allowMissingColumns=True)


def historical_mean(facts: DataFrame) -> DataFrame:
    return facts.groupBy("store_id", "item_id").agg(F.avg("sales").alias("historical_mean_sales"))
