"""Read-only answers from written forecasts and decisions; nothing is computed anew here, and no model is loaded.

Tables lie in files of ranges of (store, item). Beside each table is an index, a row for each file with its first and last
series, so that an answer about one series opens the file of its range and in it the row groups that can hold it.
"""

from __future__ import annotations

import json
import re
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import replenishment as r

IDENTIFIER = re.compile(r"[A-Za-z0-9_\-]{1,64}")
#: What an index holds of each file.
INDEX = "file string, first struct<store_id: string, item_id: string>, last struct<store_id: string, item_id: string>"
#: Bytes of a row group, and the items that its Bloom filter is made for.
ROW_GROUP, ITEMS_OF_A_GROUP = 8 << 20, 10_000
SEVERITY = [r.STOCKOUT, r.OUTLIER, r.UNCERTAIN, r.NO_DATA, r.LOW]

REASONS = {
    r.BELOW_REORDER_POINT: "Order: stock is under the demand expected until delivery plus safety stock.",
    r.AT_TARGET: "No order: stock covers this review cycle.",
    r.NO_FORECAST: "No decision: the series has no forecast.",
    r.NO_INVENTORY: "No decision: the series' stock is not known.",
    r.ZERO_FORECAST: "No order: no demand is forecast and stock covers the safety stock.",
}
RISKS = {
    r.STOCKOUT: "Stock is at or under the safety stock.",
    r.UNCERTAIN: "Demand of this segment has been hard to forecast.",
    r.OUTLIER: "The forecast is far above the series' own history; it should be looked at.",
    r.LOW: "Nothing unusual.",
    r.NO_DATA: "There is too little data to judge the risk.",
}


class StoreError(Exception):
    pass


class InvalidRequest(StoreError):
    pass


class NotFound(StoreError):
    pass


class Unavailable(StoreError):
    pass


def identifier(name: str, value: object) -> str:
    if not isinstance(value, str) or not IDENTIFIER.fullmatch(value):
        raise InvalidRequest(f"{name} has letters, digits, _ and - only, 64 at most")
    return value


def explain(reason: str | None, risk: str | None) -> str:
    return " ".join(x for x in (REASONS.get(reason or ""), RISKS.get(risk or "")) if x) or "No explanation."


def rounded(value: float | None) -> float | None:
    return None if value is None else round(float(value), 4)


class ForecastStore:
    """forecast, risk and recommendations as Parquet below a folder, and notes of the run; each is read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _table(self, name: str) -> DataFrame:
        if not self._exists(name):
            raise Unavailable(f"{name} has not been written")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @cached_property
    def forecast(self) -> DataFrame:
        return self._table("forecast")

    @cached_property
    def risk(self) -> DataFrame:
        return self._table("risk")

    @cached_property
    def recommendations(self) -> DataFrame | None:
        return self._table("recommendations") if self._exists("recommendations") else None

    @cached_property
    def notes(self) -> dict[str, Any]:
        if not self._exists("notes"):
            return {}
        return json.loads("".join(x[0] for x in self.spark.read.text(f"{self.folder}/notes").collect()))  # one line

    def health(self) -> dict[str, Any]:
        checks = {n: self._exists(n) for n in ("forecast", "risk", "notes")}
        return {"status": "ok" if all(checks.values()) else "degraded", "checks": checks, "folder": self.folder}

    def metadata(self) -> dict[str, Any]:
        known = ("model", "params", "features", "training_cutoff", "mode", "inventory_source", "horizon_days", "reused_existing_model", "generated_at")
        return {k: self.notes.get(k) for k in known} | {"n_features": len(self.notes.get("features") or [])}

    def files_of(self, name: str, store_id: str, item_id: str) -> list[str]:
        """The files whose range holds a series: one, or two where its rows lie across a border."""
        if not self._exists(f"{name}_index"):
            raise Unavailable(f"{name} has no index")
        index = self.spark.read.schema(INDEX).parquet(f"{self.folder}/{name}_index")
        key = F.struct(F.lit(store_id).alias("store_id"), F.lit(item_id).alias("item_id"))
        held = index.where((F.col("first") <= key) & (key <= F.col("last"))).select("file").orderBy("file")
        return [f"{self.folder}/{name}/{x[0]}" for x in held.collect()]

    def _of(self, name: str, df: DataFrame, store_id: str, item_id: str) -> DataFrame:
        """The rows of one series, from the files that can hold them."""
        store_id, item_id = identifier("store_id", store_id), identifier("item_id", item_id)
        files = self.files_of(name, store_id, item_id)
        rows = self.spark.read.schema(df.schema).parquet(*files) if files else df.limit(0)
        return rows.where((F.col("store_id") == store_id) & (F.col("item_id") == item_id))

    def get_forecast(self, store_id: str, item_id: str) -> dict[str, Any]:
        rows = self._of("forecast", self.forecast, store_id, item_id).orderBy("forecast_date").collect()  # a horizon of one series
        if not rows:
            raise NotFound(f"no forecast of {store_id}/{item_id}")
        risk = self._of("risk", self.risk, store_id, item_id).first()
        return {
            "store_id": store_id, "item_id": item_id, "forecast_cutoff_date": self.notes.get("training_cutoff"), "forecast_horizon": len({x["horizon_day"] for x in rows}), "forecast_dates": [str(x["forecast_date"]) for x in rows],
            "predicted_units": [rounded(x["forecast_units"]) for x in rows], "segment": rows[0]["segment"], "risk_flag": risk and risk["risk_flag"], "model": self.notes.get("model"),
        }

    def get_replenishment(self, store_id: str, item_id: str) -> dict[str, Any]:
        if self.recommendations is None:
            self.get_forecast(store_id, item_id)  # so that an unknown series is told as such
            return {"store_id": store_id, "item_id": item_id, "mode": "FORECAST-ONLY", "recommended_order_qty": None, "decision_reason": r.NO_INVENTORY, "risk_flag": None, "explanation": explain(r.NO_INVENTORY, None)}
        row = self._of("recommendations", self.recommendations, store_id, item_id).first()
        if row is None:
            raise NotFound(f"no recommendation for {store_id}/{item_id}")
        source = self.notes.get("inventory_source", "unknown")
        said = {"simulated": "The stock is a scenario's, not an observed one.", "user_supplied": "The stock was supplied."}
        return row.asDict() | {"mode": "REPLENISHMENT", "inventory_source": source, "simulation_notice": said.get(source, "Where the stock came from is not known; take it as simulated."), "explanation": explain(row["decision_reason"], row["risk_flag"])}

    def get_risk(self, top: int = 20, store_id: str | None = None) -> list[dict[str, Any]]:
        if top <= 0:
            raise InvalidRequest("top is a positive number")
        df = self.recommendations if self.recommendations is not None else self.risk
        if store_id is not None:
            df = df.where(F.col("store_id") == identifier("store_id", store_id))
        rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("risk_flag")), F.lit(0))
        order = [F.when(rank == 0, 9).otherwise(rank), *([F.desc_nulls_last("recommended_order_qty")] if "recommended_order_qty" in df.columns else []), "store_id", "item_id"]
        return [x.asDict() | {"explanation": explain(x.asDict().get("decision_reason"), x["risk_flag"])} for x in df.orderBy(*order).limit(top).collect()]

    def get_summary(self) -> dict[str, Any]:
        series = self.forecast.select("store_id", "item_id", "segment").distinct()
        tally = lambda df, c: {x[0]: x[1] for x in df.groupBy(c).count().collect()}  # noqa: E731  stores, segments, flags
        out = {"n_series": series.count(), "by_store": tally(series, "store_id"), "by_segment": tally(series, "segment"), "risk_flag_counts": tally(self.risk, "risk_flag"), "run_metadata": self.notes, "n_recommendations": 0}
        if self.recommendations is not None:
            out |= {"n_recommendations": self.recommendations.count(), "n_orders_recommended": self.recommendations.where("recommended_order_qty > 0").count(), "decision_reason_counts": tally(self.recommendations, "decision_reason")}
        return out


def publish(folder: str, forecast: DataFrame, risk: DataFrame, recommendations: DataFrame | None, notes: dict) -> None:
    """Writes what a store reads: tables in files of ranges of series, with their indexes. A store of any size is dealt over
    as many tasks as its series need; ROW_GROUP bytes at most are read for a series, and a Bloom filter says which groups
    lack an item. Rows with a null store or item are kept and named by no range."""
    spark = forecast.sparkSession
    for name, df in (("forecast", forecast), ("risk", risk), ("recommendations", recommendations)):
        if df is None:
            continue
        by = ["store_id", "item_id", *(["forecast_date"] if "forecast_date" in df.columns else [])]
        writer = df.repartitionByRange("store_id", "item_id").sortWithinPartitions(*by).write.mode("overwrite")
        writer.option("parquet.block.size", ROW_GROUP).option("parquet.bloom.filter.enabled#item_id", "true").option("parquet.bloom.filter.expected.ndv#item_id", ITEMS_OF_A_GROUP).parquet(f"{folder}/{name}")
        series = F.struct("store_id", "item_id")
        written = spark.read.schema(df.schema).parquet(f"{folder}/{name}").where("store_id is not null and item_id is not null")
        index = written.groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(F.min(series).alias("first"), F.max(series).alias("last"))
        index.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}_index")  # a row for each file
    spark.createDataFrame([(json.dumps(notes, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/notes")
