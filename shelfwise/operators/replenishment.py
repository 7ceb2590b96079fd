"""Orders from forecasts: safety stock, reorder points, order quantities, reasons and risk flags, all as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["store_id", "item_id"]

# The vocabulary of decisions.
BELOW_REORDER_POINT = "inventory_position_below_reorder_point"
AT_TARGET = "inventory_position_at_or_above_target"
NO_FORECAST = "missing_forecast"
NO_INVENTORY = "missing_inventory_data"
ZERO_FORECAST = "zero_forecast_no_order"
STOCKOUT, UNCERTAIN, OUTLIER, LOW, NO_DATA = "STOCKOUT_RISK", "HIGH_UNCERTAINTY_SEGMENT", "HIGH_FORECAST_OUTLIER", "LOW_RISK", "INSUFFICIENT_DATA"
UNCERTAIN_SEGMENTS = ("intermittent", "lumpy", "unknown")


def safety_z(service_level: float, override: float | None = None) -> float:
    """The normal quantile of a service level strictly between 0 and 1, unless overridden."""
    if override is not None:
        return float(override)
    if not 0 < service_level < 1:
        raise ValueError("a service level lies between 0 and 1")
    return NormalDist().inv_cdf(service_level)


@dataclass(frozen=True)
class Policy:
    lead_time_days: float = 7
    service_level: float = 0.95
    review_period_days: float = 7
    days_of_cover: float = 14
    fallback_sigma: float = 1.0
    outlier_multiplier: float = 10.0
    z_override: float | None = None

    def __post_init__(self) -> None:
        if min(self.lead_time_days, self.fallback_sigma) < 0:
            raise ValueError("lead time and sigma are not negative")

    @classmethod
    def from_config(cls, config: Mapping) -> Policy:
        """From the sections `replenishment` and `phase6`; a missing assumption is an error, never a silent default."""
        plain, more = config["replenishment"], config["phase6"]
        return cls(plain["lead_time_days"], plain["service_level"], plain["review_period_days"], plain["initial_inventory_days_of_cover"], more["fallback_sigma"], more["outlier_forecast_multiplier"], more.get("safety_stock_z_override"))

    @property
    def z(self) -> float:
        return safety_z(self.service_level, self.z_override)


def safety_stock(sigma: Column, policy: Policy) -> Column:
    return policy.z * sigma * policy.lead_time_days**0.5


def reorder_point(mean: Column, stock: Column, policy: Policy) -> Column:
    return F.greatest(F.lit(0.0), mean) * policy.lead_time_days + stock


def order_up_to(mean: Column, stock: Column, policy: Policy) -> Column:
    return F.greatest(F.lit(0.0), mean) * (policy.lead_time_days + policy.review_period_days) + stock


def simulated_inventory(mean: Column, policy: Policy) -> Column:
    """A scenario's stock, not an observed one: so many days of the forecast."""
    return F.greatest(F.lit(0.0), mean) * max(0.0, policy.days_of_cover)


def segment_risk(report: DataFrame, method: str) -> DataFrame:
    """segment, sigma_daily: the mean RMSE that the method had in each segment's backtest."""
    return report.where(F.col("method") == method).groupBy("segment").agg(F.avg("rmse").alias("sigma_daily"))


def per_series(forecast: DataFrame, policy: Policy, risk: DataFrame | None, history: DataFrame | None) -> DataFrame:
    """forecast (store_id, item_id, forecast_units, horizon_day, segment) as one row for each series with its inputs."""
    by = forecast.groupBy(*KEYS).agg(F.min("segment").alias("segment"), F.countDistinct("horizon_day").alias("forecast_horizon"), F.avg("forecast_units").alias("forecast_daily_mean"))
    out = by.join(F.broadcast(risk), "segment", "left") if risk is not None else by.withColumn("sigma_daily", F.lit(None).cast("double"))  # a row for each segment
    out = out.join(history.select(*KEYS, "historical_mean_sales"), KEYS, "left") if history is not None else out.withColumn("historical_mean_sales", F.lit(None).cast("double"))
    return out.withColumn("sigma_daily", F.coalesce("sigma_daily", F.lit(float(policy.fallback_sigma))))


def decide(df: DataFrame, policy: Policy) -> DataFrame:
    """Adds lead_time_days, safety_stock, reorder_point, recommended_order_qty, decision_reason and risk_flag.

    df has forecast_daily_mean, sigma_daily, segment, inventory_position and historical_mean_sales; NaN is missing.
    """
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    mean, stock_on_hand, past = F.greatest(F.lit(0.0), real("forecast_daily_mean")), real("inventory_position"), F.col("historical_mean_sales")
    mean = F.when(real("forecast_daily_mean").isNotNull(), mean)
    stock = F.when(mean.isNotNull(), safety_stock(F.col("sigma_daily"), policy))
    point = F.when(mean.isNotNull(), reorder_point(mean, stock, policy))
    out = df.withColumns({"forecast_daily_mean": mean, "inventory_position": stock_on_hand, "lead_time_days": F.lit(float(policy.lead_time_days)), "safety_stock": stock, "reorder_point": point, "__target": order_up_to(mean, stock, policy)})
    have, need, ss, rop = F.col("inventory_position"), F.col("forecast_daily_mean"), F.col("safety_stock"), F.col("reorder_point")
    reason = (
        F.when(need.isNull(), NO_FORECAST).when(have.isNull(), NO_INVENTORY)
        .when((need == 0) & (have >= ss), ZERO_FORECAST).when(need == 0, BELOW_REORDER_POINT)
        .when(have < rop, BELOW_REORDER_POINT).otherwise(AT_TARGET)
    )
    missing = need.isNull() | have.isNull()
    quantity = F.when(missing, None).when((need == 0) & (have < ss), ss - have).when((need > 0) & (have < rop), F.greatest(F.lit(0.0), F.col("__target") - have)).otherwise(0.0)
    flag = (
        F.when(missing, NO_DATA).when((past > 0) & (need > policy.outlier_multiplier * past), OUTLIER)
        .when((have <= 0) | (have < ss), STOCKOUT).when(F.col("segment").isin(*UNCERTAIN_SEGMENTS), UNCERTAIN).otherwise(LOW)
    )
    return out.withColumns({"recommended_order_qty": quantity, "decision_reason": reason, "risk_flag": flag}).drop("__target")


def recommendations(forecast: DataFrame, policy: Policy, inventory: DataFrame | None = None, risk: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Decisions for each series; without an inventory table the scenario's stock is used."""
    rows = per_series(forecast, policy, risk, history)
    if inventory is None:
        rows = rows.withColumn("inventory_position", simulated_inventory(F.col("forecast_daily_mean"), policy))
    else:
        rows = rows.join(inventory.select(*KEYS, F.col("inventory_position").cast("double").alias("inventory_position")), KEYS, "left")
    columns = [*KEYS, "segment", "forecast_horizon", "forecast_daily_mean", "inventory_position", "lead_time_days", "safety_stock", "reorder_point", "recommended_order_qty", "decision_reason", "risk_flag"]
    return decide(rows, policy).select(*columns)


def risk_summary(forecast: DataFrame, policy: Policy, risk: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Risk of each series from its forecast alone."""
    mean, past = F.col("forecast_daily_mean"), F.col("historical_mean_sales")
    stock = safety_stock(F.col("sigma_daily"), policy)
    flag = F.when(mean.isNull(), NO_DATA).when((past > 0) & (mean > policy.outlier_multiplier * past), OUTLIER).when(F.col("segment").isin(*UNCERTAIN_SEGMENTS), UNCERTAIN).otherwise(LOW)
    rows = per_series(forecast, policy, risk, history)
    return rows.select(*KEYS, "segment", "forecast_horizon", "forecast_daily_mean", "sigma_daily", F.lit(policy.z).alias("safety_stock_z"), stock.alias("safety_stock"), reorder_point(mean, stock, policy).alias("reorder_point_demand_only"), flag.alias("risk_flag"))
