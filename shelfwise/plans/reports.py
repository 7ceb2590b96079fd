"""Exports: KPI tables as CSV, metric cuts, and a run's notes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from shelfwise.operators.quality import validate
from shelfwise.plans.binding import Retail
from shelfwise.plans.named import run

#: Reports of the KPI export and their queries.
KPI_REPORTS = [
    "kpi_overall", "kpi_by_category", "kpi_by_department", "kpi_store_category_matrix", "kpi_day_of_week_profile", "store_performance", "store_growth_28d",
    "top_products_per_store", "declining_products", "product_volatility", "abc_classification", "monthly_demand_trend", "price_change_association",
]


class ValidationFailed(RuntimeError):
    pass


def write_csv(df: DataFrame, path: str) -> str:
    """One file for each task that has rows; reports are a few rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def export_kpis(model: Retail, folder: str, checked: bool = True) -> list[str]:
    """The KPI tables, unless a check of the model fails."""
    if checked and (failed := [r["check"] for r in validate(model).where("not passed").collect()]):  # 13 rows
        raise ValidationFailed(", ".join(failed))
    return [write_csv(run(model, name), f"{folder}/{name}") for name in KPI_REPORTS]


def export_cuts(cuts: dict[str, DataFrame], folder: str) -> list[str]:
    return [write_csv(df, f"{folder}/by_{name}") for name, df in cuts.items()]


def markdown(df: DataFrame, title: str, limit: int = 50) -> str:
    """The first rows of a small table as text."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"## {title}\n\n{head}\n" + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)


def write_notes(df_source: DataFrame, notes: dict, path: str) -> None:
    df_source.sparkSession.createDataFrame([(json.dumps(notes, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
