"""The star schema as named tables of the session's catalog, facts and prices in buckets of series.

Windows and joins by series read their own bucket, so lags, rolling features and backtests deal no fact anew.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from shelfwise.plans.binding import Retail, retail
from shelfwise.session import shared_dir

KEYS = ["store_id", "item_id"]
#: Tables in buckets, with the columns that sort them.
SORTED = {"fact_sales": [*KEYS, "date"], "dim_price": [*KEYS, "wm_yr_wk"]}
LEAST_BUCKETS = 8
#: About 100 MB of a bucket's facts as they lie in Parquet.
ROWS_PER_BUCKET = 10_000_000


def bucket_count(rows: int) -> int:
    """A power of two, so that tables of other sizes can share buckets by coalescing; it grows with the rows."""
    n = LEAST_BUCKETS
    while n * ROWS_PER_BUCKET < rows:
        n *= 2
    return n


def create_tables(spark: SparkSession, tables: dict[str, DataFrame], folder: str, prefix: str = "", buckets: int | None = None) -> list[str]:
    """Writes each table below the folder and names it prefix + name, in place of a table of that name. A bucket is one
    file, as rows are dealt to tasks by the hash that deals them to buckets. Empty tables keep their columns; null keys share
    a bucket."""
    buckets = buckets or bucket_count(tables["fact_sales"].count())
    for name, df in tables.items():
        spark.sql(f"DROP TABLE IF EXISTS `{prefix}{name}`")
        if name in SORTED:
            writer = df.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*SORTED[name])
        else:
            writer = df.write
        writer.format("parquet").mode("overwrite").option("path", f"{folder}/{name}").saveAsTable(f"`{prefix}{name}`")
    return [prefix + name for name in tables]


def catalog_model(spark: SparkSession, names: list[str], prefix: str = "") -> Retail:
    return Retail({name.removeprefix(prefix): spark.table(f"`{name}`") for name in names})


_MADE: dict[tuple[str, str], Retail] = {}


def bucketed(spark: SparkSession, sf_dir: str) -> Retail:
    """The model of a folder over bucketed tables, made once for an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MADE:
        model, prefix = retail(spark, sf_dir), f"retail_{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}_"
        rows = model.observed["n"] if model.observed else None
        names = create_tables(spark, model.tables, shared_dir(spark, "catalog"), prefix, bucket_count(rows) if rows is not None else None)
        _MADE[key] = catalog_model(spark, names, prefix)
    return _MADE[key]
