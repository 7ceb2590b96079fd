"""A session with the settings that the plans expect, and folders that its executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions on a single machine, by application.
_LOCAL: dict[str, str] = {}


def session(name: str = "shelfwise", master: str | None = None, **conf: str) -> SparkSession:
    """On a cluster, spark-submit's own settings hold over these."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that every executor can reach, under spark.checkpoint.dir; it goes when the session ends.

    Where that setting is missing, a local folder is used by sessions of a single machine (tests); others are told to set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        base = _LOCAL[context.applicationId]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return new_folder(spark, path)


def new_folder(spark: SparkSession, path: str) -> str:
    """The folder, made and named with its scheme: readers other than Spark take a path without one for a local path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    whole = fs.makeQualified(at).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: several branches of a plan read it, and none computes it anew."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
