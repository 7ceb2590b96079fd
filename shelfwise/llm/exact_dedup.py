"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside the groups.

Texts are equal when they are identical after lower-casing A-Z. The hash only proposes groups. Inside a group of
several rows the smallest and the largest text are compared byte by byte: both are ordinary aggregates, so each map
task sends one row for a group however many copies it holds. A group whose two ends differ is a hash collision; it is
split by grouping on the text itself.

Defined results: a null text counts as empty; empty texts are equal to each other; rows that repeat an id and a text
count each in group_size, and all carry kept = true when that id stays; a null id never stays while another id is
there; an empty table gives an empty result. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, lower_ascii, narrow, staged, without

#: Hashes of several rows are sent to every task while they are this many at most (16 bytes each); beyond, a join by hash.
BROADCAST_HASHES = 2_000_000


def md5_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def judged(docs: DataFrame, id_col: str, text_col: str, keep: str, key: Callable[[Column], Column]) -> DataFrame:
    """doc_id, sha, keep_id, group_size of each row."""
    best = {"min": F.min, "max": F.max}[keep]
    norm = narrow(docs, id_col, text_col).select("doc_id", lower_ascii(F.col("text")).alias("norm"))
    texts = norm.withColumn("h", key(F.col("norm")))
    ids = staged(texts.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-ids")
    groups = staged(ids.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")

    several = few(groups.where("group_size > 1").select("h"), BROADCAST_HASHES)
    members = texts.join(several, "h", "left_semi")
    mixed = staged(members.groupBy("h").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("h"), "dedup-collisions")
    if mixed.isEmpty():
        return ids.join(groups, "h").select("doc_id", "sha", "keep_id", "group_size")
    # the text itself is the second key of the rows whose hash is shared by different texts
    apart = texts.join(mixed, "h", "left_semi")
    classes = apart.groupBy("h", "norm").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return ids.join(mixed, "h", "left_anti").join(groups, "h").select("doc_id", "sha", "keep_id", "group_size").unionByName(
        apart.join(classes, ["h", "norm"]).select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", key: Callable[[Column], Column] = md5_key) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row; keep: the smallest ("min") or largest ("max") id stays."""
    found = judged(docs, id_col, text_col, keep, key)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", key: Callable[[Column], Column] = md5_key) -> DataFrame:
    """One row of docs, with all its columns, for each text: that of the id that stays.

    Rows are dropped by id and text together, so other texts under a dropped id stay. Of rows that repeat the id that
    stays and its text (but for the case of A-Z) one remains. Rows without an id go where a row with one has their text.
    """
    several = staged(judged(docs, id_col, text_col, keep, key).where("group_size > 1"), "dedup-several")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    named = several.select("doc_id", F.substring("sha", 1, 16).alias("h"), stays.alias("stays"))
    gone = named.where("not stays").select("doc_id", "h")
    repeated = named.where("stays").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    return without(docs, gone, repeated, id_col, lower_ascii, text_col)
