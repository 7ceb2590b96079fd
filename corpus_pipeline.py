"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of documents. run() applies them to documents.parquet of a folder. This is a job:
it sets how many rows and bytes its session's scans and Python tasks take in a batch, as its executors live through all
five stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import BATCH_ROWS, staged
from shelfwise.llm.exact_dedup import drop_exact
from shelfwise.llm.langid import UNKNOWN, language_rows
from shelfwise.llm.ngram_join import drop_near
from shelfwise.llm.packing import pack_documents
from shelfwise.llm.queries import WORD_TOKENIZER, tokenizer_path
from shelfwise.llm.suffix_dedup import suffix_dedup

#: zstandard dictionaries, hubs of near copies and multiplicative weights have no form in SQL; tests check run() by brute force.
ORACLE_SQL = None


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; a missing label is filled with it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 512)
    told = language_rows(docs).where(~F.col("rejected") & (F.col("lang_pred") != UNKNOWN))
    field = lambda c: F.coalesce(F.col("row.lang"), F.col("lang_pred")) if c == "lang" else F.col(f"row.`{c}`")
    return told.select(*[field(c).alias(c) for c in docs.columns])


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the smallest id."""
    return drop_exact(docs, keep="min")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id."""
    return drop_near(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has; documents of which nothing is left go. A null text comes out as
    the empty one, and a character that is cut through goes with the cut."""
    kept = suffix_dedup(docs, texts=True).where("n_removed = 0 or kept <> ''")
    rest = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    return kept.select(F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"), *rest).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens; executors have run four stages by now
    and get a smaller memory of words."""
    return pack_documents(docs, tokenizer_path(WORD_TOKENIZER), capacity=2048, end_id=0, remembered=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_language),
    ("exact dedup", keep_one_copy),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
