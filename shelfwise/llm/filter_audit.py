"""What filters do to each other: counts for every order of five filters, from one mask of failures for each document.

Native expressions give each text a mask with a bit for each filter that it fails. The fifth bit (a copy of a text under a
smaller id) needs the table: texts are grouped and the group's smallest id is its first document. Texts stand in the
shuffles by their SHA-256, so no text leaves its scan. Masks are summed to 32 cells for each part (a language), and all
120 orders of the filters are read from the cells: a filter removes the documents whose mask holds its bit and none of the
bits before it.

Filters (words are maximal runs of anything but space and bytes 9 to 13, case counts):
    A  fewer than 100 words                  B  100 * distinct words < 80 * words
    C  100 * A-Z > 10 * code points          D  holds one of # $ % & * |
    E  the text is that of a document with a smaller id, anywhere in the table

Defined results: a null text is the empty one (no words: fails A only, and E where an empty one came before); a null
language is the part with the empty name; a document without an id is no copy and nothing is a copy of it; rows that share
id and text are each counted, and none of them makes the others copies; labels are looked up by id, a document counts as
good (toxic) once if any of its labels says so; an empty table gives no rows.

Scale: rows shuffled are ids, hashes and masks, summed before each shuffle, so a group of copies of any size is a row for
each task. The window by hash sees a row for each part of a text. The last step holds 32 cells for a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Space and bytes 9 to 13 part words.
GAPS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SIGNS = 100, 80, 10, r"[#$%&*|]"


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_mask(text: Column) -> Column:
    """The bits of A to D of a text that is not null."""
    words = F.array_remove(F.split(text, GAPS, -1), "")
    count, chars = F.size(words).cast("long"), F.length(text).cast("long")
    upper = chars - F.length(F.translate(text, UPPER, ""))
    fails = {"A": count < LEAST_WORDS, "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * count, "C": 100 * upper > MOST_UPPER * chars, "D": text.rlike(SIGNS)}
    return sum((v.cast("int") * bit(k) for k, v in fails.items()), F.lit(0))


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters that they fail."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), text_mask(text).alias("mask"))
    rows = rows.groupBy("id", "part", "h", "mask").agg(F.count("*").alias("n"))
    said = labels.select(labels["doc_id"].cast("long").alias("label_id"), labels["quality"].alias("q"), labels["toxic"].alias("t")).groupBy("label_id").agg(F.max((F.col("q") == 1).cast("int")).alias("q"), F.max((F.col("t") == 1).cast("int")).alias("t"))
    rows = rows.join(said, F.col("id") == F.col("label_id"), "left")
    counts = {"n": F.col("n"), "good": F.col("n") * F.coalesce("q", F.lit(0)), "toxic": F.col("n") * F.coalesce("t", F.lit(0))}
    own = F.struct(F.col("id").alias("id"), *[c.alias(k) for k, c in counts.items()])
    texts = rows.groupBy("h", "part", "mask").agg(
        *[F.sum(c).alias(k) for k, c in counts.items()],
        F.min(F.when(F.col("id").isNotNull(), own)).alias("first"),  # ids come once in a group, so the least struct is the least id's
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    least = F.min("first.id").over(Window.partitionBy("h"))
    texts = texts.withColumn("leads", F.coalesce(F.col("first.id") == least, F.lit(False)))
    lead = lambda k: F.when(F.col("leads"), F.col(f"first.{k}")).otherwise(0)
    new = {"n": lead("n") + F.col("nameless"), "good": lead("good"), "toxic": lead("toxic")}  # no label without an id
    once = F.struct(F.col("mask").alias("mask"), *[c.alias(k) for k, c in new.items()])
    copies = F.struct((F.col("mask") + bit("E")).alias("mask"), *[(F.col(k) - c).alias(k) for k, c in new.items()])
    cells = texts.select("part", F.explode(F.array(once, copies)).alias("x")).select("part", "x.*")
    return cells.groupBy("part", "mask").agg(*[F.sum(k).alias(k) for k in counts])


def filter_orders(cells: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the cells alone."""
    orders = list(map("".join, permutations(FILTERS)))
    bit_of = lambda k: F.pow(F.lit(2), F.instr(F.lit(FILTERS), F.substr("filter_order", k, F.lit(1))) - 1).cast("int")
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    own, before = F.col("own"), F.col("before")

    def total(what: str, when) -> Column:
        kept = F.filter("cells", lambda c: when(c["mask"]))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda s, c: s + c[what])

    holds = lambda m, b: m.bitwiseAND(b) != 0
    removed = lambda m: holds(m, own) & ~holds(m, before)
    # in all orders together, each of a document's failures comes first equally often
    first = F.aggregate(F.filter("cells", lambda c: holds(c["mask"], own)), F.lit(0).cast("long"), lambda s, c: s + (c["n"] * len(orders) / F.bit_count(c["mask"])).cast("long"))
    steps = parts.select("part", "cells", F.explode(F.split(F.lit(",".join(orders)), ",")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")).select("*", bit_of(F.col("step")).alias("own"))
    earlier = F.filter(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: k < F.col("step"))
    steps = steps.withColumn("before", F.aggregate(earlier, F.lit(0), lambda s, k: s + bit_of(k)))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~holds(m, own.bitwiseOR(before))).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: holds(m, own) & holds(m, before)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        first.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return filter_orders(failure_cells(docs, labels))
