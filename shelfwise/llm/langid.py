"""Language ID by compression: the language whose zstandard raw-content dictionary makes a text smallest.

A dictionary is excerpts of labelled texts, lower-cased, letters only, repeats of a word once: at most EXCERPTS of them
for a language, EXCERPT bytes from the middle of each, of the texts of least hash; copies of a text count once. That bound
is all that learning reads into memory; every labelled row takes part in the choice. A text is normalised the same way
and compressed in blocks of BLOCK bytes with each dictionary; the sizes of all its blocks are summed, so whole texts count
and memory is bounded. The margin is the bytes that the winner saves against the runner-up. By chance it is of the order
of the square root of a text's length, so a text is rejected where its margin is under DOUBT times that root, or under the
share REJECT of the runner-up's size: it is about as close to two languages. One rule for texts of all lengths.

Defined results: null texts and texts without a letter are `und` with score 0 and are not rejected; where nothing was
learned all are `und`; ties go to the language first in alphabetical order; equal texts give equal values; an empty
table gives an empty result. The label, the id and other columns are no inputs of a prediction.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ddl, map_arrow, remembered

EXCERPTS, EXCERPT, BLOCK, LEVEL = 400, 256, 1024, 5
REJECT, DOUBT = 0.04, 0.3
UNKNOWN = "und"
NOT_LETTERS = regex.compile(r"\P{L}+")


def normalise(text: str) -> bytes:
    words = NOT_LETTERS.split(text.lower())
    return " ".join([w for w, before in zip(words, [None, *words], strict=False) if w != before]).strip().encode()


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", excerpts: int = EXCERPTS) -> dict[str, bytes]:
    """The dictionary of each language; rows with a null text or label are left out."""
    rows = labelled.select(labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).where("text is not null and lang is not null")
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("h")).withColumn("zeros", 64 - F.length(F.bin("h")))  # leading bits of the hash
    found = hashed.select("lang", "zeros", "h").distinct().groupBy("lang", "zeros").count().collect()  # 65 x languages at most
    least = {}
    for lang in sorted({r["lang"] for r in found}):  # so many leading zeros that hold the excerpts, and about twice as many at most
        counts = {r["zeros"]: r["count"] for r in found if r["lang"] == lang}
        least[lang] = max((z for z in counts if sum(n for k, n in counts.items() if k >= z) >= excerpts), default=0)
    if not least:
        return {}
    enough = labelled.sparkSession.createDataFrame(list(least.items()), "lang string, least int")
    length = F.length("text")
    middle = F.substr("text", F.greatest(F.lit(1), (length / 2).cast("int") - EXCERPT), F.lit(2 * EXCERPT))
    chosen = hashed.join(F.broadcast(enough), "lang").where("zeros >= least").groupBy("lang", "h").agg(F.min(middle).alias("part"))  # copies of a text take one slot
    out: dict[str, list[bytes]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["h"] & (1 << 64) - 1)):
        own = out.setdefault(r["lang"], [])
        if len(own) < excerpts:
            own.append(normalise(r["part"])[:EXCERPT])
    return {k: b"\n".join(v) for k, v in sorted(out.items()) if any(v)}


@remembered("languages")
def compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, data in dictionaries:
        known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False)))
    return out


def classify(text: str, by: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text."""
    data = normalise(text)
    if not data or not by:
        return UNKNOWN, 0.0, False
    sizes = sorted((sum(len(c.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)), lang) for lang, c in by)
    second = sizes[1][0] if len(sizes) > 1 else 2 * sizes[0][0]
    margin, needed = second - sizes[0][0], max(DOUBT * math.sqrt(len(data)), REJECT * second)
    return sizes[0][1], min(1.0, margin / (2 * needed)), margin < needed


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected behind its columns (columns of those names are replaced: see judged)."""
    return judged(docs.drop("lang_pred", "score", "rejected"), dictionaries, text_col).select("row.*", "lang_pred", "score", "rejected")


def judged(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """row (a struct of all columns of docs, whatever their names), lang_pred, score, rejected."""
    known = tuple(sorted(dictionaries.items()))
    at = docs.columns.index(text_col)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    kinds = [pa.string(), pa.float64(), pa.bool_()]

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        by = compressors(known)
        found = [classify(t or "", by) for t in batch.column(at).to_pylist()]
        columns = list(zip(*found, strict=True)) if found else [()] * 3
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {ddl(f.dataType)}" for f in rows.schema) + ", lang_pred string, score double, rejected boolean"
    row = F.struct(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])
    return map_arrow(rows, predict, schema, uses="languages").select(row.alias("row"), "lang_pred", "score", "rejected")


def held_out(doc_id: Column) -> Column:
    """The fold that is not learned from: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts all."""
    return identify(docs, learn(docs.where(~held_out(docs[id_col]))))


def language_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As language_id, with the columns of docs in the struct `row`."""
    return judged(docs, learn(docs.where(~held_out(docs[id_col]))))
