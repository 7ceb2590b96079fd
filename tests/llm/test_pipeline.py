"""The pipeline against plain Python on a small corpus: each stage does on all its input what its operator says."""

import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
import public_tokenizers as P
from shelfwise.llm import langid
from shelfwise.llm.words import WordIds
from tests.llm.test_ngram_join import brute as near_brute
from tests.llm.test_small_ops import corpus

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(rows, length=50):
    first = {}
    for i, t in rows:
        data = t.encode()
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < i:
                gone[k : k + length] = True
        left = bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")
        if left or not gone.any():
            out.append((i, left))
    return out


def test_stages_match_plain_python(spark, tmp_path):
    rows = corpus(120, 7)
    passage = " ".join(rows[0][1].split()[:25])
    rows += [(200 + i, f"{t} {passage} {t[::-1]}", lang) for i, (_, t, lang) in enumerate(rows[40:50])]
    rows += [(300 + i, t.upper(), lang) for i, (_, t, lang) in enumerate(rows[:15])] + [(400 + i, t + " end", lang) for i, (_, t, lang) in enumerate(rows[20:30])]
    rows += [(500, "", "xx"), (501, None, "xx"), (502, "12 34", None), (503, rows[3][1], None)]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    told = corpus_pipeline.keep_language(spark, docs, str(tmp_path))
    assert told.columns == docs.columns
    kept = {r.doc_id: r.text for r in told.collect()}
    found = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert set(kept) == {i for i, r in found.items() if r.lang_pred != "und" and not r.rejected} and {500, 501, 502}.isdisjoint(kept)
    assert {r.lang for r in told.where("doc_id = 503").collect()} == {found[503].lang_pred}

    groups = defaultdict(list)
    for i, t in kept.items():
        groups[t.translate(UP)].append(i)
    want = {min(g) for g in groups.values()}
    once = corpus_pipeline.keep_one_copy(spark, told, str(tmp_path))
    assert {r.doc_id for r in once.collect()} == want and once.columns == docs.columns

    near = near_brute([(i, kept[i]) for i in sorted(want)])
    want = {i for i, _, c in near if i == c}
    one = corpus_pipeline.keep_one_of_near_copies(spark, once, str(tmp_path))
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns

    want = dict(cut([(i, kept[i]) for i in sorted(want)]))
    left = corpus_pipeline.cut_repeats(spark, one, str(tmp_path))
    assert {r.doc_id: (r.text, r.n_chars) for r in left.collect()} == {i: (t, len(t)) for i, t in want.items()} and left.schema == docs.schema

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {i: np.frombuffer(x + bytes(4), "<u4") for i, x in zip(want, WordIds(P.path("word_bpe_49k.json")).encode(list(want.values())))}
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in out) == sorted((i, k, len(x[k : k + 2048]), zlib.crc32(x[k : k + 2048].tobytes())) for i, x in ids.items() for k in range(0, len(x), 2048))
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def test_every_stage_takes_what_is_odd(spark, tmp_path):
    """Repeated ids and rows, null ids, texts and languages, columns with clashing names, and an empty table."""
    rows = [(i, t, lang) for i, t, lang in corpus(60, 9)]
    own = rows[5][1]
    rows += [(3, own + " tail of its own here", "xx"), (7, rows[7][1], rows[7][2]), (None, rows[8][1], None), (None, own[::-1], None), (None, None, None), (70, "", "xx")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, keep_id long, row string, h long"
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "n", 1, None, k) for k, (i, t, lang) in enumerate(rows)], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if stage is not corpus_pipeline.pack_sequences:
            assert out.columns == docs.columns and out.count() <= docs.count()
    kept = {r.h for r in corpus_pipeline.keep_one_copy(spark, docs, str(tmp_path)).collect()}
    assert 60 in kept and 62 not in kept and len(kept & {7, 61}) == 1 and 63 in kept and len(kept & {64, 65}) == 1
    near = {r.h for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, str(tmp_path)).collect()}
    assert 62 not in near and len(near & {7, 61}) == 1 and {63, 64, 65} <= near and len(near & {5, 60}) >= 1
    assert corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).select("doc_id", "ids_crc32", "piece").count() >= len(rows)


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
