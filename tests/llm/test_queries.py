"""The registered queries over the smallest tables, against plain Python and, where there is SQL, DuckDB."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import public_tokenizers as P
from shelfwise.llm import bpe, queries
from tests.llm.test_ngram_join import brute as near_brute
from tests.llm.test_small_ops import brute_scan
from tests.llm.test_suffix_dedup import brute as cut_brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
RUN = queries.queries()


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"] or "", r["lang"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t, _ in docs}


def crc(values):
    return zlib.crc32(np.asarray(values, "<u4").tobytes())


def test_op1(spark, ids):
    got = sorted(tuple(r)[:4] for r in RUN["op1_bitplane_files"](spark, SF).collect())
    start, want = 0, []
    for i in sorted(ids):
        own = [*ids[i], 2]
        want.append((i, start, len(own), crc(own)))
        start += len(own)
    assert got == want


def test_op2(spark, docs):
    got = {r.doc_id: r for r in RUN["op2_language_id"](spark, SF).collect()}
    assert set(got) == {i for i, _, _ in docs}
    held = [(i, lang) for i, _, lang in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in held}
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.9 * len(held) and all(0 <= r.score <= 1 for r in got.values())


def test_op3(spark, ids):
    rows = RUN["op3_best_fit_packing"](spark, SF).collect()
    want = Counter()
    for i, x in ids.items():
        own = [*x, 0]
        for piece, at in enumerate(range(0, len(own), 2048)):
            want[i, piece, at, len(own[at : at + 2048]), crc(own[at : at + 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(places) <= 1.02 * -(-sum(n for *_, n, _ in want) // 2048) + 1


def test_op4(spark, docs):
    got = {r.doc_id: r for r in RUN["op4_avi_media"](spark, SF).collect()}
    assert set(got) == {i for i, _, _ in docs}
    for i, t, _ in docs:
        data = t.encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), None)
        frames = -(-len(payload) // 64 // min(48, len(payload) // 64))
        shown = np.frombuffer(payload + b" " * (frames * min(48, len(payload) // 64) * 64 - len(payload)), np.uint8)
        assert r.feature.startswith(f"frames={frames};mean={shown.mean():.3f};shots=0.00-"), r.feature


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op7_chat_format"])
def test_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    frame = RUN[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(frame.columns)
    assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == Counter(want.fetchall())


def test_op6(spark, docs):
    from shelfwise.llm.license_scan import TEMPLATES

    short = tuple(sorted((k, v) for k, v in TEMPLATES.items() if len(v) < 150))
    got = defaultdict(list)
    for r in RUN["op6_license_scan"](spark, SF).collect():
        got[r.doc_id].append((r.block, r.license, r.status))
    told = {i: brute_scan(t, short) for i, t, _ in docs if "licen" in t.lower() and len(t) < 3000}
    assert sum(map(len, told.values())) > 0 and all(sorted(got[i]) == sorted(v) for i, v in told.items())
    assert all(i in got for i, t, _ in docs if any(v in t for v in TEMPLATES.values()))


def test_op8(spark, docs):
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = []
    for i, t, _ in docs:
        raw = np.asarray(enc.encode_ordinary(t), "<u4")
        want.append((i, len(raw), hashlib.sha256(raw.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in RUN["op8_byte_bpe"](spark, SF).collect()) == sorted(want)


def test_op9(spark, docs):
    assert sorted(tuple(r) for r in RUN["op9_ngram_join"](spark, SF).collect()) == near_brute([(i, t) for i, t, _ in docs])


def test_op10(spark, docs):
    assert sorted(tuple(r) for r in RUN["op10_suffix_dedup"](spark, SF).collect()) == sorted(cut_brute([(i, t) for i, t, _ in docs], 50).values())
