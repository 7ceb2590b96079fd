import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from shelfwise.llm import suffix_dedup as sd
from shelfwise.llm.suffix_dedup import anchors, multikey_quicksort, sort_suffixes, suffix_dedup


def brute(rows, length):
    """doc -> kept bytes, from the definition."""
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            first[w] = min(first.get(w, doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc_id:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(b for b, g in zip(data, gone) if not g)
        out[(doc_id, text)] = (doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def documents(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 60))))
        rows.append((i, " ".join(parts)))
    for i in range(n, n + 15):  # edited copies
        text = list(rng.choice(rows)[1] or "x" * 80)
        for _ in range(2):
            text[rng.randrange(len(text))] = "#"
        rows.append((i, "".join(text)))
    rows += [(200, None), (201, ""), (202, "a" * 120), (203, "a" * 70), (204, "ab" * 60), (205, rows[0][1] + rows[1][1]), (300, "x" * 49), (301, "x" * 49), (302, "y" * 50), (303, "y" * 50)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "small", "hot"), [(1, None, None), (2, 700, None), (3, 700, 1), (4, 700, 3)])
def test_matches_the_definition(spark, monkeypatch, seed, small, hot):
    """Also in bundles of a few documents, and with hot anchors, whose windows go by themselves."""
    if hot:
        monkeypatch.setattr(sd, "HOT", hot)
    if small:
        monkeypatch.setattr(sd, "BUNDLE", small)
    rows = documents(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, tag string").repartition(3)
    got = sorted(tuple(r) for r in suffix_dedup(df).collect())
    assert got == sorted(brute(rows, 50).values())


def test_buckets_follow_the_bytes(spark, monkeypatch):
    """What a bucket stands for does not grow with the corpus, and many buckets (with shorter keys) give the same result."""
    for total in (0, 1 << 20, 1 << 33, 1 << 40, 100 << 40):
        buckets, key_bytes = sd.bucket_count(total, 200)
        assert buckets >= 800 and total / buckets <= sd.BUCKET_TEXT and buckets << 8 * key_bytes <= 1 << 63
    assert sd.bucket_count(0, 200) == (800, 6) and sd.bucket_count(100 << 40, 200)[1] == 5
    monkeypatch.setattr(sd, "BUCKET_TEXT", 1)
    monkeypatch.setattr(sd, "BUNDLE", 700)
    rows = documents(8)
    got = sorted(tuple(r) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute(rows, 50).values())


def test_short_strings_and_other_lengths(spark):
    rows = documents(5, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in suffix_dedup(df, length=20, gram=6).collect())
    assert got == sorted(brute(rows, 20).values())


def test_repeated_ids_null_ids_and_an_empty_table(spark):
    long = "the quick brown fox jumps over the lazy dog and then some more words follow it"
    df = spark.createDataFrame([(5, long), (5, long), (5, long + "!"), (None, long), (7, long), (3, "z")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup(df).collect())
    assert got == [(-1, 0), (3, 0), (5, 0), (5, 0), (5, 0), (7, len(long))]
    assert suffix_dedup(df.limit(0)).count() == 0


def test_sort_is_a_suffix_sort():
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(900)) + b"abababab" * 40
    starts = np.arange(len(data) - 50)
    order, rank = sort_suffixes(data, starts, np.zeros(len(starts), np.int64), 50, 16)
    want = sorted(range(len(starts)), key=lambda i: data[i : i + 50])
    assert [data[i : i + 50] for i in order] == [data[i : i + 50] for i in want]
    assert all((rank[a] == rank[b]) == (data[a : a + 50] == data[b : b + 50]) for a, b in zip(order, order[1:]))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    shared = bytes(rng.randrange(97, 110) for _ in range(50))
    a, b = (bytes(rng.randrange(97, 123) for _ in range(n)) for n in (70, 133))
    (pa, ha, _), (pb, hb, _) = (anchors(np.frombuffer(x + shared + x, np.uint8), np.array([2 * len(x) + 50])) for x in (a, b))
    assert {(p - 70, h) for p, h in zip(pa, ha) if 70 <= p <= 104} & {(p - 133, h) for p, h in zip(pb, hb) if 133 <= p <= 167}


def test_anchors_stay_inside_their_texts():
    rng = random.Random(6)
    texts = [bytes(rng.randrange(97, 105) for _ in range(n)) for n in (120, 0, 49, 50, 10, 51, 300, 30)]
    at, h, _ = anchors(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    want, begin = [], 0
    for t in texts:
        own, hashes, _ = anchors(np.frombuffer(t, np.uint8), np.array([len(t)]))
        want += list(zip((own + begin).tolist(), hashes.tolist()))
        begin += len(t)
    assert list(zip(at.tolist(), h.tolist())) == want


def test_multikey_quicksort_sorts_to_its_depth():
    rng = random.Random(7)
    for depth in (1, 7, 8, 12, 16):
        data = bytes(rng.choice(b"ab") for _ in range(400)) + b"z" * 60 + b"abcdefgh" * 30
        raw = np.frombuffer(data + b"\0" * 8, np.uint8)
        symbols = np.zeros(len(raw) - 7, np.uint64)
        for i in range(8):
            symbols = (symbols << np.uint64(8)) | raw[i : len(raw) - 7 + i]
        starts, group = np.arange(len(data) - 16), np.array([rng.randrange(3) for _ in range(len(data) - 16)])
        order, edge = multikey_quicksort(symbols, starts, group, depth)
        key = [(group[i], data[starts[i] : starts[i] + depth]) for i in order.tolist()]
        assert key == sorted(key) and sorted(order.tolist()) == list(range(len(starts)))
        assert edge.tolist() == [i for i in range(len(key)) if not i or key[i] != key[i - 1]]


def test_texts_and_rows_come_back(spark):
    rows = [(1, "é" * 40 + " one", "a", 1), (2, "x" + "é" * 40 + " two", None, 2), (3, None, "c", None), (None, "é" * 40 + " one", "d", 4), (4, "é" * 40 + " one", "e", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, kept long")
    got = {(r.doc_id, r.row["row"], r.row["kept"]): r.kept for r in suffix_dedup(df, texts=True).collect()}
    left = got.pop((2, None, 2))
    assert got == {(1, "a", 1): rows[0][1], (3, "c", None): "", (None, "d", 4): rows[0][1], (4, "e", 5): ""}
    assert left.startswith("x") and left.endswith("two") and "é" not in left


def test_anchors_take_few_bytes_for_a_byte_of_text(monkeypatch):
    """Ranks of 32 bits in strides: their cost is that of the memory they pass over. Strides change nothing."""
    data, sizes = np.random.default_rng(1).integers(97, 123, 1 << 21, np.uint8), np.full(8, 1 << 18)
    tracemalloc.start()
    at, h, least = anchors(data, sizes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(data)
    monkeypatch.setattr(sd, "STRIDE", 1000)
    for whole, cut in zip((at, h, least), anchors(data, sizes), strict=True):
        assert (whole == cut).all()


def test_near_copies_are_sorted_without_a_trie_each(monkeypatch):
    """Windows that differ beyond their first 16 bytes are split by the quicksort; only the last bytes are left to tries."""
    rng = random.Random(9)
    taken = []
    insert = sd.BlindTrie.insert
    monkeypatch.setattr(sd.BlindTrie, "insert", lambda self, start: (taken.append(start), insert(self, start))[1])
    base = bytes(rng.randrange(97, 123) for _ in range(50))
    texts = [base[:k] + bytes([rng.randrange(97, 123)]) + base[k + 1 :] for k in range(16, 48) for _ in range(4)]
    order, rank = sort_suffixes(b"".join(texts), np.arange(len(texts)) * 50, np.zeros(len(texts), np.int64))
    assert [texts[i] for i in order] == sorted(texts) and not taken
    assert all((rank[i] == rank[j]) == (texts[i] == texts[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_contexts_of_a_bundle_go_once():
    """Equal contexts stand for each other; those that agree in key, lead and size only do not."""
    data = b"one passage" + b"two passage" + b"one passage" + b"one passage"
    key, begin = np.array([7, 7, 7, 8]), np.arange(4) * 11
    found = sd.Contexts(data, key, begin, np.full(4, 4), np.full(4, 11), np.arange(4))
    assert found.like.tolist() == [0, 1, 0, 3]
    sent = {}
    for bucket, block in found.blocks(np.array([40, 30, 20, 10]), 2):
        (keys, number, _, _, low, high), text = sd.unpacked(block, sd.CONTEXT)
        sent[bucket] = list(zip(keys.tolist(), number.tolist(), low.tolist(), high.tolist())), text
    assert sent == {0: ([(8, 3, 10, 10)], b"one passage"), 1: ([(7, 0, 20, 40), (7, 1, 30, 30)], b"one passagetwo passage")}
    cut = sd.packed([np.array([0], "<i4"), np.array([3], "<i4"), np.array([11], "<i4"), np.array([20], "<i8")])
    assert sd.spans_of(found, np.array([40, 30, 20, 10]), [cut]) == {0: [(3, 11)]}
