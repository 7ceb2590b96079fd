import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import ngram_join as nj

SPACES = re.compile(rb"[^\x20\x09-\x0D]+")
UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = SPACES.findall((text or "").encode().translate(UP))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def documents(seed, families=12, singles=40, common=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = draw(30)
    texts = []
    for _ in range(families):
        base = draw(rng.choice([3, 8, 30, 80, 300]))
        for _ in range(rng.randint(2, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [" ".join(draw(rng.randint(1, 120))) for _ in range(singles)]
    texts += [" ".join(draw(rng.randint(5, 60)) + passage + draw(rng.randint(5, 60))) for _ in range(common)]
    texts += ["", None, "  \n", "One two", "one\tTWO", "one two three", texts[0].upper() if texts[0].isascii() else texts[0], texts[1], texts[1]]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "common"), [(1, 0), (2, 50)])
def test_matches_brute_force(spark, seed, common):
    rows = documents(seed, common=common)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, node string, label string").repartition(3)
    assert sorted(tuple(r) for r in nj.ngram_join(df).collect()) == brute(rows)


def test_chains_that_hubs_miss(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words))]
    for i in range(1, 12):  # each is near the one before only
        words = list(words)
        for k in range(3):
            words[rng.randrange(400)] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in nj.ngram_join(df).collect())
    assert got == brute(rows)


def test_frequent_list_changes_nothing(spark, monkeypatch):
    rows = documents(4, common=20)
    monkeypatch.setattr(nj, "FREQUENT", 1)
    monkeypatch.setattr(nj, "BROADCAST_NODES", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in nj.ngram_join(df).collect()) == brute(rows)


def sets_and_copies(seed, n=150):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in rng.integers(20, 400, n)]
    for i in range(2 * n // 3, n):
        sets[i] = np.unique(np.concatenate([sets[i - 2 * n // 3][: int(len(sets[i - 2 * n // 3]) * 0.95)], sets[i][:5]]))
    return sets


@pytest.mark.parametrize("per_unit", [2, 3, 31, 33, 150, 1500])
def test_tree_search_is_the_bound(per_unit):
    """Units of all sizes: the trees find what a look at all pairs finds."""
    sets = sets_and_copies(1, max(150, per_unit))
    n = len(sets)
    order = np.random.default_rng(2).permutation(n)
    unit = np.empty(n, np.int64)
    unit[order] = np.arange(n) // per_unit
    sort = np.lexsort((np.arange(n), unit))
    sets, unit = [sets[i] for i in sort], unit[sort]
    points, sizes, labels = [nj.point(s) for s in sets], np.array([len(s) for s in sets]), np.arange(n) % (n - 10)
    want = {(i, j) for i in range(n) for j in range(i) if unit[i] == unit[j] and labels[i] != labels[j] and nj.within(points[i], points[j], int(sizes[i]), int(sizes[j]))}
    sides, mine = np.full(n, -1), np.ones(n, bool)
    got = [(max(a, b), min(a, b)) for i, j in nj.search_rows(unit, sizes, points, labels, sides, mine, 80, True) for a, b in zip(i.tolist(), j.tolist())]
    assert len(set(got)) == len(got) and want <= set(got) and (per_unit < 150 or len(want) >= 30)
    coarse = [nj.rough(p) for p in points]
    ends = [(a, b) for i, j in nj.search_rows(unit, sizes, coarse, np.arange(n), sides, mine, 80, False) for a, b in zip(i.tolist(), j.tolist())]
    partners = {}
    for i in range(n):
        near = [j for j in range(n) if i != j and unit[i] == unit[j] and len(coarse[j]) in (len(coarse[i]), 2 * len(coarse[i])) and nj.within(coarse[i], coarse[j], int(sizes[i]), int(sizes[j]))]
        if near:
            partners[i] = {near[0], near[-1]}
    assert {(i, j) for i, js in partners.items() for j in js} == set(ends)


def test_units_meet_all_pairs_once(spark):
    """A block of more than TILE sets, in bands and tiles: each pair of near sizes meets in one unit, once."""
    rng = random.Random(5)
    nodes = [(7, rng.randbytes(9) + rng.randint(40, 90).to_bytes(3), 300) for _ in range(300)]
    rows = nj.units(spark.createDataFrame(nodes, "block long, node binary, members long"), 80, 100).collect()
    by = {}
    for r in rows:
        by.setdefault(r.unit, []).append(r)
    assert len(by) > 6 and max(map(len, by.values())) < 300
    met = [tuple(sorted((bytes(a.node), bytes(b.node)))) for own in by.values() for k, a in enumerate(own) for b in own[:k] if (a.mine or b.mine) and (a.side < 0 or a.side != b.side)]
    size = lambda x: int.from_bytes(x[9:])
    near = {tuple(sorted((a[1], b[1]))) for k, a in enumerate(nodes) for b in nodes[:k] if 100 * min(size(a[1]), size(b[1])) >= 80 * max(size(a[1]), size(b[1]))}
    assert len(set(met)) == len(met) and near <= set(met)


@pytest.mark.parametrize("tile", [4, 4096])
def test_a_hot_block_is_dealt_in_units(spark, monkeypatch, tile):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):  # a family whose members are 70 to 100 % alike, and copies
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(nj, "TILE", tile)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in nj.ngram_join(df).collect()) == brute(rows)


def test_words_of_equal_polynomials_stay_apart(spark):
    """Thue-Morse words collide under any polynomial modulo 2^64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"one two {word} three four five"), (4, f"one two {other} three four five"), (5, "a" * 70_000), (6, "A" * 70_000), (7, "b" + "a" * 69_999)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in nj.ngram_join(df).collect()) == brute(rows)


def test_overlap_is_of_the_words():
    texts = ["", "a b", "A B", "a b c", "a b c d e", "a b c d e f a b c d e", "x a b c d e f", "\t".join("abcdefgh") + "\x1c"]
    for a in texts:
        for b in texts:
            x, y = shingles(a), shingles(b)
            assert nj.overlap(a.encode(), b.encode()) == (len(x & y), len(x), len(y)), (a, b)


def test_shingles_of_arrow_slices():
    texts = ["x y", "A b\tc d e f", "", "a  b c d e\nf", "q" * 50, None]
    array = pa.array([t or "" for t in texts])
    sets = nj.shingle_sets(array)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts] and (sets[1] == sets[3]).all()
    assert all((x == y).all() for x, y in zip(nj.shingle_sets(array.slice(1, 3)), sets[1:4]))


def test_null_ids_and_an_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in nj.ngram_join(df).collect())
    assert got == [(-1, 0, -1), (-1, 2, 4), (4, 2, 4), (4, 2, 4)]
    assert nj.ngram_join(df.limit(0)).count() == 0


def test_rows_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(200)]
    changed = lambda k: " ".join(w if i != k else "zz" for i, w in enumerate(words))
    both = " ".join(w if i not in (20, 180) else "zz" for i, w in enumerate(words))
    far = [" ".join(w if i not in at else "zz" for i, w in enumerate(words)) for at in ((5, 20, 60, 100, 140, 180), (20, 180))]
    rows = [(1, " ".join(words)), (None, changed(50)), (9, both), (None, far[0]), (7, "other words are here for this one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in nj.ngram_join(df).collect()}
    assert got[(1, 196)] == got[(None, 196)] == 1 and got[(9, 196)] == 1 and got[(7, 3)] == 7
    kept = sorted(r.text for r in nj.drop_near(df).collect())
    assert kept == sorted([rows[0][1], rows[4][1]]) if brute([(i, t) for i, (_, t) in enumerate(rows)])[3][2] == 0 else len(kept) >= 2


def test_drop_near_by_id_and_text(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words[:50], "changed", *words[51:]])
    rows = [(1, " ".join(words), "a"), (2, near, "b"), (2, "a wholly different text under the same id", "c"), (3, "", "d"), (4, None, "e"), (3, "", "d"), (5, "twice the same row is here once", "f"), (5, "twice the same row is here once", "f"), (None, near, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __h string").repartition(3)
    got = nj.drop_near(df)
    assert got.columns == df.columns
    assert sorted(r["__h"] for r in got.collect()) == ["a", "c", "d", "d", "e", "f"]
    assert nj.drop_near(df.limit(0)).count() == 0


def test_points_are_small_and_only_named_texts_are_verified(spark, monkeypatch):
    """What goes into units is compressed without loss, and of the texts only those that a pair names reach the join."""
    rng = random.Random(5)
    rows = [(k, " ".join(str(rng.randrange(10**6)) for _ in range(600))) for k in range(40)]
    rows += [(100, rows[0][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {nj.node_of(s): s for s in nj.shingle_sets(pa.array([t for _, t in rows]))}
    names = spark.createDataFrame([(d, bytearray(nj.node_of(nj.shingle_sets(pa.array([t]))[0]))) for d, t in rows], "doc_id long, node binary")
    texts = nj.node_texts(docs, docs.join(names, "doc_id").select("doc_id", nj.text_key(docs.text).alias("h"), "node"), 5).cache()
    for r in texts.collect():
        raw = nj.point(sets[bytes(r.node)])
        assert nj.zstandard.decompress(r.point) == raw.tobytes() and nj.zstandard.decompress(r.rough) == nj.rough(raw).tobytes() and len(r.point) < len(raw) / 2
    ends = sorted(bytes(n) for n in (names.where("doc_id in (0, 100)").toPandas().node))
    pairs = spark.createDataFrame([tuple(map(bytearray, ends))], "a binary, b binary")
    seen = []
    monkeypatch.setattr(nj, "few", lambda df, *most: seen.append(df.count()) or df)
    assert [(bytes(r.a), bytes(r.b)) for r in nj.verified(pairs, texts, 5, 80).collect()] == [tuple(ends)] and seen == [2]
