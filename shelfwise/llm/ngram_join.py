"""N-gram Jaccard join by a count-vector R-tree: documents linked when 100 * |A n B| >= 80 * |A u B|, and their components.

A set is the distinct word shingles of a text. Equal sets are one node from the first pass on, whatever the number of
their copies. The index point of a set counts its shingles in hash groups; the summed coordinate minima of two points,
or of a point and the upper corner of an R-tree page, bound the overlap from above. A point has at least as many
groups as its set has shingles, so the bound is close; a point with more groups is folded onto one with fewer.

Sets that can be linked share a shingle among the first n - ceil(0.8 n) + 1 of any order common to all sets, so these
prefixes deal the sets into blocks (exactly: no link is lost). The order is (frequent, hash): shingles in more than
FREQUENT prefixes come last, so a passage that thousands of documents share makes no block unless they are mostly that.

1. R-trees over the points of all blocks are searched by every set for the first and the last set of its block that the
   bound leaves, in the order of their names. These pairs are verified. A block of k copies costs 2k pairs, not k^2. Of
   its blocks of frequent shingles a set takes part in ASKED only here, as they hold the same sets again and again.
2. The components of these links label the sets. A block of a single label is done. In the others the trees, now of finer
   points, are searched for all pairs of different labels; pages whose bound is too small or whose sets all carry the
   searcher's label are skipped, and surviving pairs are verified. Links of both rounds give the components.

Blocks of frequent shingles are dealt by what they hold, never gathered: one of more than TILE sets becomes units of a band
of sizes and the next one, and of two tiles of sets, so that each pair that can be linked meets in one unit. Verification
compares the words themselves, hashes only propose. Word hashes are polynomials modulo two primes, not modulo 2^64.

Defined results: a null text has no words; texts without words have an empty set, are linked with nothing and are their
own component; rows that repeat an id are reported each, by their own text; component_id ignores null ids and is null only
where all are, and rows without an id link others; an empty table gives an empty result. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import REMEMBERED, discard, few, forget, give_back, map_arrow, narrow, staged, text_key, without

WORDS, PERCENT = 5, 80
#: A shingle in more prefixes than this is frequent; the list of frequent ones that tasks receive has MOST_FREQUENT at
#: most (8 bytes each): beyond, the threshold doubles. Any list gives the same links.
FREQUENT, MOST_FREQUENT = 32, 2_000_000
#: Nodes up to this number are sent to all tasks to fetch their texts (20 bytes each); beyond, a join by id.
BROADCAST_NODES = 500_000
PAGE, COARSE, ROUGH = 32, 4, 4
#: Sets that meet in one unit of a large block; tasks that deal the sets of a frequent shingle; rows searched together.
TILE, SPREAD, TOGETHER = 4096, 64, 8_192
#: Blocks of frequent shingles that a set takes part in in the first round: those of least hash, which alike sets share.
ASKED = 4

U = np.uint64
_LOWER = np.arange(1, 257, dtype=U)
_LOWER[65:91] = _LOWER[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = U(0x9E3779B97F4A7C15 | 1)
_SEGMENT = 1 << 18
#: Words of more bytes are hashed one by one.
_LONG_WORD = 1 << 16
#: (prime, base): a word's bytes are the coefficients of a polynomial whose value at the base, modulo the prime, is taken.
_FIELDS = ((2**31 - 1, 1_358_492_671), (2**31 - 19, 906_185_303))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """The first n powers of the base, kept for the next call."""
    REMEMBERED["powers"] = _POWERS.clear
    kept = _POWERS.get(base, np.ones(1, U))
    while len(kept) < n:
        kept = np.concatenate([kept, kept * U(pow(base, len(kept), prime)) % U(prime)])
    _POWERS[base] = kept
    return kept[:n]


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of the bytes; words end at white space and at `breaks`. Hashes of all at once."""
    edge = np.zeros(len(data) + 1, bool)
    edge[breaks] = True
    solid = ~_SPACE[data]
    start = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
    end = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    out, at = np.zeros(len(start), U), 0
    while at < len(start):  # segments of whole words, so that tables of powers stay small and sums below 2^64
        stop = max(at + 1, int(np.searchsorted(end, start[at] + _SEGMENT, "right")))
        low, high = start[at], end[stop - 1]
        if high - low <= _SEGMENT:
            letters = _LOWER[data[low:high]]
            s, e = start[at:stop] - low, end[at:stop] - low
            for prime, base in _FIELDS:
                sums = np.concatenate([np.zeros(1, U), np.cumsum(letters * _powers(base, prime, _SEGMENT)[: high - low])])
                back = _powers(pow(base, -1, prime), prime, _SEGMENT)
                out[at:stop] = (out[at:stop] << U(32)) + (sums[e] - sums[s]) % U(prime) * back[s] % U(prime)
        at = stop
    size = end - start
    out = _mix(out + size.astype(U) * _STEP)
    for k in np.flatnonzero(size > _LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest((_LOWER[data[start[k] : end[k]]] - U(1)).astype(np.uint8).tobytes())
    return out, start


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles as ascending 64-bit hashes; fewer words than a shingle are one together."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return []
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    hashes, start = word_hashes(data, offsets)
    first = np.searchsorted(start, offsets)
    joined = hashes[: max(len(hashes) - words + 1, 0)]
    for k in range(1, words):
        joined = _mix(joined * _STEP + hashes[k : k + len(joined)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            one = np.full(1, b - a, U)
            for k in range(a, b):
                one = _mix(one * _STEP + hashes[k : k + 1])
            out.append(one)
        else:
            out.append(np.empty(0, U))
    return out


def node_of(s: np.ndarray) -> bytes | None:
    """Names a set by 72 bits of a hash and 24 of its size (the largest stand for all above); none for the empty one."""
    return xxhash.xxh3_128_digest(s.tobytes())[:9] + min(len(s), (1 << 24) - 1).to_bytes(3) if len(s) else None


def size_of(node: Column | str) -> Column:
    """The size that a node's name holds."""
    return F.conv(F.hex(F.substring(node, 10, 3)), 16, 10).cast("long")


def alike(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def point(s: np.ndarray) -> np.ndarray:
    """Counts of the set's shingles in hash groups: a power of two of them, at least as many as the set has members."""
    groups = max(16, 1 << max(len(s) - 1, 1).bit_length())
    while (counts := np.bincount((s >> U(20)).astype(np.int64) & (groups - 1), minlength=groups)).max(initial=0) > 255:
        groups *= 2
    return counts.astype(np.uint8)


def fold(p: np.ndarray, groups: int) -> np.ndarray:
    return p.reshape(-1, groups).sum(axis=0, dtype=np.int32) if len(p) > groups else p


def rough(p: np.ndarray) -> np.ndarray:
    """The point folded by ROUGH, for bounds that may be wider; whole where a count would not fit."""
    q = fold(p, max(len(p) // ROUGH, 16))
    return q.astype(np.uint8) if q.max(initial=0) <= 255 else p


def enough(overlap, a, b, percent: int = PERCENT):
    """Whether so much overlap links sets of these sizes: overlap / (a + b - overlap) >= percent / 100."""
    return (100 + percent) * overlap >= percent * (a + b)


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, number) for every number of the ranges low up to high."""
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]


class CountTree:
    """R-trees of count points, one for each unit, in one: rows come unit by unit, pages hold PAGE rows and pages of pages
    lie above, with their upper corner, range of sizes and common label. A page across two units only has a wider corner."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, begin: np.ndarray, end: np.ndarray, sides: np.ndarray, mine: np.ndarray, percent: int):
        self.begin, self.end, self.sides, self.mine, self.percent = begin, end, sides, mine, percent
        self.levels = [(points, sizes, sizes, labels)]
        while len(self.levels[-1][0]) > PAGE:
            corner, low, high, one = self.levels[-1]
            edge = np.arange(0, len(corner), PAGE)
            least, most = np.minimum.reduceat(one, edge), np.maximum.reduceat(one, edge)
            self.levels.append((np.maximum.reduceat(corner, edge), np.minimum.reduceat(low, edge), np.maximum.reduceat(high, edge), np.where(least == most, least, -1)))

    def passes(self, level: int, i: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (row i, page or row at) that sizes, labels and the summed coordinate minima leave possible."""
        corner, low, high, one = self.levels[level]
        points, sizes, _, labels = self.levels[0]
        keep = (one[at] != labels[i]) & (100 * high[at] >= self.percent * sizes[i]) & (self.percent * low[at] <= 100 * sizes[i])
        if not level:  # of a unit's two tiles, one of each; of its two bands, one of the first
            keep &= ((self.sides[i] < 0) | (self.sides[i] != self.sides[at])) & (self.mine[i] | self.mine[at])
        i, at = i[keep], at[keep]
        step = max(1, (1 << 22) // max(points.shape[1], 1))
        good = [enough(np.minimum(corner[at[k : k + step]], points[i[k : k + step]]).sum(axis=1, dtype=np.int64), low[at[k : k + step]], sizes[i[k : k + step]], self.percent) for k in range(0, len(i), step)]
        keep = np.concatenate([np.empty(0, bool), *good])
        return i[keep], at[keep]

    def search(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row, other row of its unit) that the bound cannot exclude, for the rows i."""
        level = 0
        while level + 1 < len(self.levels) and ((self.end[i] - 1 >> 5 * level) - (self.begin[i] >> 5 * level)).max(initial=0) >= PAGE:
            level += 1
        which, at = expand(self.begin[i] >> 5 * level, (self.end[i] - 1 >> 5 * level) + 1)
        i = i[which]
        while True:
            i, at = self.passes(level, i, at)
            if not level:
                return i, at
            level -= 1
            first, last = self.begin[i] >> 5 * level, self.end[i] - 1 >> 5 * level
            which, at = expand(np.maximum(at * PAGE, first), np.minimum(at * PAGE + PAGE - 1, last) + 1)
            i = i[which]

    def ends(self, i: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row, the first row of its unit that the bound cannot exclude; the last one with `back`), where there is one.

        Pages are looked at in runs that double until one holds such a row.
        """
        first, last = self.begin[i] >> 5, self.end[i] - 1 >> 5
        done, width, out = np.zeros(len(i), np.int64), 1, []
        while len(i):
            if back:
                high = last - done
                low = np.maximum(high - width + 1, first)
            else:
                low = first + done
                high = np.minimum(low + width - 1, last)
            which, at = expand(low, high + 1)
            row = i[which]
            if len(self.levels) > 1 and width > 1:
                row, at = self.passes(1, row, at)
            which, at = expand(np.maximum(at * PAGE, self.begin[row]), np.minimum(at * PAGE + PAGE, self.end[row]))
            row, at = self.passes(0, row[which], at)
            if len(row):
                by = np.lexsort((-at if back else at, row))
                row, at = row[by], at[by]
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out.append((row[head], at[head]))
            done += width
            stay = (first + done <= last) & ~np.isin(i, row)
            i, first, last, done, width = i[stay], first[stay], last[stay], done[stay], 2 * width
        return tuple(np.concatenate([np.empty(0, np.int64), *[x[k] for x in out]]) for k in (0, 1))


def search_rows(unit: np.ndarray, sizes: np.ndarray, points: list[np.ndarray], labels: np.ndarray, sides: np.ndarray, mine: np.ndarray, percent: int, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a unit that the bound leaves: all of different labels, or for each row the first and the last.
    A tree for each number of groups holds the points of that many and, folded, of twice as many."""
    groups = np.array([len(p) for p in points])
    for g in np.unique(groups).tolist():
        use = np.flatnonzero((groups == g) | (groups == 2 * g))
        if every:
            use = use[np.lexsort((sizes[use], unit[use]))]
        edge = np.flatnonzero(np.concatenate([[True], np.diff(unit[use]) != 0]))
        size = np.diff(np.append(edge, len(use)))
        if size.max() < 2:
            continue
        small = max(g // COARSE, 8) if every else g
        folded = np.stack([fold(points[i], small) for i in use.tolist()])
        folded = folded.astype(np.uint8 if folded.max() <= 255 else np.uint16)
        tree = CountTree(folded, sizes[use], labels[use], np.repeat(edge, size), np.repeat(edge + size, size), sides[use], mine[use], percent)
        asks = np.flatnonzero((groups[use] == g) & (np.repeat(size, size) > 1))
        for k in range(0, len(asks), 256):
            part = asks[k : k + 256]
            for i, j in [tree.search(part)] if every else [tree.ends(part), tree.ends(part, True)]:
                new = (groups[use[j]] != g) | (j < i) if every else i != j  # pairs of two larger ones are found at their own number
                yield use[i[new]], use[j[new]]


def search_units(batches: Iterator[pa.RecordBatch], percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of all units; rows (unit, node, label, size, compressed point, side, mine) come sorted by unit and node."""

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, sizes, sides, mine = (rows.column(k).to_numpy() for k in (0, 3, 5, 6))
        nodes = rows.column(1).combine_chunks()
        points = [np.frombuffer(open_.decompress(p), np.uint8) for p in rows.column(4).to_pylist()]
        names: dict[bytes, int] = {}
        labels = np.array([names.setdefault(x, len(names)) for x in rows.column(2).to_pylist()]) if every else np.arange(len(unit))
        for i, j in search_rows(unit, sizes, points, labels, sides, mine, percent, every):
            if every:
                keep = np.array([within(points[a], points[b], int(sizes[a]), int(sizes[b]), percent) for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
                i, j = i[keep], j[keep]
            x, y = nodes.take(pa.array(i)), nodes.take(pa.array(j))
            least = pc.less(x, y)
            yield pa.RecordBatch.from_arrays([pc.if_else(least, x, y), pc.if_else(least, y, x)], names=["a", "b"])

    forget()
    open_ = zstandard.ZstdDecompressor()
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            rows = pa.Table.from_batches(held)
            cut = int(np.searchsorted(rows.column(0).to_numpy(), rows.column(0)[-1].as_py()))  # the last unit may go on
            if cut:
                yield from told(rows.slice(0, cut))
                held, n = [b for b in rows.slice(cut).combine_chunks().to_batches()], n - cut
    if held:
        yield from told(pa.Table.from_batches(held))
    give_back()


def within(p: np.ndarray, q: np.ndarray, a: int, b: int, percent: int = PERCENT) -> bool:
    """Whether sizes and the summed coordinate minima leave a link possible."""
    if 100 * min(a, b) < percent * max(a, b):
        return False
    groups = min(len(p), len(q))
    return bool(enough(int(np.minimum(fold(p, groups), fold(q, groups)).sum(dtype=np.int64)), a, b, percent))


def frequent_shingles(docs: DataFrame, words: int, percent: int) -> np.ndarray:
    """Hashes of shingles in many prefixes, ascending; counted over all documents.

    A task also counts what follows the prefixes, as the frequent ones at their head make room there, and reports of
    that what it has met twice itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: list[np.ndarray] = []

        def met() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(more), return_counts=True)
            more.clear()
            return pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["key", "n"])

        forget("powers")
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * _SEGMENT / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                sets = shingle_sets(batch.column(0).slice(at, step), words)
                heads = [s[: prefix_size(len(s), percent)] for s in sets if len(s)]
                more += [s[len(h) : 4 * len(h)] for s, h in zip((s for s in sets if len(s)), heads, strict=True)]
                key, n = np.unique(np.concatenate([np.empty(0, U), *heads]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])
                if sum(map(len, more)) > 1_000_000:
                    yield met()
        if more:
            yield met()
        give_back()

    counts = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = staged(counts.where(F.col("n") > FREQUENT), "join-frequent")
    most = FREQUENT
    while often.where(F.col("n") > most).count() > MOST_FREQUENT:
        most *= 2
    found = often.where(F.col("n") > most).select("key").toArrow().column(0).to_numpy()
    return np.sort(found.view(U))


def blocks(docs: DataFrame, words: int, percent: int, frequent) -> DataFrame:
    """block, node, hot, asks: the sets of each block; of several blocks that hold the same sets one is enough. Those of
    frequent shingles (hot) are blocks as they are, dealt over SPREAD groups of tasks; asks: of use in the first round."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("powers")
        late, seen = frequent.value, set()
        for batch in batches:
            step = max(1, min(batch.num_rows, int(batch.num_rows * _SEGMENT / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                keys, nodes, times, often = [], [], [], []
                for s in shingle_sets(batch.column(0).slice(at, step), words):
                    node = node_of(s)
                    if node is None or node in seen:  # a task deals each set once
                        continue
                    seen.add(node)
                    last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s if len(late) else np.zeros(len(s), bool)
                    size = prefix_size(len(s), percent)
                    keys.append(np.concatenate([s[~last], s[last]])[:size])
                    rank = np.arange(size) - (len(s) - np.count_nonzero(last))  # among the frequent ones, by hash
                    often.append(np.where(rank < 0, 0, np.where(rank < ASKED, 2, 1)))
                    nodes.append(node)
                    times.append(size)
                if len(seen) > 500_000:
                    seen.clear()
                column = pa.array(nodes, pa.binary()).take(pa.array(np.repeat(np.arange(len(nodes)), times)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, U), *keys]).view(np.int64)), column, pa.array(np.concatenate([np.empty(0, np.int64), *often]).astype(np.int32))], names=["key", "node", "often"])
        seen.clear()
        give_back()

    dealt = docs.select("text").mapInArrow(deal, "key long, node binary, often int")
    hot = F.col("often") > 0
    sized = dealt.withColumns({"size": size_of("node"), "spread": F.when(hot, F.pmod(F.hash("node"), F.lit(SPREAD))).otherwise(-1)})
    own = Window.partitionBy("key", "spread")
    next_ = own.orderBy("size")  # a set whose neighbours in size are too small and too large has no partner in the block
    near = F.coalesce(alike(F.lag("size").over(next_), F.col("size"), percent), F.lit(False)) | F.coalesce(alike(F.lead("size").over(next_), F.col("size"), percent), F.lit(False))
    met = sized.select("key", "node", "often", "spread", near.alias("near")).withColumns({"low": F.min("node").over(own), "high": F.max("node").over(own), "x": F.bit_xor(F.xxhash64("node")).over(own), "y": F.sum(F.hash("node").cast("long")).over(own)})
    same = F.xxhash64("x", "y", "low", "high")
    use = met.where(hot | (F.col("low") != F.col("high")) & F.col("near"))
    return staged(use.select(F.when(hot, F.xxhash64("key")).otherwise(same).alias("block"), "node", hot.alias("hot"), (F.col("often") != 1).alias("asks")).distinct(), "join-blocks")


def several_sets(block: DataFrame) -> DataFrame:
    """block, node, asks, members of the blocks of several sets; members is null but for hot ones."""
    hot = block.where("hot").groupBy("block").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    counted = block.where("hot").drop("hot").join(few(hot), "block").select("block", "node", "asks", "members")
    return block.where("not hot").select("block", "node", "asks", F.lit(None).cast("long").alias("members")).unionAll(counted)


def units(rows: DataFrame, percent: int, tile: int = 0) -> DataFrame:
    """rows (block, node, members, ...) with unit, side and mine: a unit is a block, or two bands of sizes and two tiles of
    sets of one that has more than TILE sets."""
    tile = tile or TILE
    large = F.coalesce(F.col("members") > tile, F.lit(False))
    tiles = F.when(large, F.ceil(F.col("members") / tile)).otherwise(1).cast("int")
    band = F.when(large, F.floor(F.log(size_of("node").cast("double")) / math.log(100.0001 / percent))).otherwise(0).cast("int")
    placed = rows.withColumns({"band": band, "tiles": tiles}).withColumn("own", F.pmod(F.hash("node"), F.col("tiles")))
    placed = placed.withColumn("down", F.explode(F.when(large, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    name = F.xxhash64("block", F.col("band") - F.col("down"), F.least("own", "other"), F.greatest("own", "other"))
    return placed.withColumns({"unit": name, "side": F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")), "mine": F.col("down") == 0}).drop("band", "tiles", "own", "down", "other")


def searched(rows: DataFrame, texts: DataFrame, percent: int, point: str, every: bool) -> DataFrame:
    """a, b: the pairs that the trees of these rows (block, node, members, label) leave."""
    described = units(rows.join(texts.select("node", "size", F.col(point).alias("point")), "node"), percent)
    dealt = described.select("unit", "node", "label", "size", "point", "side", "mine").repartition("unit").sortWithinPartitions("unit", "node")
    return dealt.mapInArrow(lambda batches: search_units(batches, percent, every), "a binary, b binary").distinct()


def node_texts(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, size, point, rough, packed (the text) of the nodes in `nodes` (node, doc_id, h), the last three compressed: a
    point goes with its set into every unit. h is the text_key of a row's text, so that the row is found whether or not its
    id is null or repeated."""
    chosen = few(nodes.select(F.col("doc_id").alias("id"), F.col("h").alias("key"), "node"), BROADCAST_NODES)
    rows = docs.withColumn("h", text_key(F.col("text"))).join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key"))).select("text", "node")

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1)
        out = [[], [], [], [], []]
        for text, node, s in zip(batch.column(0), batch.column(1).to_pylist(), shingle_sets(batch.column(0), words), strict=True):
            for column, value in zip(out, (node, len(s), pack.compress((p := point(s)).tobytes()), pack.compress(rough(p).tobytes()), pack.compress(text.as_buffer())), strict=True):
                column.append(value)
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["node", "size", "point", "rough", "packed"])

    return map_arrow(rows, describe, "node binary, size long, point binary, rough binary, packed binary", _SEGMENT, "powers")


_LETTERS = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def overlap(a: bytes, b: bytes, words: int = WORDS) -> tuple[int, int, int]:
    """(size of the intersection, size of a's set, size of b's set) of the shingles of two texts, by their words."""
    left, right = (t.translate(_LETTERS).split() for t in (a, b))
    if min(len(left), len(right)) < words:  # all words of a text are its only shingle
        own = [len(set(zip(*[w[k:] for k in range(words)], strict=False))) if len(w) >= words else min(len(w), 1) for w in (left, right)]
        return int(bool(left) and left == right), *own
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in chain(left, right)), np.int64, len(left) + len(right))
    shingle = ids
    for k in range(1, words):  # numbers of the distinct runs of k + 1 words
        shingle = np.unique(shingle[:-1] * len(code) + ids[k:], return_inverse=True)[1]
    x, y = np.unique(shingle[: len(left) - words + 1]), np.unique(shingle[len(left) :])
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b of the pairs that are links by their words. Only texts that pairs name are shuffled, while these are few."""
    named = few(pairs.selectExpr("a node").unionAll(pairs.selectExpr("b node")).distinct())

    def side(name: str) -> DataFrame:
        return texts.join(named, "node", "left_semi").select(F.col("node").alias(name), F.col("packed").alias(f"packed_{name}"))

    def linked(batch: pa.RecordBatch) -> pa.RecordBatch:
        open_ = zstandard.ZstdDecompressor()
        keep = [bool(enough(*overlap(open_.decompress(x), open_.decompress(y), words), percent)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "packed_a", "packed_b")
    return map_arrow(full, linked, "a binary, b binary", _SEGMENT)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that the edges (a, b) reach, for nodes on an edge; large and small stars in turn."""

    def star(both: DataFrame, which) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where(which).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    now, before = staged(edges.select("a", "b").distinct(), "join-edges"), None
    while True:
        both = now.selectExpr("a u", "b v").unionAll(now.selectExpr("b u", "a v"))
        large = star(both, F.col("v") > F.col("u")).where("a <> b").distinct()
        down = large.selectExpr("greatest(a, b) u", "least(a, b) v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.selectExpr("u a", "m b")).where("a <> b").distinct()
        old, now = now, staged(small, "join-edges")
        discard(old)
        check = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if check == before:
            break
        before = check
    stars = now.selectExpr("a node", "b label")
    out = staged(stars.unionAll(stars.selectExpr("label node", "label")).distinct(), "join-labels")
    discard(now)
    return out


def joined(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """doc_id, h (text_key), n_shingles, label of each row; label is null for empty sets, else names the component."""
    spark = docs.sparkSession
    rows = narrow(docs, id_col, text_col)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), words)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.binary())], names=["doc_id", "h", "n_shingles", "node"])

    nodes = staged(map_arrow(rows.withColumn("h", text_key(F.col("text"))), measure, "doc_id long, h binary, n_shingles long, node binary", _SEGMENT, "powers"), "join-nodes")
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows, words, percent))
    dealt = blocks(rows, words, percent, frequent)
    block = staged(several_sets(dealt), "join-several")
    discard(dealt)

    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h"))
    involved = staged(nodes.join(block.select("node").distinct(), "node").groupBy("node").agg(first.alias("row")).select("node", "row.doc_id", "row.h"), "join-involved")
    texts = staged(node_texts(rows, involved, words), "join-texts")
    if texts.count() > involved.count():  # rows repeat an id and a text
        once = staged(texts.dropDuplicates(["node"]), "join-texts")
        discard(texts)
        texts = once
    pairs = staged(searched(block.where("asks").withColumn("label", F.lit(None).cast("binary")), texts, percent, "rough", False), "join-pairs")
    links = staged(verified(pairs, texts, words, percent), "join-links")
    labels = components(links)

    named = block.join(labels, "node", "left").select("block", "node", "members", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("block")
    open_ = staged(named.join(mixed, "block", "left_semi"), "join-open")
    others = staged(searched(open_, texts, percent, "point", True), "join-pairs")
    more = staged(verified(others, texts, words, percent), "join-links")
    if not more.isEmpty():
        old, labels = labels, components(links.unionAll(more))
        discard(old)
    discard(block, involved, texts, pairs, links, others, more, open_)  # from here on nodes and labels are read
    return nodes.join(labels, "node", "left").select("doc_id", "h", "n_shingles", F.coalesce("label", "node").alias("label"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    reached = joined(docs, id_col, text_col, words, percent)
    least = reached.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return reached.join(least, "label", "left").select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of docs, with all its columns, for each component: that of the smallest id, or of the smallest text_key
    where rows share it or none has one. Rows are dropped by id and text together; texts without words all stay."""
    reached = staged(joined(docs, id_col, text_col, words, percent).where(F.col("label").isNotNull()).select("doc_id", "h", "label"), "near-labels")
    row = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")
    several = reached.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first")).where("n > 1").select("label", "first")
    named = staged(reached.join(several, "label").select("doc_id", "h", (row == F.col("first")).alias("stays")), "near-rows")
    discard(reached)
    gone = named.where("not stays").select("doc_id", "h")
    repeated = named.where("stays").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    return without(docs, gone, repeated, id_col, text_col=text_col)
