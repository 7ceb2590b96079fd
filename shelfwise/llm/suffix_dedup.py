"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts in a document with a smaller id.

0. Copies. Of documents with the same text (by SHA-256) only the least id goes on; the others lose all their bytes. What
   goes on is written once as bundles: about BUNDLE bytes of texts, compressed together. A bundle speaks for all its
   documents in what follows, so a passage that a third of them share costs a row for each bundle, not for each document.
1. Anchors. In each window of `length` bytes the `gram` bytes of least rank (a hash of 32 bits) are its anchor. Equal
   windows have equal anchors at equal places, so two documents that share a window share an anchor. A bundle sends the
   hashes of its anchors (64 bits, taken at anchors only), once each, dealt into buckets whose number follows the bytes of
   all texts; a bucket answers which of them another bundle has too, and which are hot (in more than HOT bundles).
2. Contexts. Of each anchor that two documents share a bundle sends the bytes of the windows that have it as their anchor,
   which are neighbours; contexts that repeat inside a bundle go once. Of a hot anchor every window goes by itself,
   dealt by a hash of its bytes, so that what surrounds a common phrase is spread over all tasks.
3. Suffix sort. Contexts meet by anchor. Equal ones are one from here on. Where an anchor has several, the suffixes that
   start in them are sorted to `length` bytes by deep-shallow sorting: multikey quicksort on 8-byte symbols to SHALLOW
   bytes, then blind tries for groups that still share a prefix. SHALLOW is nearly `length`: near copies agree in far more
   than 16 bytes, and all segments are split in step, while a trie takes its suffixes one by one. Each class of equal
   windows knows its least document.
4. Bundles get runs of windows with the least document of each, and cut them from every document with a greater id.

Hashes of anchors only propose: windows are compared byte by byte.

Defined results: a null text counts as empty (0 bytes, nothing removed); texts shorter than `length` lose nothing; rows
that repeat an id are one document to each other (neither is smaller) and are judged each on its own text; rows without
an id neither lose nor claim anything; an empty table gives an empty result. Other columns are not looked at. A text has
less than 2 GB, as any string of Spark's.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, few, forget, give_back, map_arrow, staged

LENGTH, GRAM = 50, 24
#: Depth in bytes of the multikey quicksort; contexts sorted together.
SHALLOW, TOGETHER = 48, 6_000
#: Bytes of texts in a bundle (a longer text is one by itself); bundles that make an anchor hot; buckets for each partition.
BUNDLE, HOT, BUCKETS = 1 << 18, 2000, 4
#: Bytes of texts whose anchors (about 7 for 100 bytes) and contexts make one bucket, so that a task holds as much on any corpus.
BUCKET_TEXT = 1 << 26

U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(29))


#: Windows whose ranks are taken together: what lies between the steps stays in a processor's cache.
STRIDE = 1 << 16


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every `width` neighbours, by doubling."""
    c, m = 1, x
    while c * 2 <= width:
        m, c = f(m[:-c], m[c:]), c * 2
    return f(m[: len(m) - (width - c)], m[width - c :]) if c < width else m


def gram_ranks(data: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of the `gram` bytes from each place, never 0: a polynomial of them, by doubling, mixed at last."""
    h, c = data.astype(np.uint32), 1
    while c < gram:
        step = min(c, gram - c)
        more = h[:-step] * np.uint32(pow(0x9E3779B1, c, 1 << 32))
        more += h[step:]
        h, c = more, c + step
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    return np.maximum(h, np.uint32(1), out=h)


def gram_hashes(data: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each of these places."""
    words = np.zeros((len(at), -(-gram // 8)), U)
    words.view(np.uint8)[:, :gram] = np.lib.stride_tricks.sliding_window_view(data, gram)[at]
    h = np.zeros(len(at), U)
    for k in range(words.shape[1]):
        h = _mix((h ^ words[:, k]) * U(0xBF58476D1CE4E5B9))
    return h


def anchors(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, least) of texts that lie one after another: the anchors of all their windows, and the least rank in
    the window that starts `length - gram` places before each place, 0 where that is no window of one text. Every place
    that ties for the least rank counts."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.uint32)
    width, windows = length - gram + 1, len(data) - length + 1
    rank, least = np.empty(windows + width - 1, np.uint32), np.zeros(windows + 2 * (width - 1), np.uint32)
    inside = least[width - 1 :][:windows]  # between zeros, so that every place is in `width` windows
    for a in range(0, windows, STRIDE):
        b = min(a + STRIDE, windows) + width - 1
        rank[a:b] = gram_ranks(data[a : b + gram - 1], gram)
        inside[a : b - width + 1] = _sliding(rank[a:b], width, np.minimum)
    ends = np.cumsum(sizes)
    cross = (ends[:, None] - np.arange(1, length)).ravel()  # windows from here reach over a text's end
    inside[cross[(cross >= 0) & (cross < windows)]] = 0
    at = np.concatenate([a + np.flatnonzero(_sliding(least[a : a + STRIDE + width - 1], width, np.maximum) == rank[a : a + STRIDE]) for a in range(0, len(rank), STRIDE)])
    return at, gram_hashes(data, at, gram), least


def own_windows(at: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) start of the windows that have each of these anchors; they are neighbours."""
    first, last = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    around = np.lib.stride_tricks.sliding_window_view(least, width) if len(at) else least
    for k in range(0, len(at), 5_000):
        a = at[k : k + 5_000]
        near = around[a]
        own = near == near.max(axis=1)[:, None]  # an anchor is the greatest of the least around it
        first[k : k + 5_000], last[k : k + 5_000] = a + 1 - width + own.argmax(axis=1), a - own[:, ::-1].argmax(axis=1)
    return first, last


class BlindTrie:
    """A trie that keeps branching depths and bytes only; a descent is checked against one string at its end."""

    def __init__(self, read, first: list[int], length: int):
        self.read, self.length, self.root = read, length, first  # equal strings; a leaf: its starts; a branch: (depth, {byte: node})

    def insert(self, start: int) -> None:
        own, node = self.read(start), self.root
        while isinstance(node, tuple):
            node = node[1].get(own[node[0]]) or next(iter(node[1].values()))
        other = self.read(node[0])
        if own == other:
            node.append(start)
            return
        depth = self.length + (int.from_bytes(own) ^ int.from_bytes(other)).bit_length() // -8  # of the first byte that differs
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][own[node[0]]]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][own[depth]] = [start]
            return
        branch = (depth, {other[depth]: node, own[depth]: [start]})
        if above is None:
            self.root = branch
        else:
            above[1][own[above[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """The classes of equal strings, in order."""
        waiting = [self.root]
        while waiting:
            node = waiting.pop()
            if isinstance(node, tuple):
                waiting += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node


def multikey_quicksort(symbols: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): suffixes sorted by group and their first `depth` bytes; edges are the first places of those alike.

    symbols: the 8 bytes from each place as one number. Segments of suffixes that agree so far are split in three around a
    pivot (the median of three) of their next symbol: less and greater stay at this symbol, equal go on to the next. All
    segments are split in step; one of a single suffix, or `depth` bytes deep, is in place.
    """
    order = np.argsort(group, kind="stable")
    edges = [np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))] if len(order) else []
    edge = edges[0] if edges else np.empty(0, np.int64)
    size, at = np.diff(np.append(edge, len(order))), np.zeros(len(edge), np.int64)  # bytes that a segment agrees in
    open_ = size > 1
    edge, size, at = edge[open_], size[open_], at[open_]
    while len(edge):
        seg = np.repeat(np.arange(len(edge)), size)
        begin = np.cumsum(size) - size
        place = np.arange(len(seg)) - begin[seg] + edge[seg]
        own = order[place]
        word = symbols[starts[own] + at[seg]]
        short = depth - at
        word = np.where(short[seg] < 8, word >> (U(8) * (8 - np.minimum(short, 8)).astype(U))[seg], word)
        three = np.stack([word[begin], word[begin + size // 2], word[begin + size - 1]])
        pivot = np.sort(three, axis=0)[1][seg]
        side = (word > pivot).astype(np.int64) + (word >= pivot)  # 0 less, 1 equal, 2 greater
        counts = np.stack([np.add.reduceat((side == k).astype(np.int64), begin) for k in range(3)])
        first = edge + np.concatenate([np.zeros((1, len(edge)), np.int64), np.cumsum(counts, axis=0)[:2]])
        target = np.empty(len(seg), np.int64)
        for k in range(3):
            here = side == k
            run = np.cumsum(here) - here
            target[here] = (first[k][seg] + run - run[begin][seg])[here]
        order[target] = own
        deeper = np.stack([at, at + 8, at])
        there = counts > 0
        edges.append(first[there])
        edge, size, at = first[there], counts[there], deeper[there]
        open_ = (size > 1) & (at < depth)
        edge, size, at = edge[open_], size[open_], at[open_]
    if edges:
        edge = np.sort(np.concatenate(edges))
        edge = edge[np.concatenate([[True], edge[1:] != edge[:-1]])] if len(edge) else edge
    return order, edge


def sort_suffixes(data: bytes, starts: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): order sorts the suffixes by (group, `length` bytes); rank is equal for equal ones.

    Deep-shallow sorting: multikey quicksort to `shallow` bytes; a group that still agrees goes through a blind trie,
    unless all its suffixes are equal.
    """
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    symbols = np.zeros(len(raw) - 7, U)
    for i in range(8):
        symbols = (symbols << U(8)) | raw[i : len(raw) - 7 + i]
    shallow = min(shallow, length)
    order, edge = multikey_quicksort(symbols, starts, group, shallow)
    size = np.diff(np.append(edge, len(order)))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.repeat(edge, size)
    if len(order) and shallow < length:
        several = np.flatnonzero(size > 1)
        deep = length - shallow
        rest = np.lib.stride_tricks.sliding_window_view(raw, deep)
        seg = np.repeat(np.arange(len(several)), size[several])
        begin = np.cumsum(size[several]) - size[several]
        own = order[np.arange(len(seg)) - begin[seg] + edge[several][seg]]
        lead = own[begin][seg] if len(seg) else own
        equal = np.ones(len(own), bool)
        for at in range(0, len(own), 50_000):
            part = slice(at, at + 50_000)
            equal[part] = (rest[starts[own[part]] + shallow] == rest[starts[lead[part]] + shallow]).all(axis=1)
        mixed = np.flatnonzero(~np.logical_and.reduceat(equal, begin)) if len(seg) else several
        place = starts.tolist() if len(mixed) else []

        def read(k: int) -> bytes:
            at = place[k] + shallow
            return data[at : at + deep]

        for g in mixed.tolist():
            part = slice(begin[g], begin[g] + size[several[g]])
            members, like = own[part], equal[part]
            trie = BlindTrie(read, members[like].tolist(), deep)
            for k in members[~like].tolist():
                trie.insert(k)
            at = int(edge[several[g]])
            for leaf in trie.leaves():
                rank[leaf] = at
                at += len(leaf)
        order = np.argsort(rank, kind="stable")
    return order, rank


def window_runs(key: np.ndarray, lead: np.ndarray, ctx: list[bytes], least: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(context, start, stop, least): runs of bytes in distinct contexts whose windows have the same least document;
    least: of each context itself. Windows match at equal places about their anchor."""
    sizes = np.array([len(c) for c in ctx], np.int64)
    n = np.maximum(sizes - length + 1, 0)
    item = np.repeat(np.arange(len(ctx)), n)
    shift = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    starts = (np.cumsum(sizes) - sizes)[item] + shift
    group = np.unique(key, return_inverse=True)[1][item] * (2 * length) + shift - lead[item] + length
    order, rank = sort_suffixes(b"".join(ctx), starts, group, length)
    owner = least[item]
    edge = np.flatnonzero(np.concatenate([[True], np.diff(rank[order]) != 0])) if len(order) else order
    first = np.empty(len(item), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(owner[order], edge), np.diff(np.append(edge, len(order)))) if len(order) else order
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (first[1:] != first[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(item)) - 1 if len(item) else head
    return item[head], shift[head], shift[tail] + length, first[head]


# Bundles


def make_bundles(docs: DataFrame, size: int = 0) -> DataFrame:
    """bundle, ids, sizes, blob (texts one after another, compressed) and the other columns as lists; written once."""
    size = size or BUNDLE
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = ["bundle", "ids", "sizes", "blob", *others]

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        number = TaskContext.get().partitionId() << 33
        zstd = zstandard.ZstdCompressor(level=3)
        held: list[pa.RecordBatch] = []
        texts: list[bytes] = []

        def told() -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), c.combine_chunks()) for c in (rows.column(0), *rows.columns[2:])]
            sizes = pa.array([[len(t) for t in texts]], pa.list_(pa.int32()))
            number += 1
            out = pa.RecordBatch.from_arrays([pa.array([number - 1]), lists[0], sizes, pa.array([zstd.compress(b"".join(texts))], pa.binary()), *lists[1:]], names=names)
            held.clear()
            texts.clear()
            return out

        for batch in batches:
            own = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            at, total = 0, sum(map(len, texts))
            for k, t in enumerate(own):
                if total and total + len(t) > size:
                    if k > at:
                        held.append(batch.slice(at, k - at))
                    at, total = k, 0
                    yield told()
                texts.append(t)
                total += len(t)
            if len(own) > at:
                held.append(batch.slice(at))
        if texts:
            yield told()
        give_back()

    schema = ", ".join(["bundle long, ids array<long>, sizes array<int>, blob binary", *[f"`{c}` array<{ddl(docs.schema[c].dataType)}>" for c in others]])
    return staged(docs.select("doc_id", "text", *others).mapInArrow(bundle, schema), "suffix-bundles")


def bucket_count(total: int, parts: int) -> tuple[int, int]:
    """(buckets, bytes of a key inside one) for `total` bytes of texts and `parts` tasks: BUCKETS for each task at least,
    and more where a bucket would stand for over BUCKET_TEXT bytes. Bucket and key have 63 bits together."""
    buckets = max(parts * BUCKETS, -(-total // BUCKET_TEXT))
    return buckets, (63 - (buckets - 1).bit_length()) // 8


class Opened:
    """A bundle with its anchors: places, distinct keys in order of their bucket, and for each place the number of its key."""

    def __init__(self, sizes: list[int], blob: bytes, length: int, gram: int, buckets: int, key_bytes: int):
        self.data = decompressor().decompress(blob) if sum(sizes) else b""
        self.sizes, self.length, self.gram = np.asarray(sizes, np.int64), length, gram
        self.at, self.h, self.least = anchors(np.frombuffer(self.data, np.uint8), self.sizes, length, gram)
        bucket, key = self.h % U(buckets), self.h // U(buckets) & U((1 << 8 * key_bytes) - 1)
        self.key_bytes, code = key_bytes, (bucket << U(8 * key_bytes)) | key
        self.codes, self.number = np.unique(code, return_inverse=True)
        self.doc = np.searchsorted(np.cumsum(self.sizes), self.at, "right")

    def shared_here(self, ids: np.ndarray) -> np.ndarray:
        """Whether two ids of the bundle have each key."""
        own = ids[self.doc]
        low, high = np.full(len(self.codes), np.iinfo(np.int64).max), np.full(len(self.codes), np.iinfo(np.int64).min)
        np.minimum.at(low, self.number, own)
        np.maximum.at(high, self.number, own)
        return low < high

    def contexts(self, wanted: np.ndarray, hot: np.ndarray) -> "Contexts":
        """The windows of each wanted anchor. A hot anchor's windows are contexts of their own, their key a hash of them."""
        use = np.flatnonzero(wanted[self.number])
        begin, last = own_windows(self.at[use], self.least, self.length - self.gram + 1)
        key, at, doc, size = self.codes[self.number[use]].astype(np.int64), self.at[use], self.doc[use], last - begin + self.length
        single = hot[self.number[use]]
        if single.any():
            n = np.where(single, last - begin + 1, 1)
            row = np.repeat(np.arange(len(use)), n)
            begin = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key, at, doc, single = key[row], at[row], doc[row], single[row]
            size = np.where(single, self.length, size[row])
            own = np.flatnonzero(single)
            key[own] = [xxhash.xxh3_64_intdigest(self.data[s : s + self.length], k) >> 1 for s, k in zip(begin[own].tolist(), key[own].tolist(), strict=True)]
        return Contexts(self.data, key, begin, at - begin, size, doc)


class Contexts:
    """The places in a bundle that have a context: its key, begin and size, the bytes before its anchor, the document's
    place, and the first place with an equal one (`like`), which stands for all of them."""

    def __init__(self, data: bytes, key: np.ndarray, begin: np.ndarray, lead: np.ndarray, size: np.ndarray, doc: np.ndarray):
        self.data, self.key, self.begin, self.lead, self.size, self.doc = data, key, begin, lead, size, doc
        order = np.lexsort((lead * (1 << 31) + size, key))
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = (np.diff(key[order]) == 0) & (np.diff(lead[order]) == 0) & (np.diff(size[order]) == 0)
        several = np.sort(order[same[:-1] | same[1:]])  # not alone with its key, lead and size
        self.like = np.arange(len(key))
        first: dict[tuple[int, int, bytes], int] = {}
        rows = zip(several.tolist(), key[several].tolist(), lead[several].tolist(), begin[several].tolist(), (begin + size)[several].tolist(), strict=True)
        self.like[several] = [first.setdefault((k, before, data[a:b]), row) for row, k, before, a, b in rows]

    def blocks(self, ids: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, its different contexts)."""
        order = np.argsort(self.like, kind="stable")
        use = np.flatnonzero(self.like == np.arange(len(self.like)))
        if not len(use):
            return
        owner, edge = ids[self.doc[order]], np.searchsorted(self.like[order], use)
        columns = [self.key[use], use.astype("<i4"), self.lead[use].astype("<i4"), self.size[use].astype("<i4"), np.minimum.reduceat(owner, edge), np.maximum.reduceat(owner, edge)]
        bucket = columns[0] % buckets
        order = np.argsort(bucket, kind="stable")
        columns = [c[order] for c in columns]
        begin = self.begin[use[order]]
        texts = [self.data[a:b] for a, b in zip(begin.tolist(), (begin + columns[3]).tolist(), strict=True)]
        own, edge = np.unique(bucket[order], return_index=True)
        for k, a, b in zip(own.tolist(), edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
            yield k, packed([c[a:b] for c in columns], b"".join(texts[a:b]))


@cache
def compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3)


@cache
def decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def packed(columns: list[np.ndarray], tail: bytes = b"") -> bytes:
    """Columns of one length, and bytes behind them, as one compressed block."""
    head = struct.pack("<q", len(columns[0]))
    return compressor().compress(head + b"".join(c.tobytes() for c in columns) + tail)


def unpacked(block: bytes, kinds: list[str]) -> tuple[list[np.ndarray], bytes]:
    raw = decompressor().decompress(block)
    n, at, out = struct.unpack_from("<q", raw)[0], 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out, raw[at:]


RESULT = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
CONTEXT = ["<i8", "<i4", "<i4", "<i4", "<i8", "<i8"]  # key, number in the bundle, lead, size, least and greatest document
RUN = ["<i4", "<i4", "<i4", "<i8"]  # number in the bundle, start, stop, least document


def by_bucket(rows: DataFrame, parts: int) -> DataFrame:
    """Rows dealt so that a bucket's are together, one bucket after another."""
    return rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket", "bundle")


def each_bucket(batches: Iterator[pa.RecordBatch], settle) -> Iterator[pa.RecordBatch]:
    """settle(bundles, blocks) for each bucket's rows (bucket, bundle, block)."""
    forget()
    bundles: list[int] = []
    blocks: list[bytes] = []
    now = None
    for batch in batches:
        for bucket, bundle, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and blocks:
                yield from settle(now, bundles, blocks)
                bundles, blocks = [], []
            now = bucket
            bundles.append(bundle)
            blocks.append(block)
    if blocks:
        yield from settle(now, bundles, blocks)
    give_back()


def key_answers(bucket: int, bundles: list[int], blocks: list[bytes], many: int, key_bytes: int) -> Iterator[pa.RecordBatch]:
    """For each bundle two bits for each of its keys in the bucket: another bundle has it too; it is hot."""
    parts = []
    for block in blocks:
        raw = np.zeros((len(block) // key_bytes, 8), np.uint8)
        raw[:, :key_bytes] = np.frombuffer(block, np.uint8).reshape(-1, key_bytes)
        parts.append(raw.view("<u8").ravel())
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    size = np.diff(np.append(edge, len(keys)))
    times = np.empty(len(keys), np.int64)
    times[order] = np.repeat(size, size)
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(np.concatenate([t > 1, t > many])).tobytes() for t in np.split(times, ends[:-1])]
    told = [k for k, b in enumerate(bits) if any(b)]
    columns = [pa.array([bundles[k] for k in told], pa.int64()), pa.array([bucket] * len(told), pa.int64()), pa.array([bits[k] for k in told], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["bundle", "bucket", "bits"])


def context_answers(bucket: int, bundles: list[int], blocks: list[bytes], length: int) -> Iterator[pa.RecordBatch]:
    """For each bundle the runs of its contexts that a document of another id has a window of, with the least of these."""
    columns: list[list[np.ndarray]] = [[] for _ in CONTEXT]
    of: list[np.ndarray] = []
    known: dict[tuple[int, int, bytes], int] = {}
    kind: list[int] = []
    for k, block in enumerate(blocks):
        own, text = unpacked(block, CONTEXT)
        for column, values in zip(columns, own, strict=True):
            column.append(values)
        of.append(np.full(len(own[0]), k))
        at = 0
        for key, lead, size in zip(own[0].tolist(), own[2].tolist(), own[3].tolist(), strict=True):
            kind.append(known.setdefault((key, lead, text[at : at + size]), len(known)))
            at += size
    _, number, _, _, low, high = (np.concatenate(c) for c in columns)
    source, which = np.concatenate(of), np.array(kind)
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, which, low)
    distinct = list(known)
    key, lead = (np.array([d[k] for d in distinct], np.int64) for k in (0, 1))
    sizes = np.array([len(d[2]) for d in distinct], np.int64)
    by_key = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(key[by_key]) != 0]))
    size = np.diff(np.append(edge, len(key)))
    alone = by_key[np.repeat(size == 1, size)]  # the only context of its anchor: all its windows are in one class
    runs = [(alone, np.zeros(len(alone), np.int64), sizes[alone], least[alone])]
    several, cut = np.flatnonzero(size > 1), 0
    while cut < len(several):  # anchors by anchors, about TOGETHER contexts at a time
        end = cut + max(1, int(np.searchsorted(np.cumsum(size[several[cut:]]), TOGETHER, "right")))
        use = np.concatenate([by_key[edge[g] : edge[g] + size[g]] for g in several[cut:end].tolist()])
        item, start, stop, first = window_runs(key[use], lead[use], [distinct[k][2] for k in use.tolist()], least[use], length)
        runs.append((use[item], start, stop, first))
        cut = end
    item, start, stop, first = (np.concatenate([r[k] for r in runs]) for k in range(4))
    order = np.argsort(item, kind="stable")  # runs of a kind side by side, for each of its rows
    begin, n = np.searchsorted(item[order], np.arange(len(known))), np.bincount(item, minlength=len(known))
    row = np.repeat(np.arange(len(which)), n[which])
    run = order[np.arange(len(row)) - np.repeat(np.cumsum(n[which]) - n[which], n[which]) + begin[which][row]]
    keep = first[run] < high[row]
    row, run = row[keep], run[keep]
    edges = np.searchsorted(source[row], np.arange(len(blocks) + 1))
    out = []
    for k in range(len(blocks)):
        part = slice(edges[k], edges[k + 1])
        if edges[k] < edges[k + 1]:
            out.append((bundles[k], packed([number[row[part]].astype("<i4"), start[run[part]].astype("<i4"), stop[run[part]].astype("<i4"), first[run[part]].astype("<i8")])))
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["bundle", "runs"])


def wanted_keys(bundle: Opened, ids: np.ndarray, answer: list | None) -> tuple[np.ndarray, np.ndarray]:
    """(whether two documents share a key, whether it is hot) for each key of the bundle."""
    wanted, hot = bundle.shared_here(ids), np.zeros(len(bundle.codes), bool)
    bucket = bundle.codes >> U(8 * bundle.key_bytes)
    told = np.array([a["bucket"] for a in answer or []], U)
    low, high = np.searchsorted(bucket, told).tolist(), np.searchsorted(bucket, told, "right").tolist()
    for a, b, one in zip(low, high, answer or [], strict=True):
        bits = np.unpackbits(np.frombuffer(one["bits"], np.uint8), count=2 * (b - a)).view(bool)
        wanted[a:b] |= bits[: b - a]
        hot[a:b] = bits[b - a :]
    return wanted, hot


def strip_bundles(bundles: DataFrame, others: list[str], length: int, gram: int) -> DataFrame:
    """RESULT of each document of the bundles; kept and the other columns too, where there are any."""
    names = [*RESULT, *["kept"] * bool(others), *others]
    parts = max(1, int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = HOT
    total = bundles.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets, key_bytes = bucket_count(total, parts)
    opened = lambda sizes, blob: Opened(sizes, blob, length, gram, buckets, key_bytes)

    def keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for bundle, sizes, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = opened(sizes, blob).codes
            if not len(codes):
                continue
            bucket = (codes >> U(8 * key_bytes)).astype(np.int64)
            own, edge = np.unique(bucket, return_index=True)
            raw = codes.view(np.uint8).reshape(-1, 8)[:, :key_bytes]
            blocks = [raw[a:b].tobytes() for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(codes)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([bundle] * len(own), pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "bundle", "block"])

    def contexts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for bundle, ids, sizes, blob, answer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one, ids = opened(sizes, blob), np.array(ids, np.int64)
            found = list(one.contexts(*wanted_keys(one, ids, answer)).blocks(ids, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([bundle] * len(found), pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["bucket", "bundle", "block"])

    def strip(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            ids, sizes, blob, answer, runs = (batch.column(c)[k].as_py() for c in range(1, 6))
            one, owner = opened(sizes, blob), np.array(ids, np.int64)
            spans = spans_of(one.contexts(*wanted_keys(one, owner, answer)), owner, runs) if runs else {}
            rows, end = [], 0
            for i, size in enumerate(sizes):
                text = one.data[end : end + size]
                cut = [(a - end, b - end) for a, b in spans.get(i, [])]
                ends = [0, *[x for pair in cut for x in pair], size]
                left = b"".join([text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)])
                rows.append((ids[i], size, size - len(left), len(cut), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if others else None))
                end += size
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string()][: len(names) - len(others)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, *[batch.column(6 + c)[k].values for c in range(len(others))]], names=names)

    asked = map_arrow(bundles.select("bundle", "sizes", "blob"), keys, "bucket long, bundle long, block binary")
    shared = by_bucket(asked, parts).mapInArrow(lambda b: each_bucket(b, lambda *a: key_answers(*a, many, key_bytes)), "bundle long, bucket long, bits binary")
    answers = staged(shared.groupBy("bundle").agg(F.collect_list(F.struct("bucket", "bits")).alias("shared")), "suffix-shared")
    known = bundles.join(answers, "bundle", "left")  # both grow with the corpus, so neither is sent to all tasks
    sent = map_arrow(known.select("bundle", "ids", "sizes", "blob", "shared"), contexts, "bucket long, bundle long, block binary")
    runs = by_bucket(sent, parts).mapInArrow(lambda b: each_bucket(b, lambda *a: context_answers(*a, length)), "bundle long, runs binary")
    cuts = staged(runs.groupBy("bundle").agg(F.collect_list("runs").alias("runs")), "suffix-runs")
    told = known.join(cuts, "bundle", "left")
    more = ", kept string" * bool(others) + "".join(f", `{c}` {ddl(bundles.schema[c].dataType.elementType)}" for c in others)
    return map_arrow(told.select("bundle", "ids", "sizes", "blob", "shared", "runs", *others), strip, ", ".join(f"{c} {t}" for c, t in RESULT.items()) + more, 1 << 20)


def spans_of(found: Contexts, ids: np.ndarray, runs: list[bytes]) -> dict[int, list[tuple[int, int]]]:
    """The maximal runs of bytes that each document of the bundle loses, by its place in it, at places in the bundle;
    spans that touch are one run."""
    number, start, stop, least = (np.concatenate(c) for c in zip(*[unpacked(r, RUN)[0] for r in runs], strict=True))
    order = np.argsort(found.like, kind="stable")
    begin, end = (np.searchsorted(found.like[order], number, side) for side in ("left", "right"))
    n = end - begin
    run = np.repeat(np.arange(len(number)), n)
    at = order[np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + begin[run]]
    lose = ids[found.doc[at]] > least[run]
    at, run = at[lose], run[lose]
    a, b, own = found.begin[at] + start[run], found.begin[at] + stop[run], found.doc[at]
    order = np.argsort(a, kind="stable")  # documents lie one after another
    a, b, own = a[order], np.maximum.accumulate(b[order]), own[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] > b[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(head)
    out: dict[int, list[tuple[int, int]]] = {}
    for doc, x, y in zip(own[first].tolist(), a[first].tolist(), b[np.append(first[1:], len(a)) - 1].tolist() if len(a) else [], strict=True):
        out.setdefault(doc, []).append((x, y))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; with `texts` also kept and row (all its columns but
    the text).

    kept is what remains, decoded; a character that was cut through is dropped from it.
    """
    carried = [F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col]).alias("row")] if texts else []
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *carried)
    known = rows.where(F.col("doc_id").isNotNull())
    ids = staged(known.select("doc_id", F.unhex(F.sha2("text", 256)).alias("h")), "suffix-ids")
    least = few(staged(ids.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h", "least"), "suffix-least"))
    named = known.withColumn("h", F.unhex(F.sha2("text", 256))).join(least, "h", "left")
    is_copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    own, copied = named.where(~is_copy).select(*rows.columns), named.where(is_copy).select(*rows.columns)
    bundles = make_bundles(own)
    others = ["row"] * texts
    done = strip_bundles(bundles, others, length, gram)

    size = F.octet_length("text").cast("long")
    for other, gone in ((rows.where(F.col("doc_id").isNull()), F.lit(False)), (copied, size >= length)):
        left = F.when(gone, "").otherwise(F.col("text"))
        whole = other.select("doc_id", size.alias("n_bytes"), F.when(gone, size).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"), F.sha2(left, 256).alias("kept_sha256"), *([left.alias("kept"), F.col("row")] if texts else []))
        done = done.unionByName(whole)
    return done
