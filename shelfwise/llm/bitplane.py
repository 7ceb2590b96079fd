"""Token-id files with shuffled planes: blocks of ids transposed into byte or bit planes, each plane a zstandard frame.

A file: MAGIC, then for each block of BLOCK ids its planes one after another, then a footer (zstandard) with the chunk
index (offset and length of each plane, ids in each block) and the documents (id, null flag, number of ids), then the
footer's offset and length and MAGIC again. A plane of zeros only takes no bytes. `read_ids` fetches a range of ids by
the chunk index and touches no other block.

`write_token_files` range-partitions the documents by id, so files hold ascending ids and every task writes one file of
its own to the shared folder, under a name no other attempt uses. Its manifest, a small table committed by Spark, names
the files of the attempts that counted.

Defined results: a null text is the empty one (only the end id); a null doc_id sorts before all others; rows that
repeat an id are written each, ordered by text; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import shared_dir

from .common import forget, narrow, staged
from .words import word_ids

MAGIC = b"PLANES01"
BLOCK = 1 << 16
MANIFEST = "part long, path string, docs long, tokens long, bytes long"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The ids' four byte planes, or 32 bit planes, least significant first."""
    rows = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [r.tobytes() for r in rows]
    return [np.packbits((r >> k) & 1).tobytes() for r in rows for k in range(8)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """What to_planes was given; an empty plane is all zeros."""
    out = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if plane and len(planes) == 4:
            out[:, k] = np.frombuffer(plane, np.uint8)
        elif plane:
            out[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
    return out.reshape(-1).view("<u4")


class TokenWriter:
    """Writes one file block by block; holds a block of ids and the documents' lengths."""

    def __init__(self, sink, block: int = BLOCK, bits: bool = False, level: int = 1):
        self.sink, self.block, self.bits = sink, block, bits
        self.packer = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held = self.at = 0
        self.index: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self.flush(ids[i : i + self.block])
            self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def flush(self, ids: np.ndarray) -> None:
        packed = [self.packer.compress(p) if any(p) else b"" for p in to_planes(ids, self.bits)]
        self.index += [self.at, len(ids), *map(len, packed)]
        self.put(b"".join(packed))

    def close(self) -> None:
        if self.held:
            self.flush(np.concatenate(self.waiting))
        ids = np.array([d or 0 for d, _ in self.docs], "<i8")
        absent = np.array([d is None for d, _ in self.docs], np.uint8)
        sizes = np.array([n for _, n in self.docs], "<i8")
        planes = 32 if self.bits else 4
        footer = struct.pack("<4q", planes, self.block, len(self.docs), len(self.index)) + ids.tobytes() + absent.tobytes() + sizes.tobytes() + np.array(self.index, "<i8").tobytes()
        packed, at = self.packer.compress(footer), self.at
        self.put(packed + struct.pack("<2q", at, len(packed)) + MAGIC)


class TokenReader:
    """Reads one file through its footer."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        at, length = struct.unpack("<2q", self.fetch(size - 24, 24)[:16])
        if self.fetch(size - 8, 8) != MAGIC:
            raise ValueError("not a token file")
        raw = zstandard.ZstdDecompressor().decompress(self.fetch(at, length))
        planes, self.block, n, m = struct.unpack_from("<4q", raw)
        place = 32
        self.ids = np.frombuffer(raw, "<i8", n, place)
        self.absent = np.frombuffer(raw, np.uint8, n, place + 8 * n).astype(bool)
        self.sizes = np.frombuffer(raw, "<i8", n, place + 9 * n)
        self.index = np.frombuffer(raw, "<i8", m, place + 17 * n).reshape(-1, planes + 2)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def fetch(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def read_block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k].tolist()
        raw, planes, unpack = self.fetch(at, sum(sizes)), [], zstandard.ZstdDecompressor()
        for size in sizes:
            planes.append(unpack.decompress(raw[:size]) if size else b"")
            raw = raw[size:]
        return from_planes(planes, n)

    def read_ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start up to end of the whole file, from the blocks that hold them."""
        first = start // self.block
        parts = [self.read_block(k) for k in range(first, -(-end // self.block))] if end > start else []
        return np.concatenate([np.empty(0, "<u4"), *parts])[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document in turn; decodes each block once."""
        held, held_at, k = np.empty(0, "<u4"), 0, 0
        for i, size in enumerate(self.sizes.tolist()):
            start = int(self.starts[i])
            more = []
            while held_at + len(held) + sum(map(len, more)) < start + size:
                more.append(self.read_block(k))
                k += 1
            if more:
                held, held_at = np.concatenate([held[start - held_at :], *more]), start
            yield None if self.absent[i] else int(self.ids[i]), start, held[start - held_at : start - held_at + size]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: bool = False, files: int | None = None) -> DataFrame:
    """Writes all documents, each with end_id behind it; the manifest: part, path, docs, tokens, bytes of each file."""
    folder = shared_dir(docs.sparkSession, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("words")
        writer = None
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                rows = batch.slice(at, 250)
                if writer is None:
                    where, path = pafs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}.planes")
                    sink = where.open_output_stream(path)
                    writer = TokenWriter(sink, block, bits)
                end = np.uint32(end_id).tobytes()
                for doc_id, ids in zip(rows.column(0).to_pylist(), word_ids(tokenizer).encode(rows.column(1).to_pylist()), strict=True):
                    writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            sink.close()
            row = [TaskContext.get().partitionId(), f"{folder}/{path.rpartition('/')[2]}", len(writer.docs), sum(n for _, n in writer.docs), writer.at]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "path", "docs", "tokens", "bytes"])

    rows = narrow(docs, id_col, text_col)
    dealt = rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")
    return staged(dealt.sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of the manifest alone."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0))).select("path", "base")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, path = pafs.FileSystem.from_uri(uri)
                with where.open_input_file(path) as source:
                    rows = []
                    for doc_id, start, ids in TokenReader(source).documents():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return placed.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
