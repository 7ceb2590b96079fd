"""Byte-level BPE by tiktoken: ranks from a local file, long texts split at safe boundaries, ids decoded to raw bytes.

A safe boundary is a single space between two letters: every alternative of the split pattern that could take the
letter ends before that space, and the space opens the next match. Cutting there gives the pieces that the whole text
would give, so a text of any length is encoded in runs of about PIECE characters.

Defined results: a null text is the empty one (no ids); an empty table gives an empty result; equal texts give equal
rows; a text without any safe boundary is encoded in one run. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, narrow, remembered

PIECE = 1 << 16
SAFE = regex.compile(r"(?<=\p{L}) (?=\p{L})")
SCHEMA = "doc_id long, ids array<int>"


@remembered("ranks")
def encoding(path: str, pattern: str):
    """The encoding, made once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in runs of at least `size` characters, each cut at the next safe boundary."""
    out, at = [], 0
    while len(text) - at > size and (cut := SAFE.search(text, at + size)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def encode_text(enc, text: str, size: int = PIECE) -> np.ndarray:
    if len(text) <= size:
        return np.asarray(enc.encode_ordinary(text), "<u4")
    return np.concatenate([np.asarray(enc.encode_ordinary(x), "<u4") for x in pieces(text, size)])


def encode_batch(batch: pa.RecordBatch, path: str, pattern: str) -> pa.RecordBatch:
    enc = encoding(path, pattern)
    ids = [encode_text(enc, t) for t in batch.column(1).to_pylist()]
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = pa.array(np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])


def decode_batch(batch: pa.RecordBatch, path: str, pattern: str) -> pa.RecordBatch:
    enc = encoding(path, pattern)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array([enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids", "bytes"])


def encode_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the token ids of each whole text."""
    return map_arrow(narrow(docs, id_col, text_col), lambda b: encode_batch(b, path, pattern), SCHEMA, uses="ranks")


def decode_bpe(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and bytes: the raw bytes that the ids stand for, whether or not they are valid UTF-8."""
    return map_arrow(tokens.select("doc_id", "ids"), lambda b: decode_batch(b, path, pattern), SCHEMA + ", bytes binary", uses="ranks")


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, decoded from the ids, and digested, all in one pass."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = decode_batch(encode_batch(batch, path, pattern), path, pattern)
        ids, ends = found.column(1).flatten().to_numpy().astype("<u4"), found.column(1).offsets.to_numpy()
        hexed = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        decoded = [hashlib.sha256(x.as_buffer()).hexdigest() for x in found.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(hexed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(narrow(docs, "doc_id", "text"), digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 1 << 21, "ranks")
