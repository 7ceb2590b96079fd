"""Media columns: AVI files of motion JPEG, their frames decoded in bulk, shots found by adaptive histogram differences.

Storing bytes: a sample is one 8 x 8 block of a baseline grey JPEG whose DC coefficient is the byte (quantised by 8, so
the block is flat and nothing is lost). WIDTH samples are a row and a restart interval; frames hold ROWS rows at most.
The AVI has a stream header, the frames as '00dc' chunks, an 'idx1' index and the payload's length in its INFO list.

Reading: RIFF chunks and the index (its offsets from the frame list or from the file's start; without an index the frame
list in order) give the frames. Baseline frames of 8 bits are decoded, grey or in colour with any sampling, with their own
Huffman tables or, as is usual in motion JPEG, without any. Restart markers cut scans into intervals, and the intervals of
all frames of a batch are decoded in step, one Huffman symbol of each at a time. Of the luma, decoding gives the DC image
(a pixel for each block), which is what shot detection looks at, or with `full` every pixel.

Defined results: a null text is the empty one; the payload is padded with spaces to a positive multiple of UNIT; equal
texts give equal values; an empty table gives an empty result. A file must stay under 2 GB, so texts under about 1 GB. A
file that is not an AVI file, or with a frame that is cut, corrupt or not baseline, has its error in a column and nothing else.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, narrow, remembered

WIDTH, ROWS, UNIT, RATE = 64, 48, 192, 25
#: Huffman codes of the frames: number of codes of 1 to 16 bits, then their symbols. DC: size of the difference.
DC_CODES = ([0, 0, 6, 3], [5, 6, 4, 3, 7, 2, 1, 0, 8])
AC_CODES = ([1], [0])  # the end of the block alone
#: Chunks of a stream that are frames.
FRAMES = (b"dc", b"db")
# The JPEG standard's usual Huffman tables, which motion JPEG leaves out (counts of codes by length, symbols).
USUAL = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), tuple(range(12))),
    0x10: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), tuple(bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
        "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"))),
    0x11: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), tuple(bytes.fromhex(
        "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a43444546474849"
        "4a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
        "c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"))),
}
BINS, SHOT_FACTOR, SHOT_FLOOR = 16, 3.0, 0.15


def canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) in canonical order."""
    out, code, k = [], 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, bits))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(codes: list[tuple[int, int, int]]) -> np.ndarray:
    """For each 16 bits ahead: bits of the code * 256 + symbol; 0 where no code begins so."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, code, bits in codes:
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits * 256 + symbol
    return table


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) of each DC difference from -255 to 255, with the end of the block behind it."""
    of = {s: (c, b) for s, c, b in canonical(*DC_CODES)}
    _, end, end_bits = canonical(*AC_CODES)[0]
    codes, bits = [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = of[size]
        value = (code << size) | (d if d >= 0 else d + (1 << size) - 1)
        codes.append(value << end_bits | end)
        bits.append(n + size + end_bits)
    return np.array(codes, np.int64), np.array(bits, np.int64)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=256)
def jpeg_header(width: int, height: int) -> bytes:
    """All of a grey frame of width x height blocks up to its scan."""
    dht = b"".join(bytes([kind]) + bytes(counts + [0] * (16 - len(counts))) + bytes(symbols) for kind, (counts, symbols) in ((0x00, DC_CODES), (0x10, AC_CODES)))
    return (
        b"\xff\xd8"
        + segment(0xDB, b"\0" + bytes([8] + [16] * 63))
        + segment(0xC0, struct.pack(">BHHB", 8, height * 8, width * 8, 1) + b"\1\x11\0")
        + segment(0xC4, dht)
        + segment(0xDD, struct.pack(">H", width))
        + segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def encode_scans(rows: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): scan data of each row of samples and the marker behind it (the frame's end, where `last`)."""
    codes, bits = _difference_codes()
    level = rows.astype(np.int64) - 128
    step = np.diff(level, axis=1, prepend=0) + 255
    value, size = codes[step], bits[step]
    ends = np.cumsum(size, axis=1)
    length = (ends[:, -1] + 7) // 8
    base = np.cumsum(length) - length
    at = base[:, None] * 8 + ends - size
    byte, window = (at >> 3).ravel(), (value << (24 - (at & 7) - size)).ravel()
    total = int(length.sum())
    data = sum(np.bincount(byte + k, (window >> (16 - 8 * k)) & 255, total + 3)[: total + 3] for k in range(3)).astype(np.uint8)[:total]
    data[base + length - 1] |= ((1 << (length * 8 - ends[:, -1])) - 1).astype(np.uint8)
    full = data == 255  # a zero goes behind each
    before = np.concatenate([[0], np.cumsum(full)])
    row = np.repeat(np.arange(len(rows)), length)
    place = np.arange(total) + before[:-1] + 2 * row
    out = np.zeros(total + int(before[-1]) + 2 * len(rows), np.uint8)
    out[place] = data
    mark = base + length + before[base + length] + 2 * np.arange(len(rows))
    out[mark] = 255
    out[mark + 1] = np.where(last, 0xD9, 0xD0 + number % 8)
    return out, np.concatenate([[0], mark + 2])


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi_file(frames: list[bytes], width: int, height: int, payload: int) -> bytes:
    size = (width * 8, height * 8)
    avih = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, len(frames), 0, 1, 0, *size, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, *size)
    strf = struct.pack("<IiiHH4sIiiII", 40, *size, 1, 8, b"MJPG", size[0] * size[1], 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", b"payload=%d" % payload))
    index, at, body = [], 4, []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(chunk(b"00dc", f))
        at += len(body[-1])
    return chunk(b"RIFF", b"AVI " + head + info + chunk(b"LIST", b"movi" + b"".join(body)) + chunk(b"idx1", b"".join(index)))


def store(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each payload (lengths are positive multiples of UNIT); all rows are encoded together."""
    shapes, blocks = [], []
    for p in payloads:
        rows = len(p) // WIDTH
        height = min(rows, ROWS)
        frames = -(-rows // height)
        blocks.append(np.frombuffer(p + b" " * ((frames * height - rows) * WIDTH), np.uint8))
        shapes.append((frames, height, len(p)))
    if not payloads:
        return []
    number = np.concatenate([np.tile(np.arange(h), f) for f, h, _ in shapes])
    last = number == np.concatenate([np.full(f * h, h - 1) for f, h, _ in shapes])
    data, starts = encode_scans(np.concatenate(blocks).reshape(-1, WIDTH), last, number)
    raw, out, row = data.tobytes(), [], 0
    for frames, height, size in shapes:
        head, made = jpeg_header(WIDTH, height), []
        for _ in range(frames):
            made.append(head + raw[starts[row] : starts[row + height]])
            row += height
        out.append(avi_file(made, WIDTH, height, size))
    return out


def chunks(data: bytes, at: int, end: int):
    """(name, start, size) of the RIFF chunks between two places."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """(frames in index order, frames a second, payload length if noted)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, payload, movi, index, listed = float(RATE), None, None, None, []
    waiting = [(12, len(data), False)]
    while waiting:
        start, end, inside = waiting.pop()
        for name, at, size in chunks(data, start, end):
            kind = data[at : at + 4]
            if name == b"LIST":
                movi = at if kind == b"movi" else movi
                waiting.append((at + 4, min(at + size, len(data)), inside or kind == b"movi"))
            elif inside and name[2:] in FRAMES:
                listed.append((at, size))
            elif name == b"strh" and kind == b"vids":
                scale, per = struct.unpack_from("<II", data, at + 20)
                rate = per / max(scale, 1)
            elif name == b"ICMT" and data[at : at + 8] == b"payload=":
                payload = int(data[at + 8 : at + size])
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, at + k) for k in range(0, size - 15, 16)]
    if movi is None:
        raise ValueError("no list of frames")
    if index is None:
        places = sorted(listed)
    else:
        own = [(name, at, n) for name, _, at, n in index if name[2:] in FRAMES]
        base = movi if all(data[movi + at : movi + at + 4] == name for name, at, _ in own) else 0
        if not all(data[base + at : base + at + 4] == name for name, at, _ in own):
            raise ValueError("the index does not fit the frames")
        places = [(base + at + 8, n) for _, at, n in own]
    if any(at + n > len(data) for at, n in places):
        raise ValueError("a frame is cut")
    return [data[at : at + n] for at, n in places if n], rate, payload  # an empty chunk repeats the frame before


@remembered("frames", 32)
def table_of(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    return lookup(canonical(list(counts), list(symbols)))


@dataclass(frozen=True)
class Head:
    """What a frame's head says: size in pixels, MCUs in an interval (0: all), and for each component of its scan
    (blocks across and down in an MCU, quantisation in zigzag order, codes of its DC and AC tables)."""

    width: int
    height: int
    interval: int
    parts: tuple[tuple[int, int, bytes, tuple, tuple], ...]

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = (max(p[k] for p in self.parts) for k in (0, 1)) if len(self.parts) > 1 else (1, 1)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


@remembered("frames", 256)
def parse_header(head: bytes) -> Head:
    at, size, interval, quant, tables, planes = 2, None, 0, {}, dict(USUAL), {}
    while at + 4 <= len(head):
        _, marker, n = struct.unpack_from(">BBH", head, at)
        body = head[at + 4 : at + 2 + n]
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = body[k + 2 : k + 130 : 2] if wide else body[k + 1 : k + 65]
                k += 129 if wide else 65
        elif marker == 0xC0:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or not width or not height:
                raise ValueError("only frames of 8 bits are decoded")
            size = (width, height)
            planes = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = tuple(body[k + 1 : k + 17])
                tables[body[k]] = (counts, tuple(body[k + 17 : k + 17 + sum(counts)]))
                k += 17 + sum(counts)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if size is None or body[0] != len(planes):
                raise ValueError("only frames of one scan are decoded")
            out = []
            for k in range(body[0]):
                across, down, q = planes[body[1 + 2 * k]]
                use = body[2 + 2 * k]
                out.append((across, down, quant[q], tables[use >> 4], tables[0x10 | (use & 15)]))
            return Head(*size, interval, tuple(out))
        at += 2 + n
    raise ValueError("a frame without a scan")


def scan_start(frame: bytes) -> int:
    at = frame.find(b"\xff\xda")
    if frame[:2] != b"\xff\xd8" or at < 0:
        raise ValueError("a frame without a scan")
    return at + 2 + struct.unpack_from(">H", frame, at + 2)[0]


def decode_frames(frames: list[bytes], full: bool = False) -> list[np.ndarray | None]:
    """The luma of each frame, levels 0 to 255, of its DC image or (full) of its pixels; None for a corrupt one. Frames
    of the same kind are decoded in step."""
    out: list[np.ndarray | None] = [None] * len(frames)
    same: dict[tuple, list[tuple[int, Head, bytes]]] = {}
    for i, f in enumerate(frames):
        start = scan_start(f)
        head = parse_header(f[:start])
        alone = 0 if head.interval else head.mcus[0] * head.mcus[1]
        same.setdefault((head.interval or alone, head.parts), []).append((i, head, f[start:]))
    for (interval, parts), members in same.items():
        mcus = [h.mcus[0] * h.mcus[1] for _, h, _ in members]
        wanted = [-(-m // interval) for m in mcus]
        there = marks_in([scan for _, _, scan in members])
        good = [k for k, n in enumerate(wanted) if there[k] == n]  # frames that lack an interval are left out
        if not good:
            continue
        luma, bad = decode_intervals([members[k][2] for k in good], [wanted[k] for k in good], interval, parts, [mcus[k] for k in good], full)
        across, down = parts[0][:2] if len(parts) > 1 else (1, 1)
        at = 0
        for k in good:
            i, head, _ = members[k]
            n, (wide, high) = wanted[k], head.mcus
            blocks = luma[at : at + n].reshape(-1, down * across, luma.shape[-1])[: wide * high]
            if not bad[at : at + n].any():
                grid = blocks.reshape(high, wide, down, across, -1).transpose(0, 2, 1, 3, 4).reshape(high * down, wide * across, -1)
                out[i] = pixels(grid, parts[0][2])[: head.height, : head.width] if full else np.clip((grid[:, :, 0] * parts[0][2][0] + 4) // 8 + 128, 0, 255).astype(np.uint8)[: -(-head.height // 8), : -(-head.width // 8)]
            at += n
    return out


def pixels(grid: np.ndarray, quant: bytes) -> np.ndarray:
    """Pixels of blocks (down, across, 64 coefficients in zigzag order): dequantised and put through the inverse cosine transform."""
    order = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
    blocks = np.zeros(grid.shape, np.float64)
    blocks[:, :, order] = grid * np.frombuffer(quant, np.uint8)
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    down, across = grid.shape[:2]
    out = np.einsum("vy,dcvu,ux->dycx", basis, blocks.reshape(down, across, 8, 8), basis)
    return np.clip(np.rint(out) + 128, 0, 255).astype(np.uint8).reshape(8 * down, 8 * across)


def marks_in(scans: list[bytes]) -> np.ndarray:
    """Restart and end markers in each scan."""
    data = np.frombuffer(b"".join(scans), np.uint8)
    at = np.flatnonzero((data[:-1] == 255) & (data[1:] >= 0xD0) & (data[1:] <= 0xD9))
    ends = np.cumsum([len(s) for s in scans])
    return np.bincount(np.searchsorted(ends, at, "right"), minlength=len(scans))


def decode_intervals(scans: list[bytes], counts: list[int], interval: int, parts: tuple, mcus: list[int], full: bool) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of the first component's blocks, whether it is corrupt) of each restart interval of the scans; only
    DC values unless full. A symbol of all intervals is read at a time."""
    data = np.frombuffer(b"".join(scans) + b"\0" * 8, np.uint8)
    is_full = data[:-1] == 255
    mark = is_full & (data[1:] >= 0xD0) & (data[1:] <= 0xD9)
    drop = np.zeros(len(data), bool)
    drop[1:] = is_full & (data[1:] == 0)
    drop[:-1] |= mark
    drop[1:] |= mark
    left = np.cumsum(~drop)
    ends = left[np.flatnonzero(mark)]  # bytes before each marker
    begin = np.concatenate([[0], ends[:-1]])
    clean = np.concatenate([data[~drop], np.zeros(8, np.uint8)])
    ahead = np.zeros(len(clean) - 7, np.uint64)
    for k in range(8):
        ahead = (ahead << np.uint64(8)) | clean[k : len(clean) - 7 + k]
    todo = np.minimum(interval, np.concatenate([m - np.arange(n) * interval for n, m in zip(counts, mcus, strict=True)]))
    bit, bad = begin.astype(np.int64) * 8, np.zeros(len(begin), bool)
    pattern = [(c, (h, v)) for c, (h, v, *_) in enumerate(parts) for _ in range(h * v if len(parts) > 1 else 1)]
    own = sum(c == 0 for c, _ in pattern)
    values = np.zeros((len(parts), len(begin)), np.int64)
    out = np.zeros((len(begin), interval, own, 64 if full else 1), np.int32 if full else np.int64)

    def take(table: np.ndarray, at: np.ndarray, lanes: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, value of its extra bits, bits in all) at these places."""
        w = ahead[np.minimum(at >> 3, len(ahead) - 1)] << (at & 7).astype(np.uint64)
        entry = table[(w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        bits, symbol = entry >> 8, entry & 255
        if not bits.all():
            bad[lanes] |= bits == 0
        size = symbol & 15
        extra = (((w << bits.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
        return symbol, extra - np.where(extra < (1 << size) >> 1, (1 << size) - 1, 0), bits + size

    codes = [(table_of(*dc), table_of(*ac)) for _, _, _, dc, ac in parts]
    for j in range(interval):
        on = slice(None) if (todo > j).all() else np.flatnonzero(todo > j)
        for b, (c, _) in enumerate(pattern):
            dc, ac = codes[c]
            _, d, n = take(dc, bit[on], on)
            bit[on] += n
            values[c, on] += d
            if c == 0:
                out[on, j, b, 0] = values[0, on]
            lanes = np.arange(len(bit))[on]
            k = np.ones(len(lanes), np.int64)
            while len(lanes):
                symbol, value, n = take(ac, bit[lanes], lanes)
                bit[lanes] += n
                if not symbol.any():  # all blocks end here
                    break
                k += symbol >> 4
                if full and c == 0:
                    put = (symbol & 15 > 0) & (k < 64)
                    out[lanes[put], j, b, k[put]] = value[put]
                bad[lanes] |= (k > 63) & (symbol & 15 > 0)
                k = np.where(symbol == 0, 64, k + 1)
                lanes, k = lanes[k < 64], k[k < 64]
    return out.reshape(len(begin), interval * own, -1), bad | (bit > 8 * ends)


def read_all(files: list[bytes]) -> list[tuple[bytes, list[np.ndarray], float, str | None]]:
    """(payload, DC images, frames a second, error) of each file; of one with an error nothing else is told."""
    parsed = []
    for f in files:
        try:
            frames, rate, payload = parse_avi(f)
            for x in frames:
                parse_header(x[: scan_start(x)])
            parsed.append((frames, rate, payload, None))
        except (ValueError, KeyError, IndexError, struct.error) as e:
            parsed.append(([], 0.0, None, str(e) or "a broken frame"))
    images = iter(decode_frames([f for frames, *_ in parsed for f in frames]))
    out = []
    for frames, rate, payload, error in parsed:
        own = [next(images) for _ in frames]
        if error is None and not frames:
            error = "no frames"
        if error is None and any(x is None for x in own):
            error = "a corrupt frame"
        data = b"" if error else b"".join(i.tobytes() for i in own)
        out.append((b"", [], 0.0, error) if error else (data[:payload] if payload is not None else data, own, rate, None))
    return out


def find_shots(images: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first frame, end) of shots: cuts where the histogram differs by far more than it has within the shot so far."""
    if not images:
        return []
    histograms = np.stack([np.bincount(i.reshape(-1) >> 4, minlength=BINS) / i.size for i in images])
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    out, start, total, n = [], 0, 0.0, 0
    for k, c in enumerate(change.tolist(), 1):
        if c > max(SHOT_FLOOR, SHOT_FACTOR * total / n if n else 0.0):
            out.append((start, k))
            start, total, n = k, 0.0, 0
        else:
            total, n = total + c, n + 1
    return [*out, (start, len(images))]


def pad(text: bytes, unit: int = UNIT) -> bytes:
    return text + b" " * (max(unit, -(-len(text) // unit) * unit) - len(text))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text stored as an AVI file."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(store([pad(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(narrow(docs, id_col, text_col), encode, "doc_id long, n_bytes long, media binary", 1 << 20)


def clip_rows(images: list[np.ndarray], rate: float) -> list[tuple[float, float, int, float]]:
    """(start, end in seconds, frames, brightness) of each shot."""
    return [(a / rate, b / rate, b - a, float(np.mean([i.mean() for i in images[a:b]]))) for a, b in find_shots(images)]


def media_features(media: DataFrame) -> DataFrame:
    """Digests of each file and of the payload read back from it, its clips as one string, and its error if it has one."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column(2).to_pylist()
        rows = []
        for file, (payload, images, rate, error) in zip(files, read_all(files), strict=True):
            digest = (len(file), hashlib.sha256(file).hexdigest())
            if error:
                rows.append((None, None, None, *digest, None, error))
                continue
            clips = clip_rows(images, rate)
            mean = sum(n * level for _, _, n, level in clips) / len(images)
            feature = f"frames={len(images)};mean={mean:.3f};shots=" + ",".join(f"{a:.2f}-{b:.2f}" for a, b, _, _ in clips)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *digest, feature, None))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return map_arrow(media.select("doc_id", "n_bytes", "media"), describe, schema, 2 << 20, "frames")


def media_clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, clip, start_s, end_s, frames, brightness, error: a row for each shot, and one with the error of a file that
    cannot be read; files that are null give none."""

    def clips(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, (_, images, rate, error) in zip(batch.column(0).to_pylist(), read_all(batch.column(1).to_pylist()), strict=True):
            rows += [(doc_id, k, *clip, None) for k, clip in enumerate(clip_rows(images, rate))] if error is None else [(doc_id, *[None] * 5, error)]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.string()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "clip", "start_s", "end_s", "frames", "brightness", "error"])

    rows = media.select(media[id_col].alias("doc_id"), media[media_col].alias("media")).where("media is not null")
    return map_arrow(rows, clips, "doc_id long, clip int, start_s double, end_s double, frames int, brightness double, error string", 2 << 20, "frames")
