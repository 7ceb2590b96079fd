"""Best-fit packing: a configuration linear program over the length histogram, by multiplicative weights.

Documents become pieces of at most `capacity` tokens. The histogram of piece lengths (capacity + 1 numbers at most,
whatever the corpus) goes to the driver. There the configuration program - least number of sequences so that every
length is covered - is solved in four steps:

1. Fractional weights (`fractional`). A length's price starts as the length itself, which is the best price where sequences
   can be filled, and falls by a factor for each share of the length that is covered. In each round one knapsack dynamic
   program prices all fillings, each length still open gets its configuration of most worth, and all of these are taken
   together, as far as no length is covered by more than STEP of its need. What is left at last (LEFT of the tokens at
   most, or after ROUNDS rounds) counts as sequences of one length. The prices, divided by the most worth of any
   configuration, are feasible for the dual, so they bound the number of sequences from below.
2. Rounding (`rounded`). Running sums of the weights are rounded, so a configuration gets a whole number within one unit of
   its weight and all together keep their number; a unit is many sequences where counts are large, so that the plan stays
   in proportion to the number of lengths.
3. What rounding leaves (`solve`): the same prices and dynamic program with steps of whole sequences.
4. Configurations with more free room than a bound are taken back (of a few bounds the best one is used). They and lengths
   under capacity / SMALL, set aside as is usual for this program, go best-fit, longest first, bins counted by their room.

The plan is a list of (configuration, copies); places in it are arithmetic: the r-th piece of a length belongs to one
run of the plan. Ranks come from one range sort by (length, id, piece), so a length shared by a third of all pieces is
spread over as many tasks as its rows need, and no sequence is ever gathered in one place.

Defined results: a null text is the empty one (a single piece, the end id alone); rows that repeat an id are pieces
each of their own; a null doc_id sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, narrow, staged
from .words import REMEMBERED, word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rate at which covered lengths lose weight, and the share of a length that one whole step covers.
RATE, SHARE = 0.1, 0.25
#: Of the fractional weights: most of a length that one round covers, share of tokens where they end, most rounds, and units
#: of rounding for each length.
STEP, LEFT, ROUNDS, UNITS = 0.5, 0.05, 300, 8
#: Share of a length under which it no longer takes part in the fractional weights.
COVERED = 0.02
#: Configurations taken under the same weights; lengths under capacity / SMALL are left for best fit to fill gaps with.
TOGETHER, SMALL = 32, 32


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut every `capacity` ids."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, end = [], np.uint32(end_id).tobytes()
        for doc_id, raw in zip(batch.column(0).to_pylist(), word_ids(tokenizer, remembered).encode(batch.column(1).to_pylist()), strict=True):
            raw += end
            for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(narrow(docs, id_col, text_col), cut, PIECES, 1 << 20, uses="words")


def price(worth: np.ndarray, half: int) -> np.ndarray:
    """The most worth that fits into each room up to half a sequence: an unbounded knapsack by dynamic programming."""
    best = np.zeros(half + 1)
    for room in range(1, half + 1):
        best[room] = max(best[room - 1], (best[room - 1 :: -1] + worth[1 : room + 1]).max())
    return best


def trace(best: np.ndarray, worth: np.ndarray, room: int) -> Counter:
    """Lengths that make best[room], the longest first where several do."""
    out: Counter = Counter()
    while room > 0:
        if best[room] <= best[room - 1]:
            room -= 1
        else:
            length = int(np.flatnonzero(best[room - 1 :: -1] + worth[1 : room + 1] >= best[room] * (1 - 1e-12))[-1]) + 1
            out[length] += 1
            room -= length
    return out


def knapsack(worth: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to `top` the most worth that fits, and the length to take there (0: the room is no better than one less)."""
    best, taken = np.zeros(top + 1), np.zeros(top + 1, np.int64)
    for room in range(1, top + 1):
        with_it = best[:room] + worth[room:0:-1]  # the longest first
        at = int(with_it.argmax())
        best[room], taken[room] = (with_it[at], room - at) if with_it[at] > best[room - 1] else (best[room - 1], 0)
    return best, taken


class Fractional:
    """Weights of configurations (rows of lengths, 0 behind them) that cover a histogram, their sum with that of what is left,
    and a lower bound on any solution, whole or not."""

    def __init__(self, rows: list[np.ndarray], weights: np.ndarray, value: float, bound: float):
        self.rows, self.weights, self.value, self.bound = rows, weights, value, bound


def fractional(histogram: dict[int, int], capacity: int, rate: float = RATE, step: float = STEP, left: float = LEFT) -> Fractional:
    """Multiplicative weights over the lengths of a histogram that is not empty; no length is covered beyond its need."""
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[x] for x in lengths.tolist()], float)
    number = np.zeros(capacity + 1, np.int64)
    number[lengths] = np.arange(len(lengths))
    rest, top, tokens = need.copy(), capacity - int(lengths[0]), float((lengths * need).sum())
    rows, weights, bound = [], [], 0.0
    for _ in range(ROUNDS):
        live = np.flatnonzero(rest > COVERED * need)
        if not len(live) or (lengths * rest).sum() <= left * tokens:
            break
        worth = np.full(capacity + 1, -np.inf)
        worth[lengths[live]] = lengths[live] * np.exp(-rate * (1 - rest[live] / need[live]))
        best, taken = knapsack(worth, top)
        if len(live) == len(lengths):  # prices of all lengths, so a solution of the dual
            prices = worth[lengths]
            bound = max(bound, float((need * prices).sum() / (prices + best[capacity - lengths]).max()))
        useful = np.maximum.accumulate(np.where(taken > 0, np.arange(top + 1), 0))
        columns, room = [lengths[live]], useful[capacity - lengths[live]]
        while (got := taken[room]).any():
            columns.append(got)
            room = useful[room - got]
        configs = np.stack(columns, 1)
        real, at = configs > 0, number[configs]
        uses = np.maximum(np.bincount(at[real], minlength=len(lengths)), 1)
        weight = np.where(real, (np.minimum(step * need, rest) / uses)[at], np.inf).min(1)
        rest = np.maximum(rest - np.bincount(at[real], np.broadcast_to(weight[:, None], at.shape)[real], len(lengths)), 0)
        rows.extend(configs)
        weights.append(weight)
    weights = np.concatenate(weights) if weights else np.zeros(0)
    return Fractional(rows, weights, float(weights.sum() + (rest / (capacity // lengths)).sum()), max(bound, tokens / capacity))


def rounded(found: Fractional, histogram: dict[int, int]) -> tuple[Counter, Counter]:
    """(whole numbers of configurations, what they leave of the histogram)."""
    unit = max(1, int(found.weights.sum() // (UNITS * len(histogram))))
    copies = np.diff(np.floor(np.cumsum(found.weights) / unit + 0.5), prepend=0).astype(np.int64) * unit
    used, rest = Counter(), Counter(histogram)
    for k in np.flatnonzero(copies).tolist():
        config = Counter(found.rows[k][found.rows[k] > 0].tolist())
        if whole := min(int(copies[k]), *(rest[length] // n for length, n in config.items())):
            used[tuple(sorted(config.items()))] += whole
            rest.subtract({length: n * whole for length, n in config.items()})
    return used, +rest


def solve(histogram: dict[int, int], capacity: int, rate: float = RATE, share: float = SHARE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations and whole numbers of sequences: prices as in `fractional`, partners in two parts of half a sequence, each
    of the TOGETHER least covered lengths in a step, until all are covered or no configuration found is still whole. A step covers `share` of a length of its configuration (or is one sequence), so the number of steps is a few
    times the number of lengths, whatever their counts."""
    need, half, out = np.zeros(capacity + 1), capacity // 2, []
    for length, n in histogram.items():
        need[length] = n
    rest = need.astype(np.int64)
    moved = True
    while moved and (live := np.flatnonzero(rest)).size:
        moved, covered = False, 1 - rest[live] / need[live]
        worth = np.full(capacity + 1, -np.inf)
        worth[live] = live * np.exp(-rate * covered)
        best = price(worth, half)
        for length in live[np.lexsort((-live, covered))][:TOGETHER].tolist():
            room = capacity - length
            a = np.arange(max(0, room - half), room // 2 + 1)
            first = int(a[np.argmax(best[a] + best[room - a])]) if room > half else 0  # partners in two parts, each of half a sequence at most
            config = Counter({length: 1}) + trace(best, worth, first) + trace(best, worth, room - first)
            at, times = np.array(list(config)), np.array(list(config.values()))
            if most := int((rest[at] // times).min()):
                copies = min(most, max(1, int((need[at] / times).min() * share)))
                rest[at] -= copies * times
                out.append((tuple(sorted(config.items())), copies))
                moved = True
    return out


def best_fit(rest: Counter, capacity: int) -> Counter:
    """Configurations for the rest: longest first, each into the fullest bins that take it; bins alike are counted."""
    bins: dict[int, Counter] = defaultdict(Counter)  # free room: configuration -> copies
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                each = capacity // length
                if whole := n // each:
                    bins[capacity - each * length][((length, each),)] += whole
                if part := n % each:
                    bins[capacity - part * length][((length, part),)] += 1
                break
            config, copies = next(iter(bins[room].items()))
            each = min(room // length, n)
            taken = min(copies, n // each)
            if taken == copies:
                del bins[room][config]
                if not bins[room]:
                    del bins[room]
            else:
                bins[room][config] -= taken
            bins[room - each * length][(*config, (length, each))] += taken
            n -= taken * each
    out: Counter = Counter()
    for configs in bins.values():
        for config, copies in configs.items():
            merged: Counter = Counter()
            for length, times in config:
                merged[length] += times
            out[tuple(sorted(merged.items()))] += copies
    return out


def program(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], Counter]:
    """(configurations of the program, what is left to best fit): of the bounds on a configuration's free room the one with
    which fewest sequences are used, the widest if several do."""
    large = {k: v for k, v in histogram.items() if k >= capacity // SMALL}
    if not large:
        return [], Counter(histogram)
    whole, over = rounded(fractional(large, capacity), large)
    solved, tried = [*sorted(whole.items()), *solve(dict(over), capacity)], []
    for room in sorted({capacity, *(capacity // n for n in (64, 256, 1024)), 0}, reverse=True):
        used = [(config, copies) for config, copies in solved if capacity - sum(length * n for length, n in config) <= room]
        rest = Counter(histogram)
        for config, copies in used:
            rest.subtract({length: n * copies for length, n in config})
        rest = +rest
        tried.append((sum(n for _, n in used) + sum(best_fit(rest, capacity).values()), used, rest))
    return min(tried, key=lambda t: t[0])[1:]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(configuration, copies): together they hold each length exactly as often as the histogram says."""
    short = {k: v for k, v in histogram.items() if v and k < capacity}
    full = [(((capacity, 1),), histogram[capacity])] if histogram.get(capacity) else []
    if not short:
        return full
    used, rest = program(short, capacity)
    out = used + sorted(best_fit(rest, capacity).items())
    plain = sorted(best_fit(Counter(short), capacity).items())
    return full + (plain if sum(n for _, n in plain) < sum(n for _, n in out) else out)


def runs(configs: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """A row for each length of each configuration: length, first rank, pieces in a sequence, first sequence, offset."""
    seen, out, sequence = Counter(), [], 0
    for config, copies in configs:
        offset = 0
        for length, times in config:
            out.append((length, seen[length], times, sequence, offset))
            seen[length] += times * copies
            offset += length * times
        sequence += copies
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset; `pieces` as cut_pieces gives them."""
    ordered = pieces.repartitionByRange("length", "doc_id", "piece", "ids_crc32").sortWithinPartitions("length", "doc_id", "piece", "ids_crc32")
    ordered = staged(ordered.withColumn("at", F.monotonically_increasing_id()), "packing-order")
    counts = {(r[0], r[1]): r[2] for r in ordered.groupBy(F.shiftright("at", 33).alias("part"), "length").count().collect()}  # parts x 2, and a row for each length
    histogram = Counter()
    for (_, length), n in counts.items():
        histogram[length] += n
    parts = sorted({part for part, _ in counts})
    size = Counter()
    for (part, _), n in counts.items():
        size[part] += n
    base = dict(zip(parts, np.cumsum([0, *[size[p] for p in parts]]).tolist(), strict=False))
    lengths = sorted(histogram)
    first = dict(zip(lengths, np.cumsum([0, *[histogram[x] for x in lengths]]).tolist(), strict=False))
    table = runs(plan(dict(histogram), capacity))
    low = np.array(sorted(histogram), np.int64)
    span = int(max(histogram.values(), default=0)) + 1

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, at = batch.column(3).to_numpy(), batch.column(5).to_numpy()
        part = at >> 33
        rank = np.array([base[int(p)] for p in np.unique(part)])[np.unique(part, return_inverse=True)[1]] + (at & ((1 << 33) - 1)) - np.array([first[int(x)] for x in np.unique(length)])[np.unique(length, return_inverse=True)[1]]
        kind = np.searchsorted(low, length)
        flat = np.searchsorted(low, table[:, 0]) * span + table[:, 1]  # ascending: runs are sorted by length, then rank
        run = table[np.searchsorted(flat, kind * span + rank, "right") - 1]
        inside = rank - run[:, 1]
        sequence, offset = run[:, 3] + inside // run[:, 2], run[:, 4] + inside % run[:, 2] * length
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(ordered, place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """Every piece of every document with its place; the pieces are written once and ranked from there."""
    return pack(staged(cut_pieces(docs, tokenizer, capacity, end_id, remembered=remembered), "packing-pieces"), capacity)
