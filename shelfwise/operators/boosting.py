"""Gradient-boosted trees with a Tweedie loss and a log link, for counts with many zeros, fitted on Spark.

Features are cut once into quantile bins; a missing value has a bin of its own, and every split sends it to the side where
it fits better, so it is never mistaken for a zero. A categorical feature is split between sets of its values, which are
put in the order of their gradients first. One level of a tree is one aggregate: each task sums gradients and hessians by
(group, node, feature, bin), Spark adds these sums up, and the driver, which sees nothing else, picks the splits. So a fit
costs trees x depth jobs, and what reaches the driver does not grow with the rows.

Groups are fits that run side by side in the same jobs (the folds of a backtest, say). Rows marked as held out take no part
in the sums; their deviance ends a group's fit when it has not improved for `patience` trees, and the best count of trees
is kept.

Bounds: groups x 2^depth x features x (bins + 1) sums; a categorical feature has MOST_VALUES values at most, the most
frequent ones, and others count as missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import stored

#: Values of a categorical feature that have bins of their own.
MOST_VALUES = 254
#: Trees whose outputs are added to the stored margins together.
SETTLED = 5
#: Relative error of the quantiles that bound the bins.
QUANTILE_ERROR = 0.001


@dataclass(frozen=True)
class Settings:
    trees: int = 12
    depth: int = 4
    rate: float = 0.4
    power: float = 1.5
    bins: int = 32
    l2: float = 1.0
    least_weight: float = 20.0
    patience: int = 5


@dataclass
class Bins:
    """How raw features become bins: upper bounds of numeric ones, values of categorical ones. The last bin is `missing`."""

    features: list[str]
    edges: dict[str, list[float]]
    values: dict[str, list[str]] = field(default_factory=dict)

    def width(self) -> int:
        return 1 + max(len(self.values[f]) if f in self.values else len(self.edges[f]) + 1 for f in self.features)

    def of(self, columns: dict[str, pd.Series | np.ndarray]) -> np.ndarray:
        """A row of bins for each row of raw features."""
        out = []
        for f in self.features:
            if f in self.values:
                place = {v: i for i, v in enumerate(self.values[f])}
                out.append(np.array([place.get(v, self.width() - 1) for v in columns[f]], np.uint8))
            else:
                x = np.asarray(columns[f], float)
                out.append(np.where(np.isnan(x), self.width() - 1, np.searchsorted(self.edges[f], x, side="left")).astype(np.uint8))
        return np.column_stack(out) if out else np.empty((0, 0), np.uint8)


@dataclass
class Tree:
    """Nodes in order of their number: the children of k are 2k + 1 and 2k + 2. left holds the bins that go left."""

    feature: dict[int, int] = field(default_factory=dict)
    left: dict[int, np.ndarray] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        if not self.feature:
            return at
        size = 2 * max(self.feature) + 3
        feature, left = np.full(size, -1), np.zeros((size, len(next(iter(self.left.values())))), bool)
        for k, f in self.feature.items():
            feature[k], left[k] = f, self.left[k]
        row = np.arange(len(bins))
        for _ in range(int(max(self.feature) + 1).bit_length()):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 2 - left[at, bins[row, f]])
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        at = self.nodes(bins)
        table = np.zeros(max(self.value) + 1)
        table[list(self.value)] = list(self.value.values())
        return table[at]

    def as_dict(self) -> dict:
        return {"feature": {str(k): int(v) for k, v in self.feature.items()}, "left": {str(k): np.flatnonzero(v).tolist() for k, v in self.left.items()}, "value": {str(k): v for k, v in self.value.items()}}

    @classmethod
    def from_dict(cls, x: dict, width: int) -> Tree:
        mask = lambda bins: np.isin(np.arange(width), bins)
        return cls({int(k): v for k, v in x["feature"].items()}, {int(k): mask(v) for k, v in x["left"].items()}, {int(k): v for k, v in x["value"].items()})


def gradients(y: np.ndarray, margin: np.ndarray, power: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the Tweedie loss by the margin, the logarithm of the mean."""
    a, b = y * np.exp((1 - power) * margin), np.exp((2 - power) * margin)
    return b - a, (2 - power) * b - (1 - power) * a


def loss(y: np.ndarray, margin: np.ndarray, power: float) -> np.ndarray:
    """The Tweedie deviance but for what does not depend on the margin."""
    return np.exp((2 - power) * margin) / (2 - power) - y * np.exp((1 - power) * margin) / (1 - power)


def find_bins(train: DataFrame, numeric: list[str], categorical: list[str], bins: int) -> Bins:
    """Quantiles of all numeric features in one pass; categorical values by frequency, ties by name."""
    levels = [k / bins for k in range(1, bins)]
    found = train.select(*[F.col(c).cast("double") for c in numeric]).approxQuantile(numeric, levels, QUANTILE_ERROR) if numeric else []
    values = {}
    for c in categorical:
        most = train.groupBy(F.col(c).cast("string").alias("v")).count().where("v is not null").orderBy(F.desc("count"), "v").limit(MOST_VALUES)
        values[c] = [r.v for r in most.collect()]
    return Bins([*numeric, *categorical], {c: sorted(set(q)) for c, q in zip(numeric, found, strict=True)}, values)


def binned(train: DataFrame, bins: Bins, group: str, target: str, held_out: str, start: dict[int, float]) -> DataFrame:
    """grp, y, held, margin, bins of the rows that have a target."""
    names = bins.features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b[f"x{i}"].to_pandas() for i, c in enumerate(names)}
            grp = b["grp"].to_numpy()
            rows = np.ascontiguousarray(bins.of(columns))
            yield pa.RecordBatch.from_arrays([b["grp"], b["y"], b["held"], pa.array(np.array([start[g] for g in grp.tolist()], float)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(max(1, len(names))), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())], names=["grp", "y", "held", "margin", "bins"])

    raw = [(F.col(c).cast("string") if c in bins.values else F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(names)]
    rows = train.select(F.col(group).cast("int").alias("grp"), F.col(target).cast("double").alias("y"), F.col(held_out).alias("held"), *raw).where("y is not null")
    return rows.mapInArrow(run, "grp int, y double, held boolean, margin double, bins binary")


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, features)


def settled(rows: DataFrame, trees: dict[int, list[Tree]], features: int) -> DataFrame:
    """rows with the outputs of trees added to their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["grp"], b["y"], b["held"], pa.array(_margins(b, trees, features)), b["bins"]], names=b.schema.names)

    return stored(rows.mapInArrow(run, rows.schema), "margins")


def _margins(b: pa.RecordBatch, trees: dict[int, list[Tree]], features: int) -> np.ndarray:
    margin, grp, bins = b["margin"].to_numpy().copy(), b["grp"].to_numpy(), _matrix(b["bins"], features)
    for g, own in trees.items():
        here = np.flatnonzero(grp == g)
        for t in own:
            margin[here] += t.scores(bins[here])
    return margin


#: Of a group's held-out rows, in place of a node: sums of the loss and of the rows.
HELD = -1


def level_sums(rows: DataFrame, done: dict[int, list[Tree]], growing: dict[int, Tree], features: int, width: int, power: float, first: bool) -> pd.DataFrame:
    """grp, node, cell (feature x bin), g, h, n of the open nodes of every group's growing tree."""
    cells = features * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            margin, grp, held, y = _margins(b, done, features), b["grp"].to_numpy(), b["held"].to_numpy(zero_copy_only=False), b["y"].to_numpy()
            bins = _matrix(b["bins"], features)
            for g, tree in growing.items():
                own = grp == g
                if first and (out := np.flatnonzero(own & held)).size:
                    total = sums.setdefault((g, HELD), np.zeros((3, 1)))
                    total += np.array([[loss(y[out], margin[out], power).sum()], [0.0], [len(out)]])
                use = np.flatnonzero(own & ~held)
                at = tree.nodes(bins[use])
                grad, hess = gradients(y[use], margin[use], power)
                for node in np.unique(at):
                    if node in tree.value:
                        continue
                    here = np.flatnonzero(at == node)
                    cell = (bins[use[here]] + np.arange(features) * width).ravel()
                    weights = (np.repeat(grad[here], features), np.repeat(hess[here], features), None)
                    total = sums.setdefault((g, int(node)), np.zeros((3, cells)))
                    total += np.stack([np.bincount(cell, w, cells) for w in weights])
        for (g, node), total in sums.items():
            k = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), g), pa.int32()), pa.array(np.full(len(k), node), pa.int64()), pa.array(k, pa.int64()), *[pa.array(total[i, k]) for i in range(3)]], names=["grp", "node", "cell", "g", "h", "n"])

    found = rows.mapInArrow(run, "grp int, node long, cell long, g double, h double, n double")
    return found.groupBy("grp", "node", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()  # bounded: see the module's text


def best_split(sums: np.ndarray, features: list[str], categorical: set[str], s: Settings) -> tuple[float, int, np.ndarray] | None:
    """(gain, feature, mask of the bins that go left) of the best split of a node; None if none gains. sums: (3, features,
    bins), the last bin of the missing ones. Ties go to the first feature and the first cut."""
    width = sums.shape[2]
    total = sums[:, 0].sum(1)
    score = lambda g, h: g * g / (h + s.l2)
    best = None
    for i, name in enumerate(features):
        g, h, n = sums[:, i, :-1]
        missing = sums[:, i, -1]
        order = np.flatnonzero(n > 0)
        if name in categorical:
            order = order[np.argsort(g[order] / (h[order] + s.l2), kind="stable")]
        left = np.cumsum(np.stack([g, h, n])[:, order], axis=1)
        for side in (True, False) if missing[2] > 0 else (False,):
            a = left + (missing[:, None] if side else 0.0)
            b = total[:, None] - a
            gain = score(a[0], a[1]) + score(b[0], b[1]) - score(total[0], total[1])
            gain[(a[2] < s.least_weight) | (b[2] < s.least_weight)] = -np.inf
            if len(gain) and gain.max() > (best[0] if best else 1e-9) + 1e-12:
                k = int(gain.argmax())
                mask = np.zeros(width, bool)
                if name in categorical:
                    mask[order[: k + 1]] = True
                else:
                    mask[: order[k] + 1] = True
                mask[-1] = side
                best = float(gain[k]), i, mask
    return best


@dataclass
class Model:
    """One group's trees, over bins that all groups share."""

    bins: Bins
    start: float
    trees: list[Tree]
    held_out: list[float]

    def margin(self, columns: dict[str, pd.Series | np.ndarray]) -> np.ndarray:
        rows = self.bins.of(columns)
        return self.start + sum((t.scores(rows) for t in self.trees), np.zeros(len(rows)))

    def predict(self, rows: DataFrame, out: str) -> DataFrame:
        """rows with the mean that the model expects."""
        names, categorical = self.bins.features, self.bins.values

        @F.pandas_udf("double")
        def mean(x: pd.DataFrame) -> pd.Series:
            return pd.Series(np.exp(self.margin({c: x[f"x{i}"] for i, c in enumerate(names)})))

        return rows.withColumn(out, mean(F.struct(*[(F.col(c).cast("string") if c in categorical else F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(names)])))

    def as_dict(self) -> dict:
        return {"features": self.bins.features, "edges": self.bins.edges, "values": self.bins.values, "start": self.start, "trees": [t.as_dict() for t in self.trees], "held_out": self.held_out}

    @classmethod
    def from_dict(cls, x: dict) -> Model:
        bins = Bins(x["features"], x["edges"], x["values"])
        return cls(bins, x["start"], [Tree.from_dict(t, bins.width()) for t in x["trees"]], x["held_out"])


def fit(train: DataFrame, numeric: list[str], categorical: list[str], target: str, group: str, held_out: str, settings: Settings = Settings(), known: DataFrame | None = None) -> dict[int, Model]:
    """A model for each value of the integer column `group`. held_out: boolean, rows that judge and do not teach. known: the
    rows that the bins are found in, where not all rows of `train` may be known to every group."""
    bins = find_bins(train if known is None else known, numeric, categorical, settings.bins)
    y = F.when(~F.col(held_out), F.col(target).cast("double"))
    means = train.groupBy(F.col(group).cast("int").alias("g")).agg(F.avg(y).alias("m")).collect()  # a row for each fit
    start = {r.g: float(np.log(max(r.m or 0.0, 1e-9))) for r in means}
    if not start:
        return {}
    features, width = len(bins.features), bins.width()
    rows = stored(binned(train, bins, group, target, held_out, start), "binned")
    models = {g: Model(bins, m, [], []) for g, m in start.items()}
    pending: dict[int, list[Tree]] = {g: [] for g in models}
    open_fits = set(models)
    for k in range(settings.trees + 1):  # the last round only judges
        growing = {g: Tree() for g in open_fits}
        for level in range(settings.depth):
            sums = level_sums(rows, {g: pending[g] for g in growing}, growing, features, width, settings.power, first=level == 0)
            if level == 0:
                for r in sums[sums.node == HELD].itertuples():
                    models[r.grp].held_out.append(r.g / r.n)
                sums = sums[sums.node != HELD]
                tired = {g for g in growing if (seen := models[g].held_out) and len(seen) - 1 - int(np.argmin(seen)) >= settings.patience}
                open_fits -= tired
                growing = {g: t for g, t in growing.items() if g in open_fits}
                if k == settings.trees or not growing:
                    break
            for (g, node), own in sums.groupby(["grp", "node"]):
                if g not in growing:
                    continue
                table = np.zeros((3, features * width))
                table[:, own.cell.to_numpy()] = own[["g", "h", "n"]].to_numpy().T
                table = table.reshape(3, features, width)
                split, tree = best_split(table, bins.features, set(bins.values), settings), growing[g]
                if split is None:
                    total = table[:, 0].sum(1)
                    tree.value[node] = float(-settings.rate * total[0] / (total[1] + settings.l2))
                    continue
                _, tree.feature[node], tree.left[node] = split
                i, mask = split[1:]
                for child, side in ((2 * node + 1, mask), (2 * node + 2, ~mask)):
                    total = table[:, i, side].sum(1)
                    if level == settings.depth - 1:
                        tree.value[child] = float(-settings.rate * total[0] / (total[1] + settings.l2))
            if not any(set(t.feature) and any(c not in t.feature and c not in t.value for n in t.feature for c in (2 * n + 1, 2 * n + 2)) for t in growing.values()):
                break
        if k == settings.trees or not growing:
            break
        for g, tree in growing.items():
            models[g].trees.append(tree)
            pending[g].append(tree)
        if max(map(len, pending.values())) >= SETTLED:
            rows = settled(rows, pending, features)
            pending = {g: [] for g in models}
    for m in models.values():
        if m.held_out:
            m.trees = m.trees[: int(np.argmin(m.held_out))]
    return models
