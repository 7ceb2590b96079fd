"""Boosted Tweedie trees against a booster that goes over rows one by one, and what the model owes its parts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import boosting
from shelfwise.operators.boosting import Settings


def rows(n=400, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        a, b, s = float(rng.integers(0, 12)), float(rng.normal()), "xyz"[rng.integers(3)]
        mean = np.exp(0.15 * a - 0.5 * (s == "y") + 0.8 * (s == "z"))
        out.append((k % 2, k % 5 == 0, None if k % 7 == 0 else a, None if k % 11 == 0 else b, None if k % 13 == 0 else s, float(rng.poisson(mean)) if k % 17 else None))
    return out


def brute(data, bins, s, held):
    """Trees by plain loops over rows: (raw row) -> margin, and the held-out losses."""
    use = [r for r in data if r[5] is not None]
    codes = lambda r: bins.of({"a": [np.nan if r[2] is None else r[2]], "b": [np.nan if r[3] is None else r[3]], "s": [r[4]]})[0]
    x = [codes(r) for r in use]
    y, out = [r[5] for r in use], [r[1] and held for r in use]
    margin = [np.log(np.mean([v for v, o in zip(y, out) if not o]))] * len(use)
    start, trees, losses, width = margin[0], [], [], bins.width()

    def grad(v, m):
        a, b = v * np.exp((1 - s.power) * m), np.exp((2 - s.power) * m)
        return b - a, (2 - s.power) * b - (1 - s.power) * a

    def grow(own, level):
        g, h = sum(grad(y[i], margin[i])[0] for i in own), sum(grad(y[i], margin[i])[1] for i in own)
        best = None
        for f in range(3 if level < s.depth else 0):
            cells = {}
            for i in own:
                c = cells.setdefault(int(x[i][f]), [0.0, 0.0, 0])
                gi, hi = grad(y[i], margin[i])
                c[0], c[1], c[2] = c[0] + gi, c[1] + hi, c[2] + 1
            lost = cells.pop(width - 1, None)
            order = sorted(cells, key=lambda k: (cells[k][0] / (cells[k][1] + s.l2), k) if f == 2 else k)
            for side in (True, False) if lost else (False,):
                left = np.array(lost if side else [0.0, 0.0, 0.0], float)
                for j, k in enumerate(order):
                    left = left + cells[k]
                    right = np.array([g, h, len(own)]) - left
                    if min(left[2], right[2]) >= s.least_weight:
                        gain = left[0] ** 2 / (left[1] + s.l2) + right[0] ** 2 / (right[1] + s.l2) - g * g / (h + s.l2)
                        if gain > (best[0] if best else 1e-9) + 1e-9:
                            below = set(order[: j + 1]) if f == 2 else set(range(k + 1))
                            best = gain, f, below | ({width - 1} if side else set())
        if best is None:
            return -s.rate * g / (h + s.l2)
        _, f, go = best
        return f, go, grow([i for i in own if x[i][f] in go], level + 1), grow([i for i in own if x[i][f] not in go], level + 1)

    def read(tree, c):
        while isinstance(tree, tuple):
            tree = tree[2] if c[tree[0]] in tree[1] else tree[3]
        return tree

    for k in range(s.trees + 1):
        if any(out):
            losses.append(np.mean([boosting.loss(np.array([v]), np.array([m]), s.power)[0] for v, m, o in zip(y, margin, out) if o]))
        if k < s.trees:
            trees.append(grow([i for i, o in enumerate(out) if not o], 0))
            margin = [m + read(trees[-1], c) for m, c in zip(margin, x)]
    if losses:
        trees = trees[: int(np.argmin(losses))]
    return lambda r: start + sum(read(t, codes(r)) for t in trees), losses


@pytest.mark.parametrize("held", [False, True])
def test_equals_plain_loops(spark, held):
    data, s = rows(), Settings(trees=4, depth=3, rate=0.4, bins=8, least_weight=5, patience=9)
    df = spark.createDataFrame([(*r[:1], r[1] and held, *r[2:]) for r in data], "g int, held boolean, a double, b double, s string, y double").repartition(3)
    models = boosting.fit(df, ["a", "b"], ["s"], "y", "g", "held", s)
    assert set(models) == {0, 1}
    for g, model in models.items():
        want, losses = brute([r for r in data if r[0] == g], model.bins, s, held)
        assert model.held_out == pytest.approx(losses)
        kept = boosting.Model.from_dict(json.loads(json.dumps(model.as_dict())))
        for m in (model, kept):
            got = m.predict(df.where(F.col("g") == g), "p").collect()
            assert got and [r.p for r in got] == pytest.approx([np.exp(want((r.g, False, r.a, r.b, r.s, r.y))) for r in got])


def test_missing_is_not_zero_and_categories_split_as_sets(spark):
    data = [(0, False, None if k % 2 else 0.0, "pqrs"[k % 4], 9.0 if k % 2 else (1.0 if k % 4 else 4.0)) for k in range(400)]
    df = spark.createDataFrame(data, "g int, held boolean, a double, s string, y double")
    model = boosting.fit(df, ["a"], ["s"], "y", "g", "held", Settings(trees=25, depth=2, rate=0.5, least_weight=1))[0]
    got = {(r.a, r.s): r.p for r in model.predict(df, "p").collect()}
    assert all(got[k] == pytest.approx(v, rel=0.02) for k, v in {(None, "q"): 9, (None, "s"): 9, (0.0, "p"): 4, (0.0, "r"): 1}.items())
    unknown = spark.createDataFrame([(float("nan"), "new")], "a double, s string")
    assert model.predict(unknown, "p").first().p > 0
    assert boosting.fit(df.limit(0), ["a"], ["s"], "y", "g", "held") == {}
