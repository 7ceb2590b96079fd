"""Properties and hand-worked values of the operators."""

import math
import re
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions.semantics import CardinalityError, join_to_one
from shelfwise.operators import backtest, features, profile, quality, ranking, replenishment, stats

D0 = date(2020, 1, 1)


def sales(spark, series, extra=""):
    rows = [(s, i, D0 + timedelta(days=k), y) for (s, i), ys in series.items() for k, y in enumerate(ys)]
    return spark.createDataFrame(rows, "store_id string, item_id string, date date, sales int")


@pytest.fixture(scope="module")
def facts(spark):
    rng = np.random.default_rng(1)
    return sales(spark, {(f"S{s}", f"I{i}"): (rng.integers(0, 9, 120) * (rng.random(120) < 0.4)).tolist() for s in range(2) for i in range(3)})


def test_join_to_one(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert join_to_one(left, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"]).count() == 2
    with pytest.raises(CardinalityError):
        join_to_one(left, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"])
    with pytest.raises(CardinalityError):
        join_to_one(left, spark.createDataFrame([(1, "a")], "k int, v string"), ["k"], complete=True)


def test_segments(spark):
    df = sales(spark, {("S", "smooth"): [5, 6] * 5, ("S", "erratic"): [1, 30] * 5, ("S", "rare"): [5, 0, 0, 0, 0] * 2, ("S", "lumpy"): [1, 0, 0, 0, 0, 60, 0, 0, 0, 0], ("S", "once"): [0, 3] + [0] * 8, ("S", "never"): [0] * 10})
    assert {r.item_id: r.segment for r in profile.segments(df).collect()} == {"smooth": "smooth", "erratic": "erratic", "rare": "intermittent", "lumpy": "lumpy", "once": "unknown", "never": "unknown"}


def test_gini(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), ("b", 10), ("c", 0)], "g string, x int")
    assert {r.g: r.gini for r in profile.gini(df, F.col("x"), ["g"]).collect()} == {"a": 0.0, "b": 0.5, "c": None}
    with pytest.raises(ValueError):
        profile.gini(df.withColumn("x", F.col("x") - 5), F.col("x"))


def test_features_ignore_what_follows_the_cutoff(spark, facts):
    cutoff = D0 + timedelta(days=80)
    changed = facts.withColumn("sales", F.when(F.col("date") > F.lit(cutoff), 9999).otherwise(F.col("sales")))
    calendar = spark.range(200).select(F.date_add(F.lit(D0), F.col("id").cast("int")).alias("date")).select(
        "date", (F.dayofweek("date") % 7 + 1).alias("wday"), F.month("date").alias("month"), F.year("date").alias("year"), F.lit(None).cast("string").alias("event_name_1"), *[F.lit(1).alias(f"snap_{s}") for s in ("CA", "TX", "WI")]
    )
    stores = spark.createDataFrame([("S0", "CA"), ("S1", "TX")], "store_id string, state_id string")
    for a, b in zip(features.build_fold_features(facts, calendar, stores, cutoff, 14), features.build_fold_features(changed, calendar, stores, cutoff, 14)):
        assert sorted(map(tuple, a.df.collect()), key=repr) == sorted(map(tuple, b.df.collect()), key=repr)
    assert a.df.count() == 6 * 14 and a.df.where("y is not null").isEmpty() and not set(a.historical_cols) & set(a.known_future_cols)


def test_rolling_warm_up(spark):
    df = sales(spark, {("S", "I"): [0, 0, 3, 4]})
    got = [r.rolling_zero_rate_7 for r in features.make_rolling_features(df, D0 + timedelta(days=9)).orderBy("date").collect()]
    assert got == [None, 0.5, pytest.approx(2 / 3), 0.5]


def test_folds():
    folds = backtest.generate_folds(D0, D0 + timedelta(days=999), backtest.Scheme(28, 5, 28, 900))
    assert [f.fold_id for f in folds] == [1, 2, 3] and folds[-1].forecast_end == D0 + timedelta(days=999)
    assert all((f.forecast_end - f.train_end).days == 28 and f.train_end < f.forecast_start for f in folds)
    assert all(a.forecast_end < b.forecast_start for a, b in zip(folds, folds[1:]))
    assert backtest.generate_folds(D0, D0 + timedelta(days=100)) == []


def test_methods_match_their_recursions(spark, facts):
    folds = backtest.generate_folds(D0, D0 + timedelta(days=119), backtest.Scheme(14, 2, 14, 60))
    got = {(r.fold_id, r.store_id, r.item_id, r.horizon_day): r for r in backtest.run_backtest(facts, backtest.folds_frame(spark, folds)).collect()}
    ys = {}
    for r in facts.orderBy("date").collect():
        ys.setdefault((r.store_id, r.item_id), []).append(r.sales)
    for f in folds:
        n = (f.train_end - D0).days + 1
        for (s, i), all_y in ys.items():
            y, r = all_y[:n], got[(f.fold_id, s, i, 1)]
            level = np.mean(y[:10])
            for v in y:
                level = 0.1 * v + 0.9 * level
            hits = [k for k, v in enumerate(y) if v > 0]
            z, p, last = y[hits[0]], hits[0] + 1, hits[0]
            for k in hits[1:]:
                z, p, last = 0.1 * y[k] + 0.9 * z, 0.1 * (k - last) + 0.9 * p, k
            tz, tp = np.mean([v for v in y if v > 0]), len(hits) / n
            for v in y:
                tp = 0.1 * (v > 0) + 0.9 * tp
                tz = 0.1 * v + 0.9 * tz if v > 0 else tz
            want = {"naive": y[-1], "ma7": np.mean(y[-7:]), "ma28": np.mean(y[-28:]), "zero": 0, "ses": level, "croston": z / p, "sba": z / p * 0.95, "tsb": tz * tp, "seasonal_naive": y[-7]}
            assert {k: r[k] for k in want} == pytest.approx(want)
            assert got[(f.fold_id, s, i, 8)].seasonal_naive is None and r.actual == all_y[n]


def test_sba_smooths_intervals_by_beta(spark, facts):
    folds = backtest.generate_folds(D0, D0 + timedelta(days=119), backtest.Scheme(14, 1, 14, 60))
    got = {(r.store_id, r.item_id): (r.croston, r.sba) for r in backtest.run_backtest(facts, backtest.folds_frame(spark, folds), beta=0.3).collect()}
    ys = {}
    for r in facts.where(F.col("date") <= folds[0].train_end).orderBy("date").collect():
        ys.setdefault((r.store_id, r.item_id), []).append(r.sales)
    for key, y in ys.items():
        hits = [k for k, v in enumerate(y) if v > 0]
        z, p, q, last = y[hits[0]], hits[0] + 1, hits[0] + 1, hits[0]
        for k in hits[1:]:
            z, p, q, last = 0.1 * y[k] + 0.9 * z, 0.1 * (k - last) + 0.9 * p, 0.3 * (k - last) + 0.7 * q, k
        assert got[key] == pytest.approx((z / p, z / q * 0.85))


def test_backtest_reads_the_facts_once(spark, facts):
    folds = backtest.folds_frame(spark, backtest.generate_folds(D0, D0 + timedelta(days=119), backtest.Scheme(14, 3, 14, 60)))
    plan = backtest.run_backtest(facts, folds)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan ExistingRDD") + plan.count("FileScan") == 1 and "Join" not in plan


def test_backtest_with_gaps_late_starts_and_overlapping_folds(spark):
    """Against plain Python: series that miss days, begin late or never sell, folds whose windows overlap."""
    rng = np.random.default_rng(5)
    rows = [("s", i, D0 + timedelta(days=d), int(rng.integers(0, 4)) * int(i != "none")) for i, first in (("a", 0), ("b", 70), ("none", 3), ("late", 95)) for d in range(first, 120) if i != "b" or d % 3]
    df = spark.createDataFrame(rows, "store_id string, item_id string, date date, sales int").repartition(3)
    folds = backtest.generate_folds(D0, D0 + timedelta(days=119), backtest.Scheme(14, 4, 7, 60))
    got = {(r.fold_id, r.item_id, r.date): r for r in backtest.run_backtest(df, backtest.folds_frame(spark, folds)).collect()}
    cold = {(r.fold_id, r.item_id) for r in backtest.cold_series(df, backtest.folds_frame(spark, folds)).collect()}
    seen = set()
    for f in folds:
        for item in ("a", "b", "none", "late"):
            past = [(d, y) for _, i, d, y in rows if i == item and d <= f.train_end]
            for _, i, d, y in rows:
                if i == item and f.forecast_start <= d <= f.forecast_end:
                    r = got[f.fold_id, item, d]
                    seen.add((f.fold_id, item, d))
                    assert r.actual == y and r.horizon_day == (d - f.train_end).days and r.zero == 0
                    assert r.seasonal_naive == dict(past).get(d - timedelta(days=7))
                    if not past:
                        assert (f.fold_id, item) in cold and [r.naive, r.ma7, r.ses, r.tsb, r.croston] == [None] * 5
                        continue
                    ys = [v for _, v in past]
                    level = np.mean(ys[:10])
                    for v in ys:
                        level = 0.1 * v + 0.9 * level
                    assert (r.naive, r.ma7, r.ma28, r.ses) == pytest.approx((ys[-1], np.mean(ys[-7:]), np.mean(ys[-28:]), level))
                    assert (r.croston == 0) == (not any(ys))
    assert seen == set(got) and any(i == "late" for _, i in cold)


def test_poisson_bootstrap_covers_and_needs_no_python(spark):
    rng = np.random.default_rng(0)
    rows = [(g, k, float(x)) for g in range(60) for k, x in enumerate(rng.exponential(3.0, 80))] + [(0, 999, None)]
    df = spark.createDataFrame(rows, "g int, k int, x double")
    found = stats.poisson_bootstrap(df, ["g"], "x", ["g", "k"], n_boot=300)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
    got = {r.g: r for r in found.collect()}
    assert len(got) == 60 and all(r.n == 80 and r.low < r.estimate < r.high for r in got.values())
    assert sum(r.low <= 3.0 <= r.high for r in got.values()) >= 50  # 57 are expected
    widths = [r.high - r.low for r in got.values()]
    assert np.mean(widths) == pytest.approx(2 * 1.96 * 3.0 / 80**0.5, rel=0.15)
    again = {r.g: r for r in stats.poisson_bootstrap(df.repartition(7), ["g"], "x", ["g", "k"], n_boot=300).collect()}
    assert all(tuple(again[g]) == pytest.approx(tuple(got[g])) for g in got)


def test_hashed_permutations(spark):
    rng = np.random.default_rng(1)
    rows = [(f"null{t}", int(k % 3 == 0), k, float(x)) for t in range(40) for k, x in enumerate(rng.normal(size=60))] + [("shift", k % 2, k, float(x + (k % 2))) for k, x in enumerate(rng.normal(size=200))]
    rows += [("one side", 1, k, 1.0) for k in range(5)] + [("null0", None, 99, 1.0)]
    got = {r.test: r for r in stats.hashed_permutations(spark.createDataFrame(rows, "test string, grp int, k int, x double"), "test", "grp", "x", ["k"], n_perm=199).collect()}
    assert got["shift"].p_permutation == 1 / 200 and got["one side"].p_permutation is None
    p = np.sort([r.p_permutation for t, r in got.items() if t.startswith("null")])
    assert (p <= 0.1).mean() <= 0.25 and 0.35 <= p.mean() <= 0.65 and (got["null0"].n_x, got["null0"].n_y) == (20, 40)


def test_best_methods(spark):
    rows = [(f, h, 10.0, 10.0 + f, 10.0 + h, 10.0, 15.0) for f in (1, 2) for h in (1, 2)]
    df = spark.createDataFrame(rows, "fold_id int, horizon_day int, actual double, a double, b double, c double, d double")
    got = backtest.best_methods(df, ["a", "b", "c", "d"]).orderBy("horizon_day").collect()
    assert [tuple(r) for r in got] == [(h, "c", 0.0, "a", 1.5, "b", float(h)) for h in (1, 2)]


def test_cold_series(spark):
    df = sales(spark, {("S", "old"): [1] * 100}).unionAll(spark.createDataFrame([("S", "new", D0 + timedelta(days=95), 3)], "store_id string, item_id string, date date, sales int"))
    folds = backtest.folds_frame(spark, backtest.generate_folds(D0, D0 + timedelta(days=99), backtest.Scheme(10, 1, 10, 50)))
    assert [tuple(r) for r in backtest.cold_series(df, folds).collect()] == [(1, "S", "new")]


def test_metrics(spark):
    df = spark.createDataFrame([(2.0, 3.0), (0.0, 0.0), (0.0, 2.0), (4.0, 3.0), (5.0, None), (None, 1.0), (1.0, float("nan"))], "actual double, forecast double")
    got = df.agg(*[c.alias(k) for k, c in backtest.metric_columns().items()]).first().asDict()
    assert got == pytest.approx({"n_obs": 4, "n_nonzero_actual": 4, "mae": 1.0, "wape": 4 / 6, "rmse": math.sqrt(1.5), "bias": 0.5, "smape": (0.4 + 0 + 2 + 2 / 7) / 4, "mape": (0.5 + 0.25) / 2})
    zero = spark.createDataFrame([(0.0, 1.0)], "actual double, forecast double").agg(*[c.alias(k) for k, c in backtest.metric_columns().items()]).first()
    assert zero.wape is None and zero.mape is None and zero.smape == 2


def test_rank_tests(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 9, 40), rng.integers(2, 12, 50)
    df = spark.createDataFrame([("t", 1, float(v)) for v in x] + [("t", 0, float(v)) for v in y] + [("t", 0, None)], "test string, g int, x double")
    r = stats.mann_whitney(df, "test", "g", "x").first()
    delta = np.mean([np.sign(a - b) for a in x for b in y])
    assert r.delta == pytest.approx(delta) and r.u == pytest.approx((delta + 1) / 2 * 2000) and 0 < r.p_value < 0.01
    h = stats.kruskal(df, "test", "g", "x").first()
    mu, n = 1000, 90
    ties = sum(c**3 - c for c in np.unique(np.concatenate([x, y]), return_counts=True)[1])
    assert h.h == pytest.approx((r.u - mu) ** 2 / (2000 / 12 * (n + 1 - ties / (n * (n - 1)))))
    assert h.p_value == pytest.approx(math.erfc(math.sqrt(h.h / 2)), abs=2e-7)
    cases = [(0.0, 1), (6.0, 2), (3.84, 1), (7.0, 4), (9.5, 4), (11.07, 5), (2.0, 3), (60.0, 7)]
    tails = [r.p for r in spark.createDataFrame([(k, x, d) for k, (x, d) in enumerate(cases)], "k int, x double, d int").orderBy("k").select(stats.chi_square_tail(F.col("x"), F.col("d")).alias("p")).collect()]
    rest = lambda x, d: 1.0 if x <= 0 else (math.erfc(math.sqrt(x / 2)) if d == 1 else math.exp(-x / 2)) if d <= 2 else rest(x, d - 2) + (x / 2) ** (d / 2 - 1) * math.exp(-x / 2) / math.gamma(d / 2)
    assert tails == pytest.approx([rest(x, d) for x, d in cases], abs=2e-7)
    tail = spark.createDataFrame([(z,) for z in (0.0, 0.5, 1.96, 4.0)], "z double").select("z", stats.normal_tail(F.col("z")).alias("p")).collect()
    assert all(abs(t.p - math.erfc(t.z / math.sqrt(2))) < 2e-7 for t in tail)


def test_small_samples_without_ties_are_exact(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for t, (m, n) in enumerate([(2, 3), (4, 5), (8, 3), (5, 12)]):
        values = rng.permutation(40)[: m + n].astype(float)
        rows += [(str(t), int(k < m), float(v)) for k, v in enumerate(values)]
        u = lambda a, b: sum(x > y for x in a for y in b)
        seen = u(values[:m], values[m:])
        all_ = [u([values[i] for i in c], [values[i] for i in range(m + n) if i not in c]) for c in combinations(range(m + n), m)]
        want[str(t)] = min(1.0, 2 * sum(x >= max(seen, m * n - seen) for x in all_) / len(all_))
    rows += [("tie", g, v) for g, v in ((1, 1.0), (1, 2.0), (0, 2.0), (0, 3.0))] + [("one", 1, 1.0), ("one", 0, 2.0), ("one", 0, 3.0), ("none", 0, 3.0)]
    got = {r.test: r for r in stats.mann_whitney(spark.createDataFrame(rows, "test string, g int, x double"), "test", "g", "x").collect()}
    assert {t: got[t].p_value for t in want} == pytest.approx(want)
    assert 0.1 < got["tie"].p_value < 1 and (got["one"].n_x, got["one"].n_y, got["one"].u, got["one"].p_value) == (1, 2, None, None) and got["none"].n_x == 0


def test_kruskal_leaves_small_groups_out(spark):
    rows = [("t", g, float(v)) for g, vs in (("a", (1, 2, 3)), ("b", (4, 5, 6)), ("c", (9,))) for v in vs] + [("alone", "a", 1.0), ("alone", "a", 2.0), ("same", "a", 1.0), ("same", "a", 1.0), ("same", "b", 1.0), ("same", "b", 1.0)]
    got = {r.test: r for r in stats.kruskal(spark.createDataFrame(rows, "test string, g string, x double"), "test", "g", "x").collect()}
    assert (got["t"].k, got["t"].n, got["t"].h) == (2, 6, pytest.approx(3.857142857)) and got["t"].p_value == pytest.approx(0.0495346, abs=1e-6)
    assert got["alone"].h is None and got["alone"].p_value is None and got["same"].h is None


def test_permutations_and_resamples(monkeypatch):
    a, b = np.array([5.0, 6.0, 7.0]), np.array([1.0, 2.0, 3.0, 4.0])
    everything = [abs(np.mean([x for k, x in enumerate(np.concatenate([a, b])) if k in c]) - np.mean([x for k, x in enumerate(np.concatenate([a, b])) if k not in c])) for c in combinations(range(7), 3)]
    share = np.mean(np.array(everything) >= abs(a.mean() - b.mean()) - 1e-12)
    assert stats.permuted_share(a, b, np.random.default_rng(1), 20_000) == pytest.approx(share, abs=0.005)
    values = np.arange(50.0)
    seen = []

    def kept(samples, axis):
        seen.append(samples)
        return samples.mean(axis=axis)

    monkeypatch.setattr(stats, "DRAWN", 700)
    boot = stats._resampled(values, np.random.default_rng(2), 40, 4, kept)
    assert boot.shape == (40,) and max(len(s) for s in seen) <= 14 and all(s.shape[1] == 50 for s in seen)
    assert all((np.diff(row)[[i for i in range(49) if i % 4 != 3]] == 1).all() for s in seen for row in s)  # blocks of four neighbours


def test_places_without_one_window(spark):
    rng = np.random.default_rng(5)
    rows = [(int(v), int(k)) for k, v in enumerate(np.where(rng.random(300) < 0.4, 7, rng.integers(0, 50, 300)))]
    df = spark.createDataFrame(rows, "x long, k long").repartition(5)
    got = {r.k: r for r in ranking.in_order(df, [F.desc("x"), F.col("k")], "x").withColumn("q", ranking.quantile_group(7)).collect()}
    running, n = 0, len(rows)
    sizes = [n // 7 + (g < n % 7) for g in range(7)]
    group = [g + 1 for g, size in enumerate(sizes) for _ in range(size)]
    for place, (x, k) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
        running += x
        assert (got[k].place, got[k].running, got[k].n_rows, got[k].grand, got[k].q) == (place, running, n, sum(r[0] for r in rows), group[place - 1])
    ranks = {r.x: r["rank"] for r in ranking.mid_ranks(df, "x").collect()}
    xs = sorted(x for x, _ in rows)
    assert ranks == {x: np.mean([i + 1 for i, y in enumerate(xs) if y == x]) for x in set(xs)}
    y = df.withColumn("y", -F.col("x") * F.col("x"))
    assert stats.spearman(y, "x", "y").first().rho == pytest.approx(-1.0)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5), ("e", None)], "t string, p_value double")
    got = {r.t: (r.p_fdr, r.significant_fdr) for r in stats.benjamini_hochberg(df).collect()}
    assert got["e"] == (None, False) and got["a"] == (pytest.approx(0.04), True) and got["c"][0] == got["b"][0] == pytest.approx(0.16 / 3)


def test_bootstrap_is_reproducible_and_covers(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("g", k, float(v)) for k, v in enumerate(rng.normal(10, 2, 200))] + [("few", 0, 1.0)], "g string, k int, x double")
    a, b = ({r.g: (r.low, r.high, r.n) for r in stats.bootstrap_ci(d, ["g"], "x", "k", n_boot=300).collect()} for d in (df, df.repartition(5)))
    assert a["g"] == b["g"] and a["g"][0] < 10 < a["g"][1] and a["few"][:2] == (None, None)


def test_decisions(spark):
    policy = replenishment.Policy(z_override=1.0, lead_time_days=4, review_period_days=1, fallback_sigma=1.0)  # safety stock 2
    nan = float("nan")
    cases = [
        (None, 5.0, "smooth", None, "missing_forecast", None, "INSUFFICIENT_DATA"), (nan, 5.0, "smooth", None, "missing_forecast", None, "INSUFFICIENT_DATA"),
        (1.0, None, "smooth", None, "missing_inventory_data", None, "INSUFFICIENT_DATA"), (1.0, nan, "smooth", None, "missing_inventory_data", None, "INSUFFICIENT_DATA"),
        (0.0, 2.0, "smooth", None, "zero_forecast_no_order", 0.0, "LOW_RISK"), (0.0, -3.0, "smooth", None, "inventory_position_below_reorder_point", 5.0, "STOCKOUT_RISK"),
        (1.0, 5.0, "smooth", None, "inventory_position_below_reorder_point", 2.0, "LOW_RISK"), (1.0, 6.0, "lumpy", 1.0, "inventory_position_at_or_above_target", 0.0, "HIGH_UNCERTAINTY_SEGMENT"),
        (1.0, 1.0, "lumpy", 0.05, "inventory_position_below_reorder_point", 6.0, "HIGH_FORECAST_OUTLIER"), (-1.0, 9.0, "erratic", None, "zero_forecast_no_order", 0.0, "LOW_RISK"),
    ]
    df = spark.createDataFrame([(k, c[0], c[1], c[2], c[3], 1.0) for k, c in enumerate(cases)], "k int, forecast_daily_mean double, inventory_position double, segment string, historical_mean_sales double, sigma_daily double")
    got = replenishment.decide(df, policy).orderBy("k").collect()
    assert [(r.decision_reason, r.recommended_order_qty, r.risk_flag) for r in got] == [c[4:] for c in cases]
    assert replenishment.safety_z(0.95) == pytest.approx(1.6448536)
    for bad in (0, 1, 1.5):
        with pytest.raises(ValueError):
            replenishment.safety_z(bad)
    with pytest.raises(KeyError):
        replenishment.Policy.from_config({"replenishment": {}, "phase6": {}})


def test_quality_checks_fire(spark, facts):
    good = facts.withColumns({"sell_price": F.lit(2.0), "is_active": F.lit(True), "sales": F.col("sales") + 1})
    broken = {
        "no_duplicate_series_dates": good.unionAll(good.limit(1)), "no_nulls_in_core_columns": good.withColumn("sales", F.when(F.col("date") > F.lit(D0), F.col("sales"))), "no_negative_sales": good.withColumn("sales", -F.col("sales")),
        "series_are_contiguous_daily": good.where(F.col("date") != F.lit(D0 + timedelta(days=3))), "prices_positive": good.withColumn("sell_price", F.lit(0.0)), "active_rows_mostly_priced": good.withColumn("sell_price", F.lit(None).cast("double")), "few_all_zero_series": good.withColumn("sales", F.lit(0)),
    }
    assert quality.quality_checks(good).where("not passed").isEmpty()
    for name, df in broken.items():
        assert name in {r.check for r in quality.quality_checks(df).where("not passed").collect()}
