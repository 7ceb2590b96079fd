"""Expanding-window backtests: all folds in one plan, methods as columns, metrics as aggregates."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["store_id", "item_id"]
BASELINES = ["naive", "seasonal_naive", "ma7", "ma28", "zero"]
SMOOTHERS = ["ses", "croston", "sba", "tsb"]
METRICS = ["mae", "wape", "rmse", "bias", "smape", "mape"]


@dataclass(frozen=True)
class Fold:
    fold_id: int
    train_start: date
    train_end: date
    forecast_start: date
    forecast_end: date


@dataclass(frozen=True)
class Scheme:
    """Expanding windows: each fold trains on all days up to its end."""

    horizon_days: int = 28
    n_folds: int = 5
    step_days: int = 28
    min_train_days: int = 730


def generate_folds(first: date, last: date, scheme: Scheme = Scheme()) -> list[Fold]:
    """Folds counted back from the last day, numbered from the earliest that has enough days to train on."""
    ends = [last - timedelta(days=scheme.horizon_days + k * scheme.step_days) for k in reversed(range(scheme.n_folds))]
    use = [e for e in ends if (e - first).days >= scheme.min_train_days]
    day = timedelta(days=1)
    return [Fold(k, first, e, e + day, e + scheme.horizon_days * day) for k, e in enumerate(use, 1)]


def folds_frame(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(f).values()) for f in folds], "fold_id int, train_start date, train_end date, forecast_start date, forecast_end date")


#: Rows whose mean starts exponential smoothing.
WARM_UP = 10
#: What a span of days does to the state of a series; each is a weighted sum that composes with the span before.
PARTS = ["n", "m", "head", "heads", "level", "z", "p", "q", "tz", "tp", "sold"]


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def series_spans(facts: DataFrame, folds: list, alpha: float = 0.1, beta: float = 0.1) -> DataFrame:
    """Keys, spans, tests of each series, from one pass over it.

    Training ends cut the days into spans, and each row of the facts is in one of them, however many folds there are. A
    span's struct holds its counts of rows (n) and of sales (m) so far, and what it adds to the smoothed states; its
    `last` is what the last row looks back on. tests are the rows of the folds' forecast days.
    """
    keep, calm = 1 - alpha, 1 - beta
    ends = sorted({f.train_end for f in folds})
    carried = [c for c in ("cat_id", "state_id") if c in facts.columns]
    span = sum(((F.col("date") > F.lit(e)).cast("int") for e in ends), F.lit(0))
    rows = facts.select(*KEYS, F.col("date").cast("date").alias("date"), "sales", *carried, F.unix_date(F.col("date").cast("date")).alias("day"), span.alias("span"))
    own = Window.partitionBy(*KEYS).orderBy("day")
    sold, y = F.col("sales") > 0, F.col("sales").cast("double")
    rows = rows.withColumns({
        "rn": F.row_number().over(own), "j": F.count_if(sold).over(own.rowsBetween(Window.unboundedPreceding, 0)), "ma7": F.avg("sales").over(own.rowsBetween(-6, 0)),
        "ma28": F.avg("sales").over(own.rowsBetween(-27, 0)), "week_ago": F.max("sales").over(own.rangeBetween(-7, -7)),
    })
    rows = rows.withColumn("gap", F.col("rn") - F.coalesce(F.max(F.when(sold, F.col("rn"))).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = Window.partitionBy(*KEYS, "span")
    rows = rows.withColumns({"n": F.max("rn").over(part), "m": F.max("j").over(part)})
    n, m = F.col("n"), F.col("m")
    late, aside = F.pow(F.lit(keep), m - F.col("j")), F.pow(F.lit(calm), m - F.col("j"))
    share = lambda rate, kept: F.when(sold, F.when(F.col("j") == 1, kept).otherwise(rate * kept)).otherwise(0.0)
    sums = {
        "n": F.max("n"), "m": F.max("m"), "head": F.sum(F.when(F.col("rn") <= WARM_UP, y).otherwise(0.0)), "heads": F.count_if(F.col("rn") <= WARM_UP),
        "level": F.sum(F.pow(F.lit(keep), n - F.col("rn")) * alpha * y), "z": F.sum(share(alpha, late) * y), "p": F.sum(share(alpha, late) * F.col("gap")), "q": F.sum(share(beta, aside) * F.col("gap")),
        "tz": F.sum(F.when(sold, late * alpha * y).otherwise(0.0)), "tp": F.sum(F.when(sold, F.pow(F.lit(calm), n - F.col("rn")) * beta).otherwise(0.0)), "sold": F.sum(F.when(sold, y).otherwise(0.0)),
    }
    test = F.lit(False)
    for f in folds:
        test = test | F.col("date").between(F.lit(f.forecast_start), F.lit(f.forecast_end))
    spans = rows.groupBy(*KEYS, "span").agg(
        F.struct(*[F.coalesce(sums[k].cast("double"), F.lit(0.0)).alias(k) for k in PARTS]).alias("sums"), F.max_by(F.struct("sales", "ma7", "ma28"), "day").alias("last"),
        F.collect_list(F.when(test, F.struct("date", "sales", "week_ago", *carried))).alias("tests"),
    )
    return spans.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("span", "sums", "last"))).alias("spans"), F.flatten(F.collect_list("tests")).alias("tests"))


def composed(spans: Column, alpha: float, beta: float) -> Column:
    """The state after spans in their order: what was there fades by the rows or sales of the next span, which adds its own."""

    def after(state: Column, x: Column) -> Column:
        own = x["sums"]
        rows, sales = own["n"] - state["n"], own["m"] - state["m"]
        fade = {"level": (alpha, rows), "z": (alpha, sales), "p": (alpha, sales), "q": (beta, sales), "tz": (alpha, sales), "tp": (beta, rows)}
        value = lambda k: own[k] if k in ("n", "m") else state[k] * F.pow(F.lit(1 - fade[k][0]), fade[k][1]) + own[k] if k in fade else state[k] + own[k]
        return F.struct(*[value(k).alias(k) for k in PARTS])

    return F.aggregate(spans, F.struct(*[F.lit(0.0).alias(k) for k in PARTS]), after)


def fold_states(facts: DataFrame, folds: DataFrame, alpha: float = 0.1, beta: float = 0.1) -> DataFrame:
    """fold_id, train_end, keys, tests, state, last of each fold and series with forecast days: one scan, one exchange."""
    own = folds.orderBy("fold_id").collect()  # a handful
    ends = sorted({f.train_end for f in own})
    each = F.explode(F.array(*[F.struct(F.lit(f.fold_id).cast("int").alias("fold_id"), F.lit(f.train_end).alias("train_end"), F.lit(ends.index(f.train_end)).alias("end"), F.lit(f.forecast_start).alias("from"), F.lit(f.forecast_end).alias("to")) for f in own]))
    rows = series_spans(facts, own, alpha, beta).select("*", each.alias("f"))
    tests = F.filter("tests", lambda t: t["date"].between(F.col("f.from"), F.col("f.to")))
    known = F.filter("spans", lambda x: x["span"] <= F.col("f.end"))
    rows = rows.select(*KEYS, "f.fold_id", "f.train_end", tests.alias("tests"), known.alias("spans")).where(F.size("tests") > 0)
    return rows.select(*KEYS, "fold_id", "train_end", "tests", composed(F.col("spans"), alpha, beta).alias("state"), F.try_element_at("spans", F.lit(-1))["last"].alias("last"))


def run_backtest(facts: DataFrame, folds: DataFrame, segments: DataFrame | None = None, smoothers: bool = True, alpha: float = 0.1, beta: float = 0.1) -> DataFrame:
    """A row for each fold, series and forecast day that has an actual: actual, horizon_day, segment, methods as columns.

    Cold series (no training row) stay, with null forecasts but zero; seasonal_naive looks seven days back in training
    only, so it is null from the eighth day on.
    """
    if folds.isEmpty():
        raise ValueError("no fold has enough days to train on")
    states = fold_states(facts, folds, alpha, beta)
    s = lambda k: F.col(f"state.{k}")
    n, m, keep, calm = s("n"), s("m"), F.lit(1 - alpha), F.lit(1 - beta)
    positive = lambda c: F.when(m > 0, _clip(c)).otherwise(0.0)
    some = lambda c: F.when(c != 0, c)
    smooth = {
        "ses": _clip(F.pow(keep, n) * s("head") / some(s("heads")) + s("level")), "croston": positive(s("z") / some(s("p"))), "sba": positive(s("z") / some(s("q")) * (1 - beta / 2)),  # intervals smoothed by beta
        "tsb": positive((F.pow(keep, m) * s("sold") / some(m) + s("tz")) * (F.pow(calm, n) * m / some(n) + s("tp"))),
    }
    methods = {"naive": F.col("last.sales").cast("double"), "ma7": F.col("last.ma7"), "ma28": F.col("last.ma28"), **{k: F.when(n > 0, c) for k, c in smooth.items() if smoothers}}
    carried = [c for c in ("cat_id", "state_id") if c in facts.columns]
    out = states.select("fold_id", "train_end", *KEYS, *[c.alias(k) for k, c in methods.items()], F.explode("tests").alias("t"))
    week = F.when(F.datediff("t.date", "train_end") <= 7, F.col("t.week_ago").cast("double"))
    out = out.select("fold_id", "train_end", *KEYS, "t.date", F.col("t.sales").alias("actual"), *[f"t.{c}" for c in carried], "naive", "ma7", "ma28", week.alias("seasonal_naive"), *[k for k in smooth if smoothers])
    if segments is not None:
        out = out.join(segments.select(*KEYS, "segment"), KEYS, "left")
    segment = F.coalesce("segment", F.lit("unknown")) if segments is not None else F.lit("unknown")
    return out.withColumns({"zero": F.lit(0.0), "horizon_day": F.datediff("date", "train_end"), "segment": segment}).drop("train_end")


def melted(predictions: DataFrame, methods: list[str]) -> DataFrame:
    rest = [c for c in predictions.columns if c not in methods]
    return predictions.withColumns({m: F.col(m).cast("double") for m in methods}).unpivot(rest, methods, "method", "forecast")


def metric_columns(actual: str = "actual", forecast: str = "forecast") -> dict[str, Column]:
    """Each metric over the pairs of which neither side is missing; n_nonzero_actual counts before they are dropped."""
    a, f = F.col(actual).cast("double"), F.when(~F.isnan(forecast), F.col(forecast))
    e = f - a
    total = F.sum(F.when(e.isNotNull(), F.abs(a)))
    size = F.abs(a) + F.abs(f)
    return {
        "n_obs": F.count(e), "n_nonzero_actual": F.count_if(a > 0), "mae": F.avg(F.abs(e)), "wape": F.sum(F.abs(e)) / F.when(total != 0, total), "rmse": F.sqrt(F.avg(e * e)), "bias": F.avg(e),
        "smape": F.avg(F.when(e.isNotNull(), F.when(size == 0, 0.0).otherwise(2.0 * F.abs(e) / F.when(size != 0, size)))), "mape": F.avg(F.when(a > 0, F.abs(e) / F.when(a > 0, a))),
    }


def metric_cut(predictions: DataFrame, by: list[str], methods: list[str]) -> DataFrame:
    """Metrics of each method in each group; rows with a missing group are left out."""
    rows = melted(predictions, methods).dropna(subset=by) if by else melted(predictions, methods)
    return rows.groupBy(*by, "method").agg(*[c.alias(k) for k, c in metric_columns().items()])


def best_methods(predictions: DataFrame, methods: list[str], n: int = 3) -> DataFrame:
    """horizon_day and, of the n methods with the least mean of their folds' MAE, method_k and mae_k: the mean over folds of
    the MAE on that day, best method first. Ties go by name."""
    order = metric_cut(predictions, ["fold_id"], methods).groupBy("method").agg(F.avg("mae").alias("m")).where("m is not null").withColumn("m", F.round("m", 9)).orderBy("m", "method").limit(n)
    named = F.broadcast(order.withColumn("k", F.row_number().over(Window.orderBy("m", "method"))).drop("m"))  # n rows
    days = metric_cut(predictions, ["fold_id", "horizon_day"], methods).join(named, "method").groupBy("horizon_day", "k", "method").agg(F.avg("mae").alias("mae"))
    pick = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}")
    return days.groupBy("horizon_day").agg(*[pick(c, k) for k in range(1, n + 1) for c in ("method", "mae")])


def cold_series(facts: DataFrame, folds: DataFrame) -> DataFrame:
    """fold_id and keys of the series that are sold in a fold's forecast days but have no training row."""
    return fold_states(facts, folds).where("state.n = 0").select("fold_id", *KEYS)


def backtest_report(predictions: DataFrame, methods: list[str]) -> dict[str, DataFrame]:
    cuts = {"fold": ["fold_id"], "segment": ["segment"], "horizon": ["horizon_day"], "store": ["store_id"], "category": ["cat_id"]}
    return {k: metric_cut(predictions, by, methods) for k, by in cuts.items() if by[0] in predictions.columns}
