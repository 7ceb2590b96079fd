"""The parameterised named queries as table functions of a session: SELECT * FROM top_products_per_store(5).

Functions are temporary, read the views of `Retail.register`, carry the registry's defaults, can be called with named
arguments, and refuse a parameter out of its range when they are run. A row limit is a condition on a place: of each task
only the first rows reach the task that ranks them, as long as the limit is a literal of at most
spark.sql.optimizer.windowGroupLimitThreshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfwise.plans.binding import Retail
from shelfwise.plans.named import REGISTRY, UnknownQueryError


def _round(x: str, digits: int) -> str:
    """`semantics.rounded` in SQL."""
    return f"round(CAST({x} AS DOUBLE) * 1e{digits}D, 0) / 1e{digits}D"


def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0.0D)"


def _percent(a: str, b: str) -> str:
    return f"100.0D * ({_ratio(a, b)})"


@dataclass(frozen=True)
class TableFunction:
    """`checks` holds, by parameter, what must be true of it; the body names a parameter in braces where it is used."""

    name: str
    types: dict[str, str]
    checks: dict[str, str]
    returns: str
    body: str

    def statement(self) -> str:
        defaults = REGISTRY[self.name].params
        declared = ", ".join(f"{p} {kind} DEFAULT {defaults[p]}" for p, kind in self.types.items())
        used = {p: f"(CASE WHEN {self.checks[p]} THEN {p} ELSE CAST(raise_error('{self.name}: {p} must hold {self.checks[p]}') AS {kind}) END)" for p, kind in self.types.items()}
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({declared}) RETURNS TABLE({self.returns}) RETURN {self.body.format(**used)}"


#: Units of the last 28 days of all data and of the 28 before, by series.
RECENT = """SELECT item_id, store_id, cat_id, sum(CASE WHEN date > date_sub(hi, 28) THEN sales END) AS l, sum(CASE WHEN date <= date_sub(hi, 28) THEN sales END) AS p
    FROM v_sales CROSS JOIN (SELECT max(date) AS hi FROM v_sales) WHERE date > date_sub(hi, 56) GROUP BY item_id, store_id, cat_id"""

FUNCTIONS = [
    TableFunction(
        "top_products_per_store", {"top_n": "INT"}, {"top_n": "top_n > 0"},
        "store_id STRING, rank BIGINT, item_id STRING, cat_id STRING, total_units BIGINT, revenue_derived DOUBLE, pct_of_store DOUBLE",
        f"""SELECT s.store_id, CAST(s.k AS BIGINT), s.item_id, s.cat_id, s.total_units, {_round("s.revenue_cents / 100.0D", 2)}, {_round(_percent("s.total_units", "t.units"), 3)} FROM
            (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY total_units DESC, item_id) AS k FROM v_series_summary) s
            JOIN (SELECT store_id, sum(units) AS units FROM v_store_daily GROUP BY store_id) t ON s.store_id = t.store_id WHERE s.k <= {{top_n}}""",
    ),
    TableFunction(
        "declining_products", {"min_prior_units": "INT", "top_n": "INT"}, {"min_prior_units": "min_prior_units >= 0", "top_n": "top_n > 0"},
        "item_id STRING, store_id STRING, cat_id STRING, units_prior_28d BIGINT, units_last_28d BIGINT, units_delta BIGINT, change_pct DOUBLE",
        f"""SELECT item_id, store_id, cat_id, p, l, l - p, c FROM (SELECT *, row_number() OVER (ORDER BY c, p DESC, item_id, store_id) AS k FROM
            (SELECT *, {_round(_percent("l - p", "p"), 1)} AS c FROM ({RECENT}) WHERE p >= {{min_prior_units}} AND l < p)) WHERE k <= {{top_n}}""",
    ),
    # A row's place among all rows comes from the rows above it, which the limit leaves, and the number of its ties.
    TableFunction(
        "product_volatility", {"min_total_units": "INT", "top_n": "INT"}, {"min_total_units": "min_total_units >= 0", "top_n": "top_n > 0"},
        "item_id STRING, store_id STRING, cat_id STRING, total_units BIGINT, mean_daily_units DOUBLE, sd_daily_units DOUBLE, cv_daily_units DOUBLE, zero_share DOUBLE, volatility_quartile BIGINT",
        f"""WITH used AS (SELECT *, {_round("cv_daily_units", 9)} AS cv FROM v_series_summary WHERE total_units >= {{min_total_units}} AND cv_daily_units IS NOT NULL),
            shown AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY cv DESC, item_id, store_id) AS k FROM used) WHERE k <= {{top_n}}),
            n AS (SELECT count(*) AS n FROM used),
            ties AS (SELECT u.cv, count(*) AS c FROM used u JOIN (SELECT DISTINCT cv FROM shown) d ON u.cv = d.cv GROUP BY u.cv),
            placed AS (SELECT s.*, n.n, n.n - (rank() OVER (ORDER BY s.cv DESC) - 1) - (t.c - row_number() OVER (PARTITION BY s.cv ORDER BY s.item_id, s.store_id)) - 1 AS at FROM shown s JOIN ties t ON s.cv = t.cv CROSS JOIN n)
            SELECT item_id, store_id, cat_id, total_units, {_round("mean_daily_units", 4)}, {_round("sd_daily_units", 4)}, {_round("cv_daily_units", 3)}, {_round("zero_share", 3)},
            CASE WHEN at < n % 4 * (n DIV 4 + 1) THEN at DIV (n DIV 4 + 1) + 1 ELSE n % 4 + (at - n % 4 * (n DIV 4 + 1)) DIV greatest(n DIV 4, 1) + 1 END FROM placed""",
    ),
    TableFunction(
        "persistent_low_demand", {"max_mean_daily": "DOUBLE", "min_zero_share": "DOUBLE"}, {"max_mean_daily": "max_mean_daily >= 0", "min_zero_share": "min_zero_share BETWEEN 0 AND 1"},
        "store_id STRING, cat_id STRING, n_series BIGINT, avg_mean_daily DOUBLE, avg_zero_share DOUBLE, units_contributed BIGINT, pct_of_all_units DOUBLE",
        f"""SELECT store_id, cat_id, n, {_round("a", 4)}, {_round("z", 3)}, u, {_round(_percent("u", "sum(u) OVER ()"), 3)} FROM
            (SELECT store_id, cat_id, count(*) AS n, avg(mean_daily_units) AS a, avg(zero_share) AS z, sum(total_units) AS u FROM v_series_summary
            WHERE mean_daily_units <= {{max_mean_daily}} AND zero_share >= {{min_zero_share}} GROUP BY store_id, cat_id)""",
    ),
    TableFunction(
        "named_event_impact", {"min_occurrences": "INT"}, {"min_occurrences": "min_occurrences > 0"},
        "event_name STRING, event_type STRING, n_occurrences BIGINT, mean_units_per_row DOUBLE, observed_gap_vs_normal_pct DOUBLE",
        f"""SELECT event_name_1, event_type_1, n, {_round("a", 4)}, {_round(_percent("a - b", "b"), 1)} FROM
            (SELECT event_name_1, event_type_1, count(DISTINCT date) AS n, avg(sales) AS a FROM v_sales WHERE event_name_1 IS NOT NULL GROUP BY event_name_1, event_type_1)
            CROSS JOIN (SELECT avg(sales) AS b FROM v_sales WHERE event_name_1 IS NULL) WHERE n >= {{min_occurrences}}""",
    ),
]


def create_functions(model: Retail, spark: SparkSession) -> list[str]:
    """Makes the functions over the model's views, in place of those of another model; every parameterised query has one."""
    model.register()
    for f in FUNCTIONS:
        spark.sql(f.statement())
    return [f.name for f in FUNCTIONS]


def call(model: Retail, spark: SparkSession, name: str, **params: float) -> DataFrame:
    """The rows of a function; arguments are bound as literals, so limits are known when the plan is made."""
    kinds = {f.name: f.types for f in FUNCTIONS}
    if name not in kinds:
        raise UnknownQueryError(name)
    if unknown := set(params) - set(kinds[name]):
        raise ValueError(f"{name} has no parameters {sorted(unknown)}")
    create_functions(model, spark)
    return spark.sql(f"SELECT * FROM {name}({', '.join(f'{p} => :{p}' for p in params)})", args=params)
