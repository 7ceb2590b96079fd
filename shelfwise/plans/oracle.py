"""SQL for the named queries, over the common table expressions of `binding.SQL`; for checking, in DuckDB's dialect."""

from __future__ import annotations

import re

from shelfwise.plans import binding

BODIES = {
    "v_sales_totals": """SELECT store_id, cat_id, dept_id, state_id, year, count(*) AS n, CAST(sum(sales) AS BIGINT) AS units, CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents,
        CAST(sum(snap_active) AS BIGINT) AS snap_rows, CAST(sum(is_event_day) AS BIGINT) AS event_rows, CAST(sum(wday) AS BIGINT) AS wdays, CAST(sum(wm_yr_wk) AS BIGINT) AS weeks FROM v_sales GROUP BY ALL""",
    "v_store_daily": "SELECT store_id, state_id, date, units, revenue_cents / 100.0::DOUBLE AS revenue, active_skus, snap_active, is_event_day FROM v_store_daily",
    "v_store_cat_daily": "SELECT store_id, cat_id, date, units, revenue_cents / 100.0::DOUBLE AS revenue FROM v_store_cat_daily",
    "v_series_summary": """SELECT item_id, store_id, cat_id, dept_id, n_days, total_units, revenue_cents / 100.0::DOUBLE AS total_revenue, round(mean_daily_units, 6) AS mean_daily_units,
        round(sd_daily_units, 6) AS sd_daily_units, round(cv_daily_units, 6) AS cv_daily_units, nonzero_days, round(zero_share, 6) AS zero_share, first_active_date, last_active_date FROM v_series_summary""",
    "fact_overview": """SELECT count(*) AS n_rows, count(DISTINCT (item_id, store_id)) AS n_series, count(DISTINCT item_id) AS n_items, count(DISTINCT store_id) AS n_stores, count(DISTINCT date) AS n_dates,
        min(date) AS date_min, max(date) AS date_max, CAST(sum(sales) AS BIGINT) AS total_units, round(avg(sales), 4) AS mean_daily_units, count(*) FILTER (sales = 0) AS zero_rows,
        round(count(*) FILTER (sales = 0) / count(*), 4) AS zero_share FROM fact_sales""",
    "grain_uniqueness": "SELECT count(*) AS duplicate_keys FROM (SELECT 1 FROM fact_sales GROUP BY item_id, store_id, date HAVING count(*) > 1)",
    "join_fanout_check": "SELECT f AS fact_rows, j AS joined_rows, j - f AS fanout_delta FROM (SELECT count(*) AS f FROM fact_sales), (SELECT count(*) AS j FROM v_sales)",
    "dimension_key_uniqueness": """SELECT 'dim_product' AS table_name, count(*) AS n_rows, count(DISTINCT item_id) AS n_keys FROM dim_product
        UNION ALL SELECT 'dim_store', count(*), count(DISTINCT store_id) FROM dim_store UNION ALL SELECT 'dim_calendar', count(*), count(DISTINCT date) FROM dim_calendar
        UNION ALL SELECT 'dim_price', count(*), count(DISTINCT (store_id, item_id, wm_yr_wk)) FROM dim_price""",
    "price_coverage": """SELECT count(*) AS n_rows, count(*) FILTER (cents IS NULL) AS unpriced_rows, round(count(*) FILTER (cents IS NULL) / count(*), 6) AS unpriced_share,
        CAST(coalesce(sum(sales) FILTER (cents IS NULL), 0) AS BIGINT) AS units_without_price FROM fact_sales""",
    "series_date_continuity": "SELECT count(*) AS n_series, count(*) FILTER (n <> days) AS series_with_gaps FROM (SELECT count(*) AS n, max(date) - min(date) + 1 AS days FROM fact_sales GROUP BY item_id, store_id)",
    "active_flag_check": "SELECT count(*) FILTER (is_active) AS active_rows, count(*) FILTER (NOT is_active) AS inactive_rows FROM fact_sales",
    "kpi_overall": """SELECT CAST(sum(sales) AS BIGINT) AS total_units, round(sum(revenue_cents) / 100.0::DOUBLE, 2) AS total_revenue_derived, count(DISTINCT date) AS n_days,
        round(sum(sales) / count(DISTINCT date), 1) AS avg_units_per_day, count(DISTINCT item_id) AS n_items, count(DISTINCT store_id) AS n_stores FROM v_sales""",
    "kpi_by_category": """, g AS (SELECT cat_id, count(DISTINCT item_id) AS n_items, sum(sales) AS u, sum(revenue_cents) AS c, avg(sales) AS a, sum(sales) FILTER (snap_active = 1) AS s, sum(sales) FILTER (is_event_day = 1) AS e FROM v_sales GROUP BY 1)
        SELECT cat_id, n_items, CAST(u AS BIGINT) AS total_units, round(c / 100.0::DOUBLE, 2) AS revenue_derived, round(a, 3) AS mean_daily_units, CAST(s AS BIGINT) AS units_snap_days, CAST(e AS BIGINT) AS units_event_days,
        round(100 * (u / (SELECT sum(u) FROM g)), 2) AS pct_of_total_units, round(100 * (c / (SELECT sum(c) FROM g)), 2) AS pct_of_total_revenue FROM g""",
    "kpi_by_department": """, g AS (SELECT cat_id, dept_id, count(DISTINCT item_id) AS n_items, sum(sales) AS u, sum(revenue_cents) AS c FROM v_sales GROUP BY 1, 2)
        SELECT cat_id, dept_id, n_items, CAST(u AS BIGINT) AS total_units, round(c / 100.0::DOUBLE, 2) AS revenue_derived, (SELECT count(*) + 1 FROM g h WHERE h.cat_id = g.cat_id AND h.u > g.u) AS rank_in_category,
        round(100 * (u / (SELECT sum(h.u) FROM g h WHERE h.cat_id = g.cat_id)), 2) AS pct_of_category FROM g""",
    "kpi_store_category_matrix": """, g AS (SELECT store_id, state_id, cat_id, sum(sales) AS u, sum(revenue_cents) AS c FROM v_sales GROUP BY 1, 2, 3)
        SELECT store_id, state_id, cat_id, CAST(u AS BIGINT) AS total_units, round(c / 100.0::DOUBLE, 2) AS revenue_derived, round(100 * (u / (SELECT sum(h.u) FROM g h WHERE h.store_id = g.store_id)), 2) AS pct_of_store_units,
        (SELECT count(*) + 1 FROM g h WHERE h.cat_id = g.cat_id AND h.u > g.u) AS store_rank_in_category FROM g""",
    "kpi_day_of_week_profile": """, g AS (SELECT wday, sum(sales) AS u, avg(sales) AS a FROM v_sales GROUP BY 1)
        SELECT wday, ['Sat', 'Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri'][wday] AS day_name, CAST(u AS BIGINT) AS total_units, round(a, 4) AS mean_units_per_row, round(100 * (u / (SELECT sum(u) FROM g)), 2) AS pct_of_total FROM g""",
    "store_performance": """, g AS (SELECT store_id, state_id, sum(units) AS u, sum(revenue_cents) AS c, count(DISTINCT date) AS d, avg(active_skus) AS k FROM v_store_daily GROUP BY 1, 2), t AS (SELECT sum(u) AS s, avg(u) AS a FROM g)
        SELECT store_id, state_id, CAST(u AS BIGINT) AS total_units, round(c / 100.0::DOUBLE, 2) AS revenue_derived, round(u / d, 1) AS avg_units_per_day, round(k, 0) AS avg_active_skus, (SELECT count(*) + 1 FROM g h WHERE h.u > g.u) AS units_rank,
        round(100 * (u / s), 2) AS pct_of_chain_units, round(100 * ((u - a) / a), 2) AS pct_vs_peer_mean FROM g, t""",
    "store_growth_28d": """, w AS (SELECT store_id, state_id, sum(units) FILTER (date > (SELECT hi FROM span) - 28) AS l, sum(units) FILTER (date > (SELECT hi FROM span) - 56 AND date <= (SELECT hi FROM span) - 28) AS p FROM v_store_daily GROUP BY 1, 2)
        SELECT store_id, state_id, CAST(l AS BIGINT) AS units_last_28d, CAST(p AS BIGINT) AS units_prior_28d, CAST(l - p AS BIGINT) AS units_delta, round(100 * ((l - p) / nullif(p, 0)), 2) AS growth_pct,
        rank() OVER (ORDER BY (l - p) / nullif(p, 0) DESC NULLS LAST) AS growth_rank FROM w""",
    "store_yearly_trend": """, y AS (SELECT store_id, year, count(DISTINCT date) AS d, sum(sales) AS u, row_number() OVER (PARTITION BY store_id ORDER BY year) AS k FROM v_sales GROUP BY 1, 2)
        SELECT a.store_id, a.year, a.d AS days_observed, CAST(a.u AS BIGINT) AS units, round(a.u / a.d, 1) AS units_per_day, CAST(b.u AS BIGINT) AS prev_year_units, round(100 * ((a.u - b.u) / nullif(b.u, 0)), 2) AS yoy_growth_pct
        FROM y a LEFT JOIN y b ON a.store_id = b.store_id AND a.k = b.k + 1""",
    "store_category_strength": """, g AS (SELECT store_id, cat_id, sum(units) AS u FROM v_store_cat_daily GROUP BY 1, 2),
        i AS (SELECT *, u / sum(u) OVER (PARTITION BY store_id) AS s, sum(u) OVER (PARTITION BY cat_id) / sum(u) OVER () AS c FROM g)
        SELECT store_id, cat_id, CAST(u AS BIGINT) AS units, round(s * 100, 2) AS pct_of_store, round(c * 100, 2) AS pct_chain_benchmark, round(s / c, 3) AS index_vs_chain,
        CASE WHEN s / c >= 1.1::DOUBLE THEN 'over-indexed' WHEN s / c <= 0.9::DOUBLE THEN 'under-indexed' ELSE 'in line' END AS assessment FROM i""",
    "top_products_per_store": """SELECT store_id, rank, item_id, cat_id, total_units, round(revenue_cents / 100.0::DOUBLE, 2) AS revenue_derived, round(100 * (total_units / s), 3) AS pct_of_store FROM
        (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY total_units DESC, item_id) AS rank, sum(total_units) OVER (PARTITION BY store_id) AS s FROM v_series_summary) WHERE rank <= 10""",
    "declining_products": """, w AS (SELECT item_id, store_id, cat_id, sum(sales) FILTER (date > (SELECT hi FROM span) - 28) AS l, sum(sales) FILTER (date <= (SELECT hi FROM span) - 28) AS p FROM v_sales WHERE date > (SELECT hi FROM span) - 56 GROUP BY 1, 2, 3)
        SELECT item_id, store_id, cat_id, CAST(p AS BIGINT) AS units_prior_28d, CAST(l AS BIGINT) AS units_last_28d, CAST(l - p AS BIGINT) AS units_delta, round(100 * ((l - p) / nullif(p, 0)), 1) AS change_pct FROM w
        WHERE p >= 30 AND l < p ORDER BY change_pct, p DESC, item_id, store_id LIMIT 10""",
    "product_volatility": """, u AS (SELECT *, round(cv_daily_units, 9) AS cv FROM v_series_summary WHERE total_units >= 100 AND cv_daily_units IS NOT NULL)
        SELECT item_id, store_id, cat_id, total_units, round(mean_daily_units, 4) AS mean_daily_units, round(sd_daily_units, 4) AS sd_daily_units, round(cv_daily_units, 3) AS cv_daily_units, round(zero_share, 3) AS zero_share,
        ntile(4) OVER (ORDER BY cv, item_id, store_id) AS volatility_quartile FROM u ORDER BY cv DESC, item_id, store_id LIMIT 10""",
    "persistent_low_demand": """, l AS (SELECT * FROM v_series_summary WHERE mean_daily_units <= 9 AND zero_share >= 0.7::DOUBLE), g AS (SELECT store_id, cat_id, count(*) AS n, avg(mean_daily_units) AS a, avg(zero_share) AS z, sum(total_units) AS u FROM l GROUP BY 1, 2)
        SELECT store_id, cat_id, n AS n_series, round(a, 4) AS avg_mean_daily, round(z, 3) AS avg_zero_share, CAST(u AS BIGINT) AS units_contributed, round(100 * (u / (SELECT sum(u) FROM g)), 3) AS pct_of_all_units FROM g""",
    "abc_classification": """, c AS (SELECT total_units, sum(total_units) OVER (ORDER BY total_units DESC, item_id, store_id ROWS UNBOUNDED PRECEDING) / (SELECT sum(total_units) FROM v_series_summary) AS s FROM v_series_summary),
        g AS (SELECT CASE WHEN s <= 0.8::DOUBLE THEN 'A' WHEN s <= 0.95::DOUBLE THEN 'B' ELSE 'C' END AS abc_class, count(*) AS n, sum(total_units) AS u FROM c GROUP BY 1)
        SELECT abc_class, n AS n_series, round(100 * (n / (SELECT sum(n) FROM g)), 2) AS pct_of_series, CAST(u AS BIGINT) AS total_units, round(100 * (u / (SELECT sum(u) FROM g)), 2) AS pct_of_units FROM g""",
    "rolling_store_demand": """SELECT store_id, date, units, CAST(sum(units) OVER w AS BIGINT) AS units_7d, round(avg(units) OVER w, 1) AS avg_7d, CAST(sum(units) OVER m AS BIGINT) AS units_28d, round(avg(units) OVER m, 1) AS avg_28d,
        round(stddev_samp(units) OVER m, 1) AS sd_28d, round(avg(units) OVER w - avg(units) OVER m, 1) AS momentum_7d_vs_28d FROM v_store_daily
        WINDOW w AS (PARTITION BY store_id ORDER BY date ROWS 6 PRECEDING), m AS (PARTITION BY store_id ORDER BY date ROWS 27 PRECEDING)""",
    "rolling_category_demand": """SELECT store_id, cat_id, date, units, CAST(sum(units) OVER (o ROWS 6 PRECEDING) AS BIGINT) AS units_7d, round(avg(units) OVER (o ROWS 27 PRECEDING), 1) AS avg_28d, lag(units, 7) OVER o AS units_same_day_last_week
        FROM v_store_cat_daily WINDOW o AS (PARTITION BY store_id, cat_id ORDER BY date)""",
    "monthly_demand_trend": """, g AS (SELECT store_id, CAST(date_trunc('month', date) AS DATE) AS m, count(DISTINCT date) AS d, CAST(sum(sales) AS BIGINT) AS u FROM v_sales GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY m) AS k FROM g)
        SELECT a.store_id, a.m AS month_start, a.d AS days_observed, a.u AS units, round(a.u / a.d, 1) AS units_per_day, b.u AS prev_month_units, c.u AS same_month_last_year, round(100 * ((a.u - c.u) / nullif(c.u, 0)), 1) AS yoy_pct
        FROM k a LEFT JOIN k b ON a.store_id = b.store_id AND a.k = b.k + 1 LEFT JOIN k c ON a.store_id = c.store_id AND a.k = c.k + 12""",
    "weekday_weekend_profile": """SELECT store_id, if(wday <= 2, 'weekend', 'weekday') AS day_type, count(DISTINCT date) AS n_days, CAST(sum(sales) AS BIGINT) AS total_units, round(sum(sales) / count(DISTINCT date), 1) AS units_per_day FROM v_sales GROUP BY 1, 2""",
    "snap_day_comparison": """, g AS (SELECT store_id, state_id, count(DISTINCT date) FILTER (snap_active = 1) AS a, count(DISTINCT date) FILTER (snap_active = 0) AS b, sum(sales) FILTER (snap_active = 1) AS x, sum(sales) FILTER (snap_active = 0) AS y FROM v_sales GROUP BY 1, 2)
        SELECT store_id, state_id, a AS snap_days, b AS non_snap_days, round(x / nullif(a, 0), 1) AS units_per_snap_day, round(y / nullif(b, 0), 1) AS units_per_non_snap_day, round(100 * ((x / nullif(a, 0) - y / nullif(b, 0)) / nullif(y / nullif(b, 0), 0)), 1) AS observed_gap_pct FROM g""",
    "snap_by_category": """, g AS (SELECT cat_id, state_id, avg(sales) FILTER (snap_active = 1) AS a, avg(sales) FILTER (snap_active = 0) AS b FROM v_sales GROUP BY 1, 2)
        SELECT cat_id, state_id, round(a, 4) AS mean_units_snap, round(b, 4) AS mean_units_non_snap, round(100 * ((a - b) / nullif(b, 0)), 1) AS observed_gap_pct FROM g""",
    "event_day_comparison": """, b AS (SELECT avg(sales) AS b FROM v_sales WHERE is_event_day = 0)
        SELECT ifnull(event_type_1, 'no_event') AS event_type, count(DISTINCT date) AS n_days, round(avg(sales), 4) AS mean_units_per_row, CAST(sum(sales) AS BIGINT) AS total_units, round(100 * ((avg(sales) - any_value(b)) / nullif(any_value(b), 0)), 1) AS observed_gap_vs_normal_pct FROM v_sales, b GROUP BY 1""",
    "named_event_impact": """, b AS (SELECT avg(sales) AS b FROM v_sales WHERE is_event_day = 0)
        SELECT event_name_1 AS event_name, event_type_1 AS event_type, count(DISTINCT date) AS n_occurrences, round(avg(sales), 4) AS mean_units_per_row, round(100 * ((avg(sales) - any_value(b)) / nullif(any_value(b), 0)), 1) AS observed_gap_vs_normal_pct
        FROM v_sales, b WHERE is_event_day = 1 GROUP BY 1, 2 HAVING n_occurrences >= 3""",
    "price_change_association": """, w AS (SELECT item_id, store_id, cat_id, wm_yr_wk, sum(sales) AS u, avg(sell_price) AS p FROM v_sales WHERE sell_price IS NOT NULL GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id, store_id ORDER BY wm_yr_wk) AS k FROM w)
        SELECT b.cat_id, CASE WHEN b.p < a.p * 0.98::DOUBLE THEN 'price_decreased' WHEN b.p > a.p * 1.02::DOUBLE THEN 'price_increased' ELSE 'price_stable' END AS price_move, count(*) AS n_week_transitions,
        round(avg(a.u), 2) AS mean_units_before, round(avg(b.u), 2) AS mean_units_after, round(avg(b.u - a.u), 3) AS mean_unit_change, round(100 * (avg(b.u - a.u) / nullif(avg(a.u), 0)), 1) AS mean_pct_change
        FROM k a JOIN k b ON a.item_id = b.item_id AND a.store_id = b.store_id AND b.k = a.k + 1 GROUP BY 1, 2""",
    "series_activity_timeline": """, g AS (SELECT CAST(date_trunc('month', first_active_date) AS DATE) AS m, count(*) AS n FROM v_series_summary GROUP BY 1)
        SELECT m AS month_started, n AS series_activated, (SELECT CAST(sum(h.n) AS BIGINT) FROM g h WHERE h.m <= g.m) AS cumulative_active_series FROM g""",
}


def sql(body: str) -> str:
    """A whole statement: the model's expressions and then the body, which may add its own with a leading comma.

    Zero is added to what is rounded, so that a negative zero becomes zero.
    """
    return binding.SQL + re.sub(r", (\d)\) AS ", r", \1) + 0.0::DOUBLE AS ", body)


STATEMENTS = {name: sql(body) for name, body in BODIES.items()}
