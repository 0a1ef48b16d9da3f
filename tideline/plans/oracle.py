"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

import re

DAILY = """
o AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS y, count(*) AS n_orders FROM orders GROUP BY 1),
l AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS x, avg(l_discount) AS disc FROM lineitem GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM o),
daily AS (SELECT s.d, o.y, CAST(coalesce(o.n_orders, 0) AS BIGINT) AS n_orders, l.x, l.disc FROM spine s LEFT JOIN o USING (d) LEFT JOIN l USING (d))"""
SESSIONS = "e AS (SELECT event_id AS id, user_id, CAST(ts AS DATE) AS d, ts, event_type AS activity, value AS strain, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS minute FROM events)"
JOURNAL = "j AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS question, bool_or(o_orderstatus = 'F') AS yes FROM orders GROUP BY 1, 2)"
SPARSE = "sparse AS (SELECT d, y, CASE WHEN day(d) % 2 = 0 THEN x END AS half, CASE WHEN day(d) > 3 THEN disc END AS most FROM daily)"
PVALUES = """pv AS (SELECT o_orderkey AS id, o_orderpriority AS family, CASE WHEN o_orderkey % 13 <> 0
  THEN round((o_totalprice * o_totalprice / 1e6) - floor(o_totalprice * o_totalprice / 1e6), 9) END AS p FROM orders)"""

SQL: dict[str, str] = {}


def put(name: str, body: str, *ctes: str) -> None:
    """Register a query; rounded columns get the nudge off a tie that the Spark side gives them."""
    body = re.sub(r", (\d+)\) \+ 0\.0", lambda m: f" + 1e-{int(m[1]) + 3}, {m[1]}) + 0.0", body)
    SQL[name] = (f"WITH RECURSIVE {', '.join(c.strip() for c in ctes)} " if ctes else "") + body.strip()


def over_daily(name: str, body: str, *more: str) -> None:
    put(name, body, DAILY, *more)


def rolling(x: str, width: int) -> str:
    frame = f"OVER (ORDER BY d ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {max(2, int(0.4 * width))} THEN avg({x}) {frame} END"


def deviation(x: str, width: int) -> str:
    return f"stddev_samp({x}) OVER (ORDER BY d ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


over_daily("calendar_spine", "SELECT d, round(y, 4) + 0.0 AS y, n_orders FROM daily")
put("full_outer_days", "SELECT coalesce(a.d, b.d) AS d, a.d IS NOT NULL AS has_order, b.d IS NOT NULL AS has_ship FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) a FULL JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) b ON a.d = b.d")
put("latest_per_day", "SELECT d, o_orderkey, y FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey, round(o_totalprice, 4) + 0.0 AS y, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
put("nap_minutes", "SELECT d, round(sum(coalesce(strain, 0)), 4) + 0.0 AS nap FROM e WHERE activity = 'view' GROUP BY d", SESSIONS)
put(
    "fallback_coalesce",
    """SELECT d, o_orderkey, round(y, 4) + 0.0 AS y FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY y IS NULL, CASE WHEN y IS NOT NULL THEN o_orderkey END, o_orderkey DESC) AS n
FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS y FROM orders)) WHERE n = 1""",
)
put("journal_last", "SELECT d, question, yes FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS question, o_orderstatus = 'F' AS yes, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE), o_orderpriority ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
put("question_counts", "SELECT o_orderpriority AS question, count(*) AS n FROM orders GROUP BY 1")
put(
    "day_record",
    """SELECT user_id, d, round(recovery, 4) + 0.0 AS recovery, round(asleep, 4) + 0.0 AS asleep, round(rem, 4) + 0.0 AS rem, round(nap, 4) + 0.0 AS "napMinutes", round(coalesce(minutes, 0), 4) + 0.0 AS "workoutMinutes",
  coalesce(wn, 0) AS "workoutCount", round((CASE WHEN bm < 720 THEN bm + 1440 ELSE bm END) / 60, 6) + 0.0 AS "bedtimeHours", round(wm + 1440, 4) + 0.0 AS "wakeAdjusted", CAST(dayofweek(d) AS BIGINT) AS weekday,
  round(rem * 100 / nullif(asleep, 0), 6) + 0.0 AS "remShare", round(lead(recovery) OVER u, 4) + 0.0 AS "recoveryNext", round(lag(recovery) OVER u / 10, 6) + 0.0 AS "strainPrev",
  round(CASE WHEN count(recovery) OVER w >= 2 THEN avg(recovery) OVER w END, 4) + 0.0 AS recovery7, signup, error
FROM (SELECT *, hour(sleep_on) * 60 + minute(sleep_on) AS bm, hour(wake_on) * 60 + minute(wake_on) AS wm FROM merged)
WINDOW u AS (PARTITION BY user_id ORDER BY d), w AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "ev AS (SELECT event_id AS id, user_id, CAST(ts AS DATE) AS d, ts, event_type AS kind, value AS v, ts + to_minutes(CAST(trunc(value) AS BIGINT)) AS later FROM events)",
    "sp AS (SELECT user_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM ev GROUP BY user_id)",
    "cy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY id DESC) AS n FROM ev WHERE kind = 'purchase') WHERE n = 1)",
    "ni AS (SELECT * FROM (SELECT *, CASE WHEN id % 3 <> 0 THEN v END AS a, row_number() OVER (PARTITION BY user_id, d ORDER BY id % 3 = 0, CASE WHEN id % 3 <> 0 THEN id END, id DESC) AS n FROM ev WHERE kind = 'view' AND id % 2 = 0) WHERE n = 1)",
    "na AS (SELECT user_id, d, sum(CASE WHEN id % 3 <> 0 THEN v ELSE 0 END) AS nap FROM ev WHERE kind = 'view' AND id % 2 = 1 GROUP BY 1, 2)",
    "wo AS (SELECT user_id, d, sum(v) AS minutes, count(*) AS wn FROM ev WHERE kind = 'click' GROUP BY 1, 2)",
    "an AS (SELECT user_id, d, arg_max(id % 2 = 1, id) FILTER (kind = 'signup') AS signup, arg_max(id % 2 = 1, id) FILTER (kind = 'error') AS error FROM ev WHERE kind IN ('signup', 'error') GROUP BY 1, 2)",
    """merged AS (SELECT sp.user_id, sp.d, cy.v AS recovery, nap, minutes, wn, signup, error, CASE WHEN own THEN cy.ts ELSE ni.ts END AS sleep_on, CASE WHEN own THEN cy.later ELSE ni.later END AS wake_on,
  CASE WHEN own THEN CASE WHEN cy.odd THEN cy.v * 2 END ELSE ni.a END AS asleep, CASE WHEN own OR ni.id IS NULL THEN cy.v / 2 ELSE ni.v / 4 END AS rem
  FROM sp LEFT JOIN (SELECT *, id % 2 = 1 AS odd FROM cy) cy ON sp.user_id = cy.user_id AND sp.d = cy.d LEFT JOIN ni ON sp.user_id = ni.user_id AND sp.d = ni.d
  LEFT JOIN na ON sp.user_id = na.user_id AND sp.d = na.d LEFT JOIN wo ON sp.user_id = wo.user_id AND sp.d = wo.d LEFT JOIN an ON sp.user_id = an.user_id AND sp.d = an.d, LATERAL (SELECT coalesce(cy.odd, false) OR ni.id IS NULL AS own))""",
)
put(
    "bedtime_variability",
    "SELECT activity, count(*) AS n, round(stddev_samp(CASE WHEN minute < 720 THEN minute + 1440 ELSE minute END), 4) + 0.0 AS sd FROM e GROUP BY 1",
    SESSIONS,
)
over_daily("marker_rows", "SELECT d, x > 0 AS shipped, row FROM (SELECT *, CAST(date_diff('day', min(d) OVER (), d) AS BIGINT) AS row FROM daily) WHERE y IS NULL")
over_daily("granularity", "SELECT CASE WHEN n > 120 THEN CAST(date_trunc('week', d) AS DATE) ELSE d END AS d, round(avg(y), 4) + 0.0 AS y FROM (SELECT *, count(*) OVER () AS n FROM daily) GROUP BY 1")
over_daily("rolling_mean_7", f"SELECT d, round({rolling('y', 7)}, 4) + 0.0 AS m FROM daily")
over_daily("rolling_mean_28", f"SELECT d, round({rolling('y', 28)}, 4) + 0.0 AS m FROM daily")
over_daily("rolling_sd_28", f"SELECT d, round({deviation('y', 28)}, 3) + 0.0 AS v FROM daily")
over_daily("rolling_z", f"SELECT d, round((y - {rolling('y', 28)}) / nullif({deviation('y', 28)}, 0), 6) + 0.0 AS v FROM daily")
over_daily("acwr", f"SELECT d, round({rolling('x', 7)} / nullif({rolling('x', 28)}, 0), 6) + 0.0 AS v FROM daily")
over_daily("lead_lag", "SELECT d, round(lead(y) OVER (ORDER BY d), 4) + 0.0 AS next, round(lag(x) OVER (ORDER BY d), 4) + 0.0 AS prev FROM daily")
put(
    "panel_rolling",
    """SELECT segment, d, round(CASE WHEN count(y) OVER w >= 2 THEN avg(y) OVER w END, 4) + 0.0 AS m FROM p WINDOW w AS (PARTITION BY segment ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "f AS (SELECT c_mktsegment AS segment, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
    "s AS (SELECT segment, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM f GROUP BY segment)",
    "p AS (SELECT s.segment, s.d, f.y FROM s LEFT JOIN f ON s.segment = f.segment AND s.d = f.d)",
)
over_daily("by_week", "SELECT CAST(date_trunc('week', d) AS DATE) AS week, count(*) AS cnt, round(avg(y), 4) + 0.0 AS mean_y, round(avg(y) * count(*), 3) + 0.0 AS total FROM daily GROUP BY 1")
over_daily("select_window", "SELECT CASE WHEN n <= 90 THEN 'current' ELSE 'previous' END AS period, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM (SELECT d, row_number() OVER (ORDER BY d DESC) AS n FROM daily) WHERE n <= 180 GROUP BY 1")
over_daily("calendar_grid", "SELECT d, CAST(floor(p / 7) AS BIGINT) AS col, CAST(p % 7 AS BIGINT) AS row FROM (SELECT d, date_diff('day', (SELECT min(d) FROM daily), d) + dayofweek((SELECT min(d) FROM daily)) AS p FROM daily)")
over_daily("data_table", "SELECT d, round(y, 4) + 0.0 AS y, round(x, 4) + 0.0 AS x, round(disc, 6) + 0.0 AS disc FROM daily")
over_daily("stacked_total", "SELECT d, round(coalesce(y, 0) + coalesce(x, 0), 4) + 0.0 AS total FROM daily")
over_daily("mean_sd", "SELECT count(y) AS n, round(avg(y), 4) + 0.0 AS mean, round(stddev_samp(y), 4) + 0.0 AS sd FROM daily")
over_daily("median", "SELECT round(quantile_cont(y, 0.5), 4) + 0.0 AS median FROM daily")
over_daily("quantiles", "SELECT CAST(q AS DOUBLE) AS q, round(v, 4) + 0.0 AS value FROM (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS q, unnest(quantile_cont(y, [0.05, 0.25, 0.5, 0.75, 0.95])) AS v FROM daily)")
over_daily("pearson", "SELECT round(corr(x, y), 8) + 0.0 AS r, count(*) AS n FROM daily WHERE x IS NOT NULL AND y IS NOT NULL")
over_daily("linreg", "SELECT round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 3) + 0.0 AS intercept FROM daily")
over_daily(
    "drivers",
    """SELECT metric, round(corr(a, b), 8) + 0.0 AS r, count(*) AS n FROM (
  SELECT 'x' AS metric, x AS a, y AS b FROM nx UNION ALL SELECT 'disc', disc, y FROM nx UNION ALL SELECT 'n_orders', n_orders, y FROM nx UNION ALL SELECT 'x_next', x, next FROM nx)
WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY metric""",
    "nx AS (SELECT *, lead(y) OVER (ORDER BY d) AS next FROM daily)",
)
_WELCH = """round(avg(v) FILTER (g), 4) + 0.0 AS mean_yes, round(avg(v) FILTER (NOT g), 4) + 0.0 AS mean_no, round(avg(v) FILTER (g) - avg(v) FILTER (NOT g), 4) + 0.0 AS delta,
round((avg(v) FILTER (g) - avg(v) FILTER (NOT g)) / sqrt(var_samp(v) FILTER (g) / count(v) FILTER (g) + var_samp(v) FILTER (NOT g) / count(v) FILTER (NOT g)), 8) + 0.0 AS t,
count(v) FILTER (g) AS n_yes, count(v) FILTER (NOT g) AS n_no"""
over_daily("welch_t", f"SELECT {_WELCH} FROM (SELECT y AS v, dayofweek(d) IN (0, 6) AS g FROM daily)")
over_daily("habit_effects", f"SELECT question, {_WELCH} FROM (SELECT question, y AS v, yes AS g FROM j JOIN daily USING (d)) GROUP BY question HAVING count(v) FILTER (g) >= 8 AND count(v) FILTER (NOT g) >= 8", JOURNAL)
over_daily(
    "habit_screen",
    """SELECT question, n_yes, n_no, round((n_yes + n_no) / al, 8) + 0.0 AS coverage, n_yes >= 8 AND n_no >= 8 AND (n_yes + n_no) / al >= 0.6 AS keep
FROM (SELECT question, count(*) FILTER (yes) AS n_yes, count(*) FILTER (NOT yes) AS n_no, (SELECT count(*) FROM daily) AS al FROM j GROUP BY question)""",
    JOURNAL,
)
over_daily("period_value", "SELECT round(a, 4) + 0.0 AS value, round(a - b, 4) + 0.0 AS delta FROM (SELECT avg(y) FILTER (n <= 90) AS a, avg(y) FILTER (n > 90 AND n <= 180) AS b FROM (SELECT y, row_number() OVER (ORDER BY d DESC) AS n FROM daily))")
put("activity_summary", "SELECT l_returnflag AS activity, count(*) AS sessions, round(sum(l_quantity), 4) + 0.0 AS minutes, round(avg(l_discount), 8) + 0.0 AS mean_strain, round(avg(l_tax), 8) + 0.0 AS mean_rate, round(sum(l_extendedprice), 2) + 0.0 AS calories FROM lineitem GROUP BY 1")
put(
    "zone_minutes",
    """SELECT CAST(zone AS BIGINT) AS zone, round(sum(share / 100 * q), 3) + 0.0 AS minutes FROM (
  SELECT 1 AS zone, l_discount * 100 AS share, l_quantity AS q FROM lineitem UNION ALL SELECT 2, l_tax * 100, l_quantity FROM lineitem
  UNION ALL SELECT 3, 100 - (l_discount + l_tax) * 100, l_quantity FROM lineitem) GROUP BY 1""",
)
over_daily("weekday_deviation", "SELECT CAST(dayofweek(d) AS BIGINT) AS weekday, round(avg(y), 4) + 0.0 AS mean, round(avg(y) - (SELECT avg(y) FROM daily), 4) + 0.0 AS deviation, count(y) AS n FROM daily GROUP BY 1")
over_daily(
    "describe_vars",
    "SELECT id, count(v) AS n, count(*) - count(v) AS missing, round(avg(v), 4) + 0.0 AS mean, round(stddev_samp(v), 4) + 0.0 AS sd FROM (SELECT 'y' AS id, y * 0.001 AS v FROM daily UNION ALL SELECT 'x', x FROM daily UNION ALL SELECT 'disc', disc * 100 FROM daily UNION ALL SELECT 'n_orders', n_orders FROM daily) GROUP BY id",
)
over_daily(
    "binding_variable",
    """SELECT id, without_n, current_n, without_n >= 150 AS decisive FROM (
  SELECT 1 AS i, 'y' AS id, count(*) FILTER (half IS NOT NULL AND most IS NOT NULL) AS without_n, count(*) FILTER (y IS NOT NULL AND half IS NOT NULL AND most IS NOT NULL) AS current_n FROM sparse
  UNION ALL SELECT 2, 'half', count(*) FILTER (y IS NOT NULL AND most IS NOT NULL), count(*) FILTER (y IS NOT NULL AND half IS NOT NULL AND most IS NOT NULL) FROM sparse
  UNION ALL SELECT 3, 'most', count(*) FILTER (y IS NOT NULL AND half IS NOT NULL), count(*) FILTER (y IS NOT NULL AND half IS NOT NULL AND most IS NOT NULL) FROM sparse)
WHERE without_n > current_n ORDER BY without_n DESC, i LIMIT 1""",
    SPARSE,
)
over_daily("best_worst_day", "(SELECT 'best' AS kind, d, round(y, 4) + 0.0 AS y FROM daily WHERE y IS NOT NULL ORDER BY daily.y DESC, d LIMIT 1) UNION ALL (SELECT 'worst', d, round(y, 4) + 0.0 FROM daily WHERE y IS NOT NULL ORDER BY daily.y, d LIMIT 1)")
over_daily("best_worst_weekday", "SELECT arg_max(w, m) AS best, arg_min(w, m) AS worst FROM (SELECT CAST(dayofweek(d) AS BIGINT) AS w, avg(y) AS m FROM daily GROUP BY 1) HAVING count(*) = 7")
over_daily("band_share", "SELECT round(100.0 * count(*) FILTER (disc * 1000 >= 53) / count(disc), 6) + 0.0 AS high_share, round(100.0 * count(*) FILTER (disc * 1000 < 47) / count(disc), 6) + 0.0 AS low_share FROM daily")
over_daily("slope_from_r", "SELECT round((SELECT corr(x, y) FROM daily) * stddev_samp(y) / stddev_samp(x), 6) + 0.0 AS slope, (SELECT count(*) FROM daily WHERE x IS NOT NULL AND y IS NOT NULL) AS n FROM daily")
over_daily(
    "latest_nonnull",
    "SELECT id, max(d) AS d, round(arg_max(v, d), 6) + 0.0 AS value FROM (SELECT 'y' AS id, d, y AS v FROM sparse UNION ALL SELECT 'half', d, half FROM sparse UNION ALL SELECT 'most', d, most FROM sparse) WHERE v IS NOT NULL GROUP BY id",
    SPARSE,
)
put("topk", "SELECT o_custkey, round(sum(o_totalprice), 2) + 0.0 AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 14")
over_daily("extent", "SELECT round(min(y), 4) + 0.0 AS y_min, round(max(y), 4) + 0.0 AS y_max, round(min(x), 4) + 0.0 AS x_min, round(max(x), 4) + 0.0 AS x_max FROM daily")
put("parse_boolean", "SELECT o_orderkey, o_orderkey % 7 IN (0, 2, 3, 4) AS parsed FROM orders")
put(
    "cycle_day",
    "SELECT id, CASE WHEN id % 3 = 0 THEN d ELSE CAST(d + CAST(hour(ts) >= 18 AS INTEGER) AS DATE) END AS day, CASE WHEN id % 3 = 0 THEN d ELSE CAST(d + CAST(hour(ts) >= 18 AS INTEGER) AS DATE) END AS workout FROM e",
    SESSIONS,
)
over_daily("iso_week", "SELECT d, CAST(date_trunc('week', d) AS DATE) AS week, CAST(dayofweek(d) AS BIGINT) AS weekday, CAST(month(d) - 1 AS BIGINT) AS month FROM daily")
put("minute_of_day", "SELECT id, minute, CASE WHEN minute < 720 THEN minute + 1440 ELSE minute END AS bedtime, minute AS wrapped FROM e", SESSIONS)
over_daily("guarded_ratio", "SELECT d, round(x * 100 / nullif(CASE WHEN day(d) = 1 THEN 0 ELSE y END, 0), 8) + 0.0 AS share FROM daily")
put(
    "band",
    """SELECT o_orderkey, CASE WHEN v IS NULL THEN 'none' WHEN v < 34 THEN 'low' WHEN v < 67 THEN 'mid' ELSE 'high' END AS band, CASE WHEN v >= 90 THEN 'high' WHEN v >= 70 THEN 'mid' WHEN v IS NOT NULL THEN 'low' END AS performance,
CASE WHEN v / 50 > 1.35 THEN 'rising' WHEN v / 50 < 0.8 THEN 'falling' WHEN v IS NOT NULL THEN 'steady' END AS verdict, CASE WHEN v / 25 - 2 < -1 THEN 'below' WHEN v / 25 - 2 > 1 THEN 'above' WHEN v IS NOT NULL THEN 'usual' END AS zband
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN fmod(o_totalprice, 100.0) END AS v FROM orders)""",
)
over_daily("kpi_tone", "SELECT d, CASE WHEN x IS NULL OR abs(x) < 1e-9 THEN 'neutral' WHEN sign(x) = -1 THEN 'up' ELSE 'down' END AS tone FROM (SELECT d, y - lag(y) OVER (ORDER BY d) AS x FROM daily)")
over_daily(
    "nice_ticks",
    """SELECT week, round(step, 6) + 0.0 AS step, round(floor(lo / step) * step, 6) + 0.0 AS low, round(ceil(hi / step) * step, 6) + 0.0 AS high FROM (
  SELECT week, lo, hi, p * CASE WHEN p >= raw THEN 1 WHEN p * 2 >= raw THEN 2 WHEN p * 2.5::DOUBLE >= raw THEN 2.5::DOUBLE WHEN p * 5 >= raw THEN 5 ELSE 10 END AS step FROM (
    SELECT week, lo, hi, (hi - lo) / 4 AS raw, pow(10.0::DOUBLE, floor(log10((hi - lo) / 4))) AS p FROM (
      SELECT week, CASE WHEN a = b THEN a - 1 ELSE a END AS lo, CASE WHEN a = b THEN b + 1 ELSE b END AS hi FROM (
        SELECT CAST(date_trunc('week', d) AS DATE) AS week, floor(min(y)) AS a, ceil(max(y)) AS b FROM daily GROUP BY 1 HAVING min(y) IS NOT NULL))))""",
)
put("clock_angle", "SELECT id, round(minute / 1440 * 2 * pi() - pi() / 2, 8) + 0.0 AS angle, CASE WHEN (minute * 7) % 1440 >= minute THEN (minute * 7) % 1440 - minute ELSE (minute * 7) % 1440 + 1440 - minute END AS span FROM e", SESSIONS)
put(
    "shorten_text",
    """SELECT doc_id, CASE WHEN length(b) > 34 THEN rtrim(substr(b, 1, 33)) || '…' ELSE b END AS out FROM (
  SELECT doc_id, regexp_replace(regexp_replace(CASE doc_id % 4 WHEN 0 THEN 'Have you ' WHEN 1 THEN 'Did you  ' WHEN 2 THEN 'Have ' ELSE '' END || regexp_replace(text, '[^A-Za-z]+', '_', 'g') || '?',
    '^(?i:Have you|Did you|Do you|Have|Did)\\s+', ''), '\\?$', '') AS b FROM documents)""",
)
put(
    "shorten_text_all",
    """SELECT doc_id, CASE WHEN length(b) > 34 THEN rtrim(substr(b, 1, 33), ' ') || '…' ELSE b END AS out FROM (
  SELECT doc_id, regexp_replace(regexp_replace(text, '^(?i:Have you|Did you|Do you|Have|Did)\\s+', ''), '\\?$', '') AS b FROM documents)""",
)
put(
    "fmt_numbers",
    "SELECT o_orderkey, format('{:,}', v) AS whole, CASE WHEN v > 500 THEN '+' ELSE '' END || format('{:,}', v - 500) || ' ms' AS signed, format('{:,}', v) || ' %' AS unit FROM (SELECT o_orderkey, CAST(o_orderkey * 37 % 100000 AS BIGINT) AS v FROM orders)",
)
put(
    "significant",
    "SELECT o_orderkey, CASE WHEN v = 0 THEN 0.0 ELSE round(round(v * s) / s, 6) + 0.0 END AS sig FROM (SELECT o_orderkey, v, CASE WHEN v <> 0 THEN pow(10.0::DOUBLE, 2 - floor(log10(abs(v)))) END AS s FROM (SELECT o_orderkey, floor(o_totalprice / pow(10.0::DOUBLE, o_orderkey % 7) * 1000) / 1000 AS v FROM orders))",
)
put("fmt_duration", "SELECT id, CAST(minute // 60 AS VARCHAR) || 'h ' || lpad(CAST(minute % 60 AS VARCHAR), 2, '0') || 'm' AS out FROM e", SESSIONS)
over_daily("fmt_day", "SELECT d, strftime(d, '%-d %b') AS short, strftime(d, '%a %-d %b %Y') AS long FROM daily")
put("fmt_clock", "SELECT id, lpad(CAST(minute // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute % 60 AS VARCHAR), 2, '0') AS out FROM e", SESSIONS)
put("category_slot", "SELECT CAST(k AS BIGINT) AS c_nationkey, CASE WHEN n < 8 THEN CAST(n AS VARCHAR) ELSE 'other' END AS slot FROM (SELECT c_nationkey AS k, row_number() OVER (ORDER BY count(*) * 1000 - c_nationkey DESC) - 1 AS n FROM customer GROUP BY c_nationkey)")


def _bh(columns: str, source: str, partition: str) -> str:
    by = f"PARTITION BY {partition} " if partition else ""
    return f"""SELECT {columns}, round(least(1.0, min(m / rank * p) OVER ({by}ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) + 0.0 AS q, CAST(rank AS BIGINT) AS rank,
least(1.0, min(m / rank * p) OVER ({by}ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) <= 0.9 AS sig
FROM (SELECT *, row_number() OVER ({by}ORDER BY p, id) AS rank, count(*) OVER ({by.strip()}) AS m FROM {source} WHERE p IS NOT NULL)
UNION ALL SELECT {columns}, NULL, NULL, false FROM {source} WHERE p IS NULL"""


put("bh_qvalues", _bh("id, p", "pv", ""), PVALUES)
SQL["bh_qvalues_all"] = SQL["bh_qvalues"]
put(
    "fmt_p",
    """SELECT id, CASE WHEN v IS NULL THEN '—' ELSE a END AS alone, CASE WHEN v < 0.001 THEN a ELSE '= ' || CASE WHEN v IS NULL THEN '—' ELSE a END END AS told FROM (
  SELECT id, v, CASE WHEN v < 0.001 THEN '< 0.001' ELSE CAST(round(v * s) / s AS VARCHAR) END AS a FROM (SELECT id, v, pow(10.0::DOUBLE, 1 - floor(log10(abs(v)))) AS s FROM (SELECT id, pow(p, 3) AS v FROM pv)))""",
    PVALUES,
)
put("family_bh", _bh("family, id", "pv", "family"), PVALUES)
_SCORES = """m AS (SELECT date_diff('day', DATE '1970-01-01', d) AS t, x - avg(x) OVER () AS dx, y - avg(y) OVER () AS dy, count(*) OVER () AS n FROM daily WHERE x IS NOT NULL AND y IS NOT NULL),
b AS (SELECT sum(dx * dy) / sum(dx * dx) AS b, sum(dx * dx) AS sxx, any_value(n) AS n FROM m),
s AS (SELECT t, dx * (dy - b.b * dx) AS s FROM m, b)"""
def _two_slopes(source: str, g: str) -> str:
    """Both slopes of y on a, b and a constant within g, with HC1 and HAC errors; the constant is partialled out."""
    return f"""m AS (SELECT {g} AS g, t, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b, y - avg(y) OVER w AS y, count(*) OVER w AS n FROM ({source}) WINDOW w AS (PARTITION BY {g})),
q AS (SELECT g, any_value(n) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS "by" FROM m GROUP BY g),
c AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * "by") / (aa * bb - ab * ab) AS ca, (aa * "by" - ab * ay) / (aa * bb - ab * ab) AS cb, least(floor(4 * pow(n / 100.0, 2 / 9.0)), n - 1) AS width FROM q),
s AS (SELECT m.g, t, a * (y - ca * a - cb * b) AS sa, b * (y - ca * a - cb * b) AS sb FROM m JOIN c USING (g)),
ds AS (SELECT g, t, sum(sa) AS sa, sum(sb) AS sb FROM s GROUP BY g, t),
pair AS (SELECT p.g, p.sa AS pa, p.sb AS pb, q.sa AS qa, q.sb AS qb, 1 - (q.t - p.t) / (width + 1) AS w FROM ds p JOIN c USING (g) JOIN ds q ON p.g = q.g AND q.t > p.t AND q.t - p.t <= width),
meat AS (SELECT g, 'hc1' AS kind, sum(sa * sa) AS maa, sum(sa * sb) AS mab, sum(sb * sb) AS mbb FROM s GROUP BY g
  UNION ALL SELECT g, 'hac', sum(aa), sum(ab), sum(bb) FROM (SELECT g, sa * sa AS aa, sa * sb AS ab, sb * sb AS bb FROM ds UNION ALL SELECT g, 2 * w * pa * qa, w * (pa * qb + pb * qa), 2 * w * pb * qb FROM pair) GROUP BY g),
f AS (SELECT g, kind, n, CASE WHEN kind = 'hac' THEN CAST(width AS BIGINT) END AS bandwidth, ca, cb, sqrt((bb * bb * maa - 2 * bb * ab * mab + ab * ab * mbb) / (det * det) * n / (n - 3)) AS ea, sqrt((ab * ab * maa - 2 * aa * ab * mab + aa * aa * mbb) / (det * det) * n / (n - 3)) AS eb FROM c JOIN meat USING (g))"""


_ITEMS = "SELECT date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS t, l_returnflag, l_extendedprice / 1e4 AS y, l_quantity AS a, l_discount * 100 AS b FROM lineitem"
for _name, _g, _shown in (("ols_lineitems", "1", ""), ("ols_lineitems_keyed", "l_returnflag", "g AS l_returnflag, ")):
    put(
        _name,
        f"SELECT kind, {_shown}'a' AS term, round(ca, 8) + 0.0 AS coef, round(ea, 8) + 0.0 AS se, n, bandwidth FROM f UNION ALL SELECT kind, {_shown}'b', round(cb, 8) + 0.0, round(eb, 8) + 0.0, n, bandwidth FROM f",
        _two_slopes(_ITEMS, _g),
    )
over_daily("ols_hc1_simple", "SELECT round(b, 6) + 0.0 AS coef, round(sqrt((SELECT sum(s * s) FROM s) * n / (n - 2)) / sxx, 6) + 0.0 AS se, n FROM b", _SCORES)
over_daily(
    "ols_hac_simple",
    """SELECT round(b, 6) + 0.0 AS coef, round(sqrt(((SELECT sum(s * s) FROM s) + 2 * (SELECT sum(p.s * q.s * (1 - (q.t - p.t) / (w + 1))) FROM s p, s q, bw WHERE q.t > p.t AND q.t - p.t <= w)) * n / (n - 2)) / sxx, 6) + 0.0 AS se, n, w AS bandwidth FROM b, bw""",
    _SCORES,
    "bw AS (SELECT CAST(floor(4 * pow(n / 100, 2.0 / 9)) AS BIGINT) AS w FROM b)",
)


def _binned(x: str) -> str:
    return f"SELECT {x} AS x, y, ((r + 1) * 20 - 1) // n AS bin FROM (SELECT {x}, y, row_number() OVER (ORDER BY {x}, d) - 1 AS r, count(*) OVER () AS n FROM daily WHERE {x} IS NOT NULL AND y IS NOT NULL)"


over_daily("binscatter", f"SELECT CAST(bin AS BIGINT) AS bin, round(avg(x), 4) + 0.0 AS x, round(avg(y), 4) + 0.0 AS y, round(stddev_samp(y) / sqrt(count(*)), 4) + 0.0 AS se, count(*) AS n, round(min(x), 4) + 0.0 AS x_low, round(max(x), 4) + 0.0 AS x_high FROM ({_binned('x')}) GROUP BY bin HAVING count(*) >= 3")
over_daily("dose_response", f"SELECT CAST(bin AS BIGINT) AS bin, round(avg(x), 8) + 0.0 AS x, round(avg(y), 4) + 0.0 AS y, count(*) AS n FROM ({_binned('disc')}) GROUP BY bin HAVING count(*) >= 3")
over_daily(
    "loess",
    """SELECT round(gx, 6) + 0.0 AS x, round(swy / sw + CASE WHEN abs(swxx - swx * swx / sw) <= 1e-12 * greatest(1.0, abs(swxx)) THEN 0 ELSE (swxy - swx * swy / sw) / (swxx - swx * swx / sw) END * (gx - swx / sw), 6) + 0.0 AS y
FROM (SELECT g, gx, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy, sum(w * x * x) AS swxx, sum(w * x * y) AS swxy FROM (
  SELECT g, gx, x, y, CASE WHEN mx <= 0 THEN 1 ELSE pow(1 - pow(dist / mx, 3), 3) END AS w FROM (SELECT *, max(dist) OVER (PARTITION BY g) AS mx FROM (
    SELECT g, gx, x, y, size, abs(x - gx) AS dist, row_number() OVER (PARTITION BY g ORDER BY abs(x - gx), x, d) AS k FROM pr, grid) WHERE k <= size)) GROUP BY g, gx)""",
    "pr AS (SELECT d, x / 1e3 AS x, y / 1e5 AS y FROM daily WHERE x IS NOT NULL AND y IS NOT NULL)",
    "grid AS (SELECT g, a + g * ((b - a) / 59) AS gx, greatest(2, least(n, floor(0.35 * n + 0.5))) AS size FROM (SELECT min(x) AS a, max(x) AS b, count(*) AS n FROM pr), (SELECT unnest(range(60)) AS g))",
)
over_daily("support_gaps", "SELECT round(lo, 4) + 0.0 AS lo, round(hi, 4) + 0.0 AS hi, round(hi - lo, 4) + 0.0 AS width, round((hi - lo) / rg, 8) + 0.0 AS share FROM (SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi, max(x) OVER () - min(x) OVER () AS rg FROM (SELECT DISTINCT x FROM daily WHERE x IS NOT NULL)) WHERE hi IS NOT NULL AND (hi - lo) / rg >= 0.01")
over_daily(
    "histogram_fd",
    """SELECT CAST(bin AS BIGINT) AS bin, round(lo + bin * step, 4) + 0.0 AS "from", round(lo + (bin + 1) * step, 4) + 0.0 AS "to", count(x) AS cnt, round(count(x) / (n * step), 9) + 0.0 AS density
FROM (SELECT lo, n, step, b, unnest(range(b)) AS bin FROM sh) LEFT JOIN (SELECT x, least(b - 1, CAST(floor((x - lo) / step) AS BIGINT)) AS slot FROM daily, sh WHERE x IS NOT NULL) ON slot = bin GROUP BY bin, lo, step, n""",
    "sp AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM daily)",
    "sh AS (SELECT lo, n, b, (hi - lo) / b AS step FROM (SELECT *, CAST(least(60, greatest(4, ceil((hi - lo) / (2 * iqr * pow(n, -1.0 / 3))))) AS BIGINT) AS b FROM sp))",
)
over_daily("silverman_bw", "SELECT count(x) AS n, round(0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * pow(count(x), -0.2), 6) + 0.0 AS h FROM daily")
_KDE = (
    "v AS (SELECT x / 100 AS v FROM daily WHERE x IS NOT NULL)",
    "sp AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, 0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * pow(count(*), -0.2) AS h FROM v)",
    "sh AS (SELECT n, h, lo - 3 * h AS g0, (hi - lo + 6 * h) / 511 AS step, CAST(ceil(4 * h / ((hi - lo + 6 * h) / 511)) AS BIGINT) AS reach FROM sp)",
    "pos AS (SELECT (v - g0) / step AS p, least(510, CAST(floor((v - g0) / step) AS BIGINT)) AS c FROM v, sh)",
    "cells AS (SELECT c, sum(w) AS w FROM (SELECT c, 1 - (p - c) AS w FROM pos UNION ALL SELECT c + 1, p - c FROM pos) GROUP BY c)",
    "curve AS (SELECT i, g0 + i * step AS x, coalesce((SELECT sum(w * exp(-0.5 * pow((i - c) * step / h, 2))) FROM cells WHERE abs(i - c) <= reach), 0) / ((SELECT sum(w) FROM cells) * h * sqrt(2 * pi())) AS y FROM sh, (SELECT unnest(range(512)) AS i))",
)
over_daily("kde", "SELECT CAST(i AS BIGINT) AS i, round(x, 6) + 0.0 AS x, round(y, 8) + 0.0 AS y FROM curve", *_KDE)
over_daily(
    "density_peaks",
    "SELECT round((a + b) / 2, 6) + 0.0 AS x, round(y, 7) + 0.0 AS y, row_number() OVER (ORDER BY y DESC, (a + b) / 2) AS rank FROM nb WHERE y > coalesce(lf, 0) AND y > coalesce(rt, 0) AND y > 1e-3 * top",
    *_KDE,
    "ry AS (SELECT i, x, round(y, 9) AS y FROM curve)",
    "runs AS (SELECT *, sum(new) OVER (ORDER BY i) AS run FROM (SELECT *, CASE WHEN y IS DISTINCT FROM lag(y) OVER (ORDER BY i) THEN 1 ELSE 0 END AS new FROM ry))",
    "flat AS (SELECT run, min(x) AS a, max(x) AS b, any_value(y) AS y FROM runs GROUP BY run)",
    "nb AS (SELECT *, lag(y) OVER (ORDER BY run) AS lf, lead(y) OVER (ORDER BY run) AS rt, max(y) OVER () AS top FROM flat)",
)
over_daily(
    "cusum",
    "SELECT d, round(z, 6) + 0.0 AS z, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, signal FROM walk WHERE i > 0",
    "st AS (SELECT avg(y) AS m, stddev_samp(y) AS s FROM daily)",
    "pts AS (SELECT row_number() OVER (ORDER BY d) AS i, d, (y - m) / s AS z FROM daily, st)",
    """walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS d, CAST(NULL AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS high, CAST(0 AS DOUBLE) AS low, CAST(NULL AS VARCHAR) AS signal
  UNION ALL SELECT i, d, z, hi, lo, CASE WHEN z IS NULL THEN NULL WHEN hi > 5 THEN 'high' WHEN lo > 5 THEN 'low' END FROM (
    SELECT p.i, p.d, p.z, CASE WHEN p.z IS NULL THEN h ELSE greatest(0, h + p.z - 0.5) END AS hi, CASE WHEN p.z IS NULL THEN l ELSE greatest(0, l - p.z - 0.5) END AS lo
    FROM (SELECT i, CASE WHEN signal = 'high' THEN 0 ELSE high END AS h, CASE WHEN signal = 'low' THEN 0 ELSE low END AS l FROM walk) w JOIN pts p ON p.i = w.i + 1))""",
)
SQL["control_chart"] = SQL["cusum"].replace("avg(y) AS m, stddev_samp(y)", "avg(x) AS m, stddev_samp(x)").replace("(y - m) / s", "(x - m) / s")
over_daily(
    "changepoint_single",
    """SELECT d, round(ls / i, 6) + 0.0 AS before, round((ts - ls) / (n - i), 6) + 0.0 AS after, round(-(n * ln(sse / total) + 2 * ln(n)), 4) + 0.0 AS bic_gain FROM (
  SELECT *, lq - ls * ls / i + (tq - lq) - pow(ts - ls, 2) / (n - i) AS sse, tq - ts * ts / n AS total FROM cum WHERE i >= 10 AND n - i >= 10) WHERE sse > 0 ORDER BY sse, i LIMIT 1""",
    "v AS (SELECT d, x / 1000 + CASE WHEN d >= DATE '1998-03-01' THEN 0.5 ELSE 0 END AS v FROM daily WHERE x IS NOT NULL)",
    "cum AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n, sum(v) OVER (ORDER BY d) - v AS ls, sum(v * v) OVER (ORDER BY d) - v * v AS lq, sum(v) OVER () AS ts, sum(v * v) OVER () AS tq FROM v)",
)


# At the highest frequency whole days have no sine: the quotient of its two sums is rounding noise, and counts as zero.
def _periodogram(series: str) -> tuple[str, ...]:
    return (
        f"obs AS ({series})",
        "sp AS (SELECT series, count(*) AS n, avg(v) AS m, var_samp(v) AS var, max(t) - min(t) AS span FROM obs GROUP BY series)",
        "gr AS (SELECT series, n, m, var, k, 2 * pi() * (2 / span + k * (1 / (span * 5))) AS w FROM (SELECT *, unnest(range(CAST(floor((0.5 + 1e-12 - 2 / span) / (1 / (span * 5))) AS BIGINT) + 1)) AS k FROM sp))",
        "ph AS (SELECT g.series, k, atan2(sum(sin(2 * w * t)), sum(cos(2 * w * t))) / 2 AS tau FROM gr g JOIN obs o ON g.series = o.series GROUP BY g.series, k)",
        """pw AS (SELECT g.series, g.k, g.n, 2 * pi() / any_value(g.w) AS period, (pow(sum((v - m) * cos(w * t - tau)), 2) / sum(pow(cos(w * t - tau), 2)) + CASE WHEN sum(pow(sin(w * t - tau), 2)) > 1e-12 * count(*) THEN pow(sum((v - m) * sin(w * t - tau)), 2) / sum(pow(sin(w * t - tau), 2)) ELSE 0 END) / (2 * any_value(var)) AS power
  FROM gr g JOIN ph ON g.series = ph.series AND g.k = ph.k JOIN obs o ON g.series = o.series GROUP BY g.series, g.k, g.n)""",
        "fa AS (SELECT *, greatest(1, round(-6.362 + 1.193 * n + 0.00098 * n * n)) AS mi FROM pw)",
        "ls AS (SELECT *, CASE WHEN exp(-power) < 1e-8 THEN mi * exp(-power) ELSE 1 - pow(1 - exp(-power), mi) END AS fap FROM fa)",
    )


_SINCE = "FROM (SELECT *, date_diff('day', min(d) OVER (), d) AS t FROM daily)"
over_daily("lomb_scargle", "SELECT round(period, 6) + 0.0 AS period, round(power, 6) + 0.0 AS power, round(fap, 6) + 0.0 AS fap FROM ls", *_periodogram(f"SELECT 'y' AS series, t, y AS v {_SINCE} WHERE y IS NOT NULL"))
over_daily(
    "rhythms",
    """SELECT series, round(period, 6) + 0.0 AS period, round(power, 6) + 0.0 AS power, round(fap, 6) + 0.0 AS fap, round(least(1.0, min(2 / rk * fap) OVER (ORDER BY rk DESC)), 6) + 0.0 AS q, weekly
FROM (SELECT *, row_number() OVER (ORDER BY fap, series) AS rk FROM (SELECT series, arg_max(period, (power, -period)) AS period, max(power) AS power, arg_max(fap, (power, -period)) AS fap,
  bool_or(abs(period - 7) < 0.35 AND power > -ln(greatest(1e-15, 1 - pow(0.95, 1 / mi)))) AS weekly FROM ls GROUP BY series))""",
    *_periodogram(f"SELECT 'y' AS series, t, y AS v {_SINCE} WHERE y IS NOT NULL UNION ALL SELECT 'x', t, x {_SINCE} WHERE x IS NOT NULL"),
)
SQL["lomb_scargle_all"], SQL["rhythms_all"] = SQL["lomb_scargle"], SQL["rhythms"]
_BED = "CASE WHEN minute < 720 THEN minute + 1440 ELSE minute END"
put(
    "clock_quartiles",
    "SELECT kind, count(*) AS n, round(fmod(quantile_cont(v, 0.25), 1440), 4) + 0.0 AS q1, round(fmod(quantile_cont(v, 0.5), 1440), 4) + 0.0 AS med, round(fmod(quantile_cont(v, 0.75), 1440), 4) + 0.0 AS q3 "
    f"FROM (SELECT 'bedtime' AS kind, CAST({_BED} AS DOUBLE) AS v FROM e UNION ALL SELECT 'wake', CAST(minute AS DOUBLE) FROM e) GROUP BY kind",
    SESSIONS,
)
put(
    "sleep_window",
    f"SELECT n >= 21 AS ok, n, CAST(21 AS BIGINT) AS min_n, CAST(greatest(0, 21 - n) AS BIGINT) AS missing, round(b, 4) + 0.0 AS bed, round(w, 4) + 0.0 AS wake, round(w + 1440 - CASE WHEN b < 720 THEN b + 1440 ELSE b END, 4) + 0.0 AS window_minutes FROM (SELECT count(*) AS n, fmod(quantile_cont(CAST({_BED} AS DOUBLE), 0.5), 1440) AS b, fmod(quantile_cont(CAST(minute AS DOUBLE), 0.5), 1440) AS w FROM e)",
    SESSIONS,
)
put("clock_sessions", "SELECT activity, count(*) AS sessions, round(sum(strain), 4) + 0.0 AS strain, round(max(strain), 4) + 0.0 AS max_strain FROM e WHERE strain IS NOT NULL GROUP BY 1", SESSIONS)
put("clock_hours", "SELECT CAST(minute // 60 AS BIGINT) AS hour, round(CASE WHEN count(strain) >= 5 THEN avg(strain) END, 4) + 0.0 AS mean, count(strain) AS n FROM e GROUP BY 1", SESSIONS)
put(
    "activity_week_load",
    """SELECT t.activity, w.week, round(a.strain, 4) + 0.0 AS strain, coalesce(a.sessions, 0) AS sessions, t.rk FROM t CROSS JOIN w LEFT JOIN (
  SELECT activity, CAST(date_trunc('week', d) AS DATE) AS week, sum(strain) AS strain, count(*) AS sessions FROM s GROUP BY 1, 2) a ON a.activity = t.activity AND a.week = w.week""",
    "s AS (SELECT l_returnflag || l_linestatus AS activity, CAST(l_shipdate AS DATE) AS d, l_quantity AS strain FROM lineitem)",
    "t AS (SELECT activity, row_number() OVER (ORDER BY sum(strain) DESC, activity) AS rk FROM s GROUP BY activity QUALIFY rk <= 12)",
    "w AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('week', min(d)) AS DATE), CAST(date_trunc('week', max(d)) AS DATE), INTERVAL 7 DAY)) AS DATE) AS week FROM s)",
)


def _z(x: str) -> str:
    return f"(({x} - {rolling(x, 28)}) / nullif({deviation(x, 28)}, 0))"


over_daily("illness_index", f"SELECT d, round(i, 6) + 0.0 AS index, coalesce(round(i, 6) > 1.5, false) AS flag FROM (SELECT d, ({_z('x')} + {_z('n_orders')} - {_z('y')}) / 3 AS i FROM daily)")
over_daily("variation", f"SELECT d, round({deviation('y', 28)} / {rolling('y', 28)} * 100, 6) + 0.0 AS cv FROM daily")
over_daily("streaks", "SELECT min(d) AS first, max(d) AS last, count(*) AS length FROM (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS g FROM daily WHERE x >= 1) GROUP BY g")
over_daily("monotony", "SELECT CAST(date_trunc('week', d) AS DATE) AS week, round(avg(x) / nullif(stddev_samp(x), 0), 6) + 0.0 AS monotony, round(avg(x) / nullif(stddev_samp(x), 0) * sum(x), 3) + 0.0 AS load FROM daily GROUP BY 1")

put(
    "activity_remainder",
    "SELECT count(*) AS activities, round(coalesce(sum(t), 0), 4) + 0.0 AS strain FROM (SELECT t, row_number() OVER (ORDER BY t DESC, a) AS rk FROM (SELECT CAST(l_suppkey AS VARCHAR) AS a, sum(l_quantity) AS t FROM lineitem GROUP BY 1)) WHERE rk > 12",
)


def t_p(t: str, df: str, rows: str) -> str:
    """``id, p``: two-sided p-values of ``id, t, df`` rows, from the density of Student's t by Simpson's rule."""
    n = 4000
    return f"""tp AS (SELECT id, 1 - 2 * any_value(c) * any_value(h) / 3 * sum(CASE WHEN k = 0 OR k = {n} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(k * h, 2) / df, -(df + 1) / 2)) AS p
  FROM (SELECT id, df, abs(t) / {n} AS h, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS c, unnest(range({n + 1})) AS k FROM (SELECT id, {t} AS t, CAST({df} AS DOUBLE) AS df FROM {rows})) GROUP BY id)"""


over_daily(
    "p_of_r",
    "SELECT id AS metric, n, round(r, 8) + 0.0 AS r, round(p, 8) + 0.0 AS p FROM rs JOIN tp USING (id)",
    "rs AS (SELECT 'x' AS id, corr(x, y) AS r, count(x + y) AS n FROM daily UNION ALL SELECT 'disc', corr(disc, y), count(disc + y) FROM daily UNION ALL SELECT 'n_orders', corr(n_orders, y), count(n_orders + y) FROM daily)",
    t_p("r * sqrt((n - 2) / (1 - r * r))", "n - 2", "rs"),
)
put(
    "pack_rows",
    """SELECT user_id, d AS day, id AS ord, raw AS span, is_on, CAST(row - 1 AS BIGINT) AS row, CAST(wide + slack // cnt + CASE WHEN place < slack % cnt THEN 1 ELSE 0 END AS BIGINT) AS width FROM (
  SELECT *, 12 - sum(used1) OVER g AS slack, count(*) OVER g AS cnt, row_number() OVER (PARTITION BY user_id, d, row ORDER BY k) - 1 AS place FROM walk WINDOW g AS (PARTITION BY user_id, d, row))""",
    SESSIONS,
    "it AS (SELECT user_id, d, id, 3 + id % 3 * 3 AS raw, id % 4 <> 0 AS is_on, row_number() OVER (PARTITION BY user_id, d ORDER BY id) AS k FROM e)",
    "ru AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, d, is_on ORDER BY k) AS run FROM it)",
    "wi AS (SELECT *, CASE WHEN is_on THEN raw ELSE CASE count(*) OVER (PARTITION BY user_id, d, is_on, run) WHEN 1 THEN 12 WHEN 2 THEN 6 ELSE 4 END END AS wide FROM ru)",
    "wk AS (SELECT *, least(12, greatest(1, wide)) AS used1 FROM wi)",
    """walk AS (SELECT user_id, d, id, raw, is_on, k, wide, used1, CAST(1 AS BIGINT) AS row, CAST(used1 AS BIGINT) AS used FROM wk WHERE k = 1
  UNION ALL SELECT user_id, d, id, raw, is_on, k, wide, used1, CASE WHEN shut THEN row + 1 ELSE row END, CASE WHEN shut THEN used1 ELSE used + used1 END FROM (
    SELECT n.*, w.row, w.used, w.used + n.used1 > 12 OR w.is_on <> n.is_on AS shut FROM walk w JOIN wk n ON n.user_id = w.user_id AND n.d = w.d AND n.k = w.k + 1))""",
)
_ORDER_CYCLES = 'SELECT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS TIMESTAMP) AS "start", CAST(o_orderdate + INTERVAL 7 HOUR AS TIMESTAMP) AS "wakeOnset", CAST(o_custkey AS DOUBLE) AS recovery, CAST(o_orderkey AS DOUBLE) AS "maxHr" FROM orders'
put("csv_cycles", _ORDER_CYCLES)
put("src_zip_csv", _ORDER_CYCLES)
put(
    "csv_journal",
    """SELECT CAST(o_orderdate AS DATE) + 1 AS day, o_orderpriority AS question, o_orderstatus = 'F' AS yes, 'a "note",' || chr(10) || 'line ' || o_orderkey AS notes FROM orders""",
)
# The Cholesky factor of the cross products is the triangle of the QR factorisation.
put(
    "tree_qr",
    """SELECT i, j, round(v, 4) + 0.0 AS v FROM (
  SELECT CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, r11 AS v FROM c4 UNION ALL SELECT 1, 2, r12 FROM c4 UNION ALL SELECT 1, 3, r13 FROM c4 UNION ALL SELECT 1, 4, r14 FROM c4 UNION ALL SELECT 2, 2, r22 FROM c4
  UNION ALL SELECT 2, 3, r23 FROM c4 UNION ALL SELECT 2, 4, r24 FROM c4 UNION ALL SELECT 3, 3, r33 FROM c4 UNION ALL SELECT 3, 4, r34 FROM c4 UNION ALL SELECT 4, 4, sqrt(sdd - r14 * r14 - r24 * r24 - r34 * r34) FROM c4)""",
    "li AS (SELECT l_quantity AS a, l_extendedprice / 1e4 AS b, l_discount * 100 AS c FROM lineitem)",
    "su AS (SELECT count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc, sum(a * a) AS sbb, sum(a * b) AS sbc, sum(a * c) AS sbd, sum(b * b) AS scc, sum(b * c) AS scd, sum(c * c) AS sdd FROM li)",
    "c1 AS (SELECT *, sqrt(n) AS r11, sa / sqrt(n) AS r12, sb / sqrt(n) AS r13, sc / sqrt(n) AS r14 FROM su)",
    "c2 AS (SELECT *, sqrt(sbb - r12 * r12) AS r22 FROM c1)",
    "c3 AS (SELECT *, (sbc - r12 * r13) / r22 AS r23, (sbd - r12 * r14) / r22 AS r24 FROM c2)",
    "c3b AS (SELECT *, sqrt(scc - r13 * r13 - r23 * r23) AS r33 FROM c3)",
    "c4 AS (SELECT *, (scd - r13 * r14 - r23 * r24) / r33 AS r34 FROM c3b)",
)


put(
    "switch_on",
    """SELECT o_orderkey, kind, CASE WHEN kind = 'date' THEN CAST(today + CAST(missing AS INTEGER) AS DATE) END AS d FROM (
  SELECT *, CASE WHEN size <> 0 AND size < min_n THEN 'range' WHEN total >= size THEN 'window' ELSE 'date' END AS kind FROM (
    SELECT o_orderkey, o_orderkey % 23 + 1 AS missing, CASE WHEN o_orderkey % 3 = 0 THEN 150 ELSE 30 END AS min_n, [0, 20, 60, 90][o_custkey % 4 + 1] AS size, o_orderkey % 200 AS total, CAST(o_orderdate AS DATE) AS today FROM orders))""",
)
# Parts beyond their range count on: the 30th of February is 29 days after its first, the 14th month is the second of the next year.
put(
    "parse_timestamp",
    """SELECT id, CASE WHEN id % 11 IN (0, 1, 2) THEN date_trunc('second', ts) WHEN id % 11 IN (3, 9) THEN date_trunc('day', ts) WHEN id % 11 IN (6, 7) THEN date_trunc('minute', ts)
  WHEN id % 11 = 5 THEN CAST(make_date(year(ts), 2, 1) AS TIMESTAMP) + to_minutes(29 * 1440 + minute) WHEN id % 11 = 8 THEN date_trunc('day', ts) + INTERVAL 26 HOUR + INTERVAL 1 MINUTE
  WHEN id % 11 = 10 THEN CAST(make_date(year(ts) + 1, 2, 1) AS TIMESTAMP) + to_minutes(32 * 1440 + minute) END AS parsed FROM e""",
    SESSIONS,
)
put(
    "parse_number",
    """SELECT o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN CAST(c AS DOUBLE) WHEN 1 THEN CAST('-' || c || '5' AS DOUBLE) WHEN 4 THEN 0.0 WHEN 9 THEN CAST('0.' || c AS DOUBLE) END AS parsed
  FROM (SELECT o_orderkey, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS c FROM orders)""",
)
put("normalize_text", "SELECT doc_id, regexp_replace(lower(strip_accents(text || CASE WHEN doc_id % 3 = 0 THEN ' Čeština ő ž Łódź Ångström Ṩ ½' ELSE '' END)), '[^a-z0-9]', '', 'g') AS out FROM documents")
put(
    "student_t_p",
    "SELECT o_orderkey, round(p, 8) + 0.0 AS p FROM st JOIN c USING (t, df) JOIN tp USING (id)",
    "st AS (SELECT o_orderkey, (o_orderkey % 80) / 10.0::DOUBLE - 4 AS t, CAST(o_custkey % 25 + 1 AS DOUBLE) AS df FROM orders)",
    "c AS (SELECT row_number() OVER () AS id, t, df FROM (SELECT DISTINCT t, df FROM st))",
    t_p("t", "df", "c"),
)
_ORDER = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity"
_LINES = "OVER (" + _ORDER + " ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
put(
    "long_windows",
    f"SELECT l_orderkey, l_linenumber, round(avg(l_quantity) {_LINES.format(6)}, 4) + 0.0 AS m7, round(avg(l_quantity) {_LINES.format(27)}, 4) + 0.0 AS m28, lead(l_quantity) OVER ({_ORDER}) AS after FROM lineitem",
)
_GAPS = """ga AS (SELECT x AS lo, lead(x) OVER (ORDER BY x) AS hi FROM pt),
gp AS (SELECT lo, hi, (hi - lo) / (SELECT max(x) - min(x) FROM pt) AS share FROM ga WHERE hi - lo >= 0.02 * (SELECT max(x) - min(x) FROM pt))"""
_POINTS = """SELECT 'point' AS kind, x, CAST(NULL AS DOUBLE) AS x_high, y, CAST(NULL AS DOUBLE) AS share FROM pt UNION ALL SELECT 'gap', lo, hi, NULL, share FROM gp"""
_SHOWN = "kind, round(x, 4) + 0.0 AS x, round(x_high, 4) + 0.0 AS x_high, round(y, 4) + 0.0 AS y, round(share, 4) + 0.0 AS share"
over_daily(
    "dose_points",
    f"SELECT n >= 60 AS ok, n, CAST(60 AS BIGINT) AS min_n, CAST(greatest(0, 60 - n) AS BIGINT) AS missing, {_SHOWN} FROM (SELECT count(*) AS n FROM pt) LEFT JOIN ({_POINTS}) ON n >= 60",
    "pt AS (SELECT x, y FROM daily WHERE x IS NOT NULL AND y IS NOT NULL)",
    _GAPS,
)
over_daily(
    "explorer_scatter",
    f"SELECT {_SHOWN} FROM ({_POINTS})",
    "pt AS (SELECT x2 AS x, y FROM (SELECT *, lag(x, 2) OVER (ORDER BY d) AS x2 FROM daily) WHERE x2 IS NOT NULL AND y IS NOT NULL AND disc IS NOT NULL)",
    _GAPS,
)
put(
    "circadian_clock",
    f"""SELECT n >= 21 AS ok, n, CAST(21 AS BIGINT) AS min_n, CAST(greatest(0, 21 - n) AS BIGINT) AS missing, round(b, 4) + 0.0 AS bed, round(w, 4) + 0.0 AS wake, round(w + 1440 - CASE WHEN b < 720 THEN b + 1440 ELSE b END, 4) + 0.0 AS window_minutes,
  round(mr, 4) + 0.0 AS mean_recovery, round(ms, 4) + 0.0 AS max_strain, se AS sessions
FROM (SELECT count(*) AS n, fmod(quantile_cont(CAST({_BED} AS DOUBLE), 0.5), 1440) AS b, fmod(quantile_cont(CAST(minute AS DOUBLE), 0.5), 1440) AS w, avg(strain) FILTER (id % 4 <> 0) AS mr, max(strain) AS ms, count(strain) AS se FROM e)""",
    SESSIONS,
)
put("session_list", "SELECT d AS day, minute AS minute_of_day, round(strain, 4) + 0.0 AS strain, activity FROM e WHERE strain IS NOT NULL AND id % 7 <> 0", SESSIONS)
put(
    "csv_workouts",
    """SELECT CAST(ts + INTERVAL 1 HOUR AS DATE) AS day, date_trunc('second', ts) + INTERVAL 1 HOUR AS "start", CAST(id % 90 AS DOUBLE) AS duration, CASE WHEN id % 5 <> 0 THEN activity ELSE 'Sin nombre' END AS activity, CAST(id AS DOUBLE) AS "maxHr",
  CAST(40 AS DOUBLE) AS zone1, CAST(NULL AS DOUBLE) AS zone2 FROM e""",
    SESSIONS,
)
put("csv_sleeps", """SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, date_trunc('second', ts) + INTERVAL 8 HOUR AS "wakeOnset", CAST(id AS DOUBLE) AS asleep, id % 3 = 0 AS "isNap" FROM e""", SESSIONS)
put(
    "exact_quantiles",
    "SELECT l_suppkey, probability, round(q, 4) + 0.0 AS quantile, n FROM (SELECT l_suppkey, unnest([0.0, 0.25, 0.5, 0.9, 1.0]::DOUBLE[]) AS probability, unnest(quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.9, 1.0])) AS q, count(*) AS n FROM lineitem GROUP BY l_suppkey)",
)
put(
    "exact_quantiles_all",
    "SELECT probability, round(q, 4) + 0.0 AS quantile, n FROM (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS probability, unnest(quantile_cont(l_extendedprice, [0.25, 0.5, 0.75])) AS q, count(*) AS n FROM lineitem)",
)
