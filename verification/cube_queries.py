"""Cube slices over turns mapped from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import cube as C
from verification.registry import query
from verification.rollup_queries import CUBE_SQL, HOURS_SQL, SESSIONS_SQL, TOOLS_SQL
from verification.tables import CARD, digest, with_priced

ALL = C.Slice("2024-01-05", "2024-01-24")
BETA = C.Slice("2024-01-05", "2024-01-24", provider="p-beta")
SHOP = C.Slice("2024-01-05", "2024-01-24", provider="p-beta", lane="work", repo="shop")
DAY = C.Slice("2024-01-05", "2024-01-24", provider="p-gamma", day="2024-01-11")

RANGE = "date BETWEEN '2024-01-05' AND '2024-01-24'"
IN_BETA = f"{RANGE} AND provider = 'p-beta'"
IN_SHOP = f"{IN_BETA} AND lane = 'work' AND repo = 'shop'"
SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in (
    "turns", "input", "output", "cache_create", "cache_read", "cache_1h", "cache_5m",
    "cost_micro", "cost_floor_micro", "writes", "reads", "tool_calls"))
COST = "CAST(sum(cost_micro) AS BIGINT) / CAST(1e6 AS DOUBLE) AS cost"


def of_cube(body: str, more: str = "") -> str:
    return with_priced(body, CUBE_SQL + (", " + more if more else ""))


def grouped(dims: str, where: str, tail: str = "") -> str:
    return f"SELECT {dims}, {SUMS}, {COST} FROM cube WHERE {where} GROUP BY ALL {tail}"


def top(dims: str, where: str, by: str = "cost", label: str | None = None) -> str:
    return (f"SELECT * FROM ({grouped(dims, where)}) WHERE {by} > 0 "
            f"ORDER BY {by} DESC, {label or dims} LIMIT 8")


@query("c01_slice", of_cube(f"SELECT * FROM cube WHERE {IN_BETA} AND lane = 'work'"))
def c01(spark, sf):
    """The repo filter is exempt: its own picker still sees every repo."""
    return C.sliced(digest(spark, sf).cube, SHOP, exempt="repo")


@query("c02_group_by", of_cube(grouped("model, effort", IN_BETA)))
def c02(spark, sf):
    return C.group(digest(spark, sf).cube, BETA, ["model", "effort"])


@query("c03_slice_totals", of_cube(f"""
SELECT {", ".join(f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}" for m in (
    "turns", "input", "output", "cache_create", "cache_read", "cache_1h", "cache_5m", "writes",
    "reads", "tool_calls"))}, {COST},
  CAST(coalesce(sum(turns) FILTER (agent <> 'main thread'), 0) AS BIGINT) AS sub_turns,
  CAST(coalesce(sum(output) FILTER (agent <> 'main thread'), 0) AS BIGINT) AS sub_output,
  count(DISTINCT date) AS days FROM cube WHERE {IN_BETA}"""))
def c03(spark, sf):
    return C.slice_totals(digest(spark, sf).cube, BETA)


IN_SESSIONS = """strftime(start, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-24'"""


@query("c04_session_slice", with_priced(f"""
SELECT session, repo, turns, output FROM sessions WHERE {IN_SESSIONS} AND provider = 'p-beta'
  AND lane = 'work' AND coalesce(repo, 'unattributed') = 'shop'""", SESSIONS_SQL))
def c04(spark, sf):
    return C.slice_sessions(digest(spark, sf).sessions, SHOP) \
        .select("session", "repo", "turns", "output")


@query("c05_top_panel", of_cube(top("surface", RANGE)))
def c05(spark, sf):
    return C.top_panel(C.group(digest(spark, sf).cube, ALL, ["surface"]), "surface", "cost")


# The spine is laid over the order days, so its length follows the table.
@query("c06_date_spine", """
WITH d AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders),
s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM d),
n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1)
SELECT strftime(s.day, '%Y-%m-%d') AS date, coalesce(n.orders, 0) AS orders
FROM s LEFT JOIN n ON CAST(s.day AS DATE) = n.day""")
def c06(spark, sf):
    from verification.tables import table
    per_day = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")) \
        .agg(F.count("*").alias("orders"))
    edge = per_day.agg(F.min("d"), F.max("d")).first()
    days = C.spine(spark, str(edge[0]), str(edge[1]))
    return days.join(per_day.select(F.date_format("d", "yyyy-MM-dd").alias("date"), "orders"),
                     "date", "left").select("date", F.coalesce("orders", F.lit(0)).alias("orders"))


SERIES_SQL = f"""spine AS (SELECT strftime(unnest(generate_series(DATE '2024-01-05', DATE '2024-01-24',
  INTERVAL 1 DAY)), '%Y-%m-%d') AS date),
found AS (SELECT date, CAST(sum(output) AS BIGINT) AS v FROM cube WHERE {IN_SHOP} GROUP BY 1),
series AS (SELECT s.date, coalesce(v, 0) AS output FROM spine s LEFT JOIN found f ON s.date = f.date)"""


@query("c07_daily_series", of_cube("SELECT * FROM series", SERIES_SQL))
def c07(spark, sf):
    return C.daily_series(digest(spark, sf).cube, SHOP, "output")


@query("c08_trailing_mean", of_cube("""
SELECT *, avg(output) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean7
FROM series""", SERIES_SQL))
def c08(spark, sf):
    return C.trailing_mean(C.daily_series(digest(spark, sf).cube, SHOP, "output"), "output")


GRID_SQL = f"""{HOURS_SQL}, grid AS (
SELECT CAST(d AS INTEGER) AS dow, CAST(h AS INTEGER) AS hour, CAST(coalesce((SELECT sum(turns) FROM hours
  WHERE {RANGE} AND dayofweek(CAST(date AS DATE)) = d AND CAST(hours.hour AS INTEGER) = h), 0) AS BIGINT) AS turns
FROM range(7) a(d), range(24) b(h))"""


@query("c09_weekday_hour", with_priced("SELECT * FROM grid", GRID_SQL))
def c09(spark, sf):
    return C.weekday_hour(digest(spark, sf).hours, ALL)


# A +5.5 hour reader: 01-04 and 06-10 UTC become 06-09 and 11-15 local.
MASK_SQL = """billed AS (SELECT DISTINCT win, provider FROM priced WHERE win IS NOT NULL),
used AS (SELECT DISTINCT provider FROM priced WHERE date BETWEEN '2024-01-05' AND '2024-01-24'),
cells AS (
  SELECT provider, h, d FROM billed JOIN used USING (provider), range(24) a(h), range(7) b(d)
  WHERE (win = 'w-daily' AND ((h >= 1 AND h < 4) OR (h >= 6 AND h < 10)))
     OR (win = 'w-weekday' AND h >= 6 AND h < 10 AND d BETWEEN 1 AND 5)),
mask AS (SELECT CAST((h + 5) % 24 AS INTEGER) AS hour,
  CAST((d + (h + 5) // 24) % 7 AS INTEGER) AS dow, list_sort(list(DISTINCT provider)) AS providers
  FROM cells GROUP BY 1, 2)"""


@query("c10_peak_mask", with_priced("SELECT * FROM mask", MASK_SQL))
def c10(spark, sf):
    d = digest(spark, sf)
    return C.peak_mask(d.cube, d.windows, ALL, tz_hours=5.5)


def _grid_and_mask(spark, sf):
    d = digest(spark, sf)
    return C.weekday_hour(d.hours, ALL), C.peak_mask(d.cube, d.windows, ALL, tz_hours=5.5)


@query("c11_masked_share", with_priced("""
SELECT CAST(sum(turns) AS BIGINT) AS turns,
  CAST(coalesce(sum(turns) FILTER (providers IS NOT NULL), 0) AS BIGINT) AS peak_turns,
  CAST(coalesce(sum(turns) FILTER (providers IS NOT NULL), 0) AS BIGINT) * CAST(100.0 AS DOUBLE) / CAST(sum(turns) AS BIGINT) AS peak_pct
FROM grid LEFT JOIN mask USING (dow, hour)""", f"{GRID_SQL}, {MASK_SQL}"))
def c11(spark, sf):
    return C.masked_share(*_grid_and_mask(spark, sf))


@query("c12_best_off_peak_hours", with_priced("""
SELECT hour, CAST(sum(turns) AS BIGINT) AS turns FROM grid LEFT JOIN mask USING (dow, hour)
WHERE providers IS NULL GROUP BY 1 HAVING sum(turns) > 0 ORDER BY turns DESC, hour LIMIT 3""",
                                              f"{GRID_SQL}, {MASK_SQL}"))
def c12(spark, sf):
    return C.best_off_peak_hours(*_grid_and_mask(spark, sf))


@query("c13_calendar", """
WITH n AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS turns FROM orders GROUP BY 1),
e AS (SELECT min(d) AS lo, max(d) AS hi, max(turns) AS top FROM n),
s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d, lo, top FROM e)
SELECT strftime(s.d, '%Y-%m-%d') AS date,
  CAST(date_diff('day', CAST(date_trunc('week', lo) AS DATE), s.d) // 7 AS INTEGER) AS week,
  CAST(isodow(s.d) - 1 AS INTEGER) AS weekday, coalesce(turns, 0) AS turns,
  CASE WHEN turns > 0 THEN greatest(CAST(0.15 AS DOUBLE), turns / CAST(top AS DOUBLE)) END AS shade
FROM s LEFT JOIN n ON s.d = n.d""")
def c13(spark, sf):
    from verification.tables import table
    per_day = table(spark, sf, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("turns"))
    return C.calendar(per_day)


BEHAVIOUR_SQL = f"""{SESSIONS_SQL}, spine AS (
  SELECT strftime(unnest(generate_series(DATE '2024-01-05', DATE '2024-02-02', INTERVAL 1 DAY)), '%Y-%m-%d') AS date),
per_day AS (SELECT strftime(start, '%Y-%m-%d') AS date, count(*) AS n, CAST(sum(turns) AS BIGINT) AS t,
  CAST(sum(tool_calls) AS BIGINT) AS c, count(*) FILTER (len(models) > 1) AS s
  FROM sessions WHERE strftime(start, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-02-02'
  AND provider = 'p-beta' AND lane = 'personal' GROUP BY 1),
behaviour AS (SELECT s.date, coalesce(n, 0) AS sessions, t / CAST(n AS DOUBLE) AS turns_per_session,
  c / CAST(t AS DOUBLE) AS tool_calls_per_turn,
  CAST(100.0 AS DOUBLE) * p.s / n AS model_switch FROM spine s LEFT JOIN per_day p ON s.date = p.date)"""
QUIET = C.Slice("2024-01-05", "2024-02-02", provider="p-beta", lane="personal")


@query("c14_session_behaviour", with_priced("SELECT * FROM behaviour", BEHAVIOUR_SQL))
def c14(spark, sf):
    return C.session_behaviour(digest(spark, sf).sessions, QUIET)


def _r(c):
    return F.bround(c, 9).alias(c)


@query("c15_rolling_behaviour", with_priced("""
SELECT date, round_even(avg(turns_per_session) OVER w, 9) AS turns_per_session,
  round_even(avg(tool_calls_per_turn) OVER w, 9) AS tool_calls_per_turn,
  round_even(avg(model_switch) OVER w, 9) AS model_switch
FROM behaviour WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
                                            BEHAVIOUR_SQL))
def c15(spark, sf):
    rolled = C.rolling_behaviour(C.session_behaviour(digest(spark, sf).sessions, QUIET))
    return rolled.select("date", *[_r(h) for h in C.HABITS])


@query("c16_last_window", with_priced("""
, r AS (SELECT date, turns_per_session IS NOT NULL AS active, avg(turns_per_session) OVER w AS v,
  count(turns_per_session) OVER w AS days,
  sum(CASE WHEN turns_per_session IS NOT NULL THEN sessions ELSE 0 END) OVER w AS sessions
  FROM behaviour WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT round_even((SELECT v FROM r WHERE v IS NOT NULL ORDER BY date DESC LIMIT 1), 9) AS last_value,
  (SELECT days FROM r WHERE active ORDER BY date DESC LIMIT 1) AS days,
  CAST((SELECT sessions FROM r WHERE active ORDER BY date DESC LIMIT 1) AS BIGINT) AS sessions""",
                                      BEHAVIOUR_SQL))
def c16(spark, sf):
    b = C.session_behaviour(digest(spark, sf).sessions, QUIET)
    return C.last_window(b, "turns_per_session").withColumn(
        "last_value", F.bround("last_value", 9))


@query("c17_kpis", of_cube(f"""
, t AS (SELECT CAST(sum(cost_micro) AS BIGINT) / CAST(1e6 AS DOUBLE) AS cost, count(DISTINCT date) AS days,
  CAST(sum(cache_read) AS BIGINT) AS r, CAST(sum(cache_read + cache_create + input) AS BIGINT) AS tr,
  CAST(sum(writes) AS BIGINT) AS w, CAST(sum(reads) AS BIGINT) AS rd, CAST(sum(tool_calls) AS BIGINT) AS c,
  CAST(sum(turns) AS BIGINT) AS n FROM cube WHERE {IN_BETA})
SELECT cost AS spend, cost / days AS spend_per_active_day,
  r * CAST(100.0 AS DOUBLE) / tr AS context_reuse_pct, tr AS tokens_read,
  w / CAST(rd AS DOUBLE) AS write_read, c / CAST(n AS DOUBLE) AS tool_calls_per_turn,
  days AS active_days, 20 AS calendar_days FROM t"""))
def c17(spark, sf):
    return C.kpis(digest(spark, sf).cube, BETA)


@query("c18_heaviest_sessions", with_priced(f"""
, t AS (SELECT * FROM sessions WHERE {IN_SESSIONS} ORDER BY output DESC, session LIMIT 8)
SELECT session, coalesce(repo, 'unattributed') AS repo, surface, provider,
  strftime(start, '%Y-%m-%d') AS date, turns, output, cost, writes, reads, peak_context,
  peak_context * CAST(100.0 AS DOUBLE) / max(peak_context) OVER () AS context_pct FROM t""",
                                            SESSIONS_SQL))
def c18(spark, sf):
    return C.heaviest_sessions(digest(spark, sf).sessions, ALL)


@query("c19_phase_panel", of_cube(f"""
, t AS (SELECT CAST(sum(cost_micro) AS BIGINT) AS m, CAST(sum(cost_floor_micro) AS BIGINT) AS f,
  CAST(sum(cost_micro) FILTER (phase = 'peak') AS BIGINT) AS p FROM cube
  WHERE {RANGE} AND phase IN ('peak', 'off-peak'))
SELECT m / CAST(1e6 AS DOUBLE) AS timed_cost, p / CAST(1e6 AS DOUBLE) AS peak_cost,
  f / CAST(1e6 AS DOUBLE) AS floor_cost,
  round_even(CAST(100.0 AS DOUBLE) * p / m, 1) AS peak_pct,
  greatest(CAST(0 AS DOUBLE), (m - f) / CAST(1e6 AS DOUBLE)) AS premium FROM t WHERE m > 0"""))
def c19(spark, sf):
    return C.phase_panel(digest(spark, sf).cube, ALL)


IN_SHOP_ANY = f"{IN_BETA} AND lane = 'work'"


@query("c20_repo_ranking", of_cube(top("repo", IN_SHOP_ANY)))
def c20(spark, sf):
    return C.repo_ranking(digest(spark, sf).cube, SHOP)


@query("c20_focus_surfaces", of_cube(f"""
SELECT * FROM ({grouped("repo, surface", IN_BETA)}) WHERE cost > 0 AND repo = (
  SELECT repo FROM ({grouped("repo", IN_BETA)}) ORDER BY cost DESC, repo LIMIT 1)
ORDER BY cost DESC, surface LIMIT 8"""))
def c20_focus(spark, sf):
    return C.surfaces_in_focus(digest(spark, sf).cube, BETA)


@query("c21_models", of_cube(top("model", RANGE)))
def c21_models(spark, sf):
    free = [m for m, r in CARD.models.items() if not r["input"] and not r["output"]]
    return C.model_ranking(digest(spark, sf).cube, ALL, free)


for _dim, _by in (("provider", "cost"), ("effort", "turns")):
    def _rank(dim, by):
        return lambda spark, sf: C.ranking(digest(spark, sf).cube, ALL, dim, by)
    query(f"c21_{_dim}s", of_cube(top(_dim, RANGE, _by)))(_rank(_dim, _by))


@query("c21_tools", with_priced(f"""SELECT tool, CAST(sum(calls) AS BIGINT) AS calls FROM tools_cube
WHERE {IN_BETA} GROUP BY 1 ORDER BY calls DESC, tool LIMIT 8""", TOOLS_SQL))
def c21_tools(spark, sf):
    return C.ranking(digest(spark, sf).tools, BETA, "tool", "calls")


@query("c21_agents", of_cube(top("agent", f"{RANGE} AND agent NOT IN ('main thread', 'unattributed')",
                                 "output")))
def c21_agents(spark, sf):
    return C.agent_ranking(digest(spark, sf).cube, ALL)


@query("c22_model_switch", with_priced(f"""
SELECT count(*) AS sessions, count(*) FILTER (len(models) > 1) AS switched,
  count(*) FILTER (len(models) > 1) * CAST(100.0 AS DOUBLE) / count(*) AS switch_pct
FROM sessions WHERE {IN_SESSIONS} AND provider = 'p-beta'""", SESSIONS_SQL))
def c22(spark, sf):
    return C.model_switch_share(digest(spark, sf).sessions, BETA)


@query("c23_slicer_values", of_cube("""
SELECT 'provider' AS slicer, provider AS value, CAST(sum(cost_micro) AS BIGINT) / CAST(1e6 AS DOUBLE) AS cost FROM cube GROUP BY 2
UNION ALL SELECT 'lane', lane, CAST(sum(cost_micro) AS BIGINT) / CAST(1e6 AS DOUBLE) FROM cube GROUP BY 2
UNION ALL SELECT 'repo', repo, CAST(sum(cost_micro) AS BIGINT) / CAST(1e6 AS DOUBLE) FROM cube GROUP BY 2"""))
def c23(spark, sf):
    cube = digest(spark, sf).cube
    out = None
    for dim in C.SLICERS:
        part = C.slicer_values(cube, dim).select(F.lit(dim).alias("slicer"),
                                                 F.col(dim).alias("value"), "cost")
        out = part if out is None else out.unionByName(part)
    return out


@query("c24_day_drill", of_cube(grouped("model", "date = '2024-01-11' AND provider = 'p-gamma'")))
def c24(spark, sf):
    return C.group(digest(spark, sf).cube, DAY.clamp("2024-01-01", "2024-01-30").drill(),
                   ["model"])
