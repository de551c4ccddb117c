"""Digest aggregations over turns mapped from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import rollups as R
from verification.registry import query
from verification.tables import digest, turns, with_priced, with_turns

BUCKET = """count(*) AS turns, CAST(coalesce(sum(input), 0) AS BIGINT) AS input,
  CAST(coalesce(sum(output), 0) AS BIGINT) AS output,
  CAST(coalesce(sum(cache_create), 0) AS BIGINT) AS cache_create,
  CAST(coalesce(sum(cache_read), 0) AS BIGINT) AS cache_read,
  CAST(coalesce(sum(cache_1h), 0) AS BIGINT) AS cache_1h,
  CAST(coalesce(sum(cache_5m), 0) AS BIGINT) AS cache_5m,
  coalesce(round_even(sum(cost), 4), 0.0) AS cost, count(DISTINCT session) AS sessions"""


@query("g01_totals", with_priced(f"SELECT 'all' AS scope, {BUCKET} FROM priced"))
def g01(spark, sf):
    return digest(spark, sf).totals


@query("g02_sidechain_totals",
       with_priced(f"SELECT 'subagents' AS scope, {BUCKET} FROM priced WHERE sidechain"))
def g02(spark, sf):
    return digest(spark, sf).sidechain


@query("g03_by_day", with_priced(f"SELECT date, {BUCKET} FROM priced GROUP BY 1"))
def g03(spark, sf):
    return digest(spark, sf).by_day


@query("g03_by_local_day", with_priced(
    f"SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS date, {BUCKET} FROM priced GROUP BY 1"))
def g03_local(spark, sf):
    d = digest(spark, sf)
    return R.by_day(R.add_report_columns(d.priced.drop("ts_local", "date", "hour", "writes",
                                                       "reads", "tool_calls"), 5.5))


_MISSING = {"effort": "unset", "repo": "unattributed", "surface": "unattributed"}
for _id, _name in (("g04", "model"), ("g05", "workspace"), ("g06", "effort"), ("g09", "repo"),
                   ("g10", "surface"), ("g11", "lane"), ("g12", "provider"),
                   ("g13", "entrypoint"), ("g14", "phase")):
    def _make(name):
        return lambda spark, sf: digest(spark, sf).by(name)
    query(f"{_id}_by_{_name}", with_priced(
        f"SELECT coalesce(nullif({_name}, ''), '{_MISSING.get(_name, 'unknown')}') AS {_name}, "
        f"{BUCKET} FROM priced GROUP BY 1"))(_make(_name))


@query("g07_by_agent", with_priced(
    f"SELECT coalesce(agent, 'unnamed') AS agent, {BUCKET} FROM priced WHERE sidechain GROUP BY 1"))
def g07(spark, sf):
    return digest(spark, sf).by("agent")


@query("g08_by_tool", with_turns(
    "SELECT tool, count(*) AS calls FROM (SELECT unnest(tools) AS tool FROM turns) GROUP BY 1"))
def g08(spark, sf):
    return R.by_tool(turns(spark, sf))


@query("g15_by_hour", with_turns("""
SELECT CAST(h AS INTEGER) AS hour, count(ts) AS turns
FROM range(24) r(h) LEFT JOIN turns ON hour(ts) = h GROUP BY 1"""))
def g15(spark, sf):
    return digest(spark, sf).by_hour


@query("g16_window", with_turns("""
SELECT min(ts) AS first, max(ts) AS last, count(DISTINCT CAST(ts AS DATE)) AS days,
  list_sort(list(DISTINCT strftime(ts, '%Y-%m-%d'))) AS active_days FROM turns"""))
def g16(spark, sf):
    return digest(spark, sf).window


def _doubled(spark, sf):
    """A damaged store: every third turn is there twice, one in nine three times."""
    t = turns(spark, sf)
    copies = F.when(F.col("seq") % 9 == 0, 3).when(F.col("seq") % 3 == 0, 2).otherwise(1)
    return t.withColumn("c", F.explode(F.sequence(F.lit(1), copies))).drop("c")


@query("g17_duplicates", with_turns("""
, copies AS (SELECT *, CASE WHEN seq % 9 = 0 THEN 3 WHEN seq % 3 = 0 THEN 2 ELSE 1 END AS n FROM turns),
keys AS (SELECT provider || '|' || session || '|' || ts_raw || '|' || turn || '|' || input || '|'
  || output || '|' || cache_read || '|' || model AS k, sum(n) AS n FROM copies GROUP BY 1)
SELECT CAST(sum(n - 1) AS BIGINT) AS turns, count(*) AS "distinct" FROM keys"""))
def g17(spark, sf):
    return R.duplicates(_doubled(spark, sf))


@query("g18_synthetic", with_turns("""
SELECT count(*) FILTER (seq % 11 = 0) > 0 AS demo, count(*) FILTER (seq % 11 = 0) AS synthetic_events
FROM turns"""))
def g18(spark, sf):
    return R.synthetic_count(turns(spark, sf).withColumn("synthetic", F.col("seq") % 11 == 0))


@query("g19_active_windows", with_priced("""
SELECT win AS name, max(vendor) AS vendor, max(CASE win WHEN 'w-daily' THEN '[[1, 4], [6, 10]]'
    ELSE '[[6, 10]]' END) AS peak_utc, CAST(0.5 AS DOUBLE) AS off_peak_mult,
  list_sort(list(DISTINCT provider)) AS providers FROM priced WHERE win IS NOT NULL GROUP BY 1"""))
def g19(spark, sf):
    return digest(spark, sf).windows.select(
        "name", "vendor", F.col("peak_utc").cast("string").alias("peak_utc"), "off_peak_mult",
        "providers")


CUBE_SQL = """cube AS (
SELECT date, coalesce(provider, 'unknown') AS provider, coalesce(lane, 'unknown') AS lane,
  coalesce(entrypoint, 'unknown') AS entrypoint, coalesce(repo, 'unattributed') AS repo,
  coalesce(surface, 'unattributed') AS surface, coalesce(model, 'unknown') AS model,
  coalesce(effort, 'unset') AS effort,
  CASE WHEN sidechain THEN coalesce(agent, 'unknown') ELSE 'main thread' END AS agent, phase,
  count(*) AS turns, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
  CAST(sum(cache_create) AS BIGINT) AS cache_create,
  CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_1h) AS BIGINT) AS cache_1h,
  CAST(sum(cache_5m) AS BIGINT) AS cache_5m, CAST(sum(cost_micro) AS BIGINT) AS cost_micro,
  CAST(sum(cost_floor_micro) AS BIGINT) AS cost_floor_micro, CAST(sum(writes) AS BIGINT) AS writes,
  CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(tool_calls) AS BIGINT) AS tool_calls
FROM priced GROUP BY ALL)"""


@query("g20_main_cube", with_priced("SELECT * FROM cube", CUBE_SQL))
def g20(spark, sf):
    return digest(spark, sf).cube


HOURS_SQL = """hours AS (
SELECT date, provider, lane, coalesce(repo, 'unattributed') AS repo, hh AS hour, count(*) AS turns
FROM priced GROUP BY ALL)"""
TOOLS_SQL = """tools_cube AS (
SELECT date, provider, lane, repo, tool, count(*) AS calls FROM (
  SELECT date, provider, lane, coalesce(repo, 'unattributed') AS repo, unnest(tools) AS tool
  FROM priced) GROUP BY ALL)"""


@query("g21_hours_cube", with_priced("SELECT * FROM hours", HOURS_SQL))
def g21(spark, sf):
    return digest(spark, sf).hours


@query("g22_tools_cube", with_priced("SELECT * FROM tools_cube", TOOLS_SQL))
def g22(spark, sf):
    return digest(spark, sf).tools


SESSIONS_SQL = """areas AS (
  SELECT session AS sid, surface, count(*) AS n, min(ts) AS seen_ts, min_by(seq, (ts, seq)) AS seen_seq
  FROM priced WHERE surface IS NOT NULL GROUP BY 1, 2
), main_area AS (
  SELECT sid, count(*) AS surfaces, first(surface ORDER BY n DESC, seen_ts, seen_seq) AS surface
  FROM areas GROUP BY 1
), sessions AS (
SELECT session, min_by(workspace, (ts, seq)) AS workspace,
  first(provider ORDER BY ts, seq) AS provider, first(lane ORDER BY ts, seq) AS lane,
  first(entrypoint ORDER BY ts, seq) AS entrypoint, CAST(NULL AS VARCHAR) AS branch,
  first(repo ORDER BY ts, seq) FILTER (repo IS NOT NULL) AS repo, min(ts) AS start, max(ts) AS "end",
  count(*) AS turns, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
  CAST(sum(cache_create) AS BIGINT) AS cache_create, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  round_even(sum(cost), 4) AS cost, list_sort(list(DISTINCT model)) AS models,
  CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(writes) AS BIGINT) AS writes,
  CAST(sum(tool_calls) AS BIGINT) AS tool_calls, count(*) FILTER (sidechain) AS sidechain_turns,
  max(input + cache_read + cache_create) AS peak_context, any_value(a.surface) AS surface,
  coalesce(any_value(a.surfaces), 0) AS surfaces
FROM priced p LEFT JOIN main_area a ON p.session = a.sid GROUP BY session)"""


@query("g23_session_facts", with_priced("SELECT * FROM sessions", SESSIONS_SQL))
def g23(spark, sf):
    return digest(spark, sf).sessions


@query("g24_reconcile", with_priced("""
, long AS (UNPIVOT (SELECT count(*) AS turns, CAST(sum(input) AS BIGINT) AS input,
    CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_create) AS BIGINT) AS cache_create,
    CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_1h) AS BIGINT) AS cache_1h,
    CAST(sum(cache_5m) AS BIGINT) AS cache_5m, CAST(sum(cost_micro) AS BIGINT) AS cost_micro,
    CAST(sum(cost_floor_micro) AS BIGINT) AS cost_floor_micro,
    CAST(sum(writes) AS BIGINT) AS writes, CAST(sum(reads) AS BIGINT) AS reads,
    CAST(sum(tool_calls) AS BIGINT) AS tool_calls FROM priced) ON COLUMNS(*)
  INTO NAME metric VALUE total)
SELECT 'main' AS cube, metric, total AS cube_sum, total, true AS ok FROM long
UNION ALL SELECT 'hours', metric, total, total, true FROM long WHERE metric = 'turns'
UNION ALL SELECT 'tools', metric, total, total, true FROM long WHERE metric = 'tool_calls'"""))
def g24(spark, sf):
    return R.reconcile(digest(spark, sf).priced)
