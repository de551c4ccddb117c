"""Detectors over the digest of turns mapped from ``events``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from meterline.config import CURRENCIES, Thresholds
from meterline.operators import detectors as D
from meterline.plans.digest import Digest
from verification.registry import ORACLES, query
from verification.rollup_queries import SESSIONS_SQL, _doubled
from verification.tables import CARD, TOPOLOGY, digest, with_priced, with_turns

T = replace(Thresholds(), premium_model="frontier-a", cheaper_model="mid-a")
DBL = lambda x: f"CAST({x} AS DOUBLE)"
PCT = lambda a, b: (f"coalesce(round_even(CAST(100.0 AS DOUBLE) * ({a}) / nullif({b}, 0), 1), "  # noqa: E731
                    f"CAST(0 AS DOUBLE))")
DAYS = "(SELECT count(DISTINCT date) FROM priced)"
MONTH = lambda x: f"round_even(({x}) * CAST(30.0 AS DOUBLE) / {DAYS}, 2)"


def flat(df, evidence, labels=(), examples=False):
    """A finding as plain columns."""
    cols = [F.col("id"), F.col("severity"), F.col("saving"),
            *[F.col("evidence")[e].alias(e) for e in evidence],
            *[F.col("labels")[x].alias(x) for x in labels]]
    if examples:
        cols.append(F.array_join(F.transform("examples", lambda x: x["name"]), ",")
                    .alias("examples"))
    return df.select(*cols)


TOTALS = """tot AS (SELECT CAST(sum(turns_) AS BIGINT) AS turns, CAST(sum(input) AS BIGINT) AS input,
  CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_create) AS BIGINT) AS cc,
  CAST(sum(cache_read) AS BIGINT) AS cr, CAST(sum(cache_1h) AS BIGINT) AS c1,
  CAST(sum(cache_5m) AS BIGINT) AS c5, round_even(sum(cost), 4) AS cost
  FROM (SELECT 1 AS turns_, * FROM priced))"""


@query("d01_cache_efficiency", with_priced(f"""
SELECT CASE WHEN ok THEN 'cache-healthy' ELSE 'cache-cold' END AS id,
  CASE WHEN ok THEN 'info' ELSE 'high' END AS severity,
  CASE WHEN NOT ok THEN {MONTH(f"cc * {DBL('1.25 - 0.1')} * 5.0 / 1000000")} END AS saving,
  {PCT("cr", "cr + cc + input")} AS cache_read_share_pct, {DBL("cr")} AS cache_read,
  {DBL("cc")} AS cache_create, {DBL("input")} AS fresh_input
FROM (SELECT *, {DBL("cr")} / (cr + cc + input) >= 0.55 AS ok FROM tot)""", TOTALS))
def d01(spark, sf):
    return flat(D.cache_efficiency(digest(spark, sf), T),
                ["cache_read_share_pct", "cache_read", "cache_create", "fresh_input"])


@query("d02_cold_cache_sessions", with_priced(f"""
, v AS (SELECT * FROM sessions WHERE cache_create >= 20000 AND cache_read = 0)
SELECT 'cache-write-never-read' AS id, 'high' AS severity, {MONTH("sum(cost) * 0.2")} AS saving,
  {DBL("count(*)")} AS sessions, {DBL("sum(cache_create)")} AS tokens_written_unused,
  round_even(sum(cost), 2) AS observed_cost_usd,
  (SELECT string_agg(session, ',' ORDER BY cache_create DESC, output DESC, session) FROM (
    SELECT * FROM v ORDER BY cache_create DESC, output DESC, session LIMIT 5)) AS examples
FROM v HAVING count(*) > 0""", SESSIONS_SQL))
def d02(spark, sf):
    return flat(D.cold_cache_sessions(digest(spark, sf), T),
                ["sessions", "tokens_written_unused", "observed_cost_usd"], examples=True)


@query("d03_premium_light_work", with_priced(f"""
, p AS (SELECT model, count(*) AS turns, sum(output) AS output FROM priced
  WHERE model_tier IN ('frontier', 'opus') GROUP BY 1)
SELECT 'premium-tier-light-turns' AS id, 'medium' AS severity,
  {MONTH(f"sum(output) * ({DBL('25.0 - 15.0')} / 1000000) * 0.4")} AS saving,
  {DBL("sum(turns)")} AS premium_turns,
  round_even(sum(output) / {DBL("sum(turns)")}, 1) AS mean_output_tokens,
  string_agg(model, ',' ORDER BY output DESC) AS examples
FROM p HAVING sum(turns) >= 20 AND sum(output) / sum(turns) < 5000"""))
def d03(spark, sf):
    """The threshold is raised so that the rule fires on this table."""
    t = replace(T, light_turn_output=5000)
    return flat(D.premium_model_on_light_work(digest(spark, sf), t),
                ["premium_turns", "mean_output_tokens"], examples=True)


@query("d04_exploration", with_priced(f"""
, v AS (SELECT * FROM sessions WHERE reads >= 2 AND writes = 0 AND cost >= 0.5)
SELECT 'read-heavy-no-change' AS id, 'medium' AS severity, {MONTH("sum(cost) * 0.3")} AS saving,
  {DBL("count(*)")} AS sessions, {DBL("sum(reads)")} AS read_calls,
  round_even(sum(cost), 2) AS observed_cost_usd,
  (SELECT string_agg(session, ',' ORDER BY cost DESC, output DESC, session) FROM (
    SELECT * FROM v ORDER BY cost DESC, output DESC, session LIMIT 5)) AS examples
FROM v HAVING count(*) > 0""", SESSIONS_SQL))
def d04(spark, sf):
    return flat(D.exploration_without_output(digest(spark, sf), replace(T, explore_min_reads=2)),
                ["sessions", "read_calls", "observed_cost_usd"], examples=True)


@query("d05_context_bloat", with_priced(f"""
, v AS (SELECT * FROM sessions WHERE peak_context >= 150000)
SELECT 'context-bloat' AS id, 'medium' AS severity, {DBL("NULL")} AS saving,
  {DBL("count(*)")} AS sessions, {DBL("max(peak_context)")} AS worst_peak_context,
  first(session ORDER BY peak_context DESC, output DESC, session) AS worst_session,
  first(workspace ORDER BY peak_context DESC, output DESC, session) AS worst_workspace
FROM v HAVING count(*) > 0""", SESSIONS_SQL))
def d05(spark, sf):
    return flat(D.context_bloat(digest(spark, sf), replace(T, context_bloat_tokens=150000)),
                ["sessions", "worst_peak_context"], ["worst_session", "worst_workspace"])


@query("d06_session_churn", with_priced(f"""
, c AS (SELECT count(*) AS n, count(*) FILTER (turns <= 3) AS short FROM sessions)
SELECT 'session-churn' AS id, 'medium' AS severity, {DBL("NULL")} AS saving,
  {DBL("short")} AS short_sessions, {DBL("n")} AS total_sessions, {PCT("short", "n")} AS share_pct
FROM c WHERE n >= 10 AND short / {DBL("n")} >= 0.4""", SESSIONS_SQL))
def d06(spark, sf):
    return flat(D.session_churn(digest(spark, sf), T),
                ["short_sessions", "total_sessions", "share_pct"])


@query("d07_subagent_leverage", with_priced(f"""
, s AS (SELECT sum(output) AS total, coalesce(sum(output) FILTER (sidechain), 0) AS sub,
  count(*) FILTER (sidechain) AS n FROM priced)
SELECT CASE WHEN sub = 0 THEN 'no-delegation' WHEN sub / {DBL("total")} > 0.5 THEN 'subagent-fanout'
  ELSE 'delegation-balanced' END AS id,
  CASE WHEN sub = 0 THEN 'low' WHEN sub / {DBL("total")} > 0.5 THEN 'medium' ELSE 'info' END AS severity,
  {DBL("NULL")} AS saving, {PCT("sub", "total")} AS subagent_output_share_pct,
  CASE WHEN sub / {DBL("total")} > 0.5 THEN {DBL("n")} END AS subagent_turns FROM s WHERE total > 0"""))
def d07(spark, sf):
    return flat(D.subagent_leverage(digest(spark, sf), T),
                ["subagent_output_share_pct", "subagent_turns"])


@query("d08_cache_ttl", with_priced(f"""
SELECT CASE WHEN ok THEN 'cache-1h-justified' ELSE 'cache-1h-underused' END AS id,
  CASE WHEN ok THEN 'info' ELSE 'medium' END AS severity,
  CASE WHEN NOT ok THEN {MONTH(f"c1 * {DBL('2.0 - 1.25')} * 5.0 / 1000000")} END AS saving,
  {PCT("c1", "c1 + c5")} AS cache_1h_share_pct,
  round_even({DBL("cr")} / (c1 + c5), 2) AS reads_per_write
FROM (SELECT *, {DBL("cr")} / (c1 + c5) >= 3 AS ok FROM tot
  WHERE c1 + c5 >= 100000 AND c1 / {DBL("c1 + c5")} >= 0.5)""", TOTALS))
def d08(spark, sf):
    return flat(D.cache_ttl_choice(digest(spark, sf), T),
                ["cache_1h_share_pct", "reads_per_write"])


@query("d09_tool_concentration", with_turns(f"""
, c AS (SELECT tool, count(*) AS calls FROM (SELECT unnest(tools) AS tool FROM turns) GROUP BY 1),
s AS (SELECT sum(calls) AS total, first(tool ORDER BY calls DESC, tool) AS tool, max(calls) AS top FROM c)
SELECT 'tool-concentration' AS id, 'low' AS severity, {DBL("NULL")} AS saving, {DBL("top")} AS calls,
  {DBL("total")} AS total_calls, {PCT("top", "total")} AS share_pct, tool,
  (SELECT string_agg(tool, ',' ORDER BY calls DESC, tool) FROM (
    SELECT * FROM c ORDER BY calls DESC, tool LIMIT 3 OFFSET 1)) AS examples
FROM s WHERE total >= 50 AND top / {DBL("total")} >= 0.3"""))
def d09(spark, sf):
    return flat(D.tool_concentration(digest(spark, sf), replace(T, tool_concentration=0.3)),
                ["calls", "total_calls", "share_pct"], ["tool"], examples=True)


@query("d10_investment_concentration", with_priced(f"""
, w AS (SELECT workspace, round_even(sum(cost), 4) AS cost, count(DISTINCT session) AS sessions FROM priced
  WHERE workspace IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY cost DESC, workspace) AS i FROM w)
SELECT 'where-the-time-goes' AS id, 'info' AS severity, {DBL("NULL")} AS saving,
  {PCT("max(cost)", "sum(cost)")} AS top_share_pct,
  {PCT("sum(cost) FILTER (i <= 3)", "sum(cost)")} AS top_three_share_pct,
  {DBL("any_value(sessions) FILTER (i = 1)")} AS top_sessions,
  any_value(workspace) FILTER (i = 1) AS workspace,
  string_agg(workspace, ',' ORDER BY i) FILTER (i <= 8) AS examples
FROM r HAVING count(*) >= 3 AND sum(cost) > 0"""))
def d10(spark, sf):
    return flat(D.investment_concentration(digest(spark, sf), T),
                ["top_share_pct", "top_three_share_pct", "top_sessions"], ["workspace"],
                examples=True)


@query("d11_working_rhythm", with_turns(f"""
, h AS (SELECT hour(ts) AS h, count(*) AS n FROM turns GROUP BY 1)
SELECT 'working-rhythm' AS id, 'info' AS severity, {DBL("NULL")} AS saving,
  {DBL("first(h ORDER BY n DESC, h)")} AS peak_hour, {DBL("max(n)")} AS peak_turns,
  {PCT("coalesce(sum(n) FILTER (h < 6 OR h >= 22), 0)", "sum(n)")} AS out_of_hours_share_pct
FROM h HAVING sum(n) >= 50"""))
def d11(spark, sf):
    return flat(D.working_rhythm(digest(spark, sf), T),
                ["peak_hour", "peak_turns", "out_of_hours_share_pct"])


def _d12_sql(floor: float, least: float) -> str:
    return with_priced(f"""
, p AS (SELECT phase, round_even(sum(cost), 4) AS cost FROM priced GROUP BY 1),
s AS (SELECT sum(cost) FILTER (phase = 'peak') AS pk, coalesce(sum(cost) FILTER (phase = 'off-peak'), 0) AS off,
  (SELECT round_even(sum(cost - cost_floor) FILTER (phase = 'peak'), 4) FROM priced) AS premium FROM p),
t AS (SELECT *, pk / (pk + off) < {floor} AS healthy, premium * CAST(30.0 AS DOUBLE) / {DAYS} AS monthly FROM s)
SELECT CASE WHEN healthy THEN 'peak-window-healthy' WHEN monthly < {least} THEN 'peak-window-immaterial'
  ELSE 'peak-window-arbitrage' END AS id,
  CASE WHEN healthy THEN 'info' WHEN monthly < {least} THEN 'low' ELSE 'high' END AS severity,
  CASE WHEN NOT healthy AND monthly >= {least} THEN round_even(monthly, 2) END AS saving,
  {PCT("pk", "pk + off")} AS peak_share_pct, round_even(premium, 2) AS peak_premium_usd,
  CASE WHEN NOT healthy AND monthly < {least} THEN round_even(monthly, 2) END AS est_monthly_premium_usd,
  CASE WHEN NOT healthy AND monthly >= {least} THEN round_even(pk, 2) END AS peak_cost_usd,
  'vd, ve' AS vendors FROM t""")


_D12 = ["peak_share_pct", "peak_premium_usd", "est_monthly_premium_usd", "peak_cost_usd"]


@query("d12_peak_window", _d12_sql(0.35, 5.0))
def d12(spark, sf):
    return flat(D.peak_window_arbitrage(digest(spark, sf), T), _D12, ["vendors"])


@query("d12_peak_window_high", _d12_sql(0.1, 0.5))
def d12_high(spark, sf):
    t = replace(T, peak_share_floor=0.1, peak_min_monthly_usd=0.5)
    return flat(D.peak_window_arbitrage(digest(spark, sf), t), _D12, ["vendors"])


def _d13_sql(price: float, label: str) -> str:
    return with_priced(f"""
, m AS (SELECT cost * CAST(30.0 AS DOUBLE) / {DAYS} AS monthly FROM tot),
r AS (SELECT round_even(monthly, 2) AS api, round_even(monthly / {DBL(price)}, 2) AS multiple FROM m)
SELECT CASE WHEN multiple < 1 THEN 'plan-under-used' ELSE 'plan-value-realised' END AS id,
  CASE WHEN multiple < 1 THEN 'high' ELSE 'info' END AS severity,
  CASE WHEN multiple < 1 THEN round_even({DBL(price)} - api, 2) END AS saving,
  api AS api_equivalent_usd_month, {DBL(price)} AS plan_price_usd_month, multiple,
  {DBL(DAYS)} AS days_observed, '{label}' AS plan FROM r""", TOTALS)


@query("d13_plan_value", _d13_sql(18.0, "GLM Coding Lite"))
def d13(spark, sf):
    return flat(D.plan_value_realised(digest(spark, sf), T, plan="glm-coding-lite"),
                ["api_equivalent_usd_month", "plan_price_usd_month", "multiple", "days_observed"],
                ["plan"])


@query("d14_vendor_concentration", with_priced(f"""
, v AS (SELECT coalesce(vendor, 'unknown') AS vendor, sum(output) AS output FROM priced GROUP BY 1),
s AS (SELECT first(vendor ORDER BY output DESC, vendor) AS top, max(output) AS o, sum(output) AS total,
  count(*) AS n FROM v)
SELECT CASE WHEN o / {DBL("total")} < 0.3 THEN 'vendor-mix-healthy' ELSE 'vendor-concentration' END AS id,
  CASE WHEN o / {DBL("total")} < 0.3 THEN 'info' ELSE 'medium' END AS severity, {DBL("NULL")} AS saving,
  {PCT("o", "total")} AS share_pct, CASE WHEN o / {DBL("total")} < 0.3 THEN {DBL("n")} END AS vendors,
  top AS top_vendor, CASE WHEN o / {DBL("total")} >= 0.3 THEN (SELECT string_agg(vendor, ',' ORDER BY output DESC, vendor)
    FROM (SELECT * FROM v ORDER BY output DESC, vendor LIMIT 6)) ELSE '' END AS examples FROM s"""))
def d14(spark, sf):
    return flat(D.vendor_concentration(digest(spark, sf), replace(T, concentration_floor=0.3)),
                ["share_pct", "vendors"], ["top_vendor"], examples=True)


_IDR = CURRENCIES["IDR"]


@query("d15_local_currency", with_priced(f"""
, m AS (SELECT cost * CAST(30.0 AS DOUBLE) / {DAYS} AS usd FROM tot)
SELECT 'local-currency' AS id, 'info' AS severity, {DBL("NULL")} AS saving,
  round_even(usd * {DBL(_IDR['per_usd'])}, 0) AS monthly_local, round_even(usd, 2) AS monthly_usd,
  {DBL(_IDR['per_usd'])} AS fx_per_usd,
  round_even(usd / {DBL(_IDR['daily_dev_rate_usd'])}, 2) AS equivalent_dev_days, 'IDR' AS currency FROM m""",
                                   TOTALS))
def d15(spark, sf):
    return flat(D.local_currency_context(digest(spark, sf), T, currency="IDR"),
                ["monthly_local", "monthly_usd", "fx_per_usd", "equivalent_dev_days"],
                ["currency"])


@query("d16_unpriced", with_priced(f"""
, u AS (SELECT count(*) AS n, round_even(sum(cost), 4) AS c FROM priced WHERE NOT is_priced)
SELECT 'unpriced-models' AS id, CASE WHEN {PCT("c", "cost")} >= 10 THEN 'medium' ELSE 'info' END AS severity,
  {DBL("NULL")} AS saving, {DBL("n")} AS unpriced_turns, round_even(c, 2) AS unpriced_cost_usd,
  {PCT("c", "cost")} AS share_of_spend_pct, 'unlisted-z' AS examples FROM u, tot WHERE n > 0""", TOTALS))
def d16(spark, sf):
    return flat(D.unpriced_estimate(digest(spark, sf), T),
                ["unpriced_turns", "unpriced_cost_usd", "share_of_spend_pct"], examples=True)


@query("d17_duplicated_turns", with_turns(f"""
, d AS (SELECT CAST(sum(CASE WHEN seq % 9 = 0 THEN 2 WHEN seq % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dup,
  count(*) AS n FROM turns)
SELECT 'duplicated-turns' AS id, CASE WHEN {PCT("dup", "dup + n")} >= 5 THEN 'high' ELSE 'medium' END AS severity,
  {DBL("NULL")} AS saving, {DBL("dup")} AS duplicate_turns, {DBL("n")} AS distinct_turns,
  {PCT("dup", "dup + n")} AS share_of_store_pct FROM d WHERE dup > 0"""))
def d17(spark, sf):
    d = Digest.of(_doubled(spark, sf), TOPOLOGY, CARD)
    return flat(D.duplicated_turns(d, T),
                ["duplicate_turns", "distinct_turns", "share_of_store_pct"])


# The thresholds of the queries above, together; turns of the plain table never repeat, so
# the seventeenth detector has nothing to say.
T_ALL = replace(T, light_turn_output=5000, explore_min_reads=2, context_bloat_tokens=150000,
                tool_concentration=0.3, concentration_floor=0.3)
_EACH = ("d01_cache_efficiency", "d02_cold_cache_sessions", "d03_premium_light_work", "d04_exploration",
         "d05_context_bloat", "d06_session_churn", "d07_subagent_leverage", "d08_cache_ttl",
         "d09_tool_concentration", "d10_investment_concentration", "d11_working_rhythm", "d12_peak_window",
         "d13_plan_value", "d14_vendor_concentration", "d15_local_currency", "d16_unpriced")


def all_findings(spark, sf, gate=T.material_monthly_usd):
    """What all detectors find, through the materiality gate."""
    return D.findings(digest(spark, sf).stored(), replace(T_ALL, material_monthly_usd=gate),
                      plan="glm-coding-lite", currency="IDR")


def all_findings_sql(tail: str, gate: float = T.material_monthly_usd) -> str:
    """The single queries' SQL put together, then gated."""
    each = " UNION ALL ".join(f"SELECT {i} AS detector, id, severity AS sev, saving FROM ({ORACLES[name]})"
                              for i, name in enumerate(_EACH))
    return f"""WITH f AS ({each}),
g AS (SELECT detector, id, saving, coalesce(saving < {gate} AND sev IN ('high', 'medium'), false) AS demoted,
  CASE WHEN coalesce(saving < {gate} AND sev IN ('high', 'medium'), false) THEN 'low' ELSE sev END AS severity FROM f)
{tail}"""


@query("d18_materiality", all_findings_sql("SELECT id, severity, saving, demoted FROM g", 20.0))
def d18(spark, sf):
    return all_findings(spark, sf, 20.0).select("id", "severity", "saving", "demoted")


@query("d19_ranked_findings", all_findings_sql("""
SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1
  WHEN 'low' THEN 2 ELSE 3 END, coalesce(saving, 0) DESC, detector) AS place, id, severity, saving FROM g"""))
def d19(spark, sf):
    from pyspark.sql import Window as W
    order = F.array_position(F.array(*[F.lit(x) for x in ("high", "medium", "low", "info")]),
                             F.col("severity"))
    w = W.partitionBy(F.lit(1)).orderBy(order, F.desc(F.coalesce("saving", F.lit(0.0))),
                                        "detector")
    return all_findings(spark, sf).select(F.row_number().over(w).alias("place"), "id", "severity", "saving")


@query("d20_silent_without_data", with_turns("""
SELECT 'cache-cold' AS id, 'high' AS severity, CAST(NULL AS DOUBLE) AS saving FROM turns WHERE false
UNION ALL SELECT 'cache-cold', 'low', CAST(0 AS DOUBLE)"""))
def d20(spark, sf):
    """Over a store filtered to nothing only the rule that defines zero speaks."""
    d = digest(spark, sf).stored()
    empty = Digest(d.priced.filter("turn < 0"), d.turns.filter("turn < 0"), d.card, d.rates)
    return D.findings(empty, T).select("id", "severity", "saving")


@query("d20_all_findings", all_findings_sql("SELECT detector, id, severity, saving, demoted FROM g"))
def d20_all(spark, sf):
    return all_findings(spark, sf).select("detector", "id", "severity", "saving", "demoted")
