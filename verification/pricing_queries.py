"""Pricing operators over turns mapped from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.config import CURRENCIES, PLANS
from meterline.functions import models as M
from meterline.functions.clock import billing_hour, billing_weekday
from meterline.functions.numbers import micro
from meterline.operators import pricing as P
from meterline.schema import parse_instant
from verification.registry import query
from verification.tables import rates, turns, with_plain, with_turns


def priced(spark, sf):
    return P.price_turns(turns(spark, sf), rates(spark))


def _spelled(spark, sf):
    """Models as gateways hand them back, with snapshot dates and aliases."""
    n = F.col("seq") % 6
    m = F.col("model")
    raw = (F.when(n == 0, F.concat(F.lit("llm-gateway--"), m))
           .when(n == 1, F.concat(F.lit("openai/"), m))
           .when(n == 2, F.concat(m, F.lit("-20240115")))
           .when(n == 3, F.concat(F.lit("llm-gateway--openai/"), m, F.lit("-20240115")))
           .when(n == 4, F.lit("light-a-turbo")).otherwise(F.concat(F.lit(" other--"), m)))
    return turns(spark, sf).withColumn("model", raw)


SPELLED_SQL = """spelled AS (SELECT * EXCLUDE (model), model AS base_model, CASE seq % 6
  WHEN 0 THEN 'llm-gateway--' || model WHEN 1 THEN 'openai/' || model
  WHEN 2 THEN model || '-20240115' WHEN 3 THEN 'llm-gateway--openai/' || model || '-20240115'
  WHEN 4 THEN 'light-a-turbo' ELSE ' other--' || model END AS model FROM turns)"""


@query("p01_strip_gateway", with_turns(f""", {SPELLED_SQL}
SELECT CASE seq % 6 WHEN 0 THEN base_model WHEN 1 THEN base_model WHEN 3 THEN base_model || '-20240115'
  ELSE trim(model) END AS shown, count(*) AS turns FROM spelled GROUP BY 1"""))
def p01(spark, sf):
    return _spelled(spark, sf).groupBy(M.strip_gateway(F.col("model")).alias("shown")) \
        .agg(F.count("*").alias("turns"))


@query("p02_canonical_model", with_turns(f""", {SPELLED_SQL}
SELECT CASE seq % 6 WHEN 4 THEN 'light-a' WHEN 5 THEN 'other--' || base_model
  ELSE base_model END AS canonical, count(*) AS turns FROM spelled GROUP BY 1"""))
def p02(spark, sf):
    return P.attach_rates(_spelled(spark, sf), rates(spark)).groupBy("canonical") \
        .agg(F.count("*").alias("turns"))


@query("p03_is_priced", with_turns(f""", {SPELLED_SQL}
SELECT model, seq % 6 = 4 OR (seq % 6 < 4 AND base_model <> 'unlisted-z') AS is_priced,
  count(*) AS turns FROM spelled GROUP BY 1, 2"""))
def p03(spark, sf):
    return P.attach_rates(_spelled(spark, sf), rates(spark)).groupBy("model", "is_priced") \
        .agg(F.count("*").alias("turns"))


@query("p04_rates", with_plain(
    "SELECT model, rate_in, rate_out, rate_cache_mult, count(*) AS turns FROM priced GROUP BY ALL"))
def p04(spark, sf):
    return priced(spark, sf).groupBy("model", "rate_in", "rate_out", "rate_cache_mult") \
        .agg(F.count("*").alias("turns"))


@query("p05_rate_in_force", with_plain("""
SELECT model, speed, date, rate_in, rate_out, count(*) AS turns, min(ts) AS first_ts, max(ts) AS last_ts
FROM priced GROUP BY ALL"""))
def p05(spark, sf):
    return (priced(spark, sf)
            .groupBy("model", "speed", F.date_format("ts", "yyyy-MM-dd").alias("date"), "rate_in",
                     "rate_out")
            .agg(F.count("*").alias("turns"), F.min("ts").alias("first_ts"),
                 F.max("ts").alias("last_ts")))


@query("p06_partial_override", with_plain("""
SELECT model, rate_in, rate_out, rate_cache_mult, ts < TIMESTAMP '2024-01-09 16:00:00' AS superseded,
  count(*) AS turns FROM priced GROUP BY ALL"""))
def p06(spark, sf):
    return (priced(spark, sf)
            .groupBy("model", "rate_in", "rate_out", "rate_cache_mult",
                     (F.col("ts") < F.lit("2024-01-09 16:00:00").cast("timestamp"))
                     .alias("superseded"))
            .agg(F.count("*").alias("turns")))


@query("p07_speed_override", with_plain(
    "SELECT model, speed, rate_in, rate_out, count(*) AS turns FROM priced GROUP BY ALL"))
def p07(spark, sf):
    return priced(spark, sf).groupBy("model", "speed", "rate_in", "rate_out") \
        .agg(F.count("*").alias("turns"))


@query("p08_event_instant", with_turns("""
SELECT event_id % 5 AS shape, CASE event_id % 5 WHEN 4 THEN NULL
    WHEN 2 THEN date_trunc('second', ts) - INTERVAL 8 HOUR ELSE date_trunc('second', ts) END AS at,
  count(*) AS turns FROM raw_events GROUP BY ALL"""))
def p08(spark, sf):
    """Offsets are honoured, a bare stamp is UTC, a broken one is null."""
    shape = F.col("seq") % 5
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (F.when(shape == 0, F.concat(day, F.lit("Z"))).when(shape == 1, day)
           .when(shape == 2, F.concat(day, F.lit("+08:00")))
           .when(shape == 3, F.concat(day, F.lit("+00:00"))).otherwise(F.lit("not a time")))
    return turns(spark, sf).groupBy(shape.alias("shape"), parse_instant(raw).alias("at")) \
        .agg(F.count("*").alias("turns"))


@query("p09_hour_weekday", with_turns("""
SELECT CASE WHEN seq % 7 > 0 THEN hour(ts) END AS hour,
  CASE WHEN seq % 7 > 0 THEN isodow(ts) END AS weekday, count(*) AS turns FROM turns GROUP BY ALL"""))
def p09(spark, sf):
    """A stamp under 13 characters has no hour."""
    short = F.when(F.col("seq") % 7 == 0, F.left("ts_raw", F.lit(10))).otherwise(F.col("ts_raw"))
    return turns(spark, sf).groupBy(
        billing_hour(F.col("ts"), short).alias("hour"),
        billing_weekday(F.col("ts"), short).alias("weekday")).agg(F.count("*").alias("turns"))


@query("p10_window_phase", with_plain("""
SELECT model, phase, isodow(ts) AS weekday, hour(ts) AS hour, count(*) AS turns
FROM priced GROUP BY ALL"""))
def p10(spark, sf):
    return priced(spark, sf).groupBy("model", "phase", (F.weekday("ts") + 1).alias("weekday"),
                                     F.hour("ts").alias("hour")).agg(F.count("*").alias("turns"))


@query("p11_window_mult", with_plain(
    "SELECT model, phase, mult AS off_peak_scale, count(*) AS turns FROM priced GROUP BY ALL"))
def p11(spark, sf):
    return priced(spark, sf).groupBy("model", "phase", P.window_mult().alias("off_peak_scale")) \
        .agg(F.count("*").alias("turns"))


@query("p12_turn_cost", with_plain("SELECT seq, model, cost FROM priced"))
def p12(spark, sf):
    return priced(spark, sf).select("seq", "model", "cost")


@query("p13_counterfactual", with_plain("""
SELECT model, phase, CAST(sum(cost_micro) AS BIGINT) AS cost_micro,
  CAST(sum(cost_floor_micro) AS BIGINT) AS floor_micro,
  CAST(sum(CAST(round_even(cost_peak * 1000000.0, 0) AS BIGINT)) AS BIGINT) AS peak_micro
FROM priced GROUP BY ALL"""))
def p13(spark, sf):
    return priced(spark, sf).groupBy("model", "phase").agg(
        F.sum("cost_micro").alias("cost_micro"), F.sum("cost_floor_micro").alias("floor_micro"),
        F.sum(micro(F.col("cost_peak"))).alias("peak_micro"))


@query("p14_micro_dollars", with_plain("SELECT seq, cost_micro, cost_floor_micro FROM priced"))
def p14(spark, sf):
    return priced(spark, sf).select("seq", "cost_micro", "cost_floor_micro")


@query("p15_peak_premium", with_plain("""
SELECT round_even(coalesce(sum(cost - cost_floor) FILTER (phase = 'peak'), 0), 4) AS peak_premium_usd
FROM priced"""))
def p15(spark, sf):
    return P.peak_premium(priced(spark, sf))


@query("p15_peak_spend", with_plain("""
SELECT phase, count(*) AS turns, CAST(sum(cost_micro) AS BIGINT) AS cost_micro,
  CAST(sum(cost_floor_micro) AS BIGINT) AS floor_micro,
  CAST(sum(cost_micro - cost_floor_micro) AS BIGINT) AS premium_micro FROM priced GROUP BY 1"""))
def p15_flagship(spark, sf):
    """How much fell in each phase, and what it would have cost off-peak."""
    return priced(spark, sf).groupBy("phase").agg(
        F.count("*").alias("turns"), F.sum("cost_micro").alias("cost_micro"),
        F.sum("cost_floor_micro").alias("floor_micro"),
        F.sum(F.col("cost_micro") - F.col("cost_floor_micro")).alias("premium_micro"))


@query("p16_unpriced_models", with_turns(f""", {SPELLED_SQL}
SELECT CASE seq % 6 WHEN 5 THEN 'other--' || base_model ELSE base_model END AS model,
  count(*) AS turns FROM spelled
WHERE seq % 6 = 5 OR (seq % 6 < 4 AND base_model = 'unlisted-z')
GROUP BY 1 ORDER BY turns DESC, 1 LIMIT 8"""))
def p16(spark, sf):
    return P.unpriced_models(P.price_turns(_spelled(spark, sf), rates(spark))) \
        .select("model", "turns")


CUR_SQL = ", ".join(f"('{c}', '{v['symbol']}', CAST({v['per_usd']} AS DOUBLE), {v['decimals']})"
                    for c, v in CURRENCIES.items())


@query("p17_currency", with_plain(f"""
, cur(code, symbol, per_usd, decimals) AS (VALUES {CUR_SQL}),
usd AS (SELECT person, CAST(sum(cost_micro) AS BIGINT) AS m,
  CASE CAST(person AS BIGINT) % 4 WHEN 0 THEN 'MYR' WHEN 1 THEN 'JPY' WHEN 2 THEN 'USD'
    ELSE 'XXX' END AS code FROM priced GROUP BY 1)
SELECT person, m / 1e6 * coalesce(c.per_usd, 1.0) AS amount, coalesce(c.symbol, '$') AS symbol,
  coalesce(c.decimals, 2) AS decimals FROM usd u LEFT JOIN cur c ON u.code = c.code"""))
def p17(spark, sf):
    p = F.col("person").cast("long") % 4
    code = F.when(p == 0, "MYR").when(p == 1, "JPY").when(p == 2, "USD").otherwise("XXX")
    usd = priced(spark, sf).groupBy("person").agg(F.sum("cost_micro").alias("m"))
    shown = usd.select("person", P.convert(F.col("m") / 1e6, code).alias("c"))
    return shown.select("person", "c.amount", "c.symbol", "c.decimals")


PLAN_SQL = ", ".join(f"('{p}', '{v['label']}', CAST({v['price_usd_month']} AS DOUBLE))"
                     for p, v in PLANS.items())


@query("p18_plan_value", with_plain(f"""
, plans(plan, label, price) AS (VALUES {PLAN_SQL}),
t AS (SELECT person, sum(cost_micro) / 1e6 AS cost, count(DISTINCT date) AS days FROM priced GROUP BY 1),
m AS (SELECT person, cost * 30.0::DOUBLE / greatest(1, days) AS monthly FROM t)
SELECT person, plan, label, price AS price_usd_month,
  round_even(monthly, 2) AS api_equivalent_usd_month,
  CASE WHEN price > 0 THEN round_even(monthly / price, 2) END AS multiple,
  CASE WHEN price > 0 THEN CASE WHEN monthly < price THEN 'under-used'
    WHEN monthly < price * 3 THEN 'fair' ELSE 'excellent' END END AS verdict
FROM m, plans"""))
def p18(spark, sf):
    per_person = priced(spark, sf).groupBy("person").agg(
        (F.sum("cost_micro") / 1e6).alias("cost"),
        F.countDistinct(F.to_date("ts")).alias("days"))
    return P.plan_value(per_person)


@query("p22_rolling_usage", with_turns("""
, s AS (SELECT person, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS turns
  FROM turns GROUP BY ALL)
SELECT person, second, turns, CAST(sum(turns) OVER (PARTITION BY person ORDER BY second
  RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM s"""))
def p22(spark, sf):
    return P.rolling_usage(turns(spark, sf), "person", 5)


@query("p22_quota_headroom", with_turns("""
, s AS (SELECT person, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS turns
  FROM turns GROUP BY ALL),
u AS (SELECT person, sum(turns) OVER (PARTITION BY person ORDER BY second
  RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW) AS used FROM s),
q AS (SELECT person, max(used) AS peak_used, quantile_cont(CAST(used AS DOUBLE), 0.9) AS p90_used
  FROM u GROUP BY 1)
SELECT person, CAST(peak_used AS BIGINT) AS peak_used, p90_used, p90_used AS quota,
  'own p90' AS basis, round_even(peak_used * 100.0::DOUBLE / p90_used, 1) AS peak_pct FROM q"""))
def p22_headroom(spark, sf):
    return P.quota_headroom(P.rolling_usage(turns(spark, sf), "person", 5), None)


@query("p22_calendar_quota", with_turns("""
, u AS (SELECT person, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 7 AS week,
  count(*) AS used FROM turns GROUP BY ALL)
SELECT person, max(used) AS peak_used, round_even(quantile_cont(CAST(used AS DOUBLE), 0.9), 6) AS p90_used,
  CAST(10000 AS DOUBLE) AS quota, 'published' AS basis,
  round_even(max(used) * 100.0::DOUBLE / 10000, 1) AS peak_pct FROM u GROUP BY 1"""))
def p22_calendar(spark, sf):
    used = P.calendar_usage(turns(spark, sf), "person", 7)
    return P.quota_headroom(used, 10000).withColumn("p90_used", F.bround("p90_used", 6))


@query("p22_plan_headroom", with_turns("""
, s AS (SELECT person, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS turns FROM turns GROUP BY ALL),
r AS (SELECT person, sum(turns) OVER (PARTITION BY person ORDER BY second
  RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW) AS used FROM s),
c AS (SELECT person, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 7 AS week, count(*) AS used
  FROM turns GROUP BY ALL),
u AS (SELECT person, 'rolling' AS kind, 5 AS length, used FROM r UNION ALL SELECT person, 'calendar', 7, used FROM c),
g AS (SELECT person, kind, length, CAST(max(used) AS BIGINT) AS peak_used,
  quantile_cont(CAST(used AS DOUBLE), 0.9) AS p90 FROM u GROUP BY ALL),
w AS (SELECT *, CASE WHEN CAST(person AS BIGINT) % 3 = 0 THEN CASE kind WHEN 'rolling' THEN 400 ELSE 60000 END END AS amount
  FROM g WHERE CAST(person AS BIGINT) % 3 < 2)
SELECT person, CASE WHEN amount IS NULL THEN 'claude-pro' ELSE 'glm-coding-pro' END AS plan, kind, length, peak_used,
  round_even(p90, 6) AS p90_used, round_even(coalesce(CAST(amount AS DOUBLE), p90), 6) AS quota,
  CASE WHEN amount IS NULL THEN 'own p90' ELSE 'published' END AS basis,
  round_even(peak_used * 100.0::DOUBLE / coalesce(CAST(amount AS DOUBLE), p90), 1) AS peak_pct FROM w"""))
def p22_plan(spark, sf):
    """Each person's use against the windows of the plan that person holds; one plan has none."""
    t = turns(spark, sf)
    n = F.col("person").cast("long") % 3
    holders = t.select("person").distinct().select("person", F.when(n == 0, "glm-coding-pro").when(
        n == 1, "claude-pro").otherwise("none").alias("plan"))
    return P.plan_headroom(t, "person", holders).withColumns(
        {"p90_used": F.bround("p90_used", 6), "quota": F.bround("quota", 6)})
