"""Rate-card checks and price trends over a card derived from ``part`` and ``lineitem``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.config import FALLBACK, MULTIPLIERS, REFERENCE_MIX, RateCard
from meterline.cluster import write_and_read
from meterline.operators import pricing as P
from meterline.operators import trends as T
from verification.registry import query
from verification.tables import digest, rates, table, with_plain

TODAY = "2001-12-31"
MIX = REFERENCE_MIX
FROM, TO = "1997-01-01", "2000-06-30"


def part_card(spark, sf) -> P.RateTables:
    """Parts as models: prices from the part, one superseded version per shipping year."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    model = F.concat(F.lit("m"), key)
    items = table(spark, sf, "lineitem").withColumn("y", F.year("l_shipdate"))
    years = write_and_read(items.groupBy(F.col("l_partkey").alias("k"), "y").agg(
        F.max("l_discount").alias("disc")), "years")
    order = W.partitionBy("k").orderBy("y")
    stamp = lambda y: F.concat(y.cast("string"), F.lit("-07-01T00:00+08:00"))
    none = F.lit(None)
    history = years.select(
        F.concat(F.lit("m"), F.col("k")).alias("model"),
        (F.row_number().over(order) - 1).cast("int").alias("ord"),
        F.coalesce(stamp(F.lag("y").over(order)), F.lit("1990-01-01T00:00+08:00"))
        .alias("from_raw"),
        stamp(F.col("y")).alias("until_raw"), ((F.col("disc") * 10 + 1) / 3).alias("input"),
        F.when(F.col("y") % 2 == 0, (F.col("disc") * 20 + 2) / 3).alias("output"),
        none.cast("double").alias("cache_read_mult"), none.cast("string").alias("tier"),
        none.cast("string").alias("vendor"))
    last = years.groupBy("k").agg(F.max("y").alias("y")).withColumnRenamed("k", "lk")
    base = part.join(last, part["p_partkey"] == last["lk"], "left").select(
        model.alias("model"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("tier"),
        (F.col("p_retailprice") / 97).alias("input"), (F.col("p_retailprice") / 19)
        .alias("output"),
        F.when(key % 4 == 0, 0.05).when(key % 4 == 1, 0.2).alias("cache_read_mult"),
        none.cast("string").alias("window"),
        F.when(key % 7 == 0, F.lit("2001-07-02T00:00+08:00")).otherwise(stamp(F.col("y")))
        .alias("valid_from_raw"),
        F.when(key % 3 == 0, F.concat(F.lit("200"), (key % 4), F.lit("-01-15T00:00+08:00")))
        .alias("recheck_after"))
    aliases = spark.createDataFrame([], "alias string, target string")
    return P.RateTables(base, history, aliases, None, {}, dict(MULTIPLIERS), dict(FALLBACK)).stored()


def part_lines(spark, sf):
    """Five consecutive parts are the successive models of one line."""
    part = table(spark, sf, "part")
    n, seq = F.floor(F.col("p_partkey") / 5), (F.col("p_partkey") % 5).cast("int")
    return part.select(
        F.concat(F.lit("L"), n).alias("line"), n.cast("int").alias("def"),
        F.concat(F.lit("Brand#"), n % 20).alias("lab"), F.concat(F.lit("line "), n)
        .alias("label"),
        F.when(n % 2 == 0, "premium").otherwise("light").alias("tier"),
        (n % 3 == 0).alias("headline"), seq.alias("seq"),
        F.concat(F.lit("m"), F.col("p_partkey")).alias("model"),
        F.concat((seq + 1995).cast("string"), F.lit("-03-01T00:00+08:00")).alias("line_from"))


def part_labs(spark, sf):
    return part_lines(spark, sf).select("lab").distinct().withColumn(
        "lab_label", F.concat(F.lit("Lab "), F.col("lab")))


def part_points(spark, sf, yours=None):
    return T.points(part_lines(spark, sf), part_card(spark, sf), TODAY, MIX, yours)


D = lambda x: f"CAST({x} AS DOUBLE)"
EFF = " + ".join(f"{D(MIX[c])} * c_{c}" for c in ("input", "cache_write", "cache_read", "output"))

SQL_CARD = """years AS (SELECT l_partkey AS k, year(l_shipdate) AS y, max(l_discount) AS disc
  FROM lineitem GROUP BY 1, 2),
hist AS (SELECT 'm' || k AS model, y, make_timestamp(y, 6, 30, 16, 0, 0.0) AS until, (disc * 10 + 1) / 3 AS h_in,
  CASE WHEN y % 2 = 0 THEN (disc * 20 + 2) / 3 END AS h_out,
  lag(y) OVER (PARTITION BY k ORDER BY y) AS prev_y, row_number() OVER (PARTITION BY k ORDER BY y) - 1 AS ord
  FROM years),
base AS (SELECT 'm' || p_partkey AS model, p_partkey AS k, p_brand AS vendor, p_retailprice / 97 AS b_in,
  p_retailprice / 19 AS b_out,
  CASE p_partkey % 4 WHEN 0 THEN CAST(0.05 AS DOUBLE) WHEN 1 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS mult,
  CASE WHEN p_partkey % 3 = 0 THEN '200' || (p_partkey % 4) || '-01-15' END AS recheck FROM part),
lines AS (SELECT 'L' || (p_partkey // 5) AS line, p_partkey // 5 AS def, 'Brand#' || (p_partkey // 5 % 20) AS lab,
  'line ' || (p_partkey // 5) AS label, (p_partkey // 5) % 3 = 0 AS headline, p_partkey % 5 AS seq,
  'm' || p_partkey AS model, make_timestamp(1995 + p_partkey % 5, 3, 1, 0, 0, 0.0) - INTERVAL 8 HOUR AS start FROM part),
held AS (SELECT *, lead(start) OVER (PARTITION BY line ORDER BY seq) AS stop FROM lines),
at0 AS (SELECT line, def, lab, label, headline, model, start AS moment FROM held
  UNION ALL SELECT line, def, lab, label, headline, h.model, until FROM held JOIN hist h ON held.model = h.model
    AND until > start AND (stop IS NULL OR until < stop)),
at1 AS (SELECT *, strftime(moment + INTERVAL 8 HOUR, '%Y-%m-%d') AS date FROM at0),
at2 AS (SELECT * FROM at1 WHERE date <= '2001-12-31'
  QUALIFY row_number() OVER (PARTITION BY line, date ORDER BY moment DESC, model DESC) = 1),
at3 AS (SELECT a.*, coalesce(h.h_in, b.b_in) AS c_input, coalesce(h.h_out, b.b_out) AS c_output,
  coalesce(h.h_in, b.b_in) * b.mult AS c_cache_read,
  coalesce(h.h_in, b.b_in) * CAST(1.25 AS DOUBLE) AS c_cache_write
  FROM at2 a ASOF LEFT JOIN hist h ON a.model = h.model AND a.moment < h.until JOIN base b ON a.model = b.model),
pts AS (SELECT line, def, lab, label, headline, date, model, round_even(c_input, 6) AS input,
  round_even(c_output, 6) AS output, round_even(c_cache_read, 6) AS cache_read,
  round_even(c_cache_write, 6) AS cache_write, round_even(""" + EFF + """, 6) AS eff_ref FROM at3)"""

SQL_EVENTS = """back AS (SELECT *, lag(date) OVER w AS q_date, lag(model) OVER w AS q_model, lag(eff_ref) OVER w AS q_eff,
  lag(input) OVER w AS q_input, lag(output) OVER w AS q_output, lag(cache_read) OVER w AS q_cache_read,
  lag(cache_write) OVER w AS q_cache_write FROM pts WINDOW w AS (PARTITION BY line ORDER BY date)),
flags AS (SELECT *, abs(input - q_input) > 1e-9 AS ch_input, abs(output - q_output) > 1e-9 AS ch_output,
  abs(cache_read - q_cache_read) > 1e-9 AS ch_cache_read, abs(cache_write - q_cache_write) > 1e-9 AS ch_cache_write FROM back),
evs AS (SELECT *, CASE WHEN q_date IS NOT NULL THEN round_even((eff_ref / q_eff - 1) * 100, 2) END AS delta_pct,
  CASE WHEN q_date IS NULL THEN 'launch' WHEN model <> q_model THEN 'succession'
    WHEN (ch_input OR ch_output OR ch_cache_read OR ch_cache_write) AND eff_ref < q_eff THEN 'cut'
    WHEN ch_input OR ch_output OR ch_cache_read OR ch_cache_write THEN 'rise' END AS kind FROM flags)"""


def sql(body: str, more: str = "") -> str:
    return f"WITH {SQL_CARD}{', ' + more if more else ''}\n{body}"


@query("p19_card_violations", sql("""
, last AS (SELECT model, max(y) AS y FROM hist GROUP BY 1),
bad AS (SELECT 'base-does-not-meet-history' AS rule, b.model AS item FROM base b JOIN last USING (model)
  WHERE b.k % 7 = 0
  UNION ALL SELECT 'line-unknown-lab', line FROM lines WHERE def % 20 >= 18 GROUP BY line
  UNION ALL SELECT 'line-unknown-model', line || '#' || seq FROM lines WHERE CAST(substr(model, 2) AS BIGINT) % 50 = 0
  UNION ALL SELECT 'line-runs-backwards', line || '#3' FROM lines WHERE seq = 3 AND def % 9 = 0
  UNION ALL SELECT 'line-time-format', line || '#1' FROM lines WHERE seq = 1 AND def % 11 = 0
  UNION ALL SELECT 'history-gap-or-overlap', model || '#' || ord FROM hist WHERE ord > 0 AND y % 5 = 0
  UNION ALL SELECT 'history-unknown-model', 'ghost-' || p_brand FROM part GROUP BY p_brand
  UNION ALL SELECT 'mix-does-not-sum-to-1', '1.1000')
SELECT rule, item FROM bad"""))
def p19(spark, sf):
    """The derived card with faults planted in known places."""
    t = part_card(spark, sf)
    ghosts = table(spark, sf, "part").select("p_brand").distinct().select(
        F.concat(F.lit("ghost-"), F.col("p_brand")).alias("model"), F.lit(0).alias("ord"),
        F.lit("1995-01-01T00:00+08:00").alias("from_raw"),
        F.lit("1996-01-01T00:00+08:00").alias("until_raw"))
    late = F.when((F.col("ord") > 0) & (F.substring("until_raw", 1, 4).cast("int") % 5 == 0),
                  F.lit("1991-01-01T00:00+08:00")).otherwise(F.col("from_raw"))
    history = t.history.withColumn("from_raw", late).unionByName(ghosts, allowMissingColumns=True)
    # Only parts that never shipped lack a current start; give those a valid one.
    base = t.base.withColumn("valid_from_raw", F.coalesce(
        "valid_from_raw", F.lit("1990-01-01T00:00+08:00")))
    lines = part_lines(spark, sf)
    number = F.substr("model", F.lit(2)).cast("long")
    lines = lines.withColumn("model", F.when(number % 50 == 0, F.lit("nobody"))
                             .otherwise(F.col("model")))
    lines = lines.withColumn("line_from", F.when(
        (F.col("seq") == 3) & (F.col("def") % 9 == 0), F.lit("1996-01-01T00:00+08:00"))
        .when((F.col("seq") == 1) & (F.col("def") % 11 == 0), F.lit("1996-03-01T00:00Z"))
        .otherwise(F.col("line_from")))
    labs = part_labs(spark, sf).filter(~F.col("lab").isin("Brand#18", "Brand#19"))
    card = RateCard(models={}, reference_mix={**MIX, "input": MIX["input"] + 0.1})
    return P.card_violations(spark, card, replace(t, base=base, history=history), lines, labs)


@query("p20_review_due", sql("""
SELECT model, recheck || 'T00:00+08:00' AS recheck_after FROM base
WHERE recheck IS NOT NULL AND CAST(recheck AS DATE) <= DATE '2001-12-31'"""))
def p20(spark, sf):
    return P.review_due(part_card(spark, sf).base, "2001-12-31 00:00:00")


@query("t01_component_prices", """
WITH """ + SQL_CARD + """, asked AS (SELECT l_orderkey, l_linenumber, 'm' || l_partkey AS model,
  l_shipdate + INTERVAL 1 DAY AS moment FROM lineitem)
SELECT l_orderkey, l_linenumber, a.model, coalesce(h.h_in, b.b_in) AS input, coalesce(h.h_out, b.b_out) AS output,
  coalesce(h.h_in, b.b_in) * b.mult AS cache_read, coalesce(h.h_in, b.b_in) * CAST(1.25 AS DOUBLE) AS cache_write
FROM asked a ASOF LEFT JOIN hist h ON a.model = h.model AND a.moment < h.until JOIN base b ON a.model = b.model""")
def t01(spark, sf):
    """Prices of every shipped part on the day after it shipped."""
    asked = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("m"), F.col("l_partkey")).alias("model"),
        (F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("at"))
    return T.prices_at(asked, "model", "at", part_card(spark, sf)).drop("at")


@query("t02_effective_price", sql("SELECT line, date, eff_ref FROM pts"))
def t02(spark, sf):
    return part_points(spark, sf).select("line", "date", "eff_ref")


_N = "CAST(sum(input + cache_create + cache_read + output) AS BIGINT)"


@query("t03_reader_mix", with_plain(f"""
SELECT {D("sum(input)")} / {_N} AS input, {D("sum(cache_create)")} / {_N} AS cache_write,
  {D("sum(cache_read)")} / {_N} AS cache_read, {D("sum(output)")} / {_N} AS output FROM priced"""))
def t03(spark, sf):
    return T.mix_from_totals(digest(spark, sf).totals)


@query("t04_change_instants", sql("SELECT line, model, moment AS \"at\" FROM at1 WHERE date <= '2001-12-31'"))
def t04(spark, sf):
    return T.instants(part_lines(spark, sf), part_card(spark, sf), TODAY) \
        .select("line", "model", "at")


@query("t05_change_points", sql(
    "SELECT line, date, model, input, output, cache_read, cache_write, eff_ref FROM pts"))
def t05(spark, sf):
    return part_points(spark, sf).select("line", "date", "model", *T.COMPONENTS, "eff_ref")


@query("t05_reader_prices", with_plain(f""", {SQL_CARD}, mix AS (
  SELECT {D("sum(input)")} / {_N} AS m_input, {D("sum(cache_create)")} / {_N} AS m_cache_write,
    {D("sum(cache_read)")} / {_N} AS m_cache_read, {D("sum(output)")} / {_N} AS m_output FROM priced)
SELECT line, date, round_even(m_input * c_input + m_cache_write * c_cache_write + m_cache_read * c_cache_read
  + m_output * c_output, 6) AS eff_you FROM at3, mix"""))
def t05_you(spark, sf):
    return part_points(spark, sf, T.reader_mix(digest(spark, sf).totals)) \
        .select("line", "date", "eff_you")


@query("t06_events", sql("""
SELECT line, lab, date, kind, model, q_model AS from_model, delta_pct,
  concat_ws(',', CASE WHEN ch_input THEN 'input' END, CASE WHEN ch_output THEN 'output' END,
    CASE WHEN ch_cache_read THEN 'cache_read' END, CASE WHEN ch_cache_write THEN 'cache_write' END) AS changed
FROM evs WHERE kind IS NOT NULL""", SQL_EVENTS))
def t06(spark, sf):
    e = T.events(part_points(spark, sf))
    return e.withColumn("changed", F.array_join(
        F.transform("changed", lambda x: x["component"]), ","))


@query("t07_watch", sql("""
SELECT line, model, recheck AS recheck_after, CAST(date_diff('day', DATE '2001-12-31', CAST(recheck AS DATE)) AS INTEGER) AS days_left
FROM (SELECT line, first(model ORDER BY seq DESC) AS model FROM lines GROUP BY 1) JOIN base USING (model)
WHERE recheck IS NOT NULL"""))
def t07(spark, sf):
    return T.watch(part_lines(spark, sf), part_card(spark, sf).base, TODAY)


@query("t08_untraced", sql("""
SELECT vendor, count(*) AS models, list_sort(list(model))[1:3] AS examples,
  CASE vendor WHEN 'Brand#21' THEN '2001-01-01' ELSE '2000-01-01' END AS verified_on
FROM base WHERE vendor NOT IN (SELECT lab FROM lines) GROUP BY 1"""))
def t08(spark, sf):
    return T.untraced(part_card(spark, sf).base, part_lines(spark, sf),
                      {"Brand#21": "2001-01-01"}, "2000-01-01")


@query("t09_labs", sql("""
SELECT lab, 'Lab ' || lab AS lab_label, count(DISTINCT line) AS lines, min(date) AS traced_since
FROM pts GROUP BY lab"""))
def t09(spark, sf):
    return T.labs(part_points(spark, sf), part_labs(spark, sf))


AT = lambda d: (f"(SELECT eff_ref FROM pts p WHERE p.line = l.line AND p.date <= '{d}' "  # noqa: E731
                f"ORDER BY p.date DESC LIMIT 1)")


@query("t10_price_on_day", sql(f"SELECT line, {AT('1998-08-01')} AS value FROM "
                               "(SELECT DISTINCT line FROM pts) l"))
def t10(spark, sf):
    return T.price_on(part_points(spark, sf), "1998-08-01", "eff_ref")


SQL_MOVES = f"""opening AS (SELECT line, def, headline, arg_min(eff_ref, date) AS opening, min(date) AS born
  FROM pts GROUP BY 1, 2, 3),
moves AS (SELECT line, def, headline, coalesce({AT(FROM)}, CASE WHEN born <= '{TO}' THEN opening END) AS base,
  {AT(TO)} AS now FROM opening l),
moved AS (SELECT *, CASE WHEN base <> 0 THEN (now / base - 1) * 100 END AS pct FROM moves),
dirs AS (SELECT *, CASE WHEN pct IS NULL THEN 'none' WHEN pct < -1 THEN 'down' WHEN pct > 1 THEN 'up'
  ELSE 'flat' END AS direction FROM moved)"""


@query("t11_change", sql("SELECT line, base, now, pct, direction FROM dirs", SQL_MOVES))
def t11(spark, sf):
    return T.changes(part_points(spark, sf), "eff_ref", FROM, TO) \
        .select("line", "base", "now", "pct", "direction")


@query("t12_summary", sql(f"""
, s AS (SELECT count(*) AS n, count(*) FILTER (direction = 'down') AS down,
  count(*) FILTER (direction = 'up') AS up, count(*) FILTER (direction = 'flat') AS flat,
  first(line ORDER BY pct, def) AS lo, min(pct) AS lo_pct,
  first(line ORDER BY pct DESC, def DESC) AS hi, max(pct) AS hi_pct FROM dirs WHERE pct IS NOT NULL),
why AS (SELECT line, max(date) AS date, first(kind ORDER BY date DESC) AS kind FROM evs
  WHERE kind IS NOT NULL AND date > '{FROM}' AND date <= '{TO}' AND delta_pct <> 0 GROUP BY 1)
SELECT n, down, up, flat, CASE WHEN lo_pct < -1 THEN lo END AS drop_line,
  CASE WHEN lo_pct < -1 THEN lo_pct END AS drop_pct, CASE WHEN hi_pct > 1 THEN hi END AS rise_line,
  CASE WHEN hi_pct > 1 THEN hi_pct END AS rise_pct, a.date AS drop_date, a.kind AS drop_kind,
  b.date AS rise_date, b.kind AS rise_kind
FROM s LEFT JOIN why a ON a.line = lo AND lo_pct < -1 LEFT JOIN why b ON b.line = hi AND hi_pct > 1""",
                          f"{SQL_EVENTS}, {SQL_MOVES}"))
def t12(spark, sf):
    pts = part_points(spark, sf)
    return T.summary(pts, T.events(pts), "eff_ref", FROM, TO)


@query("t12_biggest_mover", sql("""
SELECT line, pct FROM dirs WHERE pct IS NOT NULL ORDER BY headline DESC, abs(pct) DESC, def LIMIT 1""",
                                SQL_MOVES))
def t12_biggest(spark, sf):
    return T.biggest_mover(T.changes(part_points(spark, sf), "eff_ref", FROM, TO))


@query("t13_model_table", sql("""
SELECT line, label, model, date AS "from", lead(date) OVER (PARTITION BY line ORDER BY date) AS until,
  input, output, cache_read, cache_write, eff_ref FROM pts"""))
def t13(spark, sf):
    return T.model_table(part_points(spark, sf))


@query("t14_index", sql(f"""
, v AS (SELECT line, '{FROM}' AS date, {AT(FROM)} AS value FROM (SELECT DISTINCT line FROM pts) l
  UNION ALL SELECT line, date, eff_ref FROM pts WHERE date > '{FROM}' AND date <= '{TO}')
SELECT line, date, value, value / base * 100 AS "index" FROM v JOIN moves USING (line)
WHERE value IS NOT NULL AND base IS NOT NULL AND base <> 0""", SQL_MOVES))
def t14(spark, sf):
    return T.indexed(part_points(spark, sf), "eff_ref", FROM, TO)


@query("t15_explain", sql(f"""
, e AS (SELECT line, date, kind, {", ".join(
    f"CASE WHEN ch_{c} THEN {D(MIX[c])} * ({c} - q_{c}) ELSE 0 END AS e_{c}, coalesce(ch_{c}, false) AS h_{c}"
    for c in T.COMPONENTS)} FROM evs WHERE kind IS NOT NULL),
f AS (SELECT *, e_input + e_output + e_cache_read + e_cache_write AS total FROM e
  WHERE h_input OR h_output OR h_cache_read OR h_cache_write),
g AS (SELECT *, {", ".join(f"CASE WHEN h_{c} AND total <> 0 THEN CAST(floor(e_{c} / total * 100 + 0.5) AS INTEGER) END AS s_{c}"
                           for c in T.COMPONENTS)} FROM f),
h AS (SELECT *, greatest(s_input, s_output, s_cache_read, s_cache_write) AS top FROM g)
SELECT line, date, kind, s_input AS "input", s_output AS "output", s_cache_read AS cache_read,
  s_cache_write AS cache_write, CASE WHEN top >= 50 THEN CASE top WHEN s_input THEN 'input'
    WHEN s_output THEN 'output' WHEN s_cache_read THEN 'cache_read' ELSE 'cache_write' END END AS lead FROM h""",
                          SQL_EVENTS))
def t15(spark, sf):
    e = T.explain(T.events(part_points(spark, sf)), T.fixed_mix(MIX))
    return e.select("line", "date", "kind", *[F.try_element_at("share_pct", F.lit(c)).alias(c)
                                              for c in T.COMPONENTS], "lead")


@query("t16_events_in_range", sql(f"""
SELECT line, date, kind, model, delta_pct FROM evs WHERE kind <> 'launch' AND line = 'L7'
  AND date > '{FROM}' AND date <= '{TO}'""", SQL_EVENTS))
def t16(spark, sf):
    return T.events_of(T.events(part_points(spark, sf)), "L7", FROM, TO) \
        .select("line", "date", "kind", "model", "delta_pct")


@query("t17_headline_range", sql(f"""
SELECT line, date, model, eff_ref FROM pts WHERE headline AND date >= '2001-01-01'
UNION ALL SELECT 'all', min(date), NULL, NULL FROM pts"""))
def t17(spark, sf):
    """Headline lines in the last 364 days, and where the all-time range starts."""
    pts = part_points(spark, sf)
    near = T.headline_only(pts).filter(F.col("date") >= T.preset_start(pts, TODAY, 364)) \
        .select("line", "date", "model", "eff_ref")
    first = spark.range(1).select(F.lit("all").alias("line"),
                                  T.preset_start(pts, TODAY, None).alias("date"))
    return near.unionByName(first, allowMissingColumns=True)
