"""Sharing and cohort analytics over turns mapped from ``events``."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from meterline.operators import cohorts as K
from meterline.operators import privacy as H
from verification.detector_queries import all_findings, all_findings_sql
from verification.registry import query
from verification.rollup_queries import SESSIONS_SQL
from verification.source_queries import chat_lines
from verification.tables import CARD, digest, rates, table, with_plain, with_priced, with_turns
from verification.pricing_queries import priced as plain_priced
from meterline.operators.rollups import add_report_columns
from meterline.sources.logs import records

D = lambda x: f"CAST({x} AS DOUBLE)"


def reported(spark, sf):
    """Priced turns with report columns; no gap-fill where repos are not read."""
    return add_report_columns(plain_priced(spark, sf))


def _bucket_sql(value: str, edges: list) -> str:
    return "greatest(0, " + " + ".join(
        f"CASE WHEN {value} >= {D(float(e))} THEN 1 ELSE 0 END" for e in edges) + " - 1)"


METRICS_SQL = f"""s AS (SELECT person, count(*) AS turns, greatest(1, count(DISTINCT date)) AS days,
  count(DISTINCT session) AS n, CAST(sum(output) AS BIGINT) AS output, round_even(sum(cost), 4) AS cost,
  CAST(sum(cache_read) AS BIGINT) AS cr, CAST(sum(cache_read + cache_create + input) AS BIGINT) AS rd,
  CAST(sum(tool_calls) AS BIGINT) AS calls, CAST(sum(writes) AS BIGINT) AS w, CAST(sum(reads) AS BIGINT) AS r,
  round_even(coalesce(sum(cost) FILTER (phase = 'peak'), 0), 4) AS pk,
  round_even(coalesce(sum(cost) FILTER (phase = 'off-peak'), 0), 4) AS off FROM priced GROUP BY 1),
m AS (SELECT person, days AS window_days, {D("turns")} / days AS turns_per_day, {D("n")} / days AS sessions_per_day,
  {D("output")} / days AS output_per_day, cost / days AS cost_per_day_usd,
  coalesce(round_even({D(100)} * cr / nullif(rd, 0), 1), 0) AS cache_reuse_pct,
  {D("turns")} / greatest(1, n) AS turns_per_session, {D("calls")} / greatest(1, turns) AS calls_per_turn,
  coalesce(round_even({D(100)} * pk / nullif(pk + off, 0), 1), 0) AS peak_share_pct,
  {D("w")} / greatest(1, r) AS write_read_ratio FROM s)"""


@query("h01_bucket", "SELECT o_orderkey, " + _bucket_sql(
    "o_totalprice", H.BUCKETS["output_per_day"]) + " AS bucket FROM orders")
def h01(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", H.bucket(F.col("o_totalprice"), H.BUCKETS["output_per_day"]).alias("bucket"))


@query("h02_share_metrics", with_plain(
    f", {METRICS_SQL} SELECT person, window_days, " + ", ".join(
        f"{_bucket_sql(x, e)} AS {x}" for x, e in H.BUCKETS.items()) + " FROM m"))
def h02(spark, sf):
    b = H.bucketed(H.person_metrics(reported(spark, sf)))
    return b.select("person", "window_days", *[F.col("metrics")[x].alias(x) for x in H.BUCKETS])


def _mix_sql(col: str) -> str:
    return with_plain(f"""
, v AS (SELECT person, coalesce({col}, 'unknown') AS value, CAST(sum(output) AS BIGINT) AS o FROM priced GROUP BY 1, 2),
w AS (SELECT *, sum(o) OVER (PARTITION BY person) AS t,
  row_number() OVER (PARTITION BY person ORDER BY o DESC, value) AS place FROM v)
SELECT person, value, CAST(round_even({D(100)} * o / CAST(t AS BIGINT), 0) AS INTEGER) AS share FROM w""")


@query("h03_vendor_mix", _mix_sql("vendor"))
def h03(spark, sf):
    mix = H.output_mix(reported(spark, sf), rates(spark).base, "vendor")
    return mix.select("person", F.explode("vendor").alias("value", "share"))


@query("h03_tier_mix", _mix_sql("model_tier"))
def h03_tier(spark, sf):
    mix = H.output_mix(reported(spark, sf), rates(spark).base, "tier")
    return mix.select("person", F.explode("tier").alias("value", "share"))


@query("h04_repo_shape", with_priced("""
, b AS (SELECT DISTINCT person, CAST(('0x' || left(sha256('repo-shape' || chr(0) || repo), 8))::BIGINT % 64 AS INTEGER) AS b
  FROM priced WHERE repo IS NOT NULL AND repo NOT IN ('unattributed', 'unknown'))
SELECT person, list_sort(list(b)) AS repo_shape FROM b GROUP BY 1"""))
def h04(spark, sf):
    return H.repo_shape(digest(spark, sf).priced)


@query("h05_fired_findings", all_findings_sql("SELECT list_sort(list(id)) AS findings FROM g"))
def h05(spark, sf):
    return H.fired(all_findings(spark, sf))


@query("h05_payload_findings", with_turns("""
SELECT person, list_sort(list(DISTINCT 'f' || (seq % 3))) AS findings FROM turns GROUP BY 1"""))
def h05_payload(spark, sf):
    """Findings looked for per person go into that person's payload."""
    p = reported(spark, sf)
    found = p.select("person", F.concat(F.lit("f"), F.col("seq") % 3).alias("id"))
    return H.payload(p, rates(spark).base, findings=found).select("person", "findings")


@query("h06_audit", with_turns("""
SELECT 'session' AS hit UNION ALL SELECT 'extra/branch' UNION ALL
SELECT DISTINCT 'list/*/email' FROM turns UNION ALL SELECT DISTINCT 'deep/*/*/cwd' FROM turns WHERE seq % 5 = 0 UNION ALL
SELECT DISTINCT 'second/*/prompt' FROM turns WHERE seq % 3 = 0 UNION ALL
SELECT DISTINCT 'counts/' || CASE WHEN tool = 'Bash' THEN 'prompt' ELSE 'cwd' END
FROM (SELECT unnest(tools) AS tool FROM turns) WHERE tool IN ('Bash', 'Edit')"""))
def h06(spark, sf):
    """Names planted in columns, nested fields, map keys, later list elements and map values."""
    from verification.tables import turns
    t = turns(spark, sf)
    planted = t.select(
        "person", "session", F.struct(F.lit(1).alias("branch"), F.lit(2).alias("n")).alias("extra"),
        F.map_from_entries(F.transform("tools", lambda x: F.struct(
            F.when(x == "Bash", "prompt").when(x == "Edit", "cwd").when(x == "Read", "a")
            .otherwise("b"), F.lit(1)))).alias("counts"),
        F.array(F.struct(F.lit(1).alias("email"))).alias("list"),
        F.array(F.array(F.create_map(F.lit("k"), F.lit(1))), F.array(
            F.create_map(F.lit("z"), F.lit(1)), F.create_map(F.when(F.col("seq") % 5 == 0, "cwd").otherwise("y"),
                                                             F.lit(2)))).alias("deep"),
        F.create_map(F.lit("a"), F.create_map(F.lit("k"), F.lit(1)), F.lit("b"), F.create_map(
            F.when(F.col("seq") % 3 == 0, "prompt").otherwise("n"), F.lit(1))).alias("second"))
    return H.audit(planted)


@query("h06_payload_is_clean", with_turns("SELECT '' AS hit FROM turns WHERE false"))
def h06_clean(spark, sf):
    return H.audit(H.payload(digest(spark, sf).priced, rates(spark).base, repos=True,
                             cohorts=["solo"]))


_IDX = "event_id % 1000"
_CALL = ('{{"function":{{"args":{{"file_path":"{path}"}},"name":"{name}"}},"type":"{kind}"}}')
_CALLS = ",".join(_CALL.format(path=H.FAKE_PATH, name=n, kind=k) for n, k in (
    ("Read", "function"), ("Skip", "other"), ("Edit", "function")))


@query("h07_redact", f"""
SELECT event_id AS rid, '{{"at":["' || strftime(TIMESTAMP '2026-08-19 01:02:11' + to_seconds(60 * ({_IDX})), '%Y-%m-%dT%H:%M:%S.%gZ') || '"],'
  || CASE WHEN event_id % 2 = 0 THEN '"calls":[{_CALLS}],' ELSE '' END
  || CASE WHEN event_id % 4 <> 0 THEN '"conversation":{{"id":"ses-0001"}},' ELSE '' END
  || CASE WHEN event_id % 7 IN (0, 1) THEN '"entry":"<redacted>",' ELSE '' END
  || '"finish":"stop",' || CASE WHEN event_id % 2 = 0 THEN '"model":"<redacted>",' ELSE '' END
  || '"role":"' || CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'assistant' END || '",'
  || CASE WHEN event_id % 5 <> 0 THEN '"usage":{{"completion":' || (event_id % 70 + 1) || ',"details":{{"cached":'
    || (event_id % 800) || ',"created":' || (event_id % 50) || '}},"prompt":' || (event_id % 900 + 1000) || '}},' ELSE '' END
  || '"workspace":{{"path":"{H.FAKE_PATH}"}}}}' AS json FROM events""")
def h07(spark, sf):
    return H.redact(chat_lines(spark, sf), F.col("line"), F.col("line") % 1000)


@query("h08_profile", """
WITH p AS (SELECT 'finish' AS path, 0 AS numbers, count(*) AS strings, 0 AS markers FROM events
  UNION ALL SELECT 'role', 0, count(*), 2 FROM events
  UNION ALL SELECT DISTINCT 'at', 0, 0, 0 FROM events
  UNION ALL SELECT DISTINCT 'calls', 0, 0, 0 FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT 'conversation.id', 0, count(*), 0 FROM events WHERE event_id % 4 <> 0
  UNION ALL SELECT 'entry', 0, count(*), 0 FROM events WHERE event_id % 7 IN (0, 1)
  UNION ALL SELECT 'model', 0, count(*), 0 FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT 'workspace.path', 0, count(*), 0 FROM events
  UNION ALL SELECT 'usage.' || x, count(*), 0, 0 FROM events, (VALUES ('prompt'), ('completion'), ('details.cached'),
    ('details.created')) v(x) WHERE event_id % 5 <> 0 GROUP BY x)
SELECT path, numbers, strings, CAST(markers AS BIGINT) AS markers FROM p""")
def h08(spark, sf):
    return H.profile(records(chat_lines(spark, sf)), F.col("line")).select(
        "path", "numbers", "strings", "markers")


@query("h08_draft_spec", """
WITH p AS (SELECT * FROM events WHERE event_id % 5 <> 0)
SELECT DISTINCT v.slot, v.value FROM p, (VALUES ('input', 'usage.prompt'), ('output', 'usage.completion'),
  ('cache_read', 'usage.details.cached')) v(slot, value)
UNION ALL SELECT DISTINCT 'model', 'model' FROM events WHERE event_id % 2 = 0
UNION ALL SELECT DISTINCT v.slot, v.value FROM events, (VALUES ('tools:list', 'calls'), ('tools:name', 'function.name'),
  ('tools:args', 'function.args')) v(slot, value) WHERE event_id % 2 = 0
UNION ALL SELECT 'where:role', any_value(role) FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role
  FROM p) HAVING count(DISTINCT role) = 1""")
def h08_spec(spark, sf):
    """No marker separates the priced records here: both roles carry usage."""
    spec = H.draft_spec(records(chat_lines(spark, sf)), F.col("line"))
    rows = [*spec["fields"].items(), *[(f"where:{k}", v) for k, v in spec["where"].items()]]
    rows += [(f"tools:{k}", v) for k, v in spec.get("tools", {}).items() if k != "path_args"]
    if "ts_unit" in spec:
        rows.append(("ts_unit", spec["ts_unit"]))
    return spark.createDataFrame(rows, "slot string, value string")


# ---- cohorts -------------------------------------------------------------------

SECRET = "not-a-secret"
_KEY = SECRET.encode().ljust(64, b"\0")
_HEX = lambda pad: "".join(f"{b ^ pad:02X}" for b in _KEY)
assert len(SECRET) <= hashlib.sha256().block_size


def _hmac_sql(msg: str) -> str:
    return (f"left(sha256(unhex('{_HEX(0x5C)}') || unhex(sha256(unhex('{_HEX(0x36)}') || "
            f"encode({msg})))), 24)")


@query("k01_pseudonyms", f"""
SELECT c_custkey, {_hmac_sql("'uid:' || c_name")} AS uid, {_hmac_sql("'analytics:' || c_name")} AS auid
FROM customer""")
def k01(spark, sf):
    """Two ids of one subject; side by side only here, to be checked."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", K.pseudonym(SECRET, "uid", F.col("c_name")).alias("uid"),
                    K.pseudonym(SECRET, "analytics", F.col("c_name")).alias("auid"))


def facts(spark, sf):
    return K.person_days(reported(spark, sf).withColumn("auid", F.col("person"))) \
        .withColumn("price_epoch", F.lit(1))


FACTS_SQL = """spans AS (SELECT person AS auid, date, CAST(sum(m) AS BIGINT) AS active_minutes,
  count(*) FILTER (n > 1) AS switch_sessions FROM (SELECT person, date, session,
    (CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT)) // 60 AS m, count(DISTINCT model) AS n
    FROM priced GROUP BY ALL) GROUP BY 1, 2),
prov AS (SELECT person AS auid, date, first(provider ORDER BY n DESC, provider DESC) AS tool_cohort FROM (
  SELECT person, date, provider, count(*) AS n FROM priced GROUP BY ALL) GROUP BY 1, 2),
flat AS (SELECT person AS auid, date, count(*) AS turns, count(DISTINCT session) AS sessions,
  CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
  CAST(sum(cache_create) AS BIGINT) AS cache_create, CAST(sum(cache_read) AS BIGINT) AS cache_read,
  CAST(sum(cache_1h) AS BIGINT) AS cache_1h, CAST(sum(cache_5m) AS BIGINT) AS cache_5m,
  CAST(sum(writes) AS BIGINT) AS writes, CAST(sum(reads) AS BIGINT) AS reads,
  CAST(sum(tool_calls) AS BIGINT) AS calls, CAST(sum(cost_micro) AS BIGINT) AS cost_micro,
  max(input + cache_read + cache_create) AS peak_context, count(DISTINCT model) AS models_used
  FROM priced GROUP BY 1, 2),
facts AS (SELECT * FROM flat JOIN spans USING (auid, date) JOIN prov USING (auid, date))"""


@query("k02_person_days", with_plain(f"""
, {FACTS_SQL},
h AS (SELECT person AS auid, date, {", ".join(f"count(*) FILTER (hour(ts) = {i}) AS h{i}" for i in range(24))}
  FROM priced GROUP BY 1, 2),
mm AS (SELECT person AS auid, date, string_agg(model || '=' || n || '/' || o, ',' ORDER BY model) AS models FROM (
  SELECT person, date, model, count(*) AS n, sum(output) AS o FROM priced GROUP BY ALL) GROUP BY 1, 2),
tl AS (SELECT person AS auid, date, string_agg(tool || '=' || n, ',' ORDER BY tool) AS tools FROM (
  SELECT person, date, tool, count(*) AS n FROM (SELECT person, date, unnest(tools) AS tool FROM priced) GROUP BY ALL)
  GROUP BY 1, 2)
SELECT f.*, [{", ".join(f"h{i}" for i in range(24))}] AS by_hour, models, coalesce(tools, '') AS tools
FROM facts f JOIN h USING (auid, date) JOIN mm USING (auid, date) LEFT JOIN tl USING (auid, date)"""))
def k02(spark, sf):
    f = facts(spark, sf)
    models = F.array_join(F.transform(F.map_entries("by_model"), lambda e: F.concat(
        e["key"], F.lit("="), F.get(e["value"], F.lit(0)), F.lit("/"),
        F.get(e["value"], F.lit(2)))), ",")
    tools = F.array_join(F.transform(F.map_entries("by_tool"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), ",")
    return f.select("auid", "date", *K.FLAT_SUMS, "peak_context", "models_used", "switch_sessions",
                    "tool_cohort", "by_hour", models.alias("models"), tools.alias("tools"))


K3 = "SELECT auid, date, turns, CASE WHEN {new} THEN 2 ELSE 1 END AS price_epoch FROM facts"


@query("k03_upsert", with_plain(f", {FACTS_SQL} " + K3.format(new="date > '2024-01-16'")))
def k03(spark, sf):
    """A re-upload replaces the last fourteen days in place and adds no second row."""
    f = facts(spark, sf)
    fresh = K.write_set(f.withColumn("price_epoch", F.lit(2)), "2024-01-30")
    return K.upsert(f, fresh).select("auid", "date", "turns", "price_epoch")


@query("k03_written_facts", with_plain(f", {FACTS_SQL} " + K3.format(new="date > '2024-01-16'")))
def k03_written(spark, sf):
    """The same through a store on disk: written twice, one row per person and day."""
    from meterline.cluster import scratch_path
    f, path = facts(spark, sf), scratch_path(spark, "facts")
    K.write_facts(f, path)
    for _ in range(2):
        K.write_facts(K.write_set(f.withColumn("price_epoch", F.lit(2)), "2024-01-30"), path)
    return spark.read.schema(f.schema).parquet(path).select("auid", "date", "turns", "price_epoch")


@query("k04_written_changes", with_plain(f"""
, {FACTS_SQL} SELECT DISTINCT date FROM facts WHERE date IN ('2024-01-05', '2024-01-09')"""))
def k04_written(spark, sf):
    """Only the days with a changed or a missing row are written."""
    from meterline.cluster import scratch_path
    f, path = facts(spark, sf), scratch_path(spark, "facts")
    K.write_facts(f.filter("date <> '2024-01-09'").withColumn("fingerprint", F.when(
        F.col("date") == "2024-01-05", "old").otherwise(F.col("fingerprint"))), path)
    return spark.createDataFrame([(d,) for d in K.write_changed(f, path)], "date string")


@query("k11_pruned_store", with_plain(f""", {FACTS_SQL} SELECT date, count(*) AS people FROM facts
WHERE date > '2024-01-16' GROUP BY 1"""))
def k11_pruned(spark, sf):
    """Folders past retention are removed from the store."""
    from meterline.cluster import scratch_path
    f, path = facts(spark, sf), scratch_path(spark, "facts")
    K.write_facts(f, path)
    K.prune_facts(spark, path, "2024-02-20")
    return spark.read.schema(f.schema).parquet(path).groupBy("date").agg(F.count("*").alias("people"))


@query("k04_changed_days", with_plain(f"""
, {FACTS_SQL} SELECT auid, date FROM facts
WHERE date = '2024-01-05' OR CAST(auid AS BIGINT) % 10 = 3 OR CAST(auid AS BIGINT) % 10 = 4"""))
def k04(spark, sf):
    """Changed counts, a changed price epoch and a missing row each force a write."""
    f = facts(spark, sf)
    who = F.col("auid").cast("long") % 10
    stored = f.withColumn("turns", F.when(F.col("date") == "2024-01-05", F.col("turns") + 1)
                          .otherwise(F.col("turns"))) \
        .withColumn("fingerprint", K.fingerprint()) \
        .withColumn("price_epoch", F.when(who == 3, 0).otherwise(1)).filter(who != 4)
    return K.changed_days(f, stored).select("auid", "date")


SLICED_SQL = f"""{FACTS_SQL},
sliced AS (SELECT *, unnest(['all', 'tool:' || tool_cohort, 'plan:p' || (CAST(auid AS BIGINT) % 3),
  'cohort:c' || (CAST(auid AS BIGINT) % 40)]) AS slice FROM facts)"""


def sliced(f):
    n = F.col("auid").cast("long")
    return K.slices(f, plan=F.concat(F.lit("p"), n % 3),
                    declared=F.array(F.concat(F.lit("c"), n % 40)))


@query("k05_slices", with_plain(
    f", {SLICED_SQL} SELECT slice, count(*) AS rows, count(DISTINCT auid) AS people FROM sliced GROUP BY 1"))
def k05(spark, sf):
    return sliced(facts(spark, sf)).groupBy("slice").agg(
        F.count("*").alias("rows"), F.countDistinct("auid").alias("people"))


SUMS_SQL = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in K.FLAT_SUMS)


@query("k06_slice_days", with_plain(
    f", {SLICED_SQL} SELECT slice, date, count(DISTINCT auid) AS n, {SUMS_SQL} FROM sliced GROUP BY 1, 2"))
def k06(spark, sf):
    return K.slice_days(sliced(facts(spark, sf)), min_people=1)


_M = {
    "cost": "cost_micro / 1e6::DOUBLE", "output": D("output"), "input": D("input"),
    "turns": D("turns"), "sessions": D("sessions"), "calls_per_turn": f"{D('calls')} / turns",
    "turns_per_session": f"{D('turns')} / sessions",
    "cache_reuse_pct": f"cache_read * {D(100)} / nullif(cache_read + cache_create + input, 0)",
    "write_read_ratio": f"coalesce({D('writes')} / nullif(reads, 0), 0)",
    "active_minutes": D("active_minutes"), "peak_context": D("peak_context"),
    "models_used": D("models_used"), "switch_share_pct": f"switch_sessions * {D(100)} / sessions",
    "output_per_turn": f"{D('output')} / turns", "cost_per_turn": "cost_micro / 1e6::DOUBLE / turns",
}
TALL_SQL = "tall AS (" + " UNION ALL ".join(
    f"SELECT slice, date, auid, '{m}' AS metric, {_bucket_sql(v, K.log_edges(*K.HIST_RANGES[m]))} AS bucket FROM sliced"
    for m, v in _M.items()) + ")"


@query("k06_histograms", with_plain(f""", {SLICED_SQL}, {TALL_SQL}
SELECT slice, date, metric, bucket, count(*) AS n FROM tall GROUP BY ALL"""))
def k06_hist(spark, sf):
    return K.histograms(sliced(facts(spark, sf)))


@query("k06_categories", with_plain(f""", {SLICED_SQL},
pv AS (SELECT person AS auid, date, 'by_provider' AS dim, provider AS value, count(*) AS turns FROM priced GROUP BY ALL
  UNION ALL SELECT person, date, 'by_model', model, count(*) FROM priced GROUP BY ALL
  UNION ALL SELECT person, date, 'by_effort', coalesce(effort, 'unset'), count(*) FROM priced GROUP BY ALL
  UNION ALL SELECT person, date, 'by_entrypoint', coalesce(entrypoint, 'unknown'), count(*) FROM priced GROUP BY ALL
  UNION ALL SELECT person, date, 'by_tool', tool, count(*) FROM (SELECT person, date, unnest(tools) AS tool FROM priced) GROUP BY ALL)
SELECT slice, date, dim, value, CAST(sum(pv.turns) AS BIGINT) AS turns FROM sliced JOIN pv USING (auid, date) GROUP BY ALL"""))
def k06_cat(spark, sf):
    return K.categories(sliced(facts(spark, sf)))


ELIG_SQL = f"""{SLICED_SQL}, fit AS (SELECT auid FROM facts GROUP BY 1 HAVING count(DISTINCT date) >= 12),
kept AS (SELECT slice, date, count(DISTINCT auid) AS n FROM sliced WHERE auid IN (SELECT auid FROM fit)
  GROUP BY 1, 2 HAVING count(DISTINCT auid) >= 5)"""


@query("k07_suppression", with_plain(f", {ELIG_SQL} SELECT slice, date, n FROM kept"))
def k07(spark, sf):
    """Thin slices and people with few active days never reach the table."""
    f = K.eligible(facts(spark, sf), min_days=12)
    return K.slice_days(sliced(f)).select("slice", "date", "n")


MERGED_SQL = f"""{ELIG_SQL}, {TALL_SQL}, merged AS (SELECT slice, metric, bucket, count(*) AS n FROM tall
  JOIN kept USING (slice, date) WHERE auid IN (SELECT auid FROM fit) AND date BETWEEN '2024-01-08' AND '2024-01-21'
  GROUP BY ALL),
edge(metric, b, e) AS (VALUES {", ".join(f"('{m}', {i}, {D(e)})" for m, r in K.HIST_RANGES.items()
                                        for i, e in enumerate(K.log_edges(*r)))})"""


def merged(spark, sf):
    f = K.eligible(facts(spark, sf), min_days=12)
    s = sliced(f)
    return K.merge_window(K.histograms(s, K.slice_days(s)), "2024-01-08", "2024-01-21")


@query("k08_merged_quantile", with_plain(f""", {MERGED_SQL},
run AS (SELECT *, sum(n) OVER (PARTITION BY slice, metric ORDER BY bucket) AS upto,
  sum(n) OVER (PARTITION BY slice, metric) AS total FROM merged),
land AS (SELECT * FROM run WHERE upto >= {D(0.75)} * total
  QUALIFY row_number() OVER (PARTITION BY slice, metric ORDER BY bucket) = 1)
SELECT slice, l.metric, round_even(a.e + ({D(0.75)} * total - (upto - n)) / n * (coalesce(c.e, a.e) - a.e), 6) AS value
FROM land l JOIN edge a ON a.metric = l.metric AND a.b = l.bucket
LEFT JOIN edge c ON c.metric = l.metric AND c.b = l.bucket + 1"""))
def k08(spark, sf):
    return K.quantile(merged(spark, sf), 0.75).withColumn("value", F.bround("value", 6))


@query("k09_percentile_rank", with_plain(f""", {MERGED_SQL},
v AS (SELECT auid, 'all' AS slice, 'output' AS metric, CAST(sum(output) AS BIGINT) / {D("count(*)")} AS value
  FROM facts GROUP BY 1),
o AS (SELECT *, {_bucket_sql("value", K.log_edges(*K.HIST_RANGES["output"]))} AS own FROM v)
SELECT auid, o.slice, o.metric, value, CAST(coalesce(sum(n) FILTER (bucket < own), 0) AS BIGINT) * {D(100)}
  / CAST(sum(n) AS BIGINT) AS percentile FROM o JOIN merged m ON m.slice = o.slice AND m.metric = o.metric
GROUP BY ALL"""))
def k09(spark, sf):
    viewer = facts(spark, sf).groupBy("auid").agg(
        (F.sum("output") / F.count("*")).alias("value")).select(
        "auid", F.lit("all").alias("slice"), F.lit("output").alias("metric"), "value")
    return K.percentile_of(viewer, merged(spark, sf))


@query("k10_consent", with_plain(f""", {FACTS_SQL} SELECT auid, date, turns FROM facts
WHERE CAST(auid AS BIGINT) % 4 <> 0 AND date >= CASE WHEN CAST(auid AS BIGINT) % 3 = 0 THEN '2024-01-11' ELSE '2024-01-02' END"""))
def k10(spark, sf):
    """Opted-out people vanish; the others are pooled from the day after their first sync."""
    n = F.col("auid").cast("long")
    f = facts(spark, sf)
    people = f.select("auid").distinct().select(
        "auid", (n % 4 != 0).alias("share"),
        F.when(n % 3 == 0, "2024-01-11").otherwise("2024-01-02").alias("pooling_from"))
    return K.consented(f, people).select("auid", "date", "turns")


@query("k11_retention", with_plain(f""", {FACTS_SQL} SELECT auid, date, turns FROM facts
WHERE date > '2024-01-16'"""))
def k11(spark, sf):
    return K.retained(facts(spark, sf), "2024-02-20").select("auid", "date", "turns")


@query("k12_efficiency_rank", with_plain(f"""
, s AS (SELECT person, CAST(sum(cache_read) AS BIGINT) AS cr, CAST(sum(cache_read + cache_create + input) AS BIGINT) AS rd,
  CAST(sum(input + output + cache_create + cache_read) AS BIGINT) AS tokens, CAST(sum(writes) AS BIGINT) AS w,
  CAST(sum(cost_micro) AS BIGINT) AS cost, count(DISTINCT session || '/' || date || '/' || hh) AS hours,
  CAST(coalesce(sum(cost_micro) FILTER (phase = 'peak'), 0) AS BIGINT) AS pk,
  CAST(coalesce(sum(cost_micro) FILTER (phase = 'off-peak'), 0) AS BIGINT) AS off, count(DISTINCT date) AS days
  FROM priced GROUP BY 1),
v AS (SELECT person, 'cache_reuse_pct' AS metric, {D("cr * 100")} / nullif(rd, 0) AS value FROM s
  UNION ALL SELECT person, 'tokens_per_change', -({D("tokens")} / nullif(w, 0)) FROM s
  UNION ALL SELECT person, 'cost_per_active_hour', -({D("cost")} / nullif(hours, 0)) / 1e6::DOUBLE FROM s
  UNION ALL SELECT person, 'peak_discipline_pct', {D("off * 100")} / nullif(pk + off, 0) FROM s
  UNION ALL SELECT person, 'plan_multiple', {D("cost * 30")} / nullif(days, 0) / 1e6::DOUBLE / 20.0::DOUBLE FROM s)
SELECT person, metric, value, percent_rank() OVER (PARTITION BY metric ORDER BY value) AS percent_rank
FROM v WHERE value IS NOT NULL"""))
def k12(spark, sf):
    """Ranked in chunks of a hundred values, as a metric with many people would be."""
    return K.ranked(K.efficiency(reported(spark, sf)), chunk_rows=100)
