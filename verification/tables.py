"""Test tables mapped to turn events, in Spark and in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.config import RateCard
from meterline.operators.attribution import Topology
from meterline.operators.pricing import RateTables
from meterline.plans.digest import Digest

CARD = RateCard(
    models={
        "frontier-a": {"vendor": "va", "tier": "frontier", "input": 5.0, "output": 25.0,
                       "cache_read_mult": 0.1},
        "mid-a": {"vendor": "va", "tier": "sonnet", "input": 3.0, "output": 15.0,
                  "cache_read_mult": 0.1},
        "light-a": {"vendor": "va", "tier": "haiku", "input": 1.0, "output": 5.0},
        "mid-b": {"vendor": "vb", "tier": "mid", "input": 2.0, "output": 12.0,
                  "from": "2024-01-15T00:00+08:00"},
        "code-c": {"vendor": "vc", "tier": "mid", "input": 0.95, "output": 4.0,
                   "cache_read_mult": 0.2, "from": "2024-01-10T00:00+08:00"},
        "timed-d": {"vendor": "vd", "tier": "flash", "input": 0.44, "output": 0.88,
                    "cache_read_mult": 0.1, "window": "w-daily"},
        "timed-e": {"vendor": "ve", "tier": "pro", "input": 0.6, "output": 2.2,
                    "cache_read_mult": 0.2, "window": "w-weekday"},
    },
    history={"mid-b": [{"from": "2023-01-01T00:00+08:00", "until": "2024-01-15T00:00+08:00",
                        "input": 2.5, "output": 15.0}],
             "code-c": [{"from": "2023-06-01T00:00+08:00", "until": "2024-01-10T00:00+08:00",
                         "cache_read_mult": 0.1}]},
    windows={"w-daily": {"vendor": "vd", "peak_utc": [[1, 4], [6, 10]], "off_peak_mult": 0.5},
             "w-weekday": {"vendor": "ve", "peak_utc": [[6, 10]], "days": [1, 2, 3, 4, 5],
                           "off_peak_mult": 0.5}},
    speed_overrides={"frontier-a:fast": {"input": 10.0, "output": 50.0}},
    aliases={"light-a-turbo": "light-a"},
    labs={"va": "Lab A", "vb": "Lab B"},
    lines=[{"id": "va-premium", "lab": "va", "label": "A premium", "tier": "premium",
            "headline": True, "models": [
                {"model": "mid-a", "from": "2024-01-01T00:00+08:00"},
                {"model": "frontier-a", "from": "2024-01-20T00:00+08:00"}]},
           {"id": "vb-mid", "lab": "vb", "label": "B mid", "tier": "mid", "models": [
                {"model": "mid-b", "from": "2023-01-01T00:00+08:00"}]}],
)

TOPOLOGY_CONFIG = {
    "code_roots": ["/home/dev/code", "/home/dev/code/clients"],
    "special_roots": {"/home/dev/.config": "dotfiles"},
    "scratch_prefixes": ["/tmp/", "/var/folders/"],
    "worktree_marker": ".worktrees",
    "incidental_repos": ["scratchpad", "dotfiles"],
    "surface_rules": {
        "shop": [["special/*/deep/*", "deep {1}"], ["special/*", "special"]],
        "*": [["src/*", "src/{1}"], ["packages/*", "package:{1}"], ["tests/*", "tests"],
              ["docs/*", "docs"]]},
    "lanes": {"default": "work", "rules": [{"entrypoint": "ide", "lane": "personal"},
                                           {"repo": "infra", "provider": "p-alpha",
                                            "lane": "ops"}]},
}
TOPOLOGY = Topology(TOPOLOGY_CONFIG)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(k, values):
    return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))


MODELS = ["frontier-a", "mid-a", "light-a", "mid-b", "code-c", "timed-d", "timed-e", "unlisted-z"]
PROVIDERS = ["p-alpha", "p-beta", "p-gamma", "p-delta"]
REPOS = [None, "shop", "web", None, "infra", "scratchpad"]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn events derived from every row of ``events``."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    i, kind = F.col("event_id"), F.col("event_type")
    reads = kind.isin("view", "click", "purchase")
    create = F.when(kind == "signup", 20000 + (i * 97) % 90000).otherwise(0)
    none = F.lit(None).cast("string")
    strings = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    e = e.withColumn("k", k)
    k = F.col("k")
    repo = _pick(k, REPOS)
    entry = _pick(k, ["cli", "ide", None])
    provider = _pick(k, PROVIDERS)
    return e.select(
        F.lit(2).alias("v"), provider.alias("provider"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts_raw"), "ts",
        F.concat(F.lit("s"), F.col("user_id"), F.lit("-"), F.unix_date(F.to_date("ts")))
        .alias("session"),
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("w"), F.col("user_id") % 7))
        .alias("workspace"),
        repo.alias("repo"),
        F.when(k % 6 == 1, strings("api")).when(k % 6 == 4, strings("ci")).otherwise(strings())
        .alias("surfaces"),
        none.alias("branch"), entry.alias("entrypoint"),
        TOPOLOGY.lane(repo, entry, provider).alias("lane"),
        _pick(k, MODELS).alias("model"),
        F.when(k % 5 == 0, "high").when(k % 5 == 1, "medium").alias("effort"),
        none.alias("tier"), F.when(k % 7 == 0, "fast").otherwise("standard").alias("speed"),
        (k % 9 == 0).alias("sidechain"), F.when(k % 18 == 0, "explore").alias("agent"),
        (i % 1000).cast("int").alias("turn"),
        (500 + (i * 37) % 4000).alias("input"), (100 + (i * 61) % 9000).alias("output"),
        create.cast("long").alias("cache_create"),
        F.when(reads, (i * 131) % 200000).otherwise(0).cast("long").alias("cache_read"),
        F.when(k % 5 == 0, create).otherwise(0).cast("long").alias("cache_1h"),
        F.lit(0).cast("long").alias("cache_5m"),
        F.when(kind == "view", strings("Read")).when(kind == "click", strings("Read", "Grep"))
        .when(kind == "purchase", strings("Edit")).when(kind == "error", strings("Bash"))
        .otherwise(strings()).alias("tools"),
        F.lit(0).alias("web_search"), F.lit(0).alias("web_fetch"), none.alias("stop"),
        F.lit(False).alias("synthetic"), i.alias("seq"), F.col("user_id").cast("string")
        .alias("person"))


_RATES: dict[str, RateTables] = {}


def rates(spark: SparkSession) -> RateTables:
    """The card is configuration: flattened once per application."""
    app = spark.sparkContext.applicationId
    if app not in _RATES:
        _RATES[app] = RateTables.from_card(spark, CARD)
    return _RATES[app]


def digest(spark: SparkSession, sf_dir: str) -> Digest:
    return Digest.of(turns(spark, sf_dir), TOPOLOGY, CARD, rates(spark))


# ---- the same in plain SQL ----------------------------------------------------

def _case(expr: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {expr} % {len(values)} {arms} END"


SQL_TURNS = f"""
raw_events AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
), turns0 AS (
  SELECT {_case('k', PROVIDERS)} AS provider,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_raw, ts,
    's' || user_id || '-' || date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS session,
    CASE WHEN user_id % 7 <> 0 THEN 'w' || (user_id % 7) END AS workspace,
    {_case('k', REPOS)} AS repo,
    CASE k % 6 WHEN 1 THEN ['api'] WHEN 4 THEN ['ci'] ELSE CAST([] AS VARCHAR[]) END AS surfaces,
    CASE k % 3 WHEN 0 THEN 'cli' WHEN 1 THEN 'ide' END AS entrypoint,
    {_case('k', MODELS)} AS model,
    CASE k % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS effort,
    CASE WHEN k % 7 = 0 THEN 'fast' ELSE 'standard' END AS speed,
    k % 9 = 0 AS sidechain, CASE WHEN k % 18 = 0 THEN 'explore' END AS agent,
    CAST(event_id % 1000 AS INTEGER) AS turn,
    500 + (event_id * 37) % 4000 AS input, 100 + (event_id * 61) % 9000 AS output,
    CASE WHEN event_type = 'signup' THEN 20000 + (event_id * 97) % 90000 ELSE 0 END AS cache_create,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN (event_id * 131) % 200000
         ELSE 0 END AS cache_read,
    CASE WHEN event_type = 'signup' AND k % 5 = 0 THEN 20000 + (event_id * 97) % 90000
         ELSE 0 END AS cache_1h,
    0 AS cache_5m,
    CASE event_type WHEN 'view' THEN ['Read'] WHEN 'click' THEN ['Read', 'Grep']
      WHEN 'purchase' THEN ['Edit'] WHEN 'error' THEN ['Bash']
      ELSE CAST([] AS VARCHAR[]) END AS tools,
    event_id AS seq, CAST(user_id AS VARCHAR) AS person
  FROM raw_events
), turns AS (
  SELECT *, CASE WHEN entrypoint = 'ide' THEN 'personal'
    WHEN repo = 'infra' AND provider = 'p-alpha' THEN 'ops' ELSE 'work' END AS lane
  FROM turns0
)"""

SQL_FILLED = """
g0 AS (
  SELECT *, CASE WHEN repo <> 'scratchpad' THEN repo END AS real_repo FROM turns
), g1 AS (
  SELECT *, coalesce(repo,
    last_value(real_repo IGNORE NULLS) OVER p, first_value(real_repo IGNORE NULLS) OVER f,
    last_value(repo IGNORE NULLS) OVER p, first_value(repo IGNORE NULLS) OVER f) AS repo2
  FROM g0
  WINDOW p AS (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), g2 AS (
  SELECT *, coalesce(repo2 <> 'scratchpad', false) AS is_real,
    last_value(CASE WHEN repo2 <> 'scratchpad' THEN repo2 END IGNORE NULLS) OVER b AS prev_real,
    lag(coalesce(repo2, '')) OVER (PARTITION BY session ORDER BY ts, seq) AS prev_any
  FROM g1
  WINDOW b AS (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g3 AS (
  SELECT *,
    sum(CASE WHEN is_real AND repo2 IS DISTINCT FROM prev_real THEN 1 ELSE 0 END) OVER w AS run_real,
    sum(CASE WHEN coalesce(repo2, '') IS DISTINCT FROM prev_any THEN 1 ELSE 0 END) OVER w AS run_any
  FROM g2
  WINDOW w AS (PARTITION BY session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), g4 AS (
  SELECT *, CASE WHEN is_real THEN 'r' || run_real ELSE 'a' || run_any END AS run,
    surfaces[1] AS own FROM g3
), g5 AS (
  SELECT *, coalesce(last_value(own IGNORE NULLS) OVER p, first_value(own IGNORE NULLS) OVER f) AS near
  FROM g4
  WINDOW p AS (PARTITION BY session, run ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY session, run ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), filled AS (
  SELECT * EXCLUDE (repo, repo2, near, own, real_repo, is_real, prev_real, prev_any, run_real, run_any, run),
    repo2 AS repo, coalesce(own, CASE WHEN repo2 IS NOT NULL THEN near END) AS surface,
    (repo IS NULL AND repo2 IS NOT NULL)
      OR (own IS NULL AND repo2 IS NOT NULL AND near IS NOT NULL) AS inferred
  FROM g5
)"""

SQL_CARD = """
card(model, vendor, tier, c_in, c_out, crm, win) AS (VALUES
  ('frontier-a', 'va', 'frontier', CAST(5.0 AS DOUBLE), CAST(25.0 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(NULL AS VARCHAR)),
  ('mid-a', 'va', 'sonnet', 3.0, 15.0, 0.1, NULL),
  ('light-a', 'va', 'haiku', 1.0, 5.0, 0.1, NULL),
  ('mid-b', 'vb', 'mid', 2.0, 12.0, 0.1, NULL),
  ('code-c', 'vc', 'mid', 0.95, 4.0, 0.2, NULL),
  ('timed-d', 'vd', 'flash', 0.44, 0.88, 0.1, 'w-daily'),
  ('timed-e', 've', 'pro', 0.6, 2.2, 0.2, 'w-weekday'))"""


def _sql_priced(source: str) -> str:
    """Rates, phase, cost and floor of every row of ``source``."""
    return f"""
r0 AS (
  SELECT s.*, c.model IS NOT NULL AS is_priced, c.vendor, c.tier AS model_tier, c.win,
    CASE WHEN s.model = 'frontier-a' AND s.speed = 'fast' THEN CAST(10.0 AS DOUBLE)
         WHEN s.model = 'mid-b' AND s.ts < TIMESTAMP '2024-01-14 16:00:00' THEN CAST(2.5 AS DOUBLE)
         ELSE coalesce(c.c_in, CAST(5.0 AS DOUBLE)) END AS rate_in,
    CASE WHEN s.model = 'frontier-a' AND s.speed = 'fast' THEN CAST(50.0 AS DOUBLE)
         WHEN s.model = 'mid-b' AND s.ts < TIMESTAMP '2024-01-14 16:00:00' THEN CAST(15.0 AS DOUBLE)
         ELSE coalesce(c.c_out, CAST(25.0 AS DOUBLE)) END AS rate_out,
    CASE WHEN s.model = 'code-c' AND s.ts < TIMESTAMP '2024-01-09 16:00:00' THEN CAST(0.1 AS DOUBLE)
         ELSE coalesce(c.crm, CAST(0.1 AS DOUBLE)) END AS rate_cache_mult,
    CASE WHEN c.win IS NULL THEN 'flat'
         WHEN c.win = 'w-weekday' AND isodow(s.ts) > 5 THEN 'off-peak'
         WHEN hour(s.ts) >= 6 AND hour(s.ts) < 10 THEN 'peak'
         WHEN c.win = 'w-daily' AND hour(s.ts) >= 1 AND hour(s.ts) < 4 THEN 'peak'
         ELSE 'off-peak' END AS phase
  FROM {source} s LEFT JOIN card c ON s.model = c.model
), r1 AS (
  SELECT *, CASE WHEN phase = 'off-peak' THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS mult
  FROM r0
), r2 AS (
  SELECT *, rate_in / CAST(1000000.0 AS DOUBLE) * mult AS per_in,
    rate_out / CAST(1000000.0 AS DOUBLE) * mult AS per_out,
    CASE WHEN cache_1h + cache_5m = 0 THEN cache_create ELSE cache_5m END AS short_write
  FROM r1
), r3 AS (
  SELECT *, input * per_in + output * per_out + cache_read * per_in * rate_cache_mult
    + short_write * per_in * CAST(1.25 AS DOUBLE) + cache_1h * per_in * CAST(2.0 AS DOUBLE) AS cost
  FROM r2
), priced AS (
  SELECT *, CASE WHEN win IS NULL THEN cost ELSE cost / mult * CAST(0.5 AS DOUBLE) END AS cost_floor,
    CASE WHEN win IS NULL THEN cost ELSE cost / mult * CAST(1.0 AS DOUBLE) END AS cost_peak,
    CAST(round_even(cost * 1000000.0, 0) AS BIGINT) AS cost_micro,
    CAST(round_even((CASE WHEN win IS NULL THEN cost ELSE cost / mult * CAST(0.5 AS DOUBLE) END)
      * 1000000.0, 0) AS BIGINT) AS cost_floor_micro,
    strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hh,
    CAST(list_contains(tools, 'Edit') AS BIGINT) AS writes,
    CAST(list_contains(tools, 'Read') AS BIGINT) + CAST(list_contains(tools, 'Grep') AS BIGINT) AS reads, len(tools) AS tool_calls
  FROM r3
)"""


SQL_PRICED = f"{SQL_TURNS}, {SQL_FILLED}, {SQL_CARD}, {_sql_priced('filled')}"
# Priced without gap-fill: enough where repo and surface are not read.
SQL_PLAIN = f"{SQL_TURNS}, {SQL_CARD}, {_sql_priced('turns')}"


def with_turns(body: str) -> str:
    return f"WITH {SQL_TURNS}\n{body}"


def with_filled(body: str) -> str:
    return f"WITH {SQL_TURNS}, {SQL_FILLED}\n{body}"


def with_priced(body: str, more: str = "") -> str:
    return f"WITH {SQL_PRICED}{', ' + more if more else ''}\n{body}"


def with_plain(body: str, more: str = "") -> str:
    return f"WITH {SQL_PLAIN}{', ' + more if more else ''}\n{body}"
