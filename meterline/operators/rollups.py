"""Digest aggregations: totals, breakdowns, session facts and the three cubes.

All of them aggregate with a partial step before the shuffle, and none groups
into collected lists of unbounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.cluster import small_table
from meterline.functions.clock import local_time
from meterline.functions.labels import (MAIN_THREAD, PLACEHOLDER_MODEL, UNKNOWN_HOUR,
                                        blank_to_null, breakdown_label, cube_label)
from meterline.functions.models import known_model
from meterline.operators.attribution import Topology, gap_fill, tool_counts
from meterline.operators.pricing import RateTables, price_turns, unpriced_filter
from meterline.schema import COUNTERS, event_key

CUBE_DIMS = ("date", "provider", "lane", "entrypoint", "repo", "surface", "model", "effort",
             "agent", "phase")
CUBE_METRICS = ("turns", *COUNTERS, "cost_micro", "cost_floor_micro", "writes", "reads",
                "tool_calls")
SLICE_DIMS = ("date", "provider", "lane", "repo")

# Breakdown -> (measure it is ranked by). Ties are ordered by the label.
BREAKDOWNS = {
    "model": "output", "workspace": "cost", "effort": "turns", "repo": "cost",
    "surface": "cost", "lane": "cost", "provider": "cost", "entrypoint": "cost", "phase": "cost",
}


def enrich(turns: DataFrame, topology: Topology, rates: RateTables,
           zone: str | float = 0) -> DataFrame:
    """Gap-filled, gateway-stripped, priced turns with local time and tool counts."""
    filled = gap_fill(turns, topology)
    return add_report_columns(
        price_turns(filled.withColumn("model", known_model(F.col("model"))), rates), zone)


def add_report_columns(priced: DataFrame, zone: str | float = 0) -> DataFrame:
    counts = tool_counts(F.col("tools"))
    return (priced.withColumn("ts_local", local_time(F.col("ts"), zone))
            .withColumn("date", F.date_format("ts_local", "yyyy-MM-dd"))
            .withColumn("hour", F.date_format("ts_local", "HH"))
            .withColumns(counts))


def bucket() -> list[Column]:
    """The measures every breakdown carries."""
    return [
        F.count("*").alias("turns"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS],
        F.coalesce(F.bround(F.sum("cost"), 4), F.lit(0.0)).alias("cost"),
        F.countDistinct(blank_to_null(F.col("session"))).alias("sessions"),
    ]


def totals(priced: DataFrame) -> DataFrame:
    return priced.agg(*bucket()).select(F.lit("all").alias("scope"), "*")


def sidechain_totals(priced: DataFrame) -> DataFrame:
    return priced.filter("sidechain").agg(*bucket()).select(F.lit("subagents").alias("scope"), "*")


def by_day(priced: DataFrame) -> DataFrame:
    return priced.filter(F.col("date").isNotNull()).groupBy("date").agg(*bucket()).orderBy("date")


def breakdown(priced: DataFrame, name: str) -> DataFrame:
    """One bucket per value of a label column, largest first."""
    rank = BREAKDOWNS[name]
    return (priced.groupBy(breakdown_label(name).alias(name)).agg(*bucket())
            .orderBy(F.desc(rank), name))


def subtotals(priced: DataFrame, dims: list[str], sets: list[tuple[str, ...]]) -> DataFrame:
    """Buckets of several groupings of ``dims`` in one pass over the turns.

    A missing label reads as in the breakdowns, so null always means "all values". ``level`` is
    the grouping's number: the bit of every dimension that is summed over, the first the highest.
    """
    labelled = priced.withColumns({d: breakdown_label(d) for d in dims})
    return labelled.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims]).agg(
        F.grouping_id().cast("bigint").alias("level"), *bucket())


def by_agent(priced: DataFrame) -> DataFrame:
    """Delegated turns only."""
    return (priced.filter("sidechain").groupBy(breakdown_label("agent").alias("agent"))
            .agg(*bucket()).orderBy(F.desc("output"), "agent"))


def by_tool(turns: DataFrame) -> DataFrame:
    return (turns.select(F.explode("tools").alias("tool")).groupBy("tool")
            .agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "tool"))


def by_hour(priced: DataFrame) -> DataFrame:
    """24 slots, empty hours kept."""
    spark = priced.sparkSession
    slots = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    seen = (priced.filter(F.col("ts_local").isNotNull())
            .groupBy(F.hour("ts_local").alias("h")).agg(F.count("*").alias("n")))
    return (slots.join(seen, slots["hour"] == seen["h"], "left")
            .select("hour", F.coalesce("n", F.lit(0)).alias("turns")).orderBy("hour"))


def window_span(priced: DataFrame) -> DataFrame:
    """First and last local stamp, and the active days."""
    # Days first: the list is then built from one row per calendar day.
    days = (priced.filter(F.col("date").isNotNull()).groupBy("date")
            .agg(F.min("ts_local").alias("lo"), F.max("ts_local").alias("hi")))
    return days.agg(F.min("lo").alias("first"), F.max("hi").alias("last"),
                    F.count("*").alias("days"),
                    F.array_sort(F.collect_list("date")).alias("active_days"))


def duplicates(turns: DataFrame) -> DataFrame:
    """Rows beyond the first of each natural key: counted, never dropped."""
    copies = turns.groupBy(event_key().alias("k")).agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("turns"),
                      F.count("*").alias("distinct"))


def synthetic_count(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count_if(F.col("synthetic")).alias("synthetic_events")).select(
        (F.col("synthetic_events") > 0).alias("demo"), "synthetic_events")


def unpriced(priced: DataFrame) -> DataFrame:
    """Turns and cost that rest on the fallback rate."""
    return priced.filter(unpriced_filter()).agg(
        F.count("*").alias("turns"),
        F.coalesce(F.bround(F.sum("cost"), 4), F.lit(0.0)).alias("cost"))


def active_windows(priced: DataFrame, rates: RateTables) -> DataFrame:
    """Peak schedules billed here, with the providers billed on them.

    The window belongs to the model exactly as spelled, not to its alias.
    """
    windows = rates.base.filter(F.col("window").isNotNull()).select(
        F.col("model").alias("w_model"), F.col("window").alias("window_name"))
    used = priced.groupBy("model", "provider").agg(F.lit(1).alias("one"))
    hits = used.join(windows, used["model"] == windows["w_model"]) \
        .filter(F.col("window_name").isin(list(rates.windows) or [""])
                & ~F.contains("window_name", F.lit("legacy")))
    found = hits.groupBy("window_name").agg(
        F.array_sort(F.collect_set(blank_to_null(F.col("provider")))).alias("providers"))
    spec = small_table(
        priced.sparkSession, [(n, w.get("vendor"), [list(map(int, p)) for p in w.get("peak_utc") or []],
          list(w["days"]) if w.get("days") else None, float(w.get("off_peak_mult", 1)))
         for n, w in rates.windows.items()],
        "name string, vendor string, peak_utc array<array<int>>, days array<int>, "
        "off_peak_mult double")
    return found.join(F.broadcast(spec), found["window_name"] == spec["name"]).select(
        "name", "vendor", "peak_utc", "days", "off_peak_mult", "providers")


def main_cube(priced: DataFrame) -> DataFrame:
    """Ten dimensions by twelve integer metrics."""
    agent = F.when(F.col("sidechain"), F.col("agent")).otherwise(F.lit(MAIN_THREAD))
    source = {"agent": agent}
    dims = [cube_label(d, source.get(d)).alias(d) for d in CUBE_DIMS]
    sums = [F.count("*").alias("turns")] + [
        F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in CUBE_METRICS[1:]]
    return priced.groupBy(*dims).agg(*sums)


def hours_cube(priced: DataFrame) -> DataFrame:
    hour = F.coalesce("hour", F.lit(UNKNOWN_HOUR))
    return priced.groupBy(*[cube_label(d).alias(d) for d in SLICE_DIMS], hour.alias("hour")) \
        .agg(F.count("*").alias("turns"))


def tools_cube(priced: DataFrame) -> DataFrame:
    calls = priced.select(*SLICE_DIMS, F.explode("tools").alias("tool"))
    return calls.groupBy(*[cube_label(d).alias(d) for d in (*SLICE_DIMS, "tool")]) \
        .agg(F.count("*").alias("calls"))


def session_facts(priced: DataFrame) -> DataFrame:
    """One row per session; a session id that is missing is called ``unknown``.

    First-seen values use ``min_by`` over (instant, arrival), which combines
    before the shuffle, so one giant session costs one row per input task.
    """
    sid = F.coalesce(blank_to_null(F.col("session")), F.lit("unknown"))
    place = F.struct(F.coalesce(F.unix_micros("ts"), F.lit(-(2**62))), F.col("seq"))
    first_seen = ("workspace", "provider", "lane", "entrypoint", "branch")
    counts = ("input", "output", "cache_create", "cache_read", "reads", "writes", "tool_calls")
    repo, model = blank_to_null(F.col("repo")), blank_to_null(F.col("model"))
    context = F.coalesce("input", F.lit(0)) + F.coalesce("cache_read", F.lit(0)) \
        + F.coalesce("cache_create", F.lit(0))
    # Per (session, area) first: areas are ranked from the same single pass.
    per_area = priced.groupBy(sid.alias("session"), blank_to_null(F.col("surface"))
                              .alias("area")).agg(
        F.min(place).alias("seen"), F.min_by(F.struct(*first_seen), place).alias("opening"),
        F.min_by(repo, F.when(repo.isNotNull(), place)).alias("repo"),
        F.min(F.when(repo.isNotNull(), place)).alias("repo_seen"),
        F.min("ts_local").alias("start"), F.max("ts_local").alias("end"),
        F.count("*").alias("turns"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], F.sum("cost").alias("cost"),
        F.collect_set(F.when(model != PLACEHOLDER_MODEL, model)).alias("models"),
        F.count_if("sidechain").alias("sidechain_turns"), F.max(context).alias("peak_context"))
    facts = per_area.groupBy("session").agg(
        F.min_by("opening", "seen").alias("o"), F.min_by("repo", "repo_seen").alias("repo"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("turns").alias("turns"),
        *[F.sum(c).alias(c) for c in counts], F.bround(F.sum("cost"), 4).alias("cost"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"),
        F.sum("sidechain_turns").alias("sidechain_turns"),
        F.greatest(F.max("peak_context"), F.lit(0)).alias("peak_context"),
        F.min_by("area", F.when(F.col("area").isNotNull(), F.struct(
            (-F.col("turns")).alias("n"), "seen"))).alias("surface"),
        F.count("area").alias("surfaces"))
    return facts.select(
        "session", *[F.col(f"o.{c}").alias(c) for c in first_seen], "repo", "start", "end",
        "turns", "input", "output", "cache_create", "cache_read", "cost", "models", "reads",
        "writes", "tool_calls", "sidechain_turns", "peak_context", "surface", "surfaces")


def reconcile(priced: DataFrame) -> DataFrame:
    """Every cube's sum beside the grand total; ``ok`` must be true in each row."""
    cube, hours, tools = main_cube(priced), hours_cube(priced), tools_cube(priced)
    total = priced.agg(
        F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in COUNTERS],
        *[F.sum(c).alias(c) for c in ("cost_micro", "cost_floor_micro", "writes", "reads",
                                      "tool_calls")])
    want = total.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(m) for m in CUBE_METRICS]),
        F.array(*[F.col(m).cast("long") for m in CUBE_METRICS]))).alias("metric", "total"))

    def tall(frame: DataFrame, name: str, metrics) -> DataFrame:
        sums = frame.agg(*[F.sum(c).alias(m) for m, c in metrics])
        return sums.select(F.lit(name).alias("cube"), F.explode(F.map_from_arrays(
            F.array(*[F.lit(m) for m, _ in metrics]),
            F.array(*[F.col(m).cast("long") for m, _ in metrics]))).alias("metric", "cube_sum"))

    got = tall(cube, "main", [(m, m) for m in CUBE_METRICS]) \
        .unionByName(tall(hours, "hours", [("turns", "turns")])) \
        .unionByName(tall(tools, "tools", [("tool_calls", "calls")]))
    return got.join(F.broadcast(want), "metric").select(
        "cube", "metric", "cube_sum", "total",
        F.col("cube_sum").eqNullSafe(F.col("total")).alias("ok"))
