"""Cohort analytics: pseudonymous person-day facts, slice rollups and percentiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.cluster import lookup_join, write_and_read
from meterline.functions.labels import blank_to_null, breakdown_label
from meterline.operators.privacy import bucket
from meterline.operators.scan import CHUNK_ROWS, by_chunks

# Floors, retention and write window of the fact store.
MIN_PEOPLE, MIN_ACTIVE_DAYS = 5, 7
RETENTION_DAYS, WRITE_DAYS, REBUILD_DAYS = 35, 14, 2
HIST_BUCKETS = 20
ID_CHARS = 24
FLAT_SUMS = ("turns", "sessions", "input", "output", "cache_create", "cache_read", "cache_1h",
             "cache_5m", "writes", "reads", "calls", "cost_micro", "active_minutes")


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC-SHA256 as hex, composed from ``sha2`` with padded key literals."""
    import hashlib
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def pseudonym(secret: str, purpose: str, subject: Column) -> Column:
    """An id for one purpose; ids of two purposes cannot be matched without the secret."""
    return F.left(hmac_sha256(secret, F.concat(F.lit(purpose + ":"), subject)), F.lit(ID_CHARS))


def person_days(priced: DataFrame, auid: str = "auid") -> DataFrame:
    """One row per person and UTC day, with no name of a folder, session or account.

    Turns are combined once to (person, day, session, hour, labels) and stored; everything
    else is summed from there, so the lists collected at the end hold one entry per model,
    tool or label. Turns without a person or a stamp belong to no day of anybody. The days
    are stored as well: whoever reads them several times does not sum them again.
    """
    kind = F.when(F.col("sidechain"), "sub").otherwise("main")
    dims = {"by_model": breakdown_label("model"), "by_effort": breakdown_label("effort"),
            "by_provider": breakdown_label("provider"),
            "by_entrypoint": breakdown_label("entrypoint"), "by_agent_kind": kind}
    t = priced.filter(F.col("ts").isNotNull() & F.col(auid).isNotNull()).withColumn(
        "_day", F.date_format("ts", "yyyy-MM-dd"))
    keys, second = [auid, "_day"], F.unix_seconds("ts")
    context = F.col("input") + F.col("cache_read") + F.col("cache_create")
    sums = ("input", "output", "cache_create", "cache_read", "cache_1h", "cache_5m", "writes", "reads",
            "cost_micro")
    base = write_and_read(t.groupBy(
        *keys, blank_to_null(F.col("session")).alias("_sid"), F.hour("ts").alias("_hour"),
        F.col("model").alias("_model"), *[v.cast("string").alias(d) for d, v in dims.items()]).agg(
        F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in sums], F.sum("tool_calls").alias("calls"),
        F.max(context).alias("peak_context"), F.min(second).alias("_from"), F.max(second).alias("_to")),
        "person-days")
    flat = base.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("turns", *sums, "calls")], F.max("peak_context").alias("peak_context"),
        F.countDistinct("_model").alias("models_used"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("_hour") == h, F.col("turns"))), F.lit(0))
                  for h in range(24)]).alias("by_hour"))
    spans = base.groupBy(*keys, "_sid").agg(
        F.floor((F.max("_to") - F.min("_from")) / 60).alias("m"), F.countDistinct("_model").alias("n"),
    ).groupBy(*keys).agg(
        F.sum("m").alias("active_minutes"), F.count_if(F.col("n") > 1).alias("switch_sessions"),
        F.count("_sid").alias("sessions"))
    tall = base.select(*keys, "turns", "input", "output", "cache_create", "cache_read", "cost_micro",
                       F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"))
                                           for d in dims])).alias("d"))
    per_value = tall.groupBy(*keys, "d.dim", "d.value").agg(*[F.sum(c).alias(c) for c in (
        "turns", "input", "output", "cache_create", "cache_read", "cost_micro")])
    wide = {"by_model": ("turns", "input", "output", "cache_create", "cache_read", "cost_micro"),
            "by_agent_kind": ("turns", "output")}
    maps = []
    for d in dims:
        entry = F.struct("value", F.array(*[F.col(c) for c in wide.get(
            d, ("turns", "output", "cost_micro"))]))
        maps.append(F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("dim") == d, entry)))).alias(d))
    cohort = F.max_by("value", F.when(F.col("dim") == "by_provider", F.struct("turns", "value")))
    by_dim = per_value.groupBy(*keys).agg(*maps, cohort.alias("tool_cohort"))
    calls = t.select(*keys, F.explode("tools").alias("tool")).groupBy(*keys, "tool").agg(
        F.count("*").alias("n"))
    tools = calls.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("by_tool"))
    facts = flat.join(spans, keys).join(by_dim, keys).join(tools, keys, "left")
    facts = facts.withColumnRenamed("_day", "date").withColumn(
        "by_tool", F.coalesce("by_tool", F.create_map().cast("map<string,bigint>")))
    return write_and_read(facts.withColumn("row_id", F.concat_ws(".", auid, "date")).withColumn(
        "fingerprint", fingerprint()), "facts")


def fingerprint() -> Column:
    """Hash of a day's own counts; prices are not part of it."""
    counts = [F.col(c) for c in FLAT_SUMS if c != "cost_micro"]
    return F.hex(F.xxhash64(*counts, "models_used", "switch_sessions", "peak_context",
                            F.col("by_hour")))


def write_set(fresh: DataFrame, today: str, backfilled: bool = True,
              days: int = WRITE_DAYS) -> DataFrame:
    """The last two weeks, or the whole window on the first backfill."""
    if not backfilled:
        return fresh
    return fresh.filter(F.col("date") > F.date_format(
        F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd"))


def changed_days(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Days that are new, or whose counts or price epoch differ from the stored row."""
    have = stored.select(F.col("row_id").alias("s_id"), F.col("fingerprint").alias("s_print"),
                         F.col("price_epoch").alias("s_epoch"))
    both = fresh.join(have, fresh["row_id"] == have["s_id"], "left")
    same = F.col("fingerprint").eqNullSafe(F.col("s_print")) \
        & F.col("price_epoch").eqNullSafe(F.col("s_epoch"))
    return both.filter(F.col("s_id").isNull() | ~same).select(*fresh.columns)


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with the fresh ones in place of their namesakes."""
    kept = stored.join(fresh.select("row_id"), "row_id", "left_anti")
    return kept.select(*stored.columns).unionByName(fresh.select(*stored.columns))


def consented(facts: DataFrame, people: DataFrame) -> DataFrame:
    """Drop opted-out people and days before their pooling began."""
    out = people.filter(~F.col("share")).select("auid")
    start = people.select("auid", "pooling_from")
    return (facts.join(out, "auid", "left_anti").join(start, "auid")
            .filter(F.col("date") >= F.col("pooling_from")).drop("pooling_from"))


def retained(facts: DataFrame, today: str, days: int = RETENTION_DAYS) -> DataFrame:
    return facts.filter(F.col("date") > F.date_format(
        F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd"))


def slices(facts: DataFrame, plan: Column | None = None, declared: Column | None = None,
           vendors: Column | None = None) -> DataFrame:
    """Each fact under every slice it belongs to."""
    tagged = lambda prefix, c: F.transform(c, lambda v: F.concat(F.lit(prefix), v))
    parts = [F.array(F.lit("all")), tagged("tool:", F.array("tool_cohort"))]
    if vendors is not None:
        parts.append(tagged("vendor:", vendors))
    if plan is not None:
        parts.append(tagged("plan:", F.array(plan)))
    if declared is not None:
        parts.append(tagged("cohort:", declared))
    held = F.filter(F.array_distinct(F.concat(*parts)), lambda s: s.isNotNull())
    return facts.withColumn("slice", F.explode(held))


def eligible(facts: DataFrame, min_days: int = MIN_ACTIVE_DAYS) -> DataFrame:
    """Facts of people with enough active days; a one-day visit is not a habit."""
    habit = facts.groupBy("auid").agg(F.countDistinct("date").alias("d")).filter(
        F.col("d") >= min_days).select("auid")
    return facts.join(habit, "auid", "left_semi")


def slice_days(sliced: DataFrame, min_people: int = MIN_PEOPLE) -> DataFrame:
    """Sums per slice and day; thin slices are never written."""
    sums = [F.sum(c).alias(c) for c in FLAT_SUMS]
    return (sliced.groupBy("slice", "date").agg(F.countDistinct("auid").alias("n"), *sums)
            .filter(F.col("n") >= min_people))


def log_edges(low: float, high: float, n: int = HIST_BUCKETS) -> list[float]:
    """Zero, then n - 1 log-spaced edges."""
    ratio = (high / low) ** (1 / (n - 2))
    return [0.0] + [round(low * ratio ** i, 6) for i in range(n - 1)]


# Version 1 range of each histogram; never change one in place.
HIST_RANGES = {
    "cost": (0.01, 1000.0), "output": (100.0, 1e7), "input": (100.0, 1e8), "turns": (1.0, 5000.0),
    "sessions": (1.0, 200.0), "calls_per_turn": (0.05, 20.0), "turns_per_session": (1.0, 500.0),
    "cache_reuse_pct": (1.0, 100.0), "write_read_ratio": (0.01, 20.0),
    "active_minutes": (1.0, 1440.0), "peak_context": (1000.0, 2e6), "models_used": (1.0, 20.0),
    "switch_share_pct": (1.0, 100.0), "output_per_turn": (10.0, 1e5),
    "cost_per_turn": (0.0005, 20.0),
}


def day_metrics() -> dict[str, Column]:
    """The fifteen per-day measures that are put into histograms."""
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    read = c("cache_read") + c("cache_create") + c("input")
    return {
        "cost": c("cost_micro") / 1e6, "output": c("output"), "input": c("input"),
        "turns": c("turns"), "sessions": c("sessions"),
        "calls_per_turn": over(c("calls"), c("turns")),
        "turns_per_session": over(c("turns"), c("sessions")),
        "cache_reuse_pct": over(c("cache_read") * 100.0, read),
        "write_read_ratio": over(c("writes"), c("reads")),
        "active_minutes": c("active_minutes"), "peak_context": c("peak_context"),
        "models_used": c("models_used"),
        "switch_share_pct": over(c("switch_sessions") * 100.0, c("sessions")),
        "output_per_turn": over(c("output"), c("turns")),
        "cost_per_turn": over(c("cost_micro") / 1e6, c("turns")),
    }


def histograms(sliced: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Counts per (slice, date, metric, bucket); ``kept`` limits it to published slices.

    A value's bucket is searched for in one list of all edges, in five halvings, so the code
    stays short enough to be compiled whatever the number of measures.
    """
    names, room = list(HIST_RANGES), 32
    assert HIST_BUCKETS <= room
    edges = F.lit([e for m in names for e in log_edges(*HIST_RANGES[m]) + [float("inf")] * (room - HIST_BUCKETS)])
    values = day_metrics()
    rows = sliced.select("slice", "date", F.posexplode(F.array(*[values[m].cast("double") for m in names])).alias("m", "x")) \
        .withColumn("at", F.col("m") * room)
    step = room // 2
    while step:
        # A null is above no edge.
        rows = rows.withColumn("at", F.col("at") + F.when(F.col("x") >= F.get(edges, F.col("at") + step), step).otherwise(0))
        step //= 2
    out = rows.groupBy("slice", "date", "m", F.least(F.col("at") - F.col("m") * room, F.lit(HIST_BUCKETS - 1)).alias("bucket")) \
        .agg(F.count("*").alias("n")).select(
        "slice", "date", F.get(F.lit(names), F.col("m")).alias("metric"), "bucket", "n")
    if kept is None:
        return out
    return out.join(kept.select("slice", "date"), ["slice", "date"], "left_semi")


def categories(sliced: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Turns per categorical value of each slice and day."""
    parts = None
    for dim in ("by_model", "by_effort", "by_provider", "by_entrypoint"):
        one = sliced.select("slice", "date", F.lit(dim).alias("dim"),
                            F.explode(dim).alias("value", "m")).select(
            "slice", "date", "dim", "value", F.get("m", F.lit(0)).alias("turns"))
        parts = one if parts is None else parts.unionByName(one)
    tools = sliced.select("slice", "date", F.lit("by_tool").alias("dim"),
                          F.explode("by_tool").alias("value", "turns"))
    out = parts.unionByName(tools).groupBy("slice", "date", "dim", "value").agg(
        F.sum("turns").alias("turns"))
    if kept is None:
        return out
    return out.join(kept.select("slice", "date"), ["slice", "date"], "left_semi")


def merge_window(hist: DataFrame, start: str, end: str) -> DataFrame:
    """Histograms of a date range, added bucket by bucket."""
    return hist.filter(F.col("date").between(start, end)).groupBy(
        "slice", "metric", "bucket").agg(F.sum("n").alias("n"))


def _edges_of(metric: Column) -> Column:
    table = F.create_map(*[x for m, r in HIST_RANGES.items() for x in (
        F.lit(m), F.array(*[F.lit(e) for e in log_edges(*r)]))])
    return F.try_element_at(table, metric)


def quantile(merged: DataFrame, q: float) -> DataFrame:
    """Interpolated inside the bucket where the running count reaches q of the total."""
    mine = W.partitionBy("slice", "metric").orderBy("bucket")  # at most 20 rows
    whole = W.partitionBy("slice", "metric")
    run = merged.select("*", F.sum("n").over(mine).alias("upto"),
                        F.sum("n").over(whole).alias("total"))
    target = F.lit(q) * F.col("total")
    landing = run.filter(F.col("upto") >= target).groupBy("slice", "metric").agg(
        F.min_by(F.struct("bucket", "n", "upto", "total"), "bucket").alias("b"))
    edges = _edges_of(F.col("metric"))
    low = F.get(edges, F.col("b.bucket"))
    # The last bucket has no upper edge; its value is its lower edge.
    high = F.coalesce(F.get(edges, F.col("b.bucket") + 1), low)
    part = (F.lit(q) * F.col("b.total") - (F.col("b.upto") - F.col("b.n"))) / F.col("b.n")
    return landing.select("slice", "metric", (low + part * (high - low)).alias("value"))


def percentile_of(viewer: DataFrame, merged: DataFrame) -> DataFrame:
    """Share of the cohort's days below the viewer's bucket; the viewer's value is exact.

    ``viewer`` has (slice, metric, value).
    """
    edges = _edges_of(F.col("metric"))
    spot = viewer.withColumn("own", F.greatest(F.lit(0), F.size(F.filter(
        edges, lambda e: F.col("value") >= e)) - 1))
    both = spot.join(merged.select("slice", "metric", "bucket", "n"), ["slice", "metric"])
    who = [c for c in viewer.columns if c not in ("slice", "metric", "value")]
    return both.groupBy(*who, "slice", "metric", "value").agg(
        (F.sum(F.when(F.col("bucket") < F.col("own"), F.col("n")).otherwise(0)) * 100.0
         / F.sum("n")).alias("percentile"))


def efficiency(priced: DataFrame, by: str = "person", plan_usd: float = 20.0) -> DataFrame:
    """Habits that are ranked - never volume - as (person, metric, value), higher is better."""
    tokens = F.col("input") + F.col("output") + F.col("cache_create") + F.col("cache_read")
    read = F.col("cache_read") + F.col("cache_create") + F.col("input")
    hour = F.concat_ws("/", "session", "date", "hour")
    timed = lambda p: F.sum(F.when(F.col("phase") == p, F.col("cost_micro")).otherwise(0))
    s = priced.groupBy(by).agg(
        F.sum("cache_read").alias("cr"), F.sum(read).alias("read"), F.sum(tokens).alias("tokens"),
        F.sum("writes").alias("w"), F.sum("cost_micro").alias("cost"),
        F.countDistinct(hour).alias("hours"), timed("peak").alias("pk"),
        timed("off-peak").alias("off"), F.countDistinct("date").alias("days"))
    over = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    c = F.col
    metrics = {
        "cache_reuse_pct": over(c("cr") * 100, c("read")),
        "tokens_per_change": -over(c("tokens"), c("w")),
        "cost_per_active_hour": -over(c("cost"), c("hours")) / 1e6,
        "peak_discipline_pct": over(c("off") * 100, c("pk") + c("off")),
        "plan_multiple": over(c("cost") * 30, c("days")) / 1e6 / plan_usd,
    }
    return s.select(by, F.explode(F.array(*[F.struct(
        F.lit(m).alias("metric"), v.alias("value")) for m, v in metrics.items()])).alias("m")) \
        .select(by, "m.metric", "m.value").filter(F.col("value").isNotNull())


def ranked(values: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``percent_rank`` of every value within its metric, without a one-task window.

    A metric of many people is cut into ranges of values; equal values stay together, so a
    rank is the rank inside its range plus the rows of the ranges before.
    """
    values = write_and_read(values, "values")
    totals = values.groupBy(F.col("metric").alias("t_metric")).agg(F.count("*").alias("total"))

    def place(df: DataFrame, chunk: str | None) -> DataFrame:
        part = ["metric", *([chunk] if chunk else [])]
        out = df.withColumn("below", F.rank().over(W.partitionBy(*part).orderBy("value")) - 1)
        if not chunk:
            return out
        earlier = W.partitionBy("metric").orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
        before = df.groupBy(*part).agg(F.count("*").alias("n")).select(
            F.col("metric").alias("b_metric"), F.col(chunk).alias("b_chunk"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        both = lookup_join(out, before, (out["metric"] == before["b_metric"])
                           & (out[chunk] == before["b_chunk"]), "inner")
        return both.withColumn("below", F.col("below") + F.col("before")).drop("b_metric", "b_chunk", "before")

    below = by_chunks(values, ["metric"], ["value"], place, chunk_rows)
    share = F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(0.0)
    return lookup_join(below, totals, below["metric"] == totals["t_metric"], "inner").select(
        *values.columns, share.alias("percent_rank"))


# -- the stored facts ------------------------------------------------------------

FACT_PARTITION = "date"


def write_facts(facts: DataFrame, path: str) -> list[str]:
    """Put facts into a store of one folder per day; returns the days that were written.

    A row replaces its namesake. Only the touched days are rewritten, each beside the store
    first, so a lost job leaves one intact version; a day written twice is the same day.
    """
    spark = facts.sparkSession
    fresh = write_and_read(facts, "facts")
    days = [r[0] for r in fresh.select(FACT_PARTITION).distinct().collect()]
    merged = fresh
    if _days(spark, path):
        merged = upsert(spark.read.schema(fresh.schema).parquet(path).filter(F.col(FACT_PARTITION).isin(days)), fresh)
    write_and_read(merged, "merged").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(FACT_PARTITION).parquet(path)
    return sorted(days)


def write_changed(facts: DataFrame, path: str) -> list[str]:
    """``write_facts`` with only those rows that the store lacks or that have changed."""
    spark = facts.sparkSession
    if _days(spark, path):
        facts = changed_days(facts, spark.read.schema(facts.schema).parquet(path))
    return write_facts(facts, path)


def prune_facts(spark: SparkSession, path: str, today: str, days: int = RETENTION_DAYS) -> list[str]:
    """Remove the folders of days past retention; returns them."""
    limit = str(dt.date.fromisoformat(today) - dt.timedelta(days=days))
    gone = [d for d in _days(spark, path) if d <= limit]
    for day in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{FACT_PARTITION}={day}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def _days(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(FACT_PARTITION + "="))
