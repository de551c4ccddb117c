"""Interactive slices: re-aggregate the cubes and session facts for any filter."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.functions.labels import MAIN_THREAD
from meterline.functions.numbers import pct

SLICERS = ("provider", "lane", "repo")
PANEL_ROWS = 8        # rows of a ranking panel unless a caller asks for more


@dataclass(frozen=True)
class Slice:
    """A date range and optional provider / lane / repo; ``day`` drills to one day."""

    start: str
    end: str
    provider: str | None = None
    lane: str | None = None
    repo: str | None = None
    day: str | None = None

    def clamp(self, first: str, last: str) -> "Slice":
        """Missing edges fall back to the data's; a reversed range collapses to its end."""
        start, end = self.start or first, self.end or last
        start = min(start, end)
        day = self.day if self.day and start <= self.day <= end else None
        return replace(self, start=start, end=end, day=day)

    def drill(self) -> "Slice":
        """The picked day as the whole range."""
        return replace(self, start=self.day, end=self.day) if self.day else self

    def predicate(self, columns: list[str], exempt: str | None = None) -> Column:
        keep = F.col("date").between(self.start, self.end)
        for name in SLICERS:
            wanted = getattr(self, name)
            if wanted is not None and name != exempt and name in columns:
                keep = keep & (F.col(name) == wanted)
        return keep


def sliced(cube: DataFrame, where: Slice, exempt: str | None = None) -> DataFrame:
    return cube.filter(where.predicate(cube.columns, exempt))


def group(cube: DataFrame, where: Slice, by: list[str], exempt: str | None = None) -> DataFrame:
    """Sum every metric of the slice by any dimensions; adds USD ``cost``."""
    kinds = dict(cube.dtypes)
    metrics = [c for c in cube.columns if kinds[c] in ("bigint", "int") and c not in by]
    out = sliced(cube, where, exempt).groupBy(*by).agg(*[F.sum(m).alias(m) for m in metrics])
    if "cost_micro" in metrics:
        out = out.withColumn("cost", F.col("cost_micro") / 1e6)
    return out


def slice_totals(cube: DataFrame, where: Slice) -> DataFrame:
    sub = F.col("agent") != MAIN_THREAD
    sums = ("turns", "input", "output", "cache_create", "cache_read", "cache_1h", "cache_5m",
            "writes", "reads", "tool_calls")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sliced(cube, where).agg(
        *[zero(F.sum(m)).alias(m) for m in sums],
        (zero(F.sum("cost_micro")) / 1e6).alias("cost"),
        zero(F.sum(F.when(sub, F.col("turns")))).alias("sub_turns"),
        zero(F.sum(F.when(sub, F.col("output")))).alias("sub_output"),
        F.countDistinct("date").alias("days"))


def slice_sessions(sessions: DataFrame, where: Slice) -> DataFrame:
    """Sessions by start day; a session without a repo is ``unattributed``."""
    day = F.date_format("start", "yyyy-MM-dd")
    keep = day.between(where.start, where.end)
    for name in SLICERS:
        wanted = getattr(where, name)
        if wanted is not None:
            held = F.col(name)
            if name == "repo":
                held = F.coalesce(F.nullif(held, F.lit("")), F.lit("unattributed"))
            keep = keep & (held == wanted)
    return sessions.filter(keep)


def top_panel(rows: DataFrame, label: str, value: str, keep_zero: Column | None = None,
              n: int = PANEL_ROWS) -> DataFrame:
    """The first ``n`` positive rows; rows named by ``keep_zero`` may be zero (free models)."""
    shown = F.coalesce(F.col(value), F.lit(0)) > 0
    if keep_zero is not None:
        shown = shown | keep_zero
    return rows.filter(shown).orderBy(F.desc(value), label).limit(n)


def spine(spark, start: str, end: str) -> DataFrame:
    """Every day from start to end; empty when reversed."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    valid = F.lit(start).cast("date") <= F.lit(end).cast("date")
    return (spark.range(1).filter(valid).select(F.explode(days).alias("d"))
            .select(F.date_format("d", "yyyy-MM-dd").alias("date")))


def daily_series(cube: DataFrame, where: Slice, metric: str) -> DataFrame:
    """One metric per day of the range, zero-filled."""
    days = spine(cube.sparkSession, where.start, where.end)
    found = group(cube, where, ["date"]).select("date", F.col(metric).alias("v"))
    return days.join(found, "date", "left").select(
        "date", F.coalesce("v", F.lit(0)).alias(metric))


def _trailing() -> W:
    # One row per calendar day - a century is 36,500 - so one task is enough.
    return W.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-6, 0)


def trailing_mean(series: DataFrame, metric: str) -> DataFrame:
    """Seven-day trailing mean; zeros count, early days divide by the days there are."""
    return series.withColumn("mean7", F.avg(F.col(metric).cast("double")).over(_trailing()))


def weekday_hour(hours: DataFrame, where: Slice) -> DataFrame:
    """7 x 24 grid of turns, weekday 0 = Sunday; rows of unknown hour are left out."""
    grid = hours.sparkSession.range(7 * 24).select(
        F.floor(F.col("id") / 24).cast("int").alias("dow"),
        (F.col("id") % 24).cast("int").alias("hour"))
    found = (sliced(hours, where)
             .select((F.dayofweek(F.to_date("date")) - 1).alias("dow"),
                     F.col("hour").try_cast("int").alias("hour"), "turns")
             .filter(F.col("hour").between(0, 23))
             .groupBy("dow", "hour").agg(F.sum("turns").alias("n")))
    return grid.join(found, ["dow", "hour"], "left").select(
        "dow", "hour", F.coalesce("n", F.lit(0)).alias("turns"))


def peak_mask(cube: DataFrame, windows: DataFrame, where: Slice,
              tz_hours: float = 0) -> DataFrame:
    """Reader-local (weekday, hour) cells that some used provider bills at peak rate.

    Weekday 0 = Sunday. ISO days map by ``% 7``. A zone shift moves the weekday
    as well as the hour.
    """
    used = group(cube, where, ["provider"]).select("provider")
    billed = windows.select(
        F.explode("providers").alias("provider"), "peak_utc",
        F.when(F.size(F.coalesce("days", F.array().cast("array<int>"))) > 0, F.col("days"))
        .otherwise(F.array(*[F.lit(d) for d in range(7)])).alias("days"))
    cells = (billed.join(used, "provider", "left_semi")
             .select("provider", "days", F.explode("peak_utc").alias("span"))
             .filter(F.get("span", F.lit(1)) > F.get("span", F.lit(0)))
             .select("provider", "days", F.explode(F.sequence(
                 F.get("span", F.lit(0)), F.get("span", F.lit(1)) - 1)).alias("h"))
             .select("provider", "h", F.explode("days").alias("d")))
    moved = F.floor(F.col("h") + F.lit(float(tz_hours))).cast("int")
    cells = cells.select("provider", F.pmod(moved, F.lit(24)).alias("hour"),
                         F.pmod(F.col("d") + F.floor(moved / 24).cast("int"), F.lit(7))
                         .alias("dow"))
    return cells.groupBy("dow", "hour").agg(
        F.array_sort(F.collect_set("provider")).alias("providers"))


def masked_grid(grid: DataFrame, mask: DataFrame) -> DataFrame:
    cells = mask.select("dow", "hour", F.lit(True).alias("peak"))
    return grid.join(F.broadcast(cells), ["dow", "hour"], "left").select(
        "dow", "hour", "turns", F.coalesce("peak", F.lit(False)).alias("peak"))


def masked_share(grid: DataFrame, mask: DataFrame) -> DataFrame:
    """Share of all turns that fall in masked cells."""
    return masked_grid(grid, mask).agg(
        F.sum("turns").alias("turns"),
        F.sum(F.when(F.col("peak"), F.col("turns")).otherwise(0)).alias("peak_turns")) \
        .withColumn("peak_pct", F.coalesce(F.try_divide(
            F.col("peak_turns") * 100.0, F.col("turns")), F.lit(0.0)))


def best_off_peak_hours(grid: DataFrame, mask: DataFrame, n: int = 3) -> DataFrame:
    """The busiest hours outside the mask, listed by hour."""
    return (masked_grid(grid, mask).filter(~F.col("peak")).groupBy("hour")
            .agg(F.sum("turns").alias("turns")).filter("turns > 0")
            .orderBy(F.desc("turns"), "hour").limit(n).orderBy("hour"))


def calendar(day_turns: DataFrame) -> DataFrame:
    """One row per day between first and last: Monday-aligned week and shade."""
    days = day_turns.select(F.to_date("date").alias("d"), "turns")
    edges = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi"),
                     F.max("turns").alias("top"))
    every = edges.select("lo", "top", F.explode(F.sequence("lo", "hi")).alias("d"))
    filled = every.join(days, "d", "left").withColumn("turns", F.coalesce("turns", F.lit(0)))
    week = F.floor(F.datediff(F.col("d"), F.to_date(F.date_trunc("week", "lo"))) / 7)
    return filled.select(
        F.date_format("d", "yyyy-MM-dd").alias("date"), week.cast("int").alias("week"),
        F.weekday("d").alias("weekday"), "turns",
        F.when(F.col("turns") > 0, F.greatest(F.lit(0.15), F.col("turns") / F.col("top")))
        .alias("shade"))


def session_behaviour(sessions: DataFrame, where: Slice) -> DataFrame:
    """Per start day: sessions and three habits; habits are null on empty days."""
    per_day = (slice_sessions(sessions, where)
               .groupBy(F.date_format("start", "yyyy-MM-dd").alias("date"))
               .agg(F.count("*").alias("n"), F.sum("turns").alias("t"),
                    F.sum("tool_calls").alias("c"),
                    F.count_if(F.size("models") > 1).alias("s")))
    days = spine(sessions.sparkSession, where.start, where.end)
    return days.join(per_day, "date", "left").select(
        "date", F.coalesce("n", F.lit(0)).alias("sessions"),
        (F.col("t") / F.col("n")).alias("turns_per_session"),
        F.when(F.col("n").isNotNull(), F.coalesce(F.try_divide(F.col("c"), F.col("t")),
                                                  F.lit(0.0))).alias("tool_calls_per_turn"),
        (F.lit(100.0) * F.col("s") / F.col("n")).alias("model_switch"))


HABITS = ("turns_per_session", "tool_calls_per_turn", "model_switch")


def rolling_behaviour(behaviour: DataFrame) -> DataFrame:
    """Seven-day means over the active days only."""
    return behaviour.select("date", *[F.avg(h).over(_trailing()).alias(h) for h in HABITS])


def last_window(behaviour: DataFrame, habit: str) -> DataFrame:
    """The final rolling value and the days and sessions behind it."""
    active = F.col(habit).isNotNull()
    rolled = behaviour.select(
        "date", active.alias("active"), F.avg(habit).over(_trailing()).alias("value"),
        F.count_if(active).over(_trailing()).alias("days"),
        F.sum(F.when(active, F.col("sessions")).otherwise(0)).over(_trailing()).alias("sessions"))
    return rolled.agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("date"))).alias("last_value"),
        F.max_by("days", F.when(F.col("active"), F.col("date"))).alias("days"),
        F.max_by("sessions", F.when(F.col("active"), F.col("date"))).alias("sessions"))


def kpis(cube: DataFrame, where: Slice) -> DataFrame:
    """Spend, context reuse, write/read, calls per turn and days used."""
    t = slice_totals(cube, where.drill())
    read = F.col("cache_read") + F.col("cache_create") + F.col("input")
    length = F.datediff(F.lit(where.end).cast("date"), F.lit(where.start).cast("date")) + 1
    days = F.greatest(length, F.lit(0))
    ratio = F.when(F.col("reads") != 0, F.col("writes") / F.col("reads")) \
        .when(F.col("writes") != 0, F.col("writes").cast("double"))
    return t.select(
        F.col("cost").alias("spend"),
        (F.col("cost") / F.greatest(F.lit(1), F.col("days"))).alias("spend_per_active_day"),
        F.coalesce(F.try_divide(F.col("cache_read") * 100.0, read), F.lit(0.0))
        .alias("context_reuse_pct"),
        read.alias("tokens_read"), ratio.alias("write_read"),
        F.coalesce(F.try_divide(F.col("tool_calls"), F.col("turns")), F.lit(0.0))
        .alias("tool_calls_per_turn"),
        F.col("days").alias("active_days"), days.alias("calendar_days"))


def heaviest_sessions(sessions: DataFrame, where: Slice, n: int = PANEL_ROWS) -> DataFrame:
    """Top sessions by output; context as a share of the largest one shown."""
    top = slice_sessions(sessions, where).orderBy(F.desc("output"), "session").limit(n)
    shown = W.partitionBy(F.lit(1))
    return top.select(
        "session", F.coalesce("repo", F.lit("unattributed")).alias("repo"), "surface",
        "provider", F.date_format("start", "yyyy-MM-dd").alias("date"), "turns", "output", "cost",
        "writes", "reads", "peak_context",
        F.coalesce(F.try_divide(F.col("peak_context") * 100.0, F.max("peak_context").over(shown)),
                   F.lit(0.0)).alias("context_pct"))


def phase_panel(cube: DataFrame, where: Slice) -> DataFrame:
    """Time-priced spend: peak share, the off-peak floor and the premium paid."""
    timed = sliced(cube, where).filter(F.col("phase").isin("peak", "off-peak"))
    t = timed.agg(
        F.sum("cost_micro").alias("m"),
        F.sum("cost_floor_micro").alias("f"),
        F.sum(F.when(F.col("phase") == "peak", F.col("cost_micro")).otherwise(0)).alias("p"))
    usd = lambda c: F.col(c) / 1e6
    return t.filter("m > 0").select(
        usd("m").alias("timed_cost"), usd("p").alias("peak_cost"), usd("f").alias("floor_cost"),
        pct(F.col("p"), F.col("m")).alias("peak_pct"),
        F.greatest(F.lit(0.0), (F.col("m") - F.col("f")) / 1e6).alias("premium"))


def repo_ranking(cube: DataFrame, where: Slice, n: int = PANEL_ROWS) -> DataFrame:
    """Repos by cost, ignoring the repo filter this panel sets."""
    return top_panel(group(cube, where, ["repo"], exempt="repo"), "repo", "cost", n=n)


def surfaces_in_focus(cube: DataFrame, where: Slice, n: int = PANEL_ROWS) -> DataFrame:
    """Areas of the selected repo, or of the costliest one when none is selected."""
    by_area = group(cube, where, ["repo", "surface"], exempt="repo")
    if where.repo is not None:
        inside = by_area.filter(F.col("repo") == where.repo)
    else:
        focus = (group(cube, where, ["repo"], exempt="repo")
                 .orderBy(F.desc("cost"), "repo").limit(1).select("repo"))
        inside = by_area.join(F.broadcast(focus), "repo", "left_semi")
    return top_panel(inside, "surface", "cost", n=n)


def model_ranking(cube: DataFrame, where: Slice, free: list[str] | None = None,
                  n: int = PANEL_ROWS) -> DataFrame:
    keep = F.col("model").isin(free) if free else None
    return top_panel(group(cube, where, ["model"]), "model", "cost", keep, n)


def ranking(cube: DataFrame, where: Slice, dim: str, value: str = "cost",
            n: int = PANEL_ROWS) -> DataFrame:
    """Provider, effort or tool ranking of a slice."""
    return top_panel(group(cube, where, [dim]), dim, value, n=n)


def agent_ranking(cube: DataFrame, where: Slice, n: int = PANEL_ROWS) -> DataFrame:
    named = group(cube, where, ["agent"]).filter(
        ~F.col("agent").isin(MAIN_THREAD, "unattributed"))
    return top_panel(named, "agent", "output", n=n)


def model_switch_share(sessions: DataFrame, where: Slice) -> DataFrame:
    """Share of sessions that used more than one model; no row without sessions."""
    return slice_sessions(sessions, where).agg(
        F.count("*").alias("sessions"),
        F.count_if(F.size("models") > 1).alias("switched")).filter("sessions > 0").withColumn(
        "switch_pct", F.col("switched") * 100.0 / F.col("sessions"))


def slicer_values(cube: DataFrame, dim: str) -> DataFrame:
    """Distinct values offered by a slicer, costliest first."""
    return (cube.groupBy(dim).agg((F.sum("cost_micro") / 1e6).alias("cost"))
            .orderBy(F.desc("cost"), dim))
