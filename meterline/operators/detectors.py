"""Rule detectors: each is a query over digest frames yielding no or one finding.

A finding is a row of ``FINDING``: numbers in ``evidence``, names in ``labels``
and ranked rows in ``examples``. No detector reads raw turns, and a detector
whose condition is null on this data yields nothing.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.config import PLANS, Thresholds
from meterline.functions.numbers import pct, per_month
from meterline.operators.pricing import currency_struct, plan_value
from meterline.plans.digest import Digest

FINDING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("saving", T.DoubleType()),
    T.StructField("evidence", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("examples", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()),
        T.StructField("extra", T.DoubleType())]))),
])


def _finding(df: DataFrame, id_: Column | str, severity: Column | str, evidence: dict,
             confidence: str = "high", saving: Column | None = None, labels: dict | None = None,
             examples: Column | None = None) -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    no_examples = F.array().cast(FINDING["examples"].dataType)

    def as_map(items: dict, kind: str) -> Column:
        flat = [x for k, v in items.items() for x in (F.lit(k), v.cast(kind))]
        return (F.create_map(*flat) if flat else F.create_map()).cast(f"map<string,{kind}>")

    return df.select(
        lit(id_).alias("id"), lit(severity).alias("severity"), F.lit(confidence)
        .alias("confidence"),
        (F.bround(saving, 2) if saving is not None else F.lit(None)).cast("double")
        .alias("saving"),
        as_map(evidence, "double").alias("evidence"),
        as_map(labels or {}, "string").alias("labels"),
        F.coalesce(examples.cast(FINDING["examples"].dataType), no_examples).alias("examples")
        if examples is not None else no_examples.alias("examples"))


def _days(d: Digest) -> Column:
    """Active days, as a one-value subquery."""
    return d.window.select("days").scalar()


def _monthly(d: Digest, amount: Column) -> Column:
    return per_month(amount, _days(d))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _examples(rows: DataFrame, name: str, value: str, extra: str) -> Column:
    """A handful of already-limited rows as one array, in rank order."""
    ranked = rows.select(F.struct(
        F.monotonically_increasing_id().alias("i"), F.col(name).cast("string").alias("name"),
        F.col(value).cast("double").alias("value"), F.col(extra).cast("double").alias("extra"))
        .alias("r"))
    listed = ranked.coalesce(1).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return listed.select(F.transform("rs", lambda r: F.struct(
        r["name"].alias("name"), r["value"].alias("value"), r["extra"].alias("extra")))
        .alias("examples")).scalar()


def cache_efficiency(d: Digest, t: Thresholds) -> DataFrame:
    read = F.col("cache_read") + F.col("cache_create") + F.col("input")
    share = F.coalesce(_ratio(F.col("cache_read"), read), F.lit(0.0))
    healthy = share >= t.cache_read_share_floor
    m = d.rates.multipliers
    excess = F.col("cache_create") * (m["cache_write_5m"] - m["cache_read"]) * 5.0 / 1_000_000
    return _finding(
        d.totals, F.when(healthy, "cache-healthy").otherwise("cache-cold"),
        F.when(healthy, "info").otherwise("high"),
        {"cache_read_share_pct": pct(F.col("cache_read"), read), "cache_read": F.col("cache_read"),
         "cache_create": F.col("cache_create"), "fresh_input": F.col("input")},
        saving=F.when(~healthy, _monthly(d, excess)))


def cold_cache_sessions(d: Digest, t: Thresholds) -> DataFrame:
    victims = d.sessions.filter((F.col("cache_create") >= t.cold_cache_min_tokens)
                                & (F.col("cache_read") == 0))
    s = victims.agg(F.count("*").alias("n"), F.sum("cache_create").alias("wasted"),
                    F.sum("cost").alias("cost")).filter("n > 0")
    top = victims.orderBy(F.desc("cache_create"), F.desc("output"), "session").limit(5)
    return _finding(
        s, "cache-write-never-read", "high",
        {"sessions": F.col("n"), "tokens_written_unused": F.col("wasted"),
         "observed_cost_usd": F.bround("cost", 2)},
        saving=_monthly(d, F.col("cost") * 0.2),
        examples=_examples(top, "session", "cache_create", "turns"))


def _card_rows(d: Digest) -> DataFrame:
    return d.rates.base.select(F.col("model").alias("c_model"), "vendor", "tier", "window",
                               F.col("output").alias("c_output"))


def models_with_card(d: Digest) -> DataFrame:
    """Model rows with the card's vendor and tier, matched on the name as spelled."""
    rows, card = d.by_model, _card_rows(d)
    return rows.join(card, rows["model"] == card["c_model"], "left")


def _output_rate(d: Digest, model: str) -> float:
    return float((d.card.models.get(model) or d.card.fallback)["output"])


def premium_model_on_light_work(d: Digest, t: Thresholds) -> DataFrame:
    tier = F.when(F.col("c_model").isNull(), F.lit(d.card.fallback.get("tier"))) \
        .otherwise(F.col("tier"))
    prem = models_with_card(d).filter(tier.isin(*t.premium_tiers) & (F.col("turns") > 0))
    s = prem.agg(F.sum("turns").alias("turns"), F.sum("output").alias("output"))
    mean = F.col("output") / F.col("turns")
    delta = (_output_rate(d, t.premium_model) - _output_rate(d, t.cheaper_model)) / 1_000_000
    names = prem.orderBy(F.desc("output"), "model").limit(t.premium_examples)
    return _finding(
        s.filter((F.col("turns") >= t.premium_min_turns) & (mean < t.light_turn_output)),
        "premium-tier-light-turns", "medium",
        {"premium_turns": F.col("turns"), "mean_output_tokens": F.bround(mean, 1)},
        confidence="medium", saving=_monthly(d, F.col("output") * delta * 0.4),
        examples=_examples(names, "model", "output", "turns"))


def exploration_without_output(d: Digest, t: Thresholds) -> DataFrame:
    victims = d.sessions.filter((F.col("reads") >= t.explore_min_reads) & (F.col("writes") == 0)
                                & (F.col("cost") >= t.explore_min_cost))
    s = victims.agg(F.count("*").alias("n"), F.sum("reads").alias("reads"),
                    F.sum("cost").alias("cost")).filter("n > 0")
    top = victims.orderBy(F.desc("cost"), F.desc("output"), "session").limit(5)
    return _finding(
        s, "read-heavy-no-change", "medium",
        {"sessions": F.col("n"), "read_calls": F.col("reads"),
         "observed_cost_usd": F.bround("cost", 2)},
        confidence="medium", saving=_monthly(d, F.col("cost") * 0.3),
        examples=_examples(top, "session", "cost", "reads"))


def context_bloat(d: Digest, t: Thresholds) -> DataFrame:
    # Equal peaks go to the session listed first: most output, then id.
    worst = F.min_by(F.struct("session", "workspace"), F.struct(
        -F.col("peak_context"), -F.col("output"), "session"))
    s = (d.sessions.filter(F.col("peak_context") >= t.context_bloat_tokens)
         .agg(F.count("*").alias("n"), F.max("peak_context").alias("peak"), worst.alias("w"))
         .filter("n > 0"))
    return _finding(s, "context-bloat", "medium",
                    {"sessions": F.col("n"), "worst_peak_context": F.col("peak")},
                    confidence="medium",
                    labels={"worst_session": F.col("w.session"),
                            "worst_workspace": F.col("w.workspace")})


def session_churn(d: Digest, t: Thresholds) -> DataFrame:
    s = d.sessions.agg(F.count("*").alias("n"),
                       F.count_if(F.col("turns") <= t.short_session_turns).alias("short"))
    fires = (F.col("n") >= t.short_session_min) & (
        _ratio(F.col("short"), F.col("n")) >= t.short_session_share)
    return _finding(s.filter(fires), "session-churn", "medium",
                    {"short_sessions": F.col("short"), "total_sessions": F.col("n"),
                     "share_pct": pct(F.col("short"), F.col("n"))}, confidence="medium")


def subagent_leverage(d: Digest, t: Thresholds) -> DataFrame:
    s = d.totals.select(
        F.col("output").alias("total"),
        F.coalesce(d.sidechain.select("output").scalar(), F.lit(0)).alias("sub"),
        F.coalesce(d.sidechain.select("turns").scalar(), F.lit(0)).alias("sub_turns"))
    share = _ratio(F.col("sub"), F.col("total"))
    none, high = share == 0, share > t.subagent_share_high
    return _finding(
        s.filter("total > 0"),
        F.when(none, "no-delegation").when(high, "subagent-fanout")
        .otherwise("delegation-balanced"),
        F.when(none, "low").when(high, "medium").otherwise("info"),
        {"subagent_output_share_pct": pct(F.col("sub"), F.col("total")),
         "subagent_turns": F.when(high, F.col("sub_turns"))}, confidence="medium")


def cache_ttl_choice(d: Digest, t: Thresholds) -> DataFrame:
    writes = F.col("cache_1h") + F.col("cache_5m")
    fires = (writes >= t.ttl_min_writes) & (_ratio(F.col("cache_1h"), writes) >= t.ttl_min_share)
    reuse = _ratio(F.col("cache_read"), writes)
    pays = reuse >= t.ttl_break_even_reads
    m = d.rates.multipliers
    excess = F.col("cache_1h") * (m["cache_write_1h"] - m["cache_write_5m"]) * 5.0 / 1_000_000
    return _finding(
        d.totals.filter(fires), F.when(pays, "cache-1h-justified").otherwise("cache-1h-underused"),
        F.when(pays, "info").otherwise("medium"),
        {"cache_1h_share_pct": pct(F.col("cache_1h"), writes),
         "reads_per_write": F.bround(reuse, 2)},
        confidence="medium", saving=F.when(~pays, _monthly(d, excess)))


def tool_concentration(d: Digest, t: Thresholds) -> DataFrame:
    s = d.by_tool.agg(F.sum("calls").alias("total"),
                      F.min_by(F.struct("tool", "calls"), F.struct(-F.col("calls"), "tool"))
                      .alias("top"))
    fires = (F.col("total") >= t.tool_min_calls) & (
        _ratio(F.col("top.calls"), F.col("total")) >= t.tool_concentration)
    four = d.by_tool.limit(4)
    return _finding(
        s.filter(fires), "tool-concentration", "low",
        {"calls": F.col("top.calls"), "total_calls": F.col("total"),
         "share_pct": pct(F.col("top.calls"), F.col("total"))},
        confidence="medium", labels={"tool": F.col("top.tool")},
        examples=F.slice(_examples(four, "tool", "calls", "calls"), 2, 3))


def investment_concentration(d: Digest, t: Thresholds) -> DataFrame:
    known = d.by("workspace").filter(F.col("workspace") != "unknown")
    s = known.agg(F.count("*").alias("n"), F.sum("cost").alias("total"))
    top = known.orderBy(F.desc("cost"), "workspace").limit(8)
    listed = _examples(top, "workspace", "cost", "sessions")
    framed = s.filter("n >= 3 and total > 0").withColumn("top", listed)
    three = F.aggregate(F.slice("top", 1, 3), F.lit(0.0), lambda a, x: a + x["value"])
    return _finding(
        framed, "where-the-time-goes", "info",
        {"top_share_pct": pct(F.get("top", F.lit(0))["value"], F.col("total")),
         "top_three_share_pct": pct(three, F.col("total")),
         "top_sessions": F.get("top", F.lit(0))["extra"]},
        labels={"workspace": F.get("top", F.lit(0))["name"]}, examples=F.col("top"))


def working_rhythm(d: Digest, t: Thresholds) -> DataFrame:
    late = (F.col("hour") < 6) | (F.col("hour") >= 22)
    s = d.by_hour.agg(
        F.sum("turns").alias("total"), F.sum(F.when(late, F.col("turns"))).alias("late"),
        F.max_by(F.struct("hour", "turns"), F.struct(F.col("turns"), -F.col("hour"))).alias("p"))
    return _finding(
        s.filter(F.col("total") >= t.rhythm_min_turns), "working-rhythm", "info",
        {"peak_hour": F.col("p.hour"), "peak_turns": F.col("p.turns"),
         "out_of_hours_share_pct": pct(F.col("late"), F.col("total"))})


def peak_window_arbitrage(d: Digest, t: Thresholds) -> DataFrame:
    part = lambda p, c: F.sum(F.when(F.col("phase") == p, F.col(c)))
    vendors = models_with_card(d).filter("window is not null and window <> ''").agg(
        F.array_join(F.array_sort(F.collect_set("vendor")), ", ").alias("v"))
    s = (d.by_phase.agg(part("peak", "turns").alias("turns"), part("peak", "cost").alias("peak"),
                        F.coalesce(part("off-peak", "cost"), F.lit(0.0)).alias("off"))
         .withColumn("timed", F.col("peak") + F.col("off"))
         .filter("turns > 0 and timed > 0")
         .withColumn("premium", d.peak_premium.scalar())
         .withColumn("monthly", _monthly(d, F.col("premium"))))
    healthy = _ratio(F.col("peak"), F.col("timed")) < t.peak_share_floor
    small = F.col("monthly") < t.peak_min_monthly_usd
    arbitrage = ~healthy & ~small
    return _finding(
        s, F.when(healthy, "peak-window-healthy").when(small, "peak-window-immaterial")
        .otherwise("peak-window-arbitrage"),
        F.when(healthy, "info").when(small, "low").otherwise("high"),
        {"peak_share_pct": pct(F.col("peak"), F.col("timed")),
         "peak_premium_usd": F.bround("premium", 2),
         "est_monthly_premium_usd": F.when(~healthy & small, F.bround("monthly", 2)),
         "peak_cost_usd": F.when(arbitrage, F.bround("peak", 2)),
         "off_peak_cost_usd": F.when(arbitrage, F.bround("off", 2))},
        saving=F.when(arbitrage, F.col("monthly")), labels={"vendors": vendors.scalar()})


def plan_value_realised(d: Digest, t: Thresholds, plan: str | None = "none",
                        plans: dict | None = None) -> DataFrame:
    known = plans or PLANS
    if not plan or plan == "none" or plan not in known:
        return _nothing(d)
    s = plan_value(d.totals.select("cost", _days(d).alias("days")), known, [plan])
    s = s.filter("price_usd_month > 0").withColumn("days", _days(d))
    under = F.col("multiple") < t.plan_underuse_ratio
    return _finding(
        s, F.when(under, "plan-under-used").otherwise("plan-value-realised"),
        F.when(under, "high").otherwise("info"),
        {"api_equivalent_usd_month": F.col("api_equivalent_usd_month"),
         "plan_price_usd_month": F.col("price_usd_month"), "multiple": F.col("multiple"),
         "days_observed": F.greatest(F.lit(1), F.col("days"))},
        saving=F.when(under, F.col("price_usd_month") - F.col("api_equivalent_usd_month")),
        labels={"plan": F.col("label"), "verdict": F.when(~under, F.col("verdict"))})


def vendor_concentration(d: Digest, t: Thresholds) -> DataFrame:
    by_vendor = (models_with_card(d).groupBy(F.coalesce("vendor", F.lit("unknown")).alias("vendor"))
                 .agg(F.sum("output").alias("output")))
    s = by_vendor.agg(F.sum("output").alias("total"), F.count("*").alias("n"),
                      F.min_by(F.struct("vendor", "output"), F.struct(-F.col("output"), "vendor"))
                      .alias("top")).filter("total > 0")
    spread = _ratio(F.col("top.output"), F.col("total")) < t.concentration_floor
    six = by_vendor.orderBy(F.desc("output"), "vendor").limit(6)
    listed = F.when(~spread, _examples(six, "vendor", "output", "output"))
    return _finding(
        s, F.when(spread, "vendor-mix-healthy").otherwise("vendor-concentration"),
        F.when(spread, "info").otherwise("medium"),
        {"share_pct": pct(F.col("top.output"), F.col("total")),
         "vendors": F.when(spread, F.col("n"))},
        confidence="medium", labels={"top_vendor": F.col("top.vendor")}, examples=listed)


def local_currency_context(d: Digest, t: Thresholds, currency: str = "USD",
                           currencies: dict | None = None) -> DataFrame:
    from meterline.config import CURRENCIES
    known = currencies or CURRENCIES
    if currency == "USD" or currency not in known:
        return _nothing(d)
    cur = currency_struct(F.lit(currency), known)
    places = int(known[currency]["decimals"])
    s = d.totals.select(_monthly(d, F.col("cost")).alias("usd"), cur.alias("cur"))
    return _finding(
        s, "local-currency", "info",
        {"monthly_local": F.bround(F.col("usd") * F.col("cur.per_usd"), places),
         "monthly_usd": F.bround("usd", 2), "fx_per_usd": F.col("cur.per_usd"),
         "equivalent_dev_days": F.bround(F.try_divide(
             F.col("usd"), F.col("cur.daily_dev_rate_usd")), 2)},
        confidence="medium", labels={"currency": F.lit(currency), "symbol": F.col("cur.symbol")})


def unpriced_estimate(d: Digest, t: Thresholds) -> DataFrame:
    s = d.unpriced.filter("turns > 0").withColumn("total", d.totals.select("cost").scalar())
    share = pct(F.col("cost"), F.col("total"))
    return _finding(
        s, "unpriced-models", F.when(share >= 10, "medium").otherwise("info"),
        {"unpriced_turns": F.col("turns"), "unpriced_cost_usd": F.bround("cost", 2),
         "share_of_spend_pct": share, "fallback_input": F.lit(float(d.card.fallback["input"])),
         "fallback_output": F.lit(float(d.card.fallback["output"]))},
        examples=_examples(d.unpriced_models, "model", "turns", "cost"))


def duplicated_turns(d: Digest, t: Thresholds) -> DataFrame:
    s = d.duplicates.filter("turns > 0")
    share = pct(F.col("turns"), F.col("turns") + F.col("distinct"))
    return _finding(
        s, "duplicated-turns", F.when(share >= 5, "high").otherwise("medium"),
        {"duplicate_turns": F.col("turns"), "distinct_turns": F.col("distinct"),
         "share_of_store_pct": share})


def _nothing(d: Digest) -> DataFrame:
    return d.priced.sparkSession.createDataFrame([], FINDING)


# Order matters: it breaks ties between equally severe findings.
DETECTORS: list[Callable[..., DataFrame]] = [
    cache_efficiency, cold_cache_sessions, premium_model_on_light_work,
    exploration_without_output, context_bloat, session_churn, subagent_leverage,
    cache_ttl_choice, tool_concentration, investment_concentration, working_rhythm,
    peak_window_arbitrage, plan_value_realised, vendor_concentration, local_currency_context,
    unpriced_estimate, duplicated_turns,
]


def material(findings: DataFrame, t: Thresholds) -> DataFrame:
    """Demote a costed high or medium finding that is worth too little per month."""
    demoted = (F.col("saving") < t.material_monthly_usd) & F.col("severity").isin("high", "medium")
    demoted = F.coalesce(demoted, F.lit(False))
    return findings.withColumn("demoted", demoted).withColumn(
        "severity", F.when(F.col("demoted"), "low").otherwise(F.col("severity")))


def ranked(findings: DataFrame) -> DataFrame:
    """Most severe first, then the biggest saving, then detector order."""
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1) \
        .when(F.col("severity") == "low", 2).when(F.col("severity") == "info", 3).otherwise(9)
    return findings.orderBy(order, F.desc(F.coalesce("saving", F.lit(0.0))), "detector")


def findings(digest: Digest, thresholds: Thresholds | None = None, plan: str = "none",
             currency: str = "USD", detectors: list | None = None) -> DataFrame:
    """Run every detector, apply the materiality gate and rank."""
    t = thresholds or Thresholds()
    extra = {plan_value_realised: {"plan": plan}, local_currency_context: {"currency": currency}}
    parts = [fn(digest, t, **extra.get(fn, {})).withColumn("detector", F.lit(i))
             for i, fn in enumerate(detectors or DETECTORS)]
    # A rule that could not be evaluated leaves a null id and stays silent.
    union = reduce(DataFrame.unionByName, parts).filter(F.col("id").isNotNull())
    return ranked(material(union, t))
