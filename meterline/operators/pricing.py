"""Pricing: rate tables, the rate in force, peak hours and the cost of a turn.

The card is flattened once into a lookup keyed by (name, [valid_from, valid_to)).
Alias spellings are rows of that lookup, so one left join resolves the alias
hop, the dated version, the window and the fallback for every turn.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.cluster import BROADCAST_ROWS, lookup_join, small_table, write_and_read
from meterline.config import CURRENCIES, PLANS, RateCard
from meterline.functions.clock import billing_hour, billing_weekday, iso_instant
from meterline.functions.models import card_name
from meterline.functions.numbers import micro

BASE_COLUMNS = ("model string, vendor string, tier string, input double, output double, "
                "cache_read_mult double, window string, valid_from_raw string, "
                "recheck_after string")
HISTORY_COLUMNS = ("model string, ord int, from_raw string, until_raw string, input double, "
                   "output double, cache_read_mult double, tier string, vendor string")
OFFSET_PATTERN = r"(Z|[+-]\d{2}:?\d{2})$"

BEGINNING = "0001-01-01 00:00:00"
END = "9999-12-31 23:59:59"


@dataclass
class RateTables:
    """The card as DataFrames. ``rows`` is the lookup size when it is known."""

    base: DataFrame
    history: DataFrame
    aliases: DataFrame
    speed: DataFrame | None
    windows: dict
    multipliers: dict
    fallback: dict
    rows: int | None = None

    @cached_property
    def lookup(self) -> DataFrame:
        """Rates under every accepted spelling.

        A configured card of known size is flattened once and kept as a local
        relation; a derived card stays a plan and is joined by size.
        """
        plan = rate_lookup(self)
        if self.rows is None or self.rows > BROADCAST_ROWS:
            return plan
        return plan.sparkSession.createDataFrame(plan.toArrow(), plan.schema)

    def stored(self) -> "RateTables":
        """A derived card written once, so that its uses do not derive it again."""
        return replace(self, base=write_and_read(self.base, "rates"),
                       history=write_and_read(self.history, "rates"))

    @classmethod
    def from_card(cls, spark: SparkSession, card: RateCard) -> "RateTables":
        base = [(m, r.get("vendor"), r.get("tier"), float(r["input"]), float(r["output"]),
                 _opt(r.get("cache_read_mult")), r.get("window"), r.get("from"),
                 r.get("recheck_after")) for m, r in card.models.items()]
        history = [(m, i, h.get("from"), h.get("until"), _opt(h.get("input")),
                    _opt(h.get("output")), _opt(h.get("cache_read_mult")), h.get("tier"),
                    h.get("vendor"))
                   for m, hs in card.history.items() for i, h in enumerate(hs)]
        aliases = list(card.aliases.items())
        speed = [(*k.rsplit(":", 1), _opt(v.get("input")), _opt(v.get("output")),
                  _opt(v.get("cache_read_mult"))) for k, v in card.speed_overrides.items()]
        return cls(
            base=small_table(spark, base, BASE_COLUMNS),
            history=small_table(spark, history, HISTORY_COLUMNS),
            aliases=small_table(spark, aliases, "alias string, target string"),
            speed=small_table(spark, 
                speed, "speed_model string, speed_name string, s_input double, s_output double, "
                       "s_cache_read_mult double") if speed else None,
            windows=card.windows,
            multipliers=card.multipliers,
            fallback=card.fallback,
            rows=len(base) + len(history) + 2 * len(aliases),
        )


def _opt(value):
    return None if value is None else float(value)


def card_instant(raw: Column) -> Column:
    """A card boundary -> timestamp. It must carry a UTC offset; a bare time fails."""
    bare = F.raise_error(F.concat(F.lit("rate-card time has no UTC offset: "), raw))
    return F.when(raw.isNull(), F.lit(None)).when(raw.rlike(OFFSET_PATTERN), iso_instant(raw)) \
        .otherwise(bare.cast("timestamp"))


def rate_versions(tables: RateTables) -> DataFrame:
    """Every model version as a closed-open validity interval.

    Each superseded version overrides only the columns it states. The oldest
    version reaches back to the beginning and the current one has no end.
    """
    base = tables.base
    past = tables.history.select(
        "model", "ord", card_instant(F.col("until_raw")).alias("until"),
        *[F.col(c).alias(f"h_{c}") for c in ("input", "output", "cache_read_mult", "tier",
                                             "vendor")])
    current = base.select("model", F.lit(2**31 - 1).alias("ord"),
                          F.lit(None).cast("timestamp").alias("until"),
                          *[F.lit(None).cast(base.schema[c].dataType).alias(f"h_{c}")
                            for c in ("input", "output", "cache_read_mult", "tier", "vendor")])
    by_model = W.partitionBy("model").orderBy("ord")
    spans = past.unionByName(current).withColumn("since", F.lag("until").over(by_model))
    return spans.join(base, "model").select(
        "model",
        F.coalesce("since", F.lit(BEGINNING).cast("timestamp")).alias("valid_from"),
        F.coalesce("until", F.lit(END).cast("timestamp")).alias("valid_to"),
        F.col("until").isNull().alias("is_current"),
        F.coalesce("h_input", "input").alias("rate_in"),
        F.coalesce("h_output", "output").alias("rate_out"),
        F.coalesce("h_cache_read_mult", "cache_read_mult",
                   F.lit(float(tables.multipliers["cache_read"]))).alias("rate_cache_mult"),
        F.coalesce("h_tier", "tier").alias("rate_tier"),
        F.coalesce("h_vendor", "vendor").alias("rate_vendor"),
        "window",
    )


def _mask_literal(spec: dict) -> Column:
    """168 flags, Monday 00h first: is this UTC hour billed at the peak rate?"""
    days = spec.get("days") or range(1, 8)
    flags = [any(s <= h < e for s, e in spec.get("peak_utc") or []) and d in days
             for d in range(1, 8) for h in range(24)]
    return F.array(*[F.lit(f) for f in flags])


def window_columns(window: Column, windows: dict) -> tuple[Column, Column]:
    """(peak-hour mask, off-peak multiplier) of a window name; null when undefined."""
    mask = F.lit(None).cast("array<boolean>")
    mult = F.lit(None).cast("double")
    for name, spec in windows.items():
        mask = F.when(window == name, _mask_literal(spec)).otherwise(mask)
        mult = F.when(window == name, F.lit(float(spec.get("off_peak_mult", 1.0)))).otherwise(mult)
    return mask, mult


def rate_lookup(tables: RateTables) -> DataFrame:
    """Versions under every spelling the card accepts (model ids and aliases)."""
    versions = rate_versions(tables)
    mask, mult = window_columns(F.col("window"), tables.windows)
    versions = versions.withColumn("peak_mask", mask).withColumn("off_peak_mult", mult)
    own = versions.join(tables.aliases, versions["model"] == tables.aliases["alias"], "left_anti")
    via = versions.join(tables.aliases, versions["model"] == tables.aliases["target"])
    return (own.select(F.col("model").alias("name"), F.col("model").alias("canonical"),
                       *_RATE_COLUMNS)
            .unionByName(via.select(F.col("alias").alias("name"),
                                    F.col("target").alias("canonical"), *_RATE_COLUMNS)))


_RATE_COLUMNS = ("valid_from", "valid_to", "is_current", "rate_in", "rate_out", "rate_cache_mult",
                 "rate_tier", "rate_vendor", "window", "peak_mask", "off_peak_mult")


def attach_rates(turns: DataFrame, tables: RateTables) -> DataFrame:
    """Add the rate in force at each turn's own instant (or now, if it has none).

    Adds ``canonical``, ``is_priced``, ``rate_in``, ``rate_out``,
    ``rate_cache_mult``, ``window``, ``off_peak_mult`` and ``phase``.
    """
    lookup = tables.lookup
    facts = turns.withColumn("_name", card_name(F.col("model")))
    on = (facts["_name"] == lookup["name"]) & F.when(
        facts["ts"].isNotNull(),
        (facts["ts"] >= lookup["valid_from"]) & (facts["ts"] < lookup["valid_to"]),
    ).otherwise(lookup["is_current"])
    priced = lookup_join(facts, lookup, on, "left", rows=tables.rows)
    fall = tables.fallback
    priced = (
        priced.withColumn("is_priced", F.col("name").isNotNull())
        .withColumn("canonical", F.coalesce("canonical", "_name"))
        .withColumn("rate_in", F.coalesce("rate_in", F.lit(float(fall["input"]))))
        .withColumn("rate_out", F.coalesce("rate_out", F.lit(float(fall["output"]))))
        .withColumn("rate_cache_mult", F.coalesce(
            "rate_cache_mult", F.lit(float(tables.multipliers["cache_read"]))))
    )
    if tables.speed is not None:
        speed = tables.speed
        priced = lookup_join(
            priced, speed, (priced["canonical"] == speed["speed_model"])
            & (priced["speed"] == speed["speed_name"]), "left", rows=tables.rows)
        for rate, override in (("rate_in", "s_input"), ("rate_out", "s_output"),
                               ("rate_cache_mult", "s_cache_read_mult")):
            priced = priced.withColumn(rate, F.coalesce(override, rate))
        priced = priced.drop("speed_model", "speed_name", "s_input", "s_output",
                             "s_cache_read_mult")
    return priced.withColumn("phase", phase()).drop(
        "_name", "name", "valid_from", "valid_to", "is_current", "peak_mask")


def phase() -> Column:
    """flat: no schedule; unknown: unusable stamp; otherwise peak or off-peak."""
    hour = billing_hour(F.col("ts"), F.col("ts_raw"))
    day = billing_weekday(F.col("ts"), F.col("ts_raw"))
    return (F.when(F.col("off_peak_mult").isNull(), F.lit("flat"))
            .when(hour.isNull(), F.lit("unknown"))
            .when(F.get(F.col("peak_mask"), (day - 1) * 24 + hour), F.lit("peak"))
            .otherwise(F.lit("off-peak")))


def window_mult() -> Column:
    """Only an off-peak turn is scaled."""
    return F.when(F.col("phase") == "off-peak", F.col("off_peak_mult")).otherwise(F.lit(1.0))


def turn_cost(multipliers: dict, mult: Column) -> Column:
    """USD of one turn: five token kinds, each at its own multiple of the input rate.

    A write whose lifetime split is absent is priced at the cheaper short lifetime.
    """
    per_in = F.col("rate_in") / F.lit(1_000_000.0) * mult
    per_out = F.col("rate_out") / F.lit(1_000_000.0) * mult
    count = {c: F.coalesce(F.col(c), F.lit(0)) for c in
             ("input", "output", "cache_create", "cache_read", "cache_1h", "cache_5m")}
    unsplit = count["cache_1h"] + count["cache_5m"] == 0
    short = F.when(unsplit, count["cache_create"]).otherwise(count["cache_5m"])
    return (count["input"] * per_in + count["output"] * per_out
            + count["cache_read"] * per_in * F.col("rate_cache_mult")
            + short * per_in * F.lit(float(multipliers["cache_write_5m"]))
            + count["cache_1h"] * per_in * F.lit(float(multipliers["cache_write_1h"])))


def shifted_cost(cost: Column, want: str) -> Column:
    """What the turn would have cost in the other phase; unchanged if not time-priced."""
    now = window_mult()
    target = F.lit(1.0) if want == "peak" else F.col("off_peak_mult")
    moved = F.when(now != 0, cost / now * target).otherwise(cost)
    return F.when(F.col("off_peak_mult").isNull(), cost).otherwise(moved)


def price_turns(turns: DataFrame, tables: RateTables) -> DataFrame:
    """Turns plus rates, phase, ``cost``, ``cost_floor`` and their micro-dollar forms."""
    priced = attach_rates(turns, tables).withColumn(
        "cost", turn_cost(tables.multipliers, window_mult()))
    return (priced.withColumn("cost_floor", shifted_cost(F.col("cost"), "off-peak"))
            .withColumn("cost_peak", shifted_cost(F.col("cost"), "peak"))
            .withColumn("cost_micro", micro(F.col("cost")))
            .withColumn("cost_floor_micro", micro(F.col("cost_floor"))))


def peak_premium(priced: DataFrame) -> DataFrame:
    """Extra USD paid for turns that ran in a peak window, to 4 decimals."""
    extra = F.when(F.col("phase") == "peak", F.col("cost") - F.col("cost_floor"))
    return priced.agg(F.bround(F.coalesce(F.sum(extra), F.lit(0.0)), 4).alias("peak_premium_usd"))


def unpriced_filter(placeholder: str = "<synthetic>") -> Column:
    return (~F.col("is_priced")) & (F.coalesce(F.col("model"), F.lit("")) != placeholder) \
        & (F.col("cost") > 0)


def unpriced_models(priced: DataFrame, top: int | None = 8) -> DataFrame:
    """Models the card does not name, most turns first."""
    named = F.coalesce(F.nullif(F.col("canonical"), F.lit("")), F.lit("unknown"))
    ranked = (priced.filter(unpriced_filter()).groupBy(named.alias("model"))
              .agg(F.count("*").alias("turns"), F.bround(F.sum("cost"), 4).alias("cost"))
              .orderBy(F.desc("turns"), "model"))
    return ranked.limit(top) if top else ranked


def currency_struct(code: Column, currencies: dict | None = None) -> Column:
    """Currency code -> struct(symbol, per_usd, decimals, daily_dev_rate_usd).

    A code that is not configured is shown in USD.
    """
    known = currencies or CURRENCIES

    def entry(name: str) -> Column:
        cur = known[name]
        return F.struct(
            F.lit(cur["symbol"]).alias("symbol"), F.lit(float(cur["per_usd"])).alias("per_usd"),
            F.lit(int(cur["decimals"])).alias("decimals"),
            F.lit(_opt(cur.get("daily_dev_rate_usd"))).cast("double")
            .alias("daily_dev_rate_usd"))

    table = F.create_map(*[x for name in known for x in (F.lit(name), entry(name))])
    return F.coalesce(F.try_element_at(table, code), entry("USD"))


def convert(usd: Column, code: Column, currencies: dict | None = None) -> Column:
    """USD amount -> struct(amount, symbol, decimals) in a display currency."""
    cur = currency_struct(code, currencies)
    return F.struct((usd * cur["per_usd"]).alias("amount"), cur["symbol"].alias("symbol"),
                    cur["decimals"].alias("decimals"))


def plan_value(totals: DataFrame, plans: dict | None = None,
               only: list[str] | None = None) -> DataFrame:
    """What each flat plan returned: 30-day API equivalent over its price.

    ``totals`` has one row per observed party with ``cost`` and ``days``. The
    plan list is configuration, so it is expanded in place of a join.
    """
    known = plans or PLANS
    offers = F.array(*[F.struct(
        F.lit(p).alias("plan"), F.lit(v["label"]).alias("label"),
        F.lit(float(v.get("price_usd_month") or 0)).alias("price"))
        for p, v in known.items() if only is None or p in only])
    party = [c for c in totals.columns if c not in ("cost", "days")]
    rows = totals.select(*party, (F.col("cost") * 30.0 / F.greatest(F.lit(1), F.col("days")))
                         .alias("monthly"), F.explode(offers).alias("o"))
    price, monthly = F.col("o.price"), F.col("monthly")
    return rows.select(
        *party, "o.plan", "o.label", price.alias("price_usd_month"),
        F.bround(monthly, 2).alias("api_equivalent_usd_month"),
        F.when(price > 0, F.bround(F.try_divide(monthly, price), 2)).alias("multiple"),
        F.when(price > 0, F.when(monthly < price, "under-used")
               .when(monthly < price * 3, "fair").otherwise("excellent")).alias("verdict"))


def quota_windows(spark: SparkSession, plans: dict | None = None) -> DataFrame:
    rows = [(p, w["kind"], w.get("hours") or w.get("days"),
             "hours" if w["kind"] == "rolling" else "days", w.get("amount"))
            for p, v in (plans or PLANS).items() for w in v["windows"]]
    return small_table(spark, 
        rows, "plan string, kind string, length int, unit string, amount long")


def rolling_usage(turns: DataFrame, by: str, hours: int) -> DataFrame:
    """Turns of each party in the ``hours`` up to and including each active second.

    Turns are counted per second first, so the window function walks at most
    3,600 rows per hour whatever the party's volume. A party's history is cut
    into months that overlap by the window's reach, so no task holds all of it.
    """
    per_second = (turns.filter(F.col("ts").isNotNull())
                  .groupBy(by, F.unix_seconds("ts").alias("second"))
                  .agg(F.count("*").alias("turns")))
    span, reach = 31 * 86400, hours * 3600
    own = per_second.withColumn("part", F.floor(F.col("second") / span)) \
        .withColumn("own", F.lit(True))
    tail = (own.filter(F.pmod(F.col("second"), F.lit(span)) >= span - reach)
            .withColumn("part", F.col("part") + 1).withColumn("own", F.lit(False)))
    w = W.partitionBy(by, "part").orderBy("second").rangeBetween(-reach, 0)
    return (own.unionByName(tail).withColumn("used", F.sum("turns").over(w)).filter("own")
            .select(by, "second", "turns", "used"))


def calendar_usage(turns: DataFrame, by: str, days: int) -> DataFrame:
    """Turns of each party in consecutive windows of ``days`` days."""
    slot = F.floor(F.unix_date(F.to_date("ts")) / days)
    return (turns.filter(F.col("ts").isNotNull()).groupBy(by, slot.alias("slot"))
            .agg(F.count("*").alias("used")))


def quota_headroom(used: DataFrame, amount: int | None) -> DataFrame:
    """Peak use of a quota window against its published amount, or the own p90."""
    party = used.columns[0]
    stats = used.groupBy(party).agg(F.max("used").alias("peak_used"),
                                    F.percentile("used", F.lit(0.9)).alias("p90_used"))
    limit = F.lit(amount).cast("double") if amount is not None else F.col("p90_used")
    return stats.select(party, "peak_used", "p90_used", limit.alias("quota"),
                        F.lit("published" if amount is not None else "own p90").alias("basis"),
                        F.bround(F.try_divide(F.col("peak_used") * 100.0, limit), 1)
                        .alias("peak_pct"))


def plan_headroom(turns: DataFrame, by: str, holders: DataFrame, plans: dict | None = None) -> DataFrame:
    """Headroom of every party in every quota window of its own plan.

    ``holders`` has (party, plan). A window whose vendor publishes no amount is measured
    against the party's own p90.
    """
    windows = quota_windows(turns.sparkSession, plans)
    known = {(w["kind"], w["hours" if w["kind"] == "rolling" else "days"])
             for v in (plans or PLANS).values() for w in v["windows"]}
    used = None
    for kind, length in sorted(known):
        rows = (rolling_usage if kind == "rolling" else calendar_usage)(turns, by, length).groupBy(by).agg(
            F.max("used").alias("peak_used"), F.percentile("used", F.lit(0.9)).alias("p90_used"))
        one = rows.withColumns({"kind": F.lit(kind), "length": F.lit(length)})
        used = one if used is None else used.unionByName(one)
    held = holders.select(F.col(by).alias("h_party"), "plan").join(F.broadcast(windows), "plan")
    both = used.withColumnsRenamed({"kind": "u_kind", "length": "u_length"})
    both = both.join(held, (both[by] == held["h_party"]) & (both["u_kind"] == held["kind"])
                     & (both["u_length"] == held["length"]))
    quota = F.coalesce(F.col("amount").cast("double"), "p90_used")
    return both.select(
        by, "plan", "kind", "length", "peak_used", "p90_used", quota.alias("quota"),
        F.when(F.col("amount").isNull(), "own p90").otherwise("published").alias("basis"),
        F.bround(F.try_divide(F.col("peak_used") * 100.0, quota), 1).alias("peak_pct"))


def card_violations(spark: SparkSession, card: RateCard, tables: RateTables | None = None,
                    lines: DataFrame | None = None, labs: DataFrame | None = None,
                    zone: str = "+08:00") -> DataFrame:
    """Structural problems of a card, one row each; empty means well-formed."""
    tables = tables or RateTables.from_card(spark, card)
    lines = lines if lines is not None else line_table(spark, card)
    labs = labs if labs is not None else small_table(spark, 
        list(card.labs.items()), "lab string, lab_label string")
    offset_ok = lambda c: F.coalesce(F.endswith(F.col(c), F.lit(zone)), F.lit(False))
    instant = lambda c: F.when(offset_ok(c), iso_instant(F.col(c)))
    issue = lambda df, rule, where, item: df.filter(where).select(
        F.lit(rule).alias("rule"), item.cast("string").alias("item"))

    base, hist = tables.base, tables.history
    # A broken stamp has no successor to compare with, so it is reported once.
    order = W.partitionBy("model").orderBy("ord")
    steps = (hist.join(base.select("model", F.col("valid_from_raw").alias("base_from")),
                       "model", "left")
             .withColumn("s", instant("from_raw")).withColumn("e", instant("until_raw"))
             .withColumn("prev_e", F.lag("e").over(order))
             .withColumn("last", F.lead("ord").over(order).isNull())
             .withColumn("cur", instant("base_from")))
    known = base.select("model")
    orphan = hist.select("model").distinct().join(known, "model", "left_anti")
    steps = steps.join(known, "model", "left_semi")
    where = F.concat_ws("#", "model", "ord")
    stamps = base.select(F.concat(F.col("model"), F.lit(".from")).alias("item"),
                         F.col("valid_from_raw").alias("t")).unionByName(
        base.select(F.concat(F.col("model"), F.lit(".recheck_after")).alias("item"),
                    F.col("recheck_after").alias("t"))).filter(F.col("t").isNotNull())
    in_history = hist.select("model").distinct().withColumn("has_history", F.lit(True))
    undated = base.join(in_history, "model", "left_semi").filter("valid_from_raw is null")

    line_order = W.partitionBy("line").orderBy("seq")
    tenure = lines.filter(F.col("model").isNotNull() | F.col("line_from").isNotNull()) \
        .withColumn("at", instant("line_from")) \
        .withColumn("prev", F.last("at", ignorenulls=True).over(
            line_order.rowsBetween(W.unboundedPreceding, -1)))
    line_item = F.concat_ws("#", "line", "seq")
    heads = lines.select("line", "def", "lab", F.col("model").isNull().alias("empty")).distinct()

    parts = [
        issue(orphan, "history-unknown-model", F.lit(True), F.col("model")),
        issue(steps, "history-from-format", F.col("s").isNull(), where),
        issue(steps, "history-until-format", F.col("e").isNull(), where),
        issue(steps, "history-until-not-after-from", F.col("e") <= F.col("s"), where),
        issue(steps, "history-gap-or-overlap", (F.col("s") != F.col("prev_e")), where),
        issue(steps, "base-does-not-meet-history",
              F.col("last") & (F.col("cur") != F.col("e")), F.col("model")),
        issue(undated, "model-time-format", F.lit(True), F.concat(F.col("model"), F.lit(".from"))),
        issue(stamps, "model-time-format", instant("t").isNull(), F.col("item")),
        issue(heads.groupBy("line").agg(F.countDistinct("def").alias("n")), "line-id-repeated",
              (F.col("n") > 1) | F.coalesce(F.col("line"), F.lit("")).eqNullSafe(""),
              F.col("line")),
        issue(heads.join(labs, "lab", "left_anti"), "line-unknown-lab", F.lit(True),
              F.col("line")),
        issue(heads, "line-without-models", F.col("empty"), F.col("line")),
        issue(tenure.join(known, "model", "left_anti"), "line-unknown-model", F.lit(True),
              line_item),
        issue(tenure, "line-time-format", F.col("at").isNull(), line_item),
        issue(tenure, "line-runs-backwards", F.col("at") <= F.col("prev"), line_item),
    ]
    mix = sum(card.reference_mix.values()) if card.reference_mix else 1.0
    if abs(mix - 1.0) > 0.001:
        parts.append(small_table(spark, [("mix-does-not-sum-to-1", f"{mix:.4f}")],
                                           "rule string, item string"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def review_due(base: DataFrame, now: str | dt.datetime | None = None) -> DataFrame:
    """Rates past their documented end that still price turns."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return (base.filter(F.col("recheck_after").isNotNull()
                        & (card_instant(F.col("recheck_after")) <= at))
            .select("model", "recheck_after").orderBy("model", "recheck_after"))


def line_table(spark: SparkSession, card: RateCard) -> DataFrame:
    """One row per (line, model tenure); a line without models keeps one empty row."""
    rows = []
    for d, line in enumerate(card.lines):
        entries = line.get("models") or [{}]
        for i, e in enumerate(entries):
            rows.append((line.get("id"), d, line.get("lab"), line.get("label"), line.get("tier"),
                         bool(line.get("headline")), i, e.get("model"), e.get("from")))
    return small_table(spark, 
        rows, "line string, def int, lab string, label string, tier string, headline boolean, "
              "seq int, model string, line_from string")
