from pyspark.sql import functions as F

from meterline.config import RateCard
from meterline.operators import pricing as P
from meterline.schema import conform, parse_instant

M = 1_000_000
CARD = RateCard(
    models={"timed": {"vendor": "v", "tier": "t", "input": 1.74, "output": 3.54, "window": "w"},
            "flat": {"vendor": "v", "tier": "t", "input": 5.0, "output": 25.0,
                     "from": "2026-08-21T00:00+08:00"}},
    history={"flat": [{"from": "2026-01-01T00:00+08:00", "until": "2026-08-21T00:00+08:00",
                       "input": 6.0}]},
    windows={"w": {"peak_utc": [[1, 4], [6, 10]], "days": [1, 2, 3, 4, 5], "off_peak_mult": 0.5}},
    speed_overrides={"flat:fast": {"input": 10.0, "output": 50.0}},
    aliases={"nick": "flat"})


def cost(spark, **ev):
    row = {"model": "flat", "ts_raw": "2026-09-01T02:00:00Z", "speed": None, "input": 0,
           "output": 0, "cache_create": 0, "cache_read": 0, "cache_1h": 0, "cache_5m": 0, **ev}
    df = spark.createDataFrame(
        [tuple(row.values())], "model string, ts_raw string, speed string, input long, "
        "output long, cache_create long, cache_read long, cache_1h long, cache_5m long")
    return P.price_turns(conform(df), P.RateTables.from_card(spark, CARD)).first()


def test_peak_is_twice_off_peak(spark):
    both = {"model": "timed", "input": M, "output": M}
    peak = cost(spark, ts_raw="2026-08-19T02:00:00Z", **both)       # a Wednesday
    off = cost(spark, ts_raw="2026-08-19T12:00:00Z", **both)
    weekend = cost(spark, ts_raw="2026-08-22T02:00:00Z", **both)
    assert round(peak["cost"], 6) == 5.28 and peak["phase"] == "peak"
    assert round(off["cost"], 6) == 2.64 and off["phase"] == "off-peak"
    assert weekend["phase"] == "off-peak"
    assert round(peak["cost_floor"], 6) == 2.64 and round(off["cost_peak"], 6) == 5.28


def test_price_change_is_exact_to_the_second(spark):
    # 2026-08-21 00:00 at UTC+8 is 16:00 UTC the day before.
    assert cost(spark, ts_raw="2026-08-20T15:59:59Z", input=M)["cost"] == 6.0
    assert cost(spark, ts_raw="2026-08-20T16:00:00Z", input=M)["cost"] == 5.0
    # The version overrides the input rate only.
    assert cost(spark, ts_raw="2026-08-20T15:59:59Z", output=M)["cost"] == 25.0
    # Anything earlier than the first version is still that version.
    assert cost(spark, ts_raw="2020-01-01", input=M)["cost"] == 6.0
    # No usable stamp: today's rate.
    assert cost(spark, ts_raw="nonsense", input=M)["cost"] == 5.0


def test_names_speed_and_fallback(spark):
    assert cost(spark, model="llm-gateway--openai/nick-20260101", input=M)["cost"] == 5.0
    assert cost(spark, speed="fast", output=M)["cost"] == 50.0
    unknown = cost(spark, model="never-heard-of", input=M)
    assert unknown["cost"] == 5.0 and not unknown["is_priced"] and unknown["phase"] == "flat"


def test_unsplit_cache_write_takes_the_cheap_rate(spark):
    assert cost(spark, cache_create=M)["cost"] == 6.25
    assert cost(spark, cache_create=M, cache_1h=M)["cost"] == 10.0


def test_unusable_stamp_on_a_timed_model_is_unknown(spark):
    assert cost(spark, model="timed", ts_raw="2026-08-19", input=M)["phase"] == "unknown"


def test_instants(spark):
    stamps = ["2026-08-19T01:02:11.123Z", "2026-08-19T01:02:11+08:00", "2026-08-19T01:02",
              "2026-08-19T01", "2026-08-19", "2026", "soon", None]
    df = spark.createDataFrame([(s,) for s in stamps], "raw string")
    got = [str(r[0]) for r in df.select(F.date_format(parse_instant(F.col("raw")),
                                                     "MM-dd HH:mm:ss")).collect()]
    assert got == ["08-19 01:02:11", "08-18 17:02:11", "08-19 01:02:00", "08-19 01:00:00",
                   "08-19 00:00:00", "None", "None", "None"]


def test_big_card_is_joined_without_broadcast_and_agrees(spark):
    from meterline import cluster
    from verification.tables import rates, turns
    t = turns(spark, "/root/testdata/sf0.001")
    small = P.price_turns(t, rates(spark))
    tables = rates(spark)
    lookup = tables.lookup
    left = t.withColumnRenamed("model", "m")
    on = (left["m"] == lookup["name"]) & lookup["is_current"]
    a = cluster.lookup_join(left, lookup, on, rows=1)
    b = cluster.lookup_join(left, lookup, on, rows=10**9)
    cols = ["seq", "canonical", "rate_in"]
    assert sorted(map(tuple, a.select(*cols).collect()), key=str) == \
        sorted(map(tuple, b.select(*cols).collect()), key=str)
    assert "_salt" in b._jdf.queryExecution().toString()
    assert small.count() == t.count()


def test_card_validation_finds_each_fault(spark):
    good = RateCard(models=CARD.models, history=CARD.history, labs={"l": "L"}, lines=[
        {"id": "a", "lab": "l", "models": [{"model": "flat", "from": "2026-01-01T00:00+08:00"}]}])
    assert P.card_violations(spark, good).count() == 0
    bad = RateCard(
        models={"x": {"input": 1.0, "output": 1.0, "from": "2026-03-01T00:00+08:00"}},
        history={"x": [
            {"from": "2026-01-01T00:00Z", "until": "2026-02-01T00:00+08:00", "input": 2.0},
            {"from": "2026-02-02T00:00+08:00", "until": "2026-02-02T00:00+08:00", "input": 3.0}],
            "ghost": [{"from": "2026-01-01T00:00+08:00", "until": "2026-02-01T00:00+08:00"}]},
        labs={"l": "L"}, lines=[
            {"id": "a", "lab": "nolab", "models": [{"model": "nope", "from": "2026-01-01T00:00+08:00"}]},
            {"id": "a", "lab": "l", "models": []},
            {"id": "b", "lab": "l", "models": [{"model": "x", "from": "2026-02-01T00:00+08:00"},
                                               {"model": "x", "from": "2026-01-01T00:00+08:00"}]}],
        reference_mix={"input": 0.5, "output": 0.4})
    rules = {r["rule"] for r in P.card_violations(spark, bad).collect()}
    assert rules == {"history-unknown-model", "history-from-format",
                     "history-until-not-after-from", "history-gap-or-overlap",
                     "base-does-not-meet-history", "line-id-repeated", "line-unknown-lab",
                     "line-without-models", "line-unknown-model", "line-runs-backwards",
                     "mix-does-not-sum-to-1"}
