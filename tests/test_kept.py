"""Cubes and sketches that are merged ingest by ingest."""

import random
import re

from pyspark.sql import functions as F

from meterline.operators import rollups as R
from meterline.plans import kept

SCHEMA = ("date string, provider string, lane string, repo string, session string, output bigint, tools array<string>, "
          "hour string")


def priced(spark, n, seed, dates=("2026-01-01", "2026-01-02", "2026-01-03")):
    rng = random.Random(seed)
    rows = [(rng.choice([*dates, None]), rng.choice(["p", "q", None]), "x", rng.choice(["r", ""]), f"s{rng.randrange(400)}",
             rng.randrange(1000), rng.sample(["Read", "Edit", "Bash"], rng.randrange(3)), "07") for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def cells(frame):
    return {tuple(r) for r in frame.collect()}


def test_folds_and_a_repair_equal_the_full_cube(spark, tmp_path):
    cube = kept.tools_cube(spark, str(tmp_path / "tools"))
    parts = [priced(spark, 60, 1), priced(spark, 40, 2, ("2026-01-02",)), priced(spark, 20, 3, ("2026-02-09",))]
    assert cube.fold(parts[0], 1) == ["2026-01-01", "2026-01-02", "2026-01-03", "unknown"]
    assert set(cube.fold(parts[1], 2)) == {"2026-01-02", "unknown"}
    assert cube.fold(parts[1], 2) == []  # run again
    cube.fold(parts[2], 3)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert cells(cube.rows()) == cells(R.tools_cube(whole))
    # A day that is emptied stays out, also when the repair is run again.
    gone = whole.filter("date = '2026-02-09' or output < 300")
    cube.subtract(gone, 4)
    assert cube.subtract(gone, 4) == []
    left = whole.filter("not coalesce(date = '2026-02-09', false) and output >= 300")
    assert cells(cube.rows()) == cells(R.tools_cube(left))
    assert cube.fold(parts[0].limit(0), 5) == []


def test_only_touched_days_are_read(spark, tmp_path):
    cube = kept.hours_cube(spark, str(tmp_path / "hours"))
    cube.fold(priced(spark, 50, 4), 1)
    read = cube.table.stored(["2026-01-02"])
    assert re.search(r"PartitionFilters: \[[^\]]*date", read._jdf.queryExecution().executedPlan().toString())
    assert {r["date"] for r in read.select("date").distinct().collect()} == {"2026-01-02"}


def test_merged_sketches_stay_within_their_error(spark, tmp_path):
    sketches = kept.KeptSketches(spark, str(tmp_path / "sketches"))
    whole = (spark.range(60_000).select(
        F.concat(F.lit("2026-01-0"), (F.col("id") % 6 + 1)).alias("date"), F.lit("p").alias("provider"),
        F.lit("x").alias("lane"), F.lit("r").alias("repo"), F.concat(F.lit("s"), F.hash("id") % 9000).alias("session"),
        F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("output")))
    for n in range(3):
        sketches.fold(whole.filter(F.pmod(F.col("output"), F.lit(3)) == n), n + 1)
    for lo, hi in (("2026-01-01", "2026-01-06"), ("2026-01-03", "2026-01-04")):
        part = whole.filter(F.col("date").between(lo, hi))
        exact = part.select("session").distinct().count()
        told = sketches.window(lo, hi).first()
        assert told["turns"] == part.count() and abs(told["sessions"] - exact) <= 0.05 * exact
        rank = part.filter(F.col("output") <= told["quantile"]).count() / told["turns"]
        assert abs(rank - 0.9) <= 0.03
    # A repair leaves its days with what remains, and a day without turns is no day.
    rest = whole.filter("date = '2026-01-03' and output < 100")
    assert sketches.rebuild(rest, 9, ["2026-01-03", "2026-01-04"]) == ["2026-01-03"]
    assert sketches.window("2026-01-04", "2026-01-04").first()["turns"] is None
    told = sketches.window("2026-01-03", "2026-01-03").first()
    assert told["turns"] == rest.count() and told["quantile"] < 100


def test_subtotals_tell_missing_from_total(spark):
    frame = priced(spark, 80, 5).withColumns({c: F.lit(1).cast("bigint") for c in
                                              ("input", "cache_create", "cache_read", "cache_1h", "cache_5m")})
    got = R.subtotals(frame.withColumn("cost", F.lit(0.5)), ["provider", "repo"], [("provider",), ("repo",), ()]).collect()
    assert {(r["level"], r["provider"], r["repo"]) for r in got} == {
        (1, "p", None), (1, "q", None), (1, "unknown", None), (2, None, "r"), (2, None, "unattributed"), (3, None, None)}
    assert sum(r["turns"] for r in got) == 240
