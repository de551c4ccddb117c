"""What is kept from ingest to ingest - cubes, sketches, filled turns - and as-of joins, beside SQL over all turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.cluster import scratch_path, write_and_read
from meterline.operators import rollups as R
from meterline.operators.asof import asof_join
from meterline.plans import kept
from meterline.plans.filled import FilledTurns
from verification.registry import query
from verification.rollup_queries import BUCKET, CUBE_SQL, HOURS_SQL, TOOLS_SQL
from verification.tables import TOPOLOGY, digest, turns, with_filled, with_priced, with_turns


def kept_cube(spark, sf, make, ingests=5):
    """Turns folded in by ingests; a seventh of them comes twice and is taken out again."""
    cube = make(spark, scratch_path(spark, "cube"))
    priced = write_and_read(digest(spark, sf).priced, "priced")
    for n in range(ingests):
        cube.fold(priced.filter(F.col("seq") % ingests == n), n + 1)
    twice = priced.filter(F.col("seq") % 7 == 0)
    cube.fold(twice, ingests + 1)
    cube.fold(twice, ingests + 1)  # run again: known by its number
    cube.subtract(twice, ingests + 2)
    return cube.rows()


@query("g20_kept_cube", with_priced("SELECT * FROM cube", CUBE_SQL))
def g20_kept(spark, sf):
    return kept_cube(spark, sf, kept.main_cube)


@query("g21_kept_hours", with_priced("SELECT * FROM hours", HOURS_SQL))
def g21_kept(spark, sf):
    return kept_cube(spark, sf, kept.hours_cube, 2)


@query("g22_kept_tools", with_priced("SELECT * FROM tools_cube", TOOLS_SQL))
def g22_kept(spark, sf):
    return kept_cube(spark, sf, kept.tools_cube, 2)


WINDOWS = [("2024-01-01", "2024-01-30"), ("2024-01-08", "2024-01-14"), ("2024-01-20", "2024-01-26")]


@query("g01_merged_windows", with_priced("""
SELECT lo AS since, count(*) AS turns, count(DISTINCT session) AS exact_sessions, true AS sessions_close, true AS quantile_close
FROM priced JOIN (VALUES ('2024-01-01', '2024-01-30'), ('2024-01-08', '2024-01-14'), ('2024-01-20', '2024-01-26')) w(lo, hi)
  ON date BETWEEN lo AND hi GROUP BY lo"""))
def g01_merged(spark, sf):
    """7- and 30-day windows from day rows: sessions within 5% of the exact count, p90 within 3% of its rank."""
    priced = write_and_read(digest(spark, sf).priced, "priced")
    sketches = kept.KeptSketches(spark, scratch_path(spark, "sketches"))
    for n in range(3):
        sketches.fold(priced.filter(F.col("seq") % 3 == n), n + 1)
    out = None
    for lo, hi in WINDOWS:
        told = sketches.window(lo, hi).select("turns", "sessions", "quantile")
        exact = priced.filter(F.col("date").between(lo, hi)).join(F.broadcast(told.select("quantile"))).agg(
            F.countDistinct("session").alias("exact_sessions"), F.count_if(F.col("output") < F.col("quantile")).alias("below"),
            F.count_if(F.col("output") <= F.col("quantile")).alias("upto"), F.count("*").alias("n"))
        one = told.crossJoin(exact).select(
            F.lit(lo).alias("since"), "turns", "exact_sessions",
            (F.abs(F.col("sessions") - F.col("exact_sessions")) <= 0.05 * F.col("exact_sessions")).alias("sessions_close"),
            ((F.col("below") <= 0.93 * F.col("n")) & (F.col("upto") >= 0.87 * F.col("n"))).alias("quantile_close"))
        out = one if out is None else out.unionByName(one)
    return out


@query("g04_subtotals", with_priced(f"""
SELECT CAST(grouping_id(provider, model, phase) AS BIGINT) AS level, provider, model, phase, {BUCKET}
FROM (SELECT * REPLACE (coalesce(nullif(provider, ''), 'unknown') AS provider, coalesce(nullif(model, ''), 'unknown') AS model,
  coalesce(nullif(phase, ''), 'unknown') AS phase) FROM priced)
GROUP BY GROUPING SETS ((provider, model), (provider, phase), (model), (provider), ())"""))
def g04_subtotals(spark, sf):
    """Five levels in one pass; a missing label is ``unknown``, a total null, and ``level`` tells which."""
    return R.subtotals(digest(spark, sf).priced, ["provider", "model", "phase"],
                       [("provider", "model"), ("provider", "phase"), ("model",), ("provider",), ()])


EDITS = """
, v AS (SELECT person, provider, ts, max(output) AS price FROM turns WHERE list_contains(tools, 'Edit') GROUP BY ALL)
"""


def edits(spark, sf):
    return turns(spark, sf).filter(F.array_contains("tools", "Edit"))


@query("p05_asof_last", with_turns(EDITS + """
SELECT seq, v.ts AS since, v.price FROM turns t ASOF LEFT JOIN v ON t.person = v.person AND t.ts >= v.ts"""))
def p05_asof(spark, sf):
    """Every turn meets the last edit of its person, itself included: two growing sides."""
    return asof_join(turns(spark, sf).select("seq", "person", "ts"), edits(spark, sf), {"person": "person"}, "ts", "ts",
                     {"ts": "since", "output": "price"}).select("seq", "since", "price")


@query("t10_asof_next", with_turns(EDITS + """
SELECT seq, v.ts AS since FROM turns t ASOF LEFT JOIN v ON t.provider = v.provider AND t.ts < v.ts"""))
def t10_asof(spark, sf):
    """The next edit of the provider; four keys hold everything and are cut into chunks."""
    return asof_join(turns(spark, sf).select("seq", "provider", "ts"), edits(spark, sf), {"provider": "provider"}, "ts", "ts",
                     {"ts": "since"}, forward=True, strict=True, chunk_rows=500).select("seq", "since")


@query("a10_kept_fill", with_filled("SELECT seq, repo, surface, inferred FROM filled"))
def a10_kept(spark, sf):
    """Turns of three ingests, the later ones in a few sessions; each fills what it touches."""
    store = FilledTurns(spark, scratch_path(spark, "filled"), TOPOLOGY, buckets=8)
    part = F.when(F.col("person").cast("int") % 50 == 0, F.col("seq") % 3 + 1).otherwise(1)
    for n in (1, 2, 3):
        store.fold(turns(spark, sf).filter(part == n), n)
    return store.rows().select("seq", "repo", "surface", "inferred")
