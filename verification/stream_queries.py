"""Streaming jobs over turns mapped from ``events``, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.cluster import scratch_path
from meterline.schema import conform
from meterline.sources import native as N
from meterline.sources import store as S
from meterline.sources.resume import GrowingLogs
from meterline.streaming import jobs as J
from verification.registry import query
from verification.source_queries import RESUMED_SQL, grow, resumed, rollout_lines
from verification.tables import TOPOLOGY, turns, with_turns


def landed(spark, sf, *parts):
    """Turns written as drops: one folder entry per part, in the order given."""
    path = scratch_path(spark, "landing")
    t = turns(spark, sf)
    for keep in parts or ("true",):
        t.filter(keep).write.mode("append").parquet(path)
    return path, t.schema


def stream(spark, sf, *parts, files_per_batch=None):
    path, schema = landed(spark, sf, *parts)
    return J.watch_tables(spark, path, schema, files_per_batch)


@query("s26_incremental_read", with_turns("""
SELECT 'first' AS run, count(*) FILTER (seq % 3 <> 0) AS stored FROM turns
UNION ALL SELECT 'idle', count(*) FILTER (seq % 3 <> 0) FROM turns
UNION ALL SELECT 'second', count(*) FROM turns
UNION ALL SELECT 'grown log', 0 FROM turns HAVING count(*) > 0"""))
def s26(spark, sf):
    """New drops only are read, a run without news adds nothing, a re-read finds nothing new."""
    path, schema = landed(spark, sf, "seq % 3 <> 0")
    store, mark = scratch_path(spark, "store"), scratch_path(spark, "mark")
    seen = []

    def run(name):
        J.ingest(J.watch_tables(spark, path, schema), store, mark)
        seen.append((name, spark.read.parquet(store).count()))

    run("first")
    run("idle")
    turns(spark, sf).filter("seq % 3 = 0").write.mode("append").parquet(path)
    run("second")
    new = J.refresh_grown(spark, lambda s, since: conform(turns(s, sf)), store, "2024-01-01")
    seen.append(("grown log", new.count()))
    return spark.createDataFrame(seen, "run string, stored long")


@query("x01_stream_ingest", with_turns("""
SELECT strftime(ts, '%Y-%m') AS month, provider, count(*) AS n, CAST(sum(output) AS BIGINT) AS output
FROM turns GROUP BY 1, 2"""))
def x01(spark, sf):
    store, mark = scratch_path(spark, "store"), scratch_path(spark, "mark")
    J.ingest(stream(spark, sf, "seq % 2 = 0", "seq % 2 = 1"), store, mark)
    return spark.read.parquet(store).groupBy(F.col("month").cast("string"), "provider").agg(
        F.count("*").alias("n"), F.sum("output").alias("output"))


@query("x01_log_stream", RESUMED_SQL)
def x01_logs(spark, sf):
    """Logs drop and grow between three triggers of one stream; the turns are those of the whole logs."""
    lines = rollout_lines(spark, sf)
    path, store, mark = (scratch_path(spark, n) for n in ("logs", "store", "mark"))
    logs = GrowingLogs("disk", [f"{path}/*"], N.ROLLOUT, TOPOLOGY, store)
    last = lines.agg(F.max("line")).first()[0]
    early = F.xxhash64("file") % 2 == 0
    for piece in range(1, 4):  # the late half of the logs only appears with the second trigger
        grow(spark, lines.filter(early) if piece < 2 else lines, path, f"line <= {last * piece // 3}")
        J.ingest_logs(logs, J.watch_logs(spark, logs.globs), mark)
    return resumed(S.scan(spark, store))


@query("x02_stream_dedupe", with_turns("SELECT seq, session, output FROM turns"))
def x02(spark, sf):
    """Half of the drops arrive twice, newest first and one file at a time; a second run adds nothing."""
    out, mark = scratch_path(spark, "once"), scratch_path(spark, "mark")
    path, schema = landed(spark, sf, "ts >= '2024-01-16'", "true", "seq % 2 = 0")
    for _ in range(2):
        J.once_only(J.watch_tables(spark, path, schema, 1), out, mark)
        turns(spark, sf).filter("seq % 3 = 0").write.mode("append").parquet(path)
    return spark.read.parquet(out).select("seq", "session", "output")


@query("x03_two_day_rebuild", with_turns("""
SELECT CASE WHEN seq % 11 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS date, count(*) AS turns,
  CAST(sum(output) AS BIGINT) AS output FROM turns GROUP BY 1"""))
def x03(spark, sf):
    """Late rows and rows without a stamp land and count, one file at a time or all at once."""
    raw, roll, mark = (scratch_path(spark, n) for n in ("raw", "days", "mark"))
    path = scratch_path(spark, "landing")
    t = turns(spark, sf).withColumn("ts", F.when(F.col("seq") % 11 != 0, F.col("ts")))
    measures = [F.count("*").alias("turns"), F.sum("output").alias("output")]
    t.filter("ts >= '2024-01-21' and seq % 5 <> 0").write.parquet(path)
    J.rebuild_days(J.watch_tables(spark, path, t.schema, 1), raw, roll, mark, measures)
    t.filter("not coalesce(ts >= '2024-01-21' and seq % 5 <> 0, false)").write.mode("append").parquet(path)
    J.rebuild_days(J.watch_tables(spark, path, t.schema, 1), raw, roll, mark, measures)
    return spark.read.schema("turns long, output long, date string").parquet(roll)


@query("x03_reach", with_turns("""
SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date FROM turns WHERE ts < TIMESTAMP '2024-01-18' AND seq % 5 = 0"""))
def x03_reach(spark, sf):
    """With a reach of two days older days wait, and are listed; their rows have landed."""
    raw, roll, mark = (scratch_path(spark, n) for n in ("raw", "days", "mark"))
    path, schema = landed(spark, sf, "ts < '2024-01-21' and seq % 5 <> 0")
    measures = [F.count("*").alias("turns"), F.sum("output").alias("output")]
    J.rebuild_days(J.watch_tables(spark, path, schema), raw, roll, mark, measures, reach_days=40)
    turns(spark, sf).filter("ts < '2024-01-21' and seq % 5 = 0").write.mode("append").parquet(path)
    J.rebuild_days(J.watch_tables(spark, path, schema), raw, roll, mark, measures, reach_days=2)
    return spark.createDataFrame([(d,) for d in J.stale_days(spark, raw, roll)], "date string")


@query("x04_hourly_rollup", with_turns("""
SELECT date_trunc('hour', ts) AS start, provider, count(*) AS turns, CAST(sum(output) AS BIGINT) AS output
FROM turns GROUP BY 1, 2
HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM turns) - INTERVAL 2 HOUR"""))
def x04(spark, sf):
    """Hours that can no longer change have been written; the open ones wait."""
    out, mark = scratch_path(spark, "hourly"), scratch_path(spark, "mark")
    J.append_to(J.hourly(stream(spark, sf), ["provider"]), out, mark)
    return spark.read.parquet(out)


@query("x05_rolling_quota", with_turns("""
, w AS (SELECT person, unnest(generate_series(1, 20)) AS i, ts FROM turns),
e AS (SELECT person, time_bucket(INTERVAL 15 MINUTE, ts) + i * INTERVAL 15 MINUTE AS as_of FROM w)
SELECT as_of, person, count(*) AS used FROM e GROUP BY 1, 2
HAVING as_of <= (SELECT date_trunc('millisecond', max(ts)) FROM turns) - INTERVAL 2 HOUR"""))
def x05(spark, sf):
    out, mark = scratch_path(spark, "quota"), scratch_path(spark, "mark")
    J.rolling_quota(stream(spark, sf), "person", out, mark)
    return J.quota_rows(spark, out).select("as_of", "person", "used")


@query("x06_session_rollup", with_turns("""
SELECT session, count(*) AS turns, CAST(sum(output) AS BIGINT) AS output, min(ts) AS start, max(ts) AS "end",
  max(input + cache_read + cache_create) AS peak_context FROM turns GROUP BY 1"""))
def x06(spark, sf):
    """Two runs of several batches update the same sessions."""
    path, schema = landed(spark, sf, "seq % 2 = 0")
    out, mark = scratch_path(spark, "sessions"), scratch_path(spark, "mark")
    J.session_totals(J.watch_tables(spark, path, schema, 1), out, mark, buckets=16)
    turns(spark, sf).filter("seq % 2 = 1").write.mode("append").parquet(path)
    J.session_totals(J.watch_tables(spark, path, schema, 1), out, mark, buckets=16)
    return J.latest(spark, out)


@query("x06_session_window", with_turns("""
, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new
  FROM turns WINDOW w AS (PARTITION BY person ORDER BY ts, seq)),
s AS (SELECT *, sum(new) OVER (PARTITION BY person ORDER BY ts, seq) AS sid FROM g)
SELECT person, count(*) AS turns, CAST(sum(output) AS BIGINT) AS output, min(ts) AS start, max(ts) AS "end",
  max(input + cache_read + cache_create) AS peak_context FROM s GROUP BY person, sid
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM turns) - INTERVAL 1 DAY"""))
def x06_gap(spark, sf):
    """Without session ids, six idle hours end a session."""
    out, mark = scratch_path(spark, "gaps"), scratch_path(spark, "mark")
    J.append_to(J.session_rollup(stream(spark, sf), "6 hours", "person"), out, mark)
    return spark.read.parquet(out)
