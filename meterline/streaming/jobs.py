"""Structured Streaming forms of ingest, dedupe and the rollups kept fresh.

Each job takes a streaming frame of turns and folders in shared storage, runs
until the available input is used up and leaves its progress in a checkpoint.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.cluster import small_table, write_and_read
from meterline.sources import tail
from meterline.sources.resume import GrowingLogs
from meterline.sources.store import (UNDATED, _exists, append, first_copies, month_of, reconcile_months)
from meterline.streaming.state import BUCKETS, BucketedRows

LATE_ROLLUP = "2 hours"   # how late a turn may be and still be counted in a window


def watch_tables(spark: SparkSession, path: str, schema: T.StructType,
                 files_per_batch: int | None = None) -> DataFrame:
    """Parquet drops as a stream; a file is read once."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def watch_logs(spark: SparkSession, globs: list[str]) -> DataFrame:
    """Log files as a stream of lines: new files, and what known files have gained.

    The checkpoint holds every file's size. A last line without a line feed waits; a file that
    has shrunk is read from its start.
    """
    return tail.watch(spark, globs)


def ingest_logs(logs: GrowingLogs, lines: DataFrame, checkpoint: str, trigger: dict | None = None) -> None:
    """Turns of streamed log lines, appended to the store that ``logs`` names.

    What a reader carries from batch to batch - totals, settings, ordinals, waiting calls - is
    kept in versions named by the batch. A batch that is run again starts from the version
    before it, and the store's keys recognise the turns it had appended.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        logs.take(batch, batch_id + 1, chunk="block")

    _finish(lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def ingest(turns: DataFrame, store: str, checkpoint: str) -> None:
    """Append new turns by month; a second run with nothing new writes nothing."""
    out = turns.withColumns({"ingest": F.unix_micros(F.current_timestamp()),
                             "month": month_of(F.col("ts_raw"))})
    _finish(out.writeStream.format("parquet").partitionBy("month").option("path", store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def refresh_grown(spark: SparkSession, load, store: str, since: str) -> DataFrame:
    """Turns of logs changed after ``since`` that the store does not have yet.

    ``load(spark, modified_after)`` re-reads the changed logs whole; the key
    decides what is new, so a grown, shrunk or rewritten log is safe.
    """
    fresh = load(spark, since)
    return reconcile_months(write_and_read(fresh, "fresh"), store) if _exists(spark, store) else fresh


def once_only(turns: DataFrame, store: str, checkpoint: str) -> None:
    """Append each turn once, however late a copy comes and however the files are cut.

    A batch is compared with the store by key, within the months that it touches: a key
    holds its stamp, so a copy lies in the same month. A batch that is run again finds its
    own rows there and adds nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = reconcile_months(batch, store) if _exists(spark, store) else first_copies(batch)
        append(fresh, store)

    _finish(turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_to(frame: DataFrame, path: str, checkpoint: str) -> None:
    _finish(frame.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def hourly(turns: DataFrame, by: list[str], late: str = LATE_ROLLUP) -> DataFrame:
    """Turns and tokens per hour; an hour is written once it can no longer change."""
    return (turns.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), *by)
            .agg(F.count("*").alias("turns"), F.sum("output").alias("output"))
            .select(F.col("window.start").alias("start"), *by, "turns", "output"))


def rolling_quota(turns: DataFrame, by: str, path: str, checkpoint: str, hours: int = 5,
                  slide: str = "15 minutes", late: str = LATE_ROLLUP) -> None:
    """Turns of each party in overlapping windows, for quota alerts; ``quota_rows`` reads them.

    A window is a run of slots. A batch is combined to slots (party, slot), which are stored;
    the windows that the batch closes are then summed from the slots they cover, so a turn is
    held once and not once per window. A window is written when the newest stamp is ``late``
    beyond its end; a turn that is later than that still counts in the windows that are open.
    A party's slots meet in one task, where its windows are made: only slots are shuffled. A
    batch that is run again finds what was there before it.
    """
    def micros(length: str) -> int:
        return turns.sparkSession.range(1).select(F.expr(
            f"unix_micros(timestamp_seconds(0) + interval {length})")).first()[0]

    step, delay, span = micros(slide), micros(late), micros(f"{hours} hours")
    if step > span:
        raise ValueError("windows must not leave gaps")
    width = math.gcd(step, span)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        older = _closed(spark, path, batch_id)
        before = older[max(older)][0] if older else None
        at = F.unix_micros("ts")
        (batch.filter("ts is not null").groupBy((F.floor(at / width) * width + width).alias("slot"), by)
         .agg(F.count("*").alias("used"), F.max(at).alias("newest"))
         .write.mode("overwrite").parquet(f"{path}/slots/batch={batch_id}"))
        kind = T.StructType([T.StructField("slot", T.LongType()), batch.schema[by],
                             T.StructField("used", T.LongType()), T.StructField("newest", T.LongType())])
        last, top = spark.read.schema(kind).parquet(f"{path}/slots/batch={batch_id}").agg(
            F.max("newest"), F.max("slot")).first()
        # As a watermark, the limit of closed windows is kept in whole milliseconds.
        limits = [before, None if last is None else last // 1000 * 1000 - delay]
        now = max((n for n in limits if n is not None), default=None)
        if now != before or not _exists(spark, f"{path}/windows"):
            slots = spark.read.schema(kind.add("batch", "long")).parquet(f"{path}/slots")
            held = slots.filter((F.col("batch") <= batch_id) & (F.col("slot") <= F.lit(now).cast("long")))
            first = F.ceil((F.col("slot") - span) / step) * step + span
            ends = F.sequence(first, F.col("slot") - width + span, F.lit(step).cast("long"))
            open_ = F.col("as_of") <= F.lit(now).cast("long")
            if before is not None:
                held, open_ = held.filter(F.col("slot") > before - span), open_ & (F.col("as_of") > before)
            # Partitioned by party alone, the sums need no shuffle of their own.
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            windows = (held.select("slot", by, "used").repartition(parts, by)
                       .select(F.explode(ends).alias("as_of"), by, "used").filter(open_)
                       .groupBy("as_of", by).agg(F.sum("used").alias("used")))
            windows.select(F.timestamp_micros("as_of").alias("as_of"), by, "used").write.mode("overwrite") \
                .parquet(f"{path}/windows/batch={batch_id}")
        small_table(spark, [(now, top)], "closed bigint, top bigint").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/closed/batch={batch_id}")
        for n, (_, top) in older.items():  # slots that no open window covers; the newest limit stays
            if before is not None and n != max(older) and (top is None or top <= before - span):
                _remove(spark, f"{path}/slots/batch={n}")
                _remove(spark, f"{path}/closed/batch={n}")

    _finish(turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _closed(spark: SparkSession, path: str, batch: int) -> dict[int, tuple]:
    """For every earlier batch: up to when windows are closed, and its newest slot."""
    if not any(int(n) < batch for n in _folders(spark, f"{path}/closed", "batch=")):
        return {}
    rows = spark.read.schema("closed bigint, top bigint, batch bigint").parquet(f"{path}/closed")
    return {r["batch"]: (r["closed"], r["top"]) for r in rows.filter(F.col("batch") < batch).collect()}


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def quota_rows(spark: SparkSession, path: str) -> DataFrame:
    """The windows that ``rolling_quota`` has written."""
    return spark.read.parquet(f"{path}/windows")


def session_rollup(turns: DataFrame, gap: str | None = None, by: str | None = None,
                   late: str = "1 day") -> DataFrame:
    """Running facts per session id, or per activity gap where no id exists."""
    facts = [F.count("*").alias("turns"), F.sum("output").alias("output"),
             F.min("ts").alias("start"), F.max("ts").alias("end"),
             F.max(F.col("input") + F.col("cache_read") + F.col("cache_create"))
             .alias("peak_context")]
    if gap is None:
        return turns.groupBy("session").agg(*facts)
    return (turns.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by)
            .agg(*facts).drop("session_window"))


def session_totals(turns: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Facts per session id, kept up to date without streaming state.

    A batch is combined to one row per session and merged into the buckets its sessions lie
    in, so memory does not grow with the sessions ever seen nor a batch's work with the
    history; a batch that is run again starts from the same rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        BucketedRows(batch.sparkSession, path).merge(session_rollup(batch), "session", batch_id, buckets, _added)

    _finish(turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _added(before: DataFrame, new: DataFrame) -> DataFrame:
    return before.unionByName(new).groupBy("session").agg(
        F.sum("turns").alias("turns"), F.sum("output").alias("output"), F.min("start").alias("start"),
        F.max("end").alias("end"), F.max("peak_context").alias("peak_context"))


def keep_latest(frame: DataFrame, path: str, checkpoint: str, key: str, buckets: int = BUCKETS) -> None:
    """Update-mode sink: one row per key, the newest.

    A batch's rows replace those of their keys, bucket by bucket; see ``state.BucketedRows``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        BucketedRows(batch.sparkSession, path).merge(batch, key, batch_id, buckets)

    _finish(frame.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Current rows of ``session_totals`` or ``keep_latest``."""
    return BucketedRows(spark, path).rows()


def rebuild_days(turns: DataFrame, raw: str, rollup: str, checkpoint: str,
                 measures: list[Column], reach_days: int | None = None) -> None:
    """Keep a per-day rollup right while late submissions arrive.

    Every row of a batch lands, whatever its stamp; then the days the batch touched are
    recomputed from all landed rows and those partitions overwritten, so the result does not
    depend on how files are cut into batches. Rows without a stamp are one group, ``date``
    null. With ``reach_days`` only days up to so far before the newest landed one are
    recomputed; ``stale_days`` lists the others.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = F.coalesce(F.to_date("ts").cast("string"), F.lit(UNDATED))
        batch.withColumn("date", day).write.mode("overwrite").partitionBy("date").parquet(
            f"{raw}/batch={batch_id}")
        here = f"{raw}/batch={batch_id}"
        # One value per calendar day, read from the folders' names.
        days = _days_of(spark, here)
        if reach_days is not None and days:
            newest = max((d for d in _all_days(spark, raw) if d != UNDATED), default=None)
            first = None if newest is None else str(
                dt.date.fromisoformat(newest) - dt.timedelta(days=reach_days))
            days = [d for d in days if first is None or (d != UNDATED and d >= first)]
        if days:
            landed = spark.read.schema(batch.schema.add("batch", "long").add("date", "string")) \
                .option("basePath", raw).parquet(raw)
            (landed.filter(F.col("date").isin(days)).groupBy("date").agg(*measures)
             .withColumn("built", F.lit(batch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("date").parquet(rollup))

    _finish(turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stale_days(spark: SparkSession, raw: str, rollup: str) -> list[str]:
    """Days with landed rows that a later batch than their rollup brought."""
    built = {r["date"]: r["built"] for r in spark.read.schema("built long, date string").parquet(rollup)
             .groupBy("date").agg(F.max("built").alias("built")).collect()}
    newest: dict[str, int] = {}
    for batch in _folders(spark, raw, "batch="):
        for day in _days_of(spark, f"{raw}/batch={batch}"):
            newest[day] = max(newest.get(day, -1), int(batch))
    return sorted(d for d, b in newest.items() if built.get(d, -1) < b)


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    if not _exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = (f.getPath().getName() for f in fs.listStatus(p))
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))


def _days_of(spark: SparkSession, batch: str) -> list[str]:
    return _folders(spark, batch, "date=")


def _all_days(spark: SparkSession, raw: str) -> set[str]:
    return {d for b in _folders(spark, raw, "batch=") for d in _days_of(spark, f"{raw}/batch={b}")}
