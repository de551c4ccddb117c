"""The turn store: month-partitioned Parquet, reconcile, dedupe, purge and sync."""

from __future__ import annotations

import inspect
import time
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.cluster import scratch_path, write_and_read
from meterline.schema import TURN_SCHEMA, event_key

# Shape of sample rows written before the flag existed.
SAMPLE_WORKSPACES = ("checkout-service", "growth-web", "data-platform", "infra-tooling",
                     "scratchpad")
SAMPLE_SESSION = "^d[0-9a-f]{5}$"
UNDATED = "unknown"


def month_of(ts_raw: Column) -> Column:
    """Partition of a stamp: its year and month as written, or ``unknown``."""
    month = F.left(ts_raw, F.lit(7))
    return F.when(month.rlike(r"^\d{4}-\d{2}$"), month).otherwise(UNDATED)


def arrival() -> Column:
    """Number of an ingest: later ingests have larger ones. Fixed when the frame is built."""
    return F.lit(time.time_ns() // 1000)


def append(turns: DataFrame, path: str, number: Column | None = None) -> None:
    """Append turns to the store, one folder per month, marked with the ingest's number.

    ``seq`` orders the rows of one read only; ``ingest`` orders the reads.
    """
    turns.withColumns({"ingest": arrival() if number is None else number,
                       "month": month_of(F.col("ts_raw"))}).write.mode("append") \
        .partitionBy("month").parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The stored turns; a filter on ``month`` prunes folders."""
    schema = T.StructType([*TURN_SCHEMA.fields, T.StructField("ingest", T.LongType()),
                           T.StructField("month", T.StringType())])
    return spark.read.schema(schema).parquet(path)


def first_copies(turns: DataFrame) -> DataFrame:
    """The first copy of each natural key: oldest month, then order of arrival.

    Arrival is the number of the ingest, then the line. Only key and place are combined, one
    candidate per key and task; whole rows move once, to the places that were chosen, and a
    key with many copies can be split there. Keys begin alike, which makes them slow to sort;
    their hashes go before them.
    """
    place = F.struct(
        F.col("month") if "month" in turns.columns else month_of(F.col("ts_raw")),
        *[F.col(c) for c in ("ingest", "seq") if c in turns.columns], F.xxhash64(*turns.columns))
    keyed = turns.withColumn("_key", event_key()).withColumns({"_hash": F.xxhash64("_key"), "_place": place})
    first = keyed.groupBy("_hash", "_key").agg(F.min("_place").alias("_first")).withColumnsRenamed({"_hash": "_h", "_key": "_k"})
    # No place is smaller than the first: joining on the key alone leaves the rows where the
    # last step wants them. Rows equal in every column are one.
    found = keyed.join(first, (F.col("_hash") == F.col("_h")) & (F.col("_key") == F.col("_k"))
                       & (F.col("_place") <= F.col("_first")), "left_semi")
    return found.dropDuplicates(["_hash", "_key"]).drop("_hash", "_key", "_place")


def dedupe_counts(turns: DataFrame) -> DataFrame:
    keys = turns.groupBy(event_key().alias("k")).agg(F.count("*").alias("n"))
    return keys.agg(F.count("*").alias("kept"),
                    F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("removed"))


def reconcile(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh turns whose key the store lacks; repeats within the batch count once."""
    # What is stored goes first: only new turns are compared with each other.
    have = stored.select(event_key().alias("_have")).withColumn("_hash", F.xxhash64("_have"))
    new = fresh.withColumn("_k", event_key()).withColumn("_h", F.xxhash64("_k")).join(
        have, (F.col("_h") == F.col("_hash")) & (F.col("_k") == F.col("_have")), "left_anti")
    return first_copies(new.drop("_h", "_k"))


def reconcile_months(fresh: DataFrame, path: str) -> DataFrame:
    """``reconcile`` with the stored turns of the time that the fresh turns cover.

    The stamp is part of the key, so other months, and row groups of other times, need not be
    read. Where a fresh turn has no month, whole months are.
    """
    spark = fresh.sparkSession
    spans = fresh.groupBy(month_of(F.col("ts_raw")).alias("m")).agg(
        F.min("ts_raw").alias("lo"), F.max("ts_raw").alias("hi")).collect()
    stored = scan(spark, path).filter(F.col("month").isin([r["m"] for r in spans]))
    if spans and all(r["m"] != UNDATED for r in spans):
        stored = stored.filter(F.col("ts_raw").between(min(r["lo"] for r in spans), max(r["hi"] for r in spans)))
    return reconcile(fresh, stored)


def is_sample() -> Column:
    """A fixture row, flagged or recognisable by its old shape."""
    old = F.col("workspace").isin(*SAMPLE_WORKSPACES) & F.coalesce(
        F.col("session"), F.lit("")).rlike(SAMPLE_SESSION)
    return F.coalesce(F.col("synthetic"), F.lit(False)) | F.coalesce(old, F.lit(False))


def count_samples(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count_if(is_sample()).alias("sample_rows"))


def without_samples(turns: DataFrame) -> DataFrame:
    return turns.filter(~is_sample())


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the store's months with ``change(store)``.

    The result is written beside the store first; the store is overwritten only
    from that finished copy, so a lost job leaves one intact version.
    """
    staged = scratch_path(spark, "rewrite")
    before = scan(spark, path)
    months = before.select("month").distinct()
    change(before).write.partitionBy("month").parquet(staged)
    after = scan(spark, staged)
    emptied = [r[0] for r in months.join(after.select("month").distinct(), "month", "left_anti")
               .collect()]
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("month").parquet(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    for month in emptied:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/month={month}"), True)


def purge_samples(spark: SparkSession, path: str) -> None:
    rewrite(spark, path, without_samples)


def dedupe_store(spark: SparkSession, path: str) -> None:
    rewrite(spark, path, first_copies)


@dataclass
class Source:
    """A named provider and how to read its turns.

    A loader that takes a second argument, ``modified_after``, is asked for the logs changed
    since the last sync only.
    """

    provider: str
    load: Callable[..., DataFrame]

    def read(self, spark: SparkSession, since: str | None = None) -> DataFrame:
        takes = len(inspect.signature(self.load).parameters)
        return self.load(spark, since) if takes > 1 else self.load(spark)


def sync(spark: SparkSession, sources: list[Source], path: str,
         full: bool = False, since: str | None = None) -> DataFrame:
    """Read every source into the store and report what happened to each.

    Only turns that the store lacks are appended, so running it twice writes once. One job
    per source: a source that fails is reported and the rest still land. Where single files
    cannot be read, the others of the source land and the error is reported. Logs changed
    after ``since`` are read, all of them with ``full``.
    """
    report = []
    for source in sources:
        after, error = None if full else since, None
        for lenient in (False, True):
            try:
                read, put = _take(spark, source, path, after, lenient)
                if not lenient or put["written"]:
                    report.append((source.provider, error is None, read, put["written"],
                                   read - put["written"], put["lo"], put["hi"], error))
                    break
            except Exception as exc:  # noqa: BLE001 - one bad source must not stop the others
                error = error or f"{type(exc).__name__}: {str(exc)[:200]}"
        else:
            report.append((source.provider, False, 0, 0, 0, None, None, error))
    return spark.createDataFrame(
        report, "provider string, ok boolean, read long, written long, skipped long, "
                "first_month string, last_month string, error string")


def _take(spark: SparkSession, source: Source, path: str, since: str | None,
          lenient: bool) -> tuple[int, dict]:
    """One source into the store; ``lenient`` passes over files that cannot be read."""
    key, seen, wrote = "spark.sql.files.ignoreCorruptFiles", Observation(), Observation()
    before = spark.conf.get(key)
    spark.conf.set(key, str(lenient).lower())
    try:
        # Stored once: the log is parsed once, and its months are known before it is compared.
        fresh = write_and_read(source.read(spark, since).observe(
            seen, F.count(F.lit(1)).alias("read")), "fresh")
        if _exists(spark, path):
            fresh = reconcile_months(fresh, path)
        else:
            fresh = first_copies(fresh)
        append(fresh.observe(wrote, F.count(F.lit(1)).alias("written"),
                             F.min(month_of(F.col("ts_raw"))).alias("lo"),
                             F.max(month_of(F.col("ts_raw"))).alias("hi")), path)
        return seen.get["read"], wrote.get
    finally:
        spark.conf.set(key, before)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
