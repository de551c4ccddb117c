"""Cubes and sketches that are kept up to date instead of built anew.

Each ingest is aggregated by itself; its sums are merged into the day partitions that it
touches, and no other day is read or written. Turns that a repair takes out are subtracted the
same way. Counts that do not add up - distinct sessions, quantiles - are kept as mergeable
sketches per day and slice, so any window is answered from day rows; sketches cannot forget, so
a repair rebuilds those of its days from the turns that remain.

Every merge has a number, larger than those before it, and a day remembers the last one it
holds. A merge that is run again after a lost job passes over the days that have it already.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.cluster import write_and_read
from meterline.functions.labels import blank_to_null, cube_label
from meterline.operators import rollups as R

# Distinct counts: 2**LOG_K registers, standard error about 1.04 / 2**(LOG_K / 2) = 1.6%.
LOG_K = 12
# Quantiles: the rank of an answer is within about 1.7% of the one asked for.
KLL_K = 200


@dataclass
class DayTable:
    """Rows of (date, other dimensions, values), one folder per day, merged by ``combine``."""

    spark: SparkSession
    path: str
    dims: tuple[str, ...]
    combine: dict[str, Callable[[str], Column]]

    def stored(self, days: list[str] | None = None) -> DataFrame | None:
        """Rows as stored, those of some days only; None before the first merge."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/date=*")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at):
            return None
        # The layout of the files, the partition column as text.
        first = self.spark.read.option("basePath", self.path).parquet(self.path).schema
        kind = T.StructType([T.StructField(f.name, T.StringType() if f.name == "date" else f.dataType) for f in first.fields])
        rows = self.spark.read.schema(kind).parquet(self.path)
        return rows if days is None else rows.filter(F.col("date").isin(days))

    def merge(self, delta: DataFrame, number: int, replace: bool = False) -> list[str]:
        """Merge rows of the same layout into their days; returns the days written.

        With ``replace`` a day is left with the rows of ``delta`` alone.
        """
        delta = write_and_read(delta.select(*self.dims, *self.combine), "delta")
        days = sorted(r[0] for r in delta.select("date").distinct().collect())  # calendar days
        before = self.stored(days) if days else None
        if before is not None:
            have = {r[0] for r in before.groupBy("date").agg(F.max("upto").alias("upto"))
                    .filter(F.col("upto") >= number).collect()}
            days = [d for d in days if d not in have]
        if not days:
            return []
        rows = delta.filter(F.col("date").isin(days))
        if before is not None and not replace:
            rows = rows.unionByName(before.filter(F.col("date").isin(days)).select(*rows.columns))
        merged = rows.groupBy(*self.dims).agg(*[how(c).alias(c) for c, how in self.combine.items()])
        # Written beside the table first: the days are overwritten from a finished copy.
        merged = write_and_read(merged.withColumn("upto", F.lit(number).cast("bigint")), "merged")
        (merged.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date").parquet(self.path))
        return days


@dataclass
class KeptCube:
    """A cube of sums: ``build`` makes it from priced turns, ``fold`` adds those of an ingest."""

    table: DayTable
    build: Callable[[DataFrame], DataFrame]
    metrics: tuple[str, ...]

    def fold(self, priced: DataFrame, number: int) -> list[str]:
        return self.table.merge(self.build(priced), number)

    def subtract(self, priced: DataFrame, number: int) -> list[str]:
        """Take turns out again, as they were priced when they were folded in."""
        cube = self.build(priced)
        return self.table.merge(cube.select(*self.table.dims, *[(-F.col(m)).alias(m) for m in self.metrics]), number)

    def rows(self) -> DataFrame:
        """The cube, without cells that a subtraction has emptied."""
        return self.table.stored().filter(F.col(self.metrics[0]) != 0).select(*self.table.dims, *self.metrics)


def _kept(spark: SparkSession, path: str, build, dims: tuple[str, ...], metrics: tuple[str, ...]) -> KeptCube:
    return KeptCube(DayTable(spark, path, dims, dict.fromkeys(metrics, F.sum)), build, metrics)


def main_cube(spark: SparkSession, path: str) -> KeptCube:
    return _kept(spark, path, R.main_cube, R.CUBE_DIMS, R.CUBE_METRICS)


def hours_cube(spark: SparkSession, path: str) -> KeptCube:
    return _kept(spark, path, R.hours_cube, (*R.SLICE_DIMS, "hour"), ("turns",))


def tools_cube(spark: SparkSession, path: str) -> KeptCube:
    return _kept(spark, path, R.tools_cube, (*R.SLICE_DIMS, "tool"), ("calls",))


@dataclass
class KeptSketches:
    """Sessions and output tokens of every day and slice, as sketches that merge."""

    spark: SparkSession
    path: str

    @property
    def table(self) -> DayTable:
        return DayTable(self.spark, self.path, R.SLICE_DIMS, {
            "turns": F.sum, "sessions": F.hll_union_agg, "outputs": F.kll_merge_agg_bigint})

    @staticmethod
    def build(priced: DataFrame) -> DataFrame:
        return priced.groupBy(*[cube_label(d).alias(d) for d in R.SLICE_DIMS]).agg(
            F.count("*").alias("turns"), F.hll_sketch_agg(blank_to_null(F.col("session")), LOG_K).alias("sessions"),
            F.kll_sketch_agg_bigint(F.coalesce("output", F.lit(0)), KLL_K).alias("outputs"))

    def fold(self, priced: DataFrame, number: int) -> list[str]:
        return self.table.merge(self.build(priced), number)

    def rebuild(self, remaining: DataFrame, number: int, days: list[str]) -> list[str]:
        """Sketches of the days, made anew from the turns that remain; a day without any goes."""
        here = remaining.filter(cube_label("date").isin(days))
        written = self.table.merge(self.build(here), number, replace=True)
        left = {r[0] for r in here.select(cube_label("date").alias("date")).distinct().collect()}
        for day in set(days) - left:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/date={day}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return written

    def window(self, since: str, until: str, *by: str, quantile: float = 0.9) -> DataFrame:
        """Turns, distinct sessions and a quantile of output tokens of the days in [since, until]."""
        rows = self.table.stored().filter(F.col("date").between(since, until))
        return rows.groupBy(*by).agg(
            F.sum("turns").alias("turns"), F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("sessions"),
            F.when(F.sum("turns") > 0, F.kll_sketch_get_quantile_bigint(
                F.kll_merge_agg_bigint("outputs"), F.lit(quantile))).alias("quantile"))
