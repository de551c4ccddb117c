"""Gap-filled turns that are kept up to date: an ingest fills only what it touches.

A turn with a real repo and a surface of its own is an *anchor*: no turn before it can change a
turn after it, and the other way round. Sessions are therefore cut at anchors - the first one of
each day, so that there are few - and a segment, from one border to the next, is filled by itself
once the two borders are in it. The border that closes a segment is stored with it as a ghost
row, so filling needs no other segment.

An ingest finds the segments that its turns fall into by an as-of join, fills those with the new
turns and writes them as a new version; a list of segments, written last, says which version
counts. All other segments, also those of the same session, are neither read into the fill nor
written. A border never goes: turns are only added. Turns that a repair takes out need a new
table, built by one ``fold`` of what remains.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.cluster import write_and_read
from meterline.operators.asof import asof_join
from meterline.operators.attribution import Topology, gap_fill
from meterline.operators.scan import CHUNK_ROWS, Scan, by_chunks, hold, running

DAY = 86_400_000_000
BEGIN = -(2**63)  # before every position
SEGMENT = ["_sid", "_from"]


def _place(ts: Column, seq: Column) -> Column:
    return F.struct(ts.cast("bigint").alias("ts"), seq.cast("bigint").alias("seq"))


@dataclass
class FilledTurns:
    """Turns with repo, surface and ``inferred``, as ``gap_fill`` over all of them would give."""

    spark: SparkSession
    path: str
    topology: Topology
    buckets: int = 64
    chunk_rows: int = CHUNK_ROWS

    def fold(self, turns: DataFrame, number: int) -> int:
        """Take in new turns; returns how many turns were written, old and new.

        Numbers rise from ingest to ingest. An ingest that is run again does nothing if it
        was finished, and overwrites what it had written if not.
        """
        if number in self._numbers("segments"):
            return 0
        if "surface" not in turns.columns:
            turns = turns.withColumn("surface", F.lit(None).cast("string"))
        stamp = F.coalesce(F.unix_micros("ts"), F.lit(-(2**62)))  # the order that gap_fill uses
        new = turns.select(
            "*", F.coalesce("session", F.lit("")).alias("_sid"), _place(stamp, F.col("seq")).alias("_at"),
            F.col("session").alias("_session"), F.col("repo").alias("_own_repo"),
            F.col("surface").alias("_own_surface"), F.lit(False).alias("_ghost"))
        new = new.withColumn("_bucket", F.pmod(F.xxhash64("_sid"), F.lit(self.buckets)).cast("int"))
        begin = _place(F.lit(BEGIN), F.lit(BEGIN))
        known = self._segments()
        if known is None:
            work = placed = write_and_read(new.withColumn("_from", begin), "placed")
        else:
            placed = asof_join(new, known, {"_sid": "_sid"}, "_at", "_from",
                               {"_from": "_from", "_version": "_version"}, chunk_rows=self.chunk_rows)
            placed = write_and_read(placed, "placed")
            again = self._stored(placed.filter("_version is not null"))
            work = placed.drop("_version").withColumn("_from", F.coalesce("_from", begin))
            work = work if again is None else work.unionByName(again)
        if placed.isEmpty():
            return 0
        self._write(self._cut(self._fill(work)), number)
        return self._read("rows").filter((F.col("_ingest") == number) & ~F.col("_ghost")).count()

    def rows(self) -> DataFrame:
        """Every turn once, with what was filled in."""
        rows = self._current().filter(~F.col("_ghost")).withColumn("session", F.col("_session"))
        return rows.drop(*[c for c in rows.columns if c.startswith("_")])

    def compact(self, number: int) -> None:
        """Write the versions that count as one and remove the others; frames read before go stale."""
        older = [n for n in self._numbers("rows") if n < number]
        if number not in self._numbers("segments"):
            self._write(self._current().drop("_ingest"), number)
        for n in older:
            for kind in ("segments", "rows"):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/ingest-{n}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    # ------------------------------------------------------------ one ingest

    def _stored(self, touched: DataFrame) -> DataFrame | None:
        """The stored rows of the segments that new turns fall into, ghosts included."""
        # At most one row per bucket and version: it prunes the folders that are read.
        where = touched.select("_bucket", "_version").distinct().collect()
        if not where:
            return None
        rows = self._read("rows").filter(F.col("_bucket").isin(sorted({r[0] for r in where}))
                                         & F.col("_ingest").isin(sorted({r[1] for r in where})))
        asked = touched.select(*SEGMENT, F.col("_version").alias("_ingest")).distinct()
        again = rows.join(asked, [*SEGMENT, "_ingest"], "left_semi")
        return again.drop("_ingest", "inferred")

    def _fill(self, work: DataFrame) -> DataFrame:
        """``gap_fill`` with segments in place of sessions, from what the logs said."""
        segment = F.concat_ws("\x01", "_sid", F.col("_from.ts").cast("string"), F.col("_from.seq").cast("string"))
        return gap_fill(work.withColumns({"session": segment, "repo": F.col("_own_repo"),
                                          "surface": F.col("_own_surface")}), self.topology, self.chunk_rows)

    def _cut(self, filled: DataFrame) -> DataFrame:
        """Part segments at the new borders; a border also closes the segment before it."""
        own = F.nullif(F.col("_own_repo"), F.lit(""))
        anchor = (own.isNotNull() & ~F.coalesce(self.topology.is_incidental(own), F.lit(False))
                  & F.get("surfaces", F.lit(0)).isNotNull() & ~F.col("_ghost"))
        day = F.floor(F.col("_at.ts") / DAY)
        order = ["_at", "_ghost"]

        def borders(df: DataFrame, chunk: str | None) -> DataFrame:
            df = running(df, SEGMENT, order, [Scan("_day", "last_before", F.when(anchor, day))], chunk)
            border = anchor & ~F.col("_day").eqNullSafe(day) & (F.col("_at") > F.col("_from"))
            df = hold(df.withColumn("_border", border), chunk)
            here = F.when(F.col("_border"), F.col("_at"))
            return running(df, SEGMENT, order, [Scan("_now", "last", here), Scan("_then", "last_before", here)], chunk)

        cut = by_chunks(filled, SEGMENT, order, borders, self.chunk_rows)
        side = lambda place, ghost: F.struct(F.coalesce(place, "_from").alias("at"), ghost.alias("ghost"))
        kept = side(F.col("_now"), F.col("_ghost"))
        both = F.when(F.col("_border"), F.array(kept, side(F.col("_then"), F.lit(True)))).otherwise(F.array(kept))
        cut = cut.withColumn("_side", F.explode(both))
        return (cut.withColumns({"_from": F.col("_side.at"), "_ghost": F.col("_side.ghost")})
                .drop("_side", "_day", "_border", "_now", "_then"))

    # ------------------------------------------------------------ storage

    def _write(self, rows: DataFrame, number: int) -> None:
        at = f"{self.path}/rows/ingest-{number}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_bucket").parquet(at)
        # The list of segments makes the rows count: it is written when they are all there.
        self.spark.read.parquet(at).select(*SEGMENT).distinct().write.mode("overwrite") \
            .parquet(f"{self.path}/segments/ingest-{number}")

    def _numbers(self, kind: str) -> list[int]:
        """Finished ingests."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/ingest-*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("ingest-")) for f in found)

    def _read(self, kind: str) -> DataFrame:
        """All finished versions. A filter on the number leaves out whole branches of the union."""
        out = None
        for n in self._numbers("segments"):
            part = self.spark.read.parquet(f"{self.path}/{kind}/ingest-{n}").withColumn("_ingest", F.lit(n).cast("bigint"))
            out = part if out is None else out.unionByName(part)
        return out

    def _segments(self) -> DataFrame | None:
        every = self._read("segments")
        return None if every is None else every.groupBy(*SEGMENT).agg(F.max("_ingest").alias("_version"))

    def _current(self) -> DataFrame:
        rows = self._read("rows")
        if len(self._numbers("segments")) == 1:
            return rows
        return rows.join(self._segments().withColumnRenamed("_version", "_ingest"), [*SEGMENT, "_ingest"], "left_semi")
