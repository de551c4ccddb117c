"""Reading on where the last read ended: cursors and reader state kept beside the store.

Every ingest of a provider writes one version of two small tables: ``cursors`` (how far each
file was read) and ``carry`` (rows that the reader needs from before, see ``sources.native``).
A version holds only the files that the ingest touched; the newest version of a file counts.
When ``MERGE`` versions have gathered, the next one holds all files and the older ones go.

Turns are appended first, then the version is committed, its cursors last. A job lost in
between finds its old version, reads the same bytes again and makes the same turns, which the
store's keys recognise. So nothing is lost or doubled wherever it stops.

A file that is read from its start has no state: what it carried before is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.cluster import is_small, write_and_read
from meterline.operators.attribution import Topology
from meterline.sources import tail
from meterline.sources.native import Shape
from meterline.sources.store import _exists, append, first_copies, reconcile_months

CURSORS = "file string, size bigint, mtime bigint, mark bigint"
MERGE = 16


@dataclass
class ReaderState:
    """Versions of cursors and carried rows below one folder."""

    spark: SparkSession
    path: str

    def versions(self, part: str = "cursors") -> list[int]:
        root = self._path(f"{self.path}/{part}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = (str(f.getPath().getName()) for f in fs.listStatus(root))
        return sorted(int(n.removeprefix("version=")) for n in found if n.startswith("version=")
                      and _exists(self.spark, f"{self.path}/{part}/{n}/_SUCCESS"))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _read(self, part: str, versions: list[int], schema) -> DataFrame:
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if not versions:
            return self.spark.createDataFrame([], T.StructType([*kind.fields, T.StructField("version", T.LongType())]))
        frames = [self.spark.read.schema(kind).parquet(f"{self.path}/{part}/version={v}")
                  .withColumn("version", F.lit(v).cast("bigint")) for v in versions]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def cursors(self, before: int | None = None) -> DataFrame:
        """The newest cursor of every file, with its version."""
        rows = self._read("cursors", [v for v in self.versions() if before is None or v < before], CURSORS)
        newest = rows.groupBy("file").agg(F.max_by(F.struct("size", "mtime", "mark", "version"), "version").alias("c"))
        return newest.select("file", "c.*")

    def carried(self, schema: T.StructType, before: int | None = None) -> DataFrame:
        """Rows that the newest version of every file carries, in the reader's parsed shape."""
        versions = [v for v in self.versions() if before is None or v < before]
        rows = self._read("carry", [v for v in versions if _exists(self.spark, f"{self.path}/carry/version={v}")], schema)
        newest = self.cursors(before).select(F.col("file").alias("n_file"), F.col("version").alias("n_version"))
        return rows.join(newest, (F.col("file") == F.col("n_file")) & (F.col("version") == F.col("n_version"))) \
            .drop("n_file", "n_version", "version")

    def commit(self, number: int, cursors: DataFrame, carry: DataFrame) -> None:
        """Write version ``number``: state of the files in ``cursors``; merged with all others now and then."""
        older = [v for v in self.versions() if v < number]
        if len(older) >= MERGE:
            touched = cursors.select(F.col("file").alias("t_file"))
            rest = self.cursors(number).join(touched, F.col("file") == F.col("t_file"), "left_anti")
            kept = self.carried(carry.schema, number).join(touched, F.col("file") == F.col("t_file"), "left_anti")
            cursors = cursors.unionByName(rest.select(*cursors.columns))
            carry = carry.unionByName(kept.select(*carry.columns))
        carry.write.mode("overwrite").parquet(f"{self.path}/carry/version={number}")
        cursors.write.mode("overwrite").parquet(f"{self.path}/cursors/version={number}")
        if len(older) > MERGE:  # the merged version before this one stands; those before it are not asked any more
            for v in older[:-1]:
                for part in ("cursors", "carry"):
                    gone = self._path(f"{self.path}/{part}/version={v}")
                    gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)


@dataclass
class GrowingLogs:
    """Logs of one provider that are read on from where the last ingest ended.

    ``store`` is the turn store; the state lies in a folder of its own beside it.
    """

    provider: str
    globs: list[str]
    shape: Shape
    topology: Topology
    store: str
    # Small side tables: name of the reader's parameter -> how to read it.
    sides: dict[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)
    bytes_per_task: int = tail.RANGE

    def state(self, spark: SparkSession) -> ReaderState:
        return ReaderState(spark, f"{self.store.rstrip('/')}.readers/{self.provider}")

    def sync(self, spark: SparkSession) -> dict:
        """One ingest: reads what the logs have gained, appends its turns, commits the state.

        Returns the number of files and bytes read and of turns made and written. Where nothing
        has changed, nothing is read or written.
        """
        state = self.state(spark)
        versions = state.versions()
        number = versions[-1] + 1 if versions else 1
        found = tail.changes(spark, self.globs, state.cursors() if versions else None).collect()
        if not found:
            return {"files": 0, "bytes": 0, "turns": 0, "written": 0}
        lines = tail.read_ranges(spark, found, self.bytes_per_task)
        cursors = spark.createDataFrame([(r["file"], r["size"], r["mtime"], r["mark"]) for r in found], CURSORS)
        anew = [r["file"] for r in found if r["start"] == 0]
        long_file = any(r["size"] - r["start"] > self.bytes_per_task for r in found)
        made, written = self.take(lines, number, cursors, anew, "block" if long_file else None)
        return {"files": len(found), "bytes": sum(r["size"] - r["start"] for r in found), "turns": made, "written": written}

    def take(self, lines: DataFrame, number: int, cursors: DataFrame | None = None, anew: list[str] | None = None,
             chunk: str | None = None) -> tuple[int, int]:
        """Turns of ``lines`` appended to the store, then version ``number`` of the state.

        Without ``cursors`` - in a stream, whose checkpoint has the offsets - files and their
        fresh starts are taken from the lines. Returns the turns made and those written.
        """
        spark = lines.sparkSession
        state = self.state(spark)
        parsed = write_and_read(self.shape.read(lines), "parsed")
        if cursors is None:
            seen = parsed.groupBy("file").agg(F.max("fresh").alias("fresh"), F.max("line").alias("size"))
            seen = write_and_read(seen, "files")
            cursors = seen.select("file", "size", *[F.lit(None).cast("bigint").alias(c) for c in ("mtime", "mark")])
            fresh = seen.filter("fresh").select("file")
        else:
            fresh = spark.createDataFrame([(f,) for f in anew or []], "file string")
        rows = parsed.drop("fresh").withColumn("base", F.lit(None).cast("bigint"))
        carried = state.carried(rows.schema, number)
        here = cursors.select(F.col("file").alias("h_file")).join(
            fresh.select(F.col("file").alias("f_file")), F.col("h_file") == F.col("f_file"), "left_anti")
        carried = carried.join(F.broadcast(here) if is_small(here) else here, F.col("file") == F.col("h_file"), "left_semi")
        # Carried rows go before the first line: their own chunk, the base row before waiting calls.
        carried = write_and_read(carried.withColumns(
            {"block": F.lit(-1).cast("bigint"), "line": F.coalesce("line", F.lit(-1))}), "carried")
        sides = {name: read(spark) for name, read in self.sides.items()}
        turns, left = self.shape.turns(rows.unionByName(carried), self.topology, provider=self.provider, chunk=chunk, **sides)
        turns = write_and_read(turns, "turns")
        new = reconcile_months(turns, self.store) if _exists(spark, self.store) else first_copies(turns)
        new = write_and_read(new, "new")
        written = new.count()
        if written:
            append(new, self.store)
        # Rows that were carried in and are carried on keep their place; a base row has none.
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in left.columns]
        state.commit(number, cursors, left.select("*", *empty).select(*rows.columns))
        return turns.count(), written


def sync_grown(spark: SparkSession, logs: list[GrowingLogs]) -> DataFrame:
    """One ingest of every provider; one that fails is reported and the rest still land.

    A failed provider's state stays as it was, so its next ingest begins at the same bytes.
    """
    report = []
    for one in logs:
        try:
            got, error = one.sync(spark), None
        except Exception as exc:  # noqa: BLE001 - one bad source must not stop the others
            got, error = dict.fromkeys(("files", "bytes", "turns", "written"), 0), f"{type(exc).__name__}: {str(exc)[:200]}"
        report.append((one.provider, error is None, *got.values(), error))
    return spark.createDataFrame(report, "provider string, ok boolean, files long, bytes long, read long, written long, error string")
