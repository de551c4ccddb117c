"""Rows kept by key between batches, in buckets, so that a batch rewrites only what it touches.

A key's bucket is its hash. A batch reads the buckets its keys lie in, merges, and writes those
buckets as ``rows/batch=k``; then ``heads/batch=k``, which says for every bucket which batch
wrote it last, makes them count. Readers follow the newest head. The head before it is kept with
its buckets, since a batch that is run again starts from there; what only older heads name goes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.cluster import small_table, write_and_read

BUCKETS = 256


@dataclass
class BucketedRows:
    spark: SparkSession
    path: str

    def merge(self, new: DataFrame, key: str, batch: int, buckets: int = BUCKETS,
              combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[int]:
        """Merge a batch of one row per key; returns the buckets written.

        ``combine(before, new)`` gets the stored rows of the touched buckets; without it a new
        row replaces the old one. ``buckets`` must stay the same for a path.
        """
        older = [n for n in self._heads() if n < batch]
        head = self._head(older[-1]) if older else {}
        new = write_and_read(new.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most ``buckets``
        if not touched:
            return []
        fresh, before = new.drop("_bucket"), self._read({b: head[b] for b in touched if b in head})
        if before is None:
            rows = fresh
        elif combine:
            rows = combine(before, fresh)
        else:
            changed = fresh.select(F.col(key).alias("_k"))
            rows = fresh.unionByName(before.join(changed, before[key].eqNullSafe(changed["_k"]), "left_anti"))
        (rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("_bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_bucket")
         .parquet(f"{self.path}/rows/batch={batch}"))
        now = {**head, **dict.fromkeys(touched, batch)}
        small_table(self.spark, sorted(now.items()), "bucket int, batch bigint").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/heads/batch={batch}")
        self._forget(older[:-1], set(head.items()) | set(now.items()))
        return touched

    def rows(self) -> DataFrame:
        return self._read(self._head(self._heads()[-1]))

    def _read(self, head: dict[int, int]) -> DataFrame | None:
        if not head:
            return None
        paths = [f"{self.path}/rows/batch={n}/_bucket={b}" for b, n in head.items()]
        return self.spark.read.parquet(*paths)

    def _heads(self) -> list[int]:
        """Finished batches, oldest first."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/heads/batch=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found)

    def _head(self, batch: int) -> dict[int, int]:
        return {r[0]: r[1] for r in self.spark.read.schema("bucket int, batch bigint").parquet(
            f"{self.path}/heads/batch={batch}").collect()}  # one row per bucket

    def _forget(self, heads: list[int], named: set[tuple[int, int]]) -> None:
        for n in heads:
            for b, batch in set(self._head(n).items()) - named:
                self._delete(f"rows/batch={batch}/_bucket={b}")
            self._delete(f"heads/batch={n}")

    def _delete(self, below: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
