"""Connected components of a graph whose links never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.cluster import scratch_path


def _stored(df: DataFrame) -> tuple[DataFrame, tuple]:
    path = scratch_path(df.sparkSession, "links")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    seen = back.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return back, tuple(seen)


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the links (a, b); root is the smallest vertex reached.

    Alternates two steps until nothing changes: every vertex hands its larger neighbours to
    its smallest one, then its smaller neighbours. Each round is one combine and one join on
    a vertex, written to the shared folder. No links give no rows; loops and repeated links
    do no harm.
    """
    now, seen = _stored(links.filter("a <> b").select("a", "b").distinct())
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(least, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x"))
                 .select("x.a", "x.b").filter("a <> b").distinct())
        was = seen
        now, seen = _stored(small)
        if seen == was:
            break
    roots = now.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()
