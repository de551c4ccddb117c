"""Ordered running computations that survive one huge key.

A window over ``partitionBy(key)`` puts a whole key into one task. Here a key
may be cut into consecutive *chunks*: the window runs inside each chunk, each
chunk leaves a one-row summary, and the summaries (few per key) carry the state
across chunk borders. With no chunk column the plain window is used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.cluster import is_small, write_and_read

# Keys above this many rows are cut into chunks of about this size.
CHUNK_ROWS = 2_000_000
# The cuts are drawn from rows that reach the driver, some for every chunk: beyond so many
# chunks they hold more rows instead.
CHUNKS = 512


@dataclass
class Scan:
    """One running value. ``kind`` is one of

    last        latest non-null value up to and including this row
    last_before latest non-null value strictly before this row
    next        nearest non-null value from this row on
    total       running sum up to and including this row
    """

    name: str
    kind: str
    value: Column


def running(df: DataFrame, keys: list[str], order: list[str], scans: list[Scan],
            chunk: str | None = None) -> DataFrame:
    """Add every scan's column, ordered by ``order`` within ``keys``."""
    inputs = {s.name: f"_in_{s.name}" for s in scans}
    framed = df.select("*", *[s.value.alias(inputs[s.name]) for s in scans])
    part = keys + ([chunk] if chunk else [])
    ordered = W.partitionBy(*part).orderBy(*order)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    # A frame that ends at the partition's end is computed anew for every row. Going through
    # the rows backwards, the same value is a running one.
    backward = W.partitionBy(*part).orderBy(*[F.col(c).desc_nulls_last() for c in order]) \
        .rowsBetween(W.unboundedPreceding, W.currentRow)

    def local(s: Scan) -> Column:
        col = F.col(inputs[s.name])
        if s.kind == "last":
            return F.last(col, ignorenulls=True).over(upto)
        if s.kind == "last_before":
            return F.last(col, ignorenulls=True).over(before)
        if s.kind == "next":
            return F.last(col, ignorenulls=True).over(backward)
        return F.sum(col).over(upto)

    out = framed.select("*", *[local(s).alias(s.name) for s in scans])
    if chunk:
        out = _carry(framed, out, keys, order, scans, inputs, chunk)
    return out.drop(*inputs.values())


def hold(df: DataFrame, chunk: str | None) -> DataFrame:
    """Store a chunked frame between two scans.

    A scan over chunks reads its input twice; chaining scans without storing
    would double the work at every link. Plain windows need no storing.
    """
    return write_and_read(df, "scan") if chunk else df


def _carry(framed: DataFrame, out: DataFrame, keys, order, scans, inputs, chunk) -> DataFrame:
    """Add the state left by earlier (or later) chunks of the same key."""
    place = F.struct(*order)

    def summary(s: Scan) -> Column:
        col = F.col(inputs[s.name])
        if s.kind in ("last", "last_before"):
            return F.max_by(col, F.when(col.isNotNull(), place))
        if s.kind == "next":
            return F.min_by(col, F.when(col.isNotNull(), place))
        return F.sum(col)

    per_chunk = framed.groupBy(*keys, chunk).agg(
        *[summary(s).alias(f"_c_{s.name}") for s in scans])
    chunks = W.partitionBy(*keys).orderBy(chunk)
    earlier = chunks.rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.col(chunk).desc_nulls_last()) \
        .rowsBetween(W.unboundedPreceding, -1)

    def state(s: Scan) -> Column:
        col = F.col(f"_c_{s.name}")
        if s.kind in ("last", "last_before"):
            return F.last(col, ignorenulls=True).over(earlier)
        if s.kind == "next":
            return F.last(col, ignorenulls=True).over(later)
        return F.sum(col).over(earlier)

    marks = [*keys, chunk]
    carried = per_chunk.select(*[F.col(c).alias(f"_k_{c}") for c in marks],
                               *[state(s).alias(f"_s_{s.name}") for s in scans])
    on = None
    for c in marks:
        same = out[c].eqNullSafe(carried[f"_k_{c}"])
        on = same if on is None else on & same
    joined = out.join(carried, on, "left")
    for s in scans:
        held = F.col(f"_s_{s.name}")
        if s.kind == "total":
            value = F.col(s.name) + F.coalesce(held, F.lit(0))
        else:
            value = F.coalesce(s.name, held)
        joined = joined.withColumn(s.name, value)
    return joined.drop(*[f"_k_{c}" for c in marks], *[f"_s_{s.name}" for s in scans])


def by_chunks(df: DataFrame, keys: list[str], order: list[str], run,
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Apply ``run(frame, chunk)`` with hot keys cut into chunks, the rest whole.

    Hot keys are found by counting. Their rows are range-partitioned on
    (key, order) - which splits inside a key - and written once, so that the
    chunk of a row is the same for every later pass and after a lost executor.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk_rows)
    hot_rows = sizes.agg(F.sum("_n"), F.count("*")).first()
    if not hot_rows[1]:
        return run(df, None)
    hot = sizes.select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    on = None
    for k in keys:
        same = df[k].eqNullSafe(hot[f"_h_{k}"])
        on = same if on is None else on & same
    mark = F.broadcast(hot) if is_small(hot, hot_rows[1]) else hot
    pieces = min(CHUNKS, max(2, -(-int(hot_rows[0]) // chunk_rows)))
    cut = (df.join(mark, on, "left_semi")
           .repartitionByRange(pieces, *keys, *order)
           .withColumn("_chunk", F.spark_partition_id()))
    cut = write_and_read(cut, "chunks")
    rest = df.join(mark, on, "left_anti")
    return run(rest, None).unionByName(run(cut, "_chunk").drop("_chunk"))
