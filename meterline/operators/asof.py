"""As-of join of two large tables: each fact row meets the version in force at its own instant.

Facts and versions are put in one order per key and the version is a running value over it,
so neither side has to be small and no pair is ever made that is not returned. A key that
holds a third of all rows is cut into ranges by ``scan.by_chunks``; a range without a version
of its own takes the last one of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators.scan import CHUNK_ROWS, Scan, by_chunks, running


def asof_join(facts: DataFrame, versions: DataFrame, keys: dict[str, str], at: str, since: str,
              take: dict[str, str], forward: bool = False, strict: bool = False, how: str = "left",
              chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``facts`` with columns of the latest version whose ``since`` is not after ``at``.

    ``keys`` maps columns of the facts to those of the versions, ``take`` columns of the
    versions to their names in the result. ``forward`` looks for the earliest version not
    before ``at`` instead; ``strict`` leaves out versions of the very same instant. ``how`` is
    ``left`` or ``inner``.

    Of versions with equal key and instant the one with the greatest values of ``take``, in
    that order, is taken (the least with ``forward``). A null key or instant matches nothing,
    as in SQL. Facts that are repeated stay repeated.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    names = [f"k{i}" for i in range(len(keys))]
    values = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(take)])
    right = versions.select(*[F.col(c).alias(n) for n, c in zip(names, keys.values())],
                            F.col(since).alias("at"), values.alias("version"))
    left = facts.select(*[F.col(c).alias(n) for n, c in zip(names, keys)],
                        F.col(at).alias("at"), F.struct(*facts.columns).alias("fact"))
    sound = F.col("at").isNotNull()
    for n in names:
        sound = sound & F.col(n).isNotNull()
    # At one instant the order of the two sides decides whether they meet.
    versions_first = forward == strict
    nothing = F.lit(None)
    both = left.filter(sound).select(
        *names, "at", F.lit(1).alias("side"), nothing.cast(right.schema["version"].dataType).alias("version"), "fact"
    ).unionByName(right.filter(sound).select(
        *names, "at", F.lit(0 if versions_first else 2).alias("side"), "version",
        nothing.cast(left.schema["fact"].dataType).alias("fact")))
    scan = [Scan("held", "next" if forward else "last", F.col("version"))]
    order = ["at", "side", "version"]
    met = by_chunks(both, names, order, lambda df, chunk: running(df, names, order, scan, chunk), chunk_rows)
    met = met.filter("side = 1")
    if how == "inner":
        met = met.filter("held is not null")
    else:
        met = met.unionByName(left.filter(~sound), allowMissingColumns=True)
    return met.select("fact.*", *[F.col(f"held.v{i}").alias(name) for i, name in enumerate(take.values())])
