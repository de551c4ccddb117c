"""The turn event: one row per priced turn of an AI tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions.clock import iso_instant

# Event schema version, token counters and fields of the natural key.
SCHEMA_VERSION = 2
COUNTERS = ("input", "output", "cache_create", "cache_read", "cache_1h", "cache_5m")
KEY_FIELDS = ("provider", "session", "ts", "turn", "input", "output", "cache_read", "model")

_STRINGS = ("provider", "ts_raw", "session", "workspace", "repo", "branch", "entrypoint",
            "lane", "model", "effort", "tier", "speed", "agent", "stop")

TURN_SCHEMA = T.StructType([
    T.StructField("v", T.IntegerType()),
    T.StructField("provider", T.StringType()),
    T.StructField("ts_raw", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("session", T.StringType()),
    T.StructField("workspace", T.StringType()),
    T.StructField("repo", T.StringType()),
    T.StructField("surfaces", T.ArrayType(T.StringType())),
    T.StructField("branch", T.StringType()),
    T.StructField("entrypoint", T.StringType()),
    T.StructField("lane", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("effort", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("speed", T.StringType()),
    T.StructField("sidechain", T.BooleanType()),
    T.StructField("agent", T.StringType()),
    T.StructField("turn", T.IntegerType()),
    *[T.StructField(c, T.LongType()) for c in COUNTERS],
    T.StructField("tools", T.ArrayType(T.StringType())),
    T.StructField("web_search", T.IntegerType()),
    T.StructField("web_fetch", T.IntegerType()),
    T.StructField("stop", T.StringType()),
    T.StructField("synthetic", T.BooleanType()),
    # Arrival order of the row in its store; breaks every first-seen tie.
    T.StructField("seq", T.LongType()),
])


def conform(df: DataFrame) -> DataFrame:
    """Give a parsed frame exactly the turn columns, filling what it lacks."""
    have = set(df.columns)
    out = []
    for field in TURN_SCHEMA.fields:
        name, kind = field.name, field.dataType
        col = F.col(name) if name in have else F.lit(None)
        if name == "v":
            col = F.lit(SCHEMA_VERSION)
        elif isinstance(kind, T.ArrayType):
            col = F.coalesce(col, F.array().cast(kind)) if name in have else F.array()
        elif isinstance(kind, T.BooleanType):
            col = F.coalesce(col.cast(kind), F.lit(False))
        elif name in COUNTERS or name in ("turn", "web_search", "web_fetch"):
            col = F.coalesce(col.cast(kind), F.lit(0))
        elif name == "ts" and name not in have:
            col = parse_instant(F.col("ts_raw"))
        out.append(col.cast(kind).alias(name))
    return df.select(*out)


def parse_instant(raw: Column) -> Column:
    """ISO stamp -> timestamp. A stamp without an offset is UTC; a bad one is null.

    The session clock is UTC, so the cast reads a bare stamp as UTC.
    """
    return iso_instant(raw)


def event_key() -> Column:
    """Natural identity of a turn; null, 0 and '' are the same absence."""
    parts = []
    for name in KEY_FIELDS:
        col = F.col("ts_raw" if name == "ts" else name).cast("string")
        parts.append(F.coalesce(F.when(col != "0", col), F.lit("")) if name in
                     ("turn", "input", "output", "cache_read") else F.coalesce(col, F.lit("")))
    return F.concat_ws("|", *parts)
