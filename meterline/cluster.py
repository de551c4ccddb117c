"""Session settings, shared storage and size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A side is broadcast only when it is proven to hold at most this many rows.
BROADCAST_ROWS = 100_000
# How many ways a join key is split when the lookup side is too big to broadcast.
SALTS = 32


def get_session(app: str = "meterline", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator assumes (UTC clock, AQE on)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # Streaming state (dedupe keys, open windows) outgrows executor heaps.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset; it gets a local folder that goes when
    the process ends. On a cluster each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="meterline-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_MADE: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Remove every table that this process has stored below the shared folder.

    To be called when a job has written its results: frames that still read such a table
    cannot be used afterwards. Returns how many were removed.
    """
    conf, gone = spark._jsc.hadoopConfiguration(), 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """A configuration table as a local relation: no task runs to read it."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [[] for _ in kind.fields]
    data = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(data, schema=arrow), kind)


def is_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` provably has at most ``limit`` rows.

    ``rows`` is passed when the caller already knows the size (config tables);
    otherwise a count that stops at ``limit + 1`` rows decides.
    """
    if rows is None:
        rows = df.limit(limit + 1).count()
    return rows <= limit


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Column,
    how: str = "left",
    rows: int | None = None,
    spread: Column | None = None,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a fact frame to a lookup frame without trusting the lookup's size.

    A lookup of checked size is broadcast. A bigger one is copied under
    ``SALTS`` salt values and joined on (key, salt), so a key that holds a third
    of the fact rows is spread over that many tasks.
    """
    if is_small(small, rows, limit):
        return big.join(F.broadcast(small), on, how)
    spread = spread if spread is not None else F.xxhash64(*[big[c] for c in big.columns[:6]])
    left = big.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = left.join(right, on & (left["_salt"] == right["_salt_r"]), how)
    return joined.drop("_salt", "_salt_r")
