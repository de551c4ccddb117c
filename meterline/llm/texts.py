"""Words, identities and Arrow batches shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A word is a run of digits, letters and anything beyond ASCII, with A-Z lower-cased. In
# UTF-8 every byte of a non-ASCII character is at least 0x80, so bytes can be searched.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# The same for Java's and DuckDB's regular expressions, before lower-casing.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows in one Arrow batch: whole texts travel, so batches are kept short.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if v is None else v for v in column.cast(kind).to_pylist()]


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + GOLDEN
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(found: list[bytes]) -> np.ndarray:
    """The same 64-bit number for the same word in every process."""
    seen = {w: xxhash.xxh3_64_intdigest(w) for w in set(found)}
    return np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))


def over_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                 schema: str | T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` with batches short enough for whole texts."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def bucket(c: Column, of: int) -> Column:
    """crc32 of a value as text, modulo ``of``: the stable split into folds (null: 0)."""
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(of)), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """Helper column names that none of ``columns`` has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a finished intermediate table of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
