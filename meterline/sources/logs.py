"""Reading log files: discovery, ordered lines, JSON records and path lookups."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_SCHEMA = "file string, block long, line long, value string"


def expand(globs) -> list[str]:
    """``~`` expanded; one glob or many."""
    globs = [globs] if isinstance(globs, str) else list(globs)
    return [os.path.expanduser(g) for g in globs]


def discover(spark: SparkSession, globs) -> DataFrame:
    """Files behind the globs, with size and time; no content is read."""
    found = None
    for glob in expand(globs):
        try:
            one = spark.read.format("binaryFile").load(glob).select(
                F.col("path").alias("file"), "length", "modificationTime")
        except AnalysisException:
            continue  # a glob that matches nothing is a source that is not installed
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "file string, length long, modificationTime timestamp")
    return found.distinct()


def since(spark: SparkSession, modified_after: str | None):
    """A reader that passes over files not changed after the stamp (UTC, to the second)."""
    return spark.read.option("modifiedAfter", modified_after) if modified_after else spark.read


def read_lines(spark: SparkSession, globs, modified_after: str | None = None) -> DataFrame:
    """Every line with its place: (file, block, line).

    (block, line) orders the lines of a file however many tasks read it. Blocks depend on
    the cluster and the input's size: they hold within one read and are not stored.
    """
    frames = []
    for glob in expand(globs):
        try:
            frames.append(since(spark, modified_after).text(glob).select(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"), "value"))
        except AnalysisException:
            continue
    if not frames:
        return spark.createDataFrame([], LINE_SCHEMA)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def read_documents(spark: SparkSession, globs, modified_after: str | None = None,
                   up_to: int | None = None, packed: str = "$^") -> DataFrame:
    """One row per file, the whole document in ``value``.

    With ``up_to`` only files of at most so many bytes, and those whose name matches ``packed``.
    """
    fits = F.lit(True) if up_to is None else (
        (F.col("_metadata.file_size") <= up_to) | F.lower("_metadata.file_path").rlike(packed))
    frames = []
    for glob in expand(globs):
        try:
            frames.append(since(spark, modified_after).text(glob, wholetext=True).filter(fits).select(
                F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"),
                F.lit(0).cast("long").alias("line"), "value"))
        except AnalysisException:
            continue
    if not frames:
        return spark.createDataFrame([], LINE_SCHEMA)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def split_chunk(spark: SparkSession, globs) -> str | None:
    """``"block"`` when some file spans several blocks, else None.

    A file below one block is at most that many bytes of one task; only longer
    files need their running values carried across blocks.
    """
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    long_file = discover(spark, globs).filter(F.col("length") > limit).limit(1).count()
    return "block" if long_file else None


def records(lines: DataFrame) -> DataFrame:
    """Lines that parse as JSON, as VARIANT ``rec``; broken and blank lines are skipped."""
    # Exploding a one-item array keeps later filters above the parse: pushed below
    # it, each of them would parse the text once more.
    parsed = lines.select("*", F.explode(F.array(F.try_parse_json(F.trim("value")))).alias("rec"))
    return parsed.filter(F.col("rec").isNotNull()).drop("value")


def quarantine(lines: DataFrame) -> DataFrame:
    """The non-blank lines ``records`` skipped; text is not kept, only its place and size."""
    bad = F.try_parse_json(F.trim("value")).isNull() & (F.trim("value") != "")
    return lines.filter(bad).select("file", "block", "line", F.length("value").alias("chars"))


def array_records(docs: DataFrame, path: str | None) -> DataFrame:
    """Documents -> records: the document itself, or each element of an array inside."""
    parsed = records(docs)
    if not path:
        return parsed
    items = F.try_variant_get("rec", json_path(path), "array<variant>")
    return parsed.select("file", "block", F.posexplode(items).alias("line", "rec")) \
        .withColumn("line", F.col("line").cast("long"))


def json_path(dotted: str) -> str:
    """``a.b.0`` -> ``$['a']['b'][0]``."""
    parts = ["$"]
    for part in dotted.split("."):
        parts.append(f"[{part}]" if part.isdigit() else f"['{part}']")
    return "".join(parts)


def dig(node, dotted: str | None, kind: str = "string") -> Column:
    """Dotted lookup in a VARIANT; null on any missing or wrongly typed hop."""
    if not dotted:
        return F.lit(None).cast(kind)
    return F.try_variant_get(node, json_path(dotted), kind)


def counter(node, dotted: str | None) -> Column:
    """A whole token count; absent or unreadable is 0."""
    if not dotted:
        return F.lit(0).cast("long")
    return F.coalesce(dig(node, dotted, "long"), F.lit(0))


def truthy(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def equals(node, where: dict | None) -> Column:
    """All dotted paths equal their stated value."""
    out = F.lit(True)
    for path, value in (where or {}).items():
        kind = "boolean" if isinstance(value, bool) else \
            "double" if isinstance(value, (int, float)) else "string"
        if value is None:
            out = out & dig(node, path).isNull()
        else:
            out = out & F.coalesce(dig(node, path, kind) == F.lit(value), F.lit(False))
    return out


def items(node, dotted: str | None) -> Column:
    """A list of sub-records; anything else is an empty list."""
    empty = F.array().cast("array<variant>")
    return F.coalesce(dig(node, dotted, "array<variant>"), empty) if dotted else empty


def path_args(blocks: Column, args: str, keys, only_absolute: bool = False) -> Column:
    """Path-shaped arguments of every block, in order."""
    def of(block: Column) -> Column:
        found = [dig(block, f"{args}.{k}" if args else k) for k in keys]
        return F.array(*found)
    flat = F.flatten(F.transform(blocks, of))
    kept = F.filter(flat, lambda p: p.isNotNull() & F.startswith(p, F.lit("/")))
    return kept
