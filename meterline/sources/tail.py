"""Reading only what log files have gained: a data source of byte ranges.

``log_ranges`` reads lines from (file, first byte, end) ranges, many tasks to a file if need
be. A line belongs to the range that holds its line feed, so neighbouring ranges never share
or lose one, and a last line that is still being written waits for the read that sees its end.
A range that begins inside a line looks back for the line's start. ``line`` is the byte at
which the line begins: an order that holds for all reads of a file, ever.

As a batch source it is given its ranges by ``changes``, which compares a listing with the
cursors of the last read: unchanged files cost nothing, grown ones their new bytes and two
short probes, shrunk and replaced ones are read anew from byte 0. As a stream its offsets are
the files' sizes, so it follows files that grow as well as new ones.

Files are opened by the workers through ``pyarrow.fs`` (local, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from meterline.cluster import lookup_join
from meterline.sources.logs import LINE_SCHEMA, discover

SCHEMA = LINE_SCHEMA + ", fresh boolean"
RANGE = 64 << 20          # bytes that one task reads
TASKS = 512               # beyond so many tasks one takes several ranges, up to RANGE bytes
READ = 1 << 20            # bytes of one read, and about those of one Arrow batch
PROBE = 1024              # bytes at either end of what was read that tell a replaced file


def _open(path: str) -> pa.NativeFile:
    local = re.match(r"file:/+|/", path)
    if local:
        return pa.fs.LocalFileSystem().open_input_file("/" + path[local.end():])
    fs, name = pa.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def lines_of(handle, start: int, end: int, read: int = READ) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of every line whose line feed lies in [start, end)."""
    begin, head = start, b""
    while begin > 0:  # back to the line feed before ``start``
        step = max(0, begin - (len(head) or 256))
        handle.seek(step)
        head = handle.read(begin - step) + head
        at = head.rfind(b"\n")
        begin = step
        if at >= 0:
            begin, head = step + at + 1, head[at + 1:]
            break
    held, at = [head] if head else [], begin
    handle.seek(start)
    while start < end:
        piece = handle.read(min(read, end - start))
        if not piece:
            return
        start += len(piece)
        lines = piece.split(b"\n")
        for line in lines[:-1]:
            whole = b"".join([*held, line])
            held = []
            yield at, whole
            at += len(whole) + 1
        held.append(lines[-1])


def _batches(file: str, path: str, start: int, end: int, fresh: bool) -> Iterator[pa.RecordBatch]:
    names = ["file", "block", "line", "value", "fresh"]
    at, values, size = [], [], 0

    def made():
        n = len(at)
        return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([start] * n, pa.int64()), pa.array(at, pa.int64()),
                                           pa.array(values, pa.string()), pa.array([fresh] * n)], names=names)

    with _open(path) as handle:
        for first, line in lines_of(handle, start, end):
            at.append(first)
            values.append(line.rstrip(b"\r").decode("utf-8", "replace"))
            size += len(line)
            if size >= READ:
                yield made()
                at, values, size = [], [], 0
    if at:
        yield made()


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple]):
        self.ranges = ranges  # (file, path, start, end, fresh)


def tasks_of(files: list[tuple], size: int = RANGE) -> list[Ranges]:
    """Long files are cut, short ones put together, so that no task reads more than ``size``."""
    out, held, left = [], [], size
    for file, path, start, end, fresh in files:
        while start < end:
            stop = min(end, start + size if end - start > size else end)
            if held and stop - start > left:
                out.append(Ranges(held))
                held, left = [], size
            held.append((file, path, start, stop, fresh))
            left -= stop - start
            start = stop
    return [*out, Ranges(held)] if held else out


def gathered(tasks: list[Ranges], most: int = TASKS, size: int = RANGE) -> list[Ranges]:
    """Neighbouring tasks put together where there are more than ``most``; the ranges stay as cut.

    A start of a worker and an output file for every few kilobytes cost more than their lines.
    """
    lengths = [sum(r[3] - r[2] for r in t.ranges) for t in tasks]
    limit = min(size, -(-sum(lengths) // most)) if len(tasks) > most else 0
    out, held = [], 0
    for task, length in zip(tasks, lengths):
        if out and held + length <= limit:
            out[-1] = Ranges([*out[-1].ranges, *task.ranges])
            held += length
        else:
            out.append(task)
            held = length
    return out


class LogRanges(DataSource):
    """``ranges`` (batch) is a JSON list of [file, path, start, end, fresh]; ``path`` (stream) globs."""

    @classmethod
    def name(cls) -> str:
        return "log_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.files = [tuple(r) for r in json.loads(options["ranges"])]
        self.size = int(options.get("bytes", RANGE))

    def partitions(self) -> list[Ranges]:
        return gathered(tasks_of(self.files, self.size)) or [Ranges([])]

    def read(self, partition: Ranges):
        for r in partition.ranges:
            yield from _batches(*r)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.globs = json.loads(options["globs"])
        self.size = int(options.get("bytes", RANGE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(sorted(sizes(self.globs).items()))

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        grown = []
        for path, size in end.items():
            seen = start.get(path, 0)
            seen = seen if size >= seen else 0
            grown.append((path, path, seen, size, seen == 0))
        return gathered(tasks_of(grown, self.size))

    def read(self, partition: Ranges):
        for r in partition.ranges:
            yield from _batches(*r)

    def commit(self, end: dict) -> None:
        pass


def sizes(globs: list[str]) -> dict[str, int]:
    """Files behind the globs (``*`` stays within one folder) and their sizes."""
    found = {}
    for glob in globs:
        local = re.match(r"file:/+|/", glob)
        prefix = "file:///" if local else ""
        fixed = "/" + glob[local.end():] if local else glob
        base = re.split(r"[*?\[]", fixed)[0].rsplit("/", 1)[0] or "/"
        fs, root = (pa.fs.LocalFileSystem(), base) if local else pa.fs.FileSystem.from_uri(base)
        shape = re.compile("".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in fixed) + r"(/[^/]*)?")
        selector = pa.fs.FileSelector(root, recursive=True, allow_not_found=True)
        for info in fs.get_file_info(selector):
            name = info.path if local else base[:len(base) - len(root)] + info.path
            hidden = info.base_name.startswith((".", "_"))
            if info.type == pa.fs.FileType.File and not hidden and shape.fullmatch(name):
                found[prefix + name.lstrip("/") if local else name] = info.size
    return found


def probe(path: str, size: int) -> int:
    """A mark of the first ``size`` bytes: hash of their beginning and end."""
    with _open(path) as handle:
        head = handle.read(min(PROBE, size))
        handle.seek(max(0, size - PROBE))
        return xxhash.xxh3_64_intdigest(head + handle.read(min(PROBE, size))) >> 1


def changes(spark: SparkSession, globs, cursors: DataFrame | None = None) -> DataFrame:
    """(file, path, start, size, mtime, mark) of every file to be read, new, grown, shrunk or replaced.

    ``cursors`` has (file, size, mtime, mark) as of the last read. A file with the same size and
    time is passed over; one whose old bytes carry the old mark is read from where the last read
    ended, any other from byte 0.
    """
    found = discover(spark, globs).select(
        F.col("file").alias("path"), F.regexp_replace("file", "^file:/+", "file:///").alias("file"),
        F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))
    if cursors is None:
        known = found.withColumns({c: F.lit(None).cast("bigint") for c in ("c_size", "c_mtime", "c_mark")})
    else:
        seen = cursors.select(F.col("file").alias("c_file"), *[F.col(c).alias(f"c_{c}") for c in ("size", "mtime", "mark")])
        known = lookup_join(found, seen, F.col("file") == F.col("c_file")).drop("c_file")
    same = (F.col("size") == F.col("c_size")) & (F.col("mtime") == F.col("c_mtime"))
    changed = known.filter(~F.coalesce(same, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                kept = r["c_size"] is not None and r["size"] >= r["c_size"] and probe(r["path"], r["c_size"]) == r["c_mark"]
                r["start"] = r["c_size"] if kept else 0
                r["mark"] = probe(r["path"], r["size"])
            names = ("file", "path", "start", "size", "mtime", "mark")
            kinds = (pa.string(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    return changed.mapInArrow(run, "file string, path string, start bigint, size bigint, mtime bigint, mark bigint")


def read_ranges(spark: SparkSession, ranges: list, size: int = RANGE) -> DataFrame:
    """Lines of the ranges, rows with file, path, start and size, ready for the log readers."""
    spark.dataSource.register(LogRanges)
    listed = [[r["file"], r["path"], r["start"], r["size"], r["start"] == 0] for r in ranges]
    return spark.read.format("log_ranges").option("ranges", json.dumps(listed)).option("bytes", size).load()


def watch(spark: SparkSession, globs: list[str], size: int = RANGE) -> DataFrame:
    """New lines of new and grown files as a stream."""
    spark.dataSource.register(LogRanges)
    return (spark.readStream.format("log_ranges").option("globs", json.dumps(globs)).option("bytes", size).load())
