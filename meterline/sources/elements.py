"""Reading one long JSON document with many tasks.

A file is read in fragments that end at a closing brace, which any file system that Spark knows
can split, and put together to pieces of some megabytes. Where strings and brackets begin and end
inside a piece depends on what went before, so every piece is summed up in one row: quotes and
brackets under either guess of the piece beginning inside a string. Running sums over these rows
tell how each piece really begins. A second look gives the shallow brackets that a piece leaves
open, a fold over those rows the path at which each piece begins, and a third look cuts the
elements of the wanted list out of all pieces at once. An element that crosses a border leaves
parts, which are joined by its place in the list.

A document is skipped if its brackets or quotes do not close or a second document follows, an
element if it does not parse on its own. Rows of one file that meet in a task: one of about 200
bytes for every piece. An element has to fit into memory, a document does not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.cluster import is_small, write_and_read
from meterline.sources import logs as L

CUT = "}"                 # a piece never ends inside a key, unless the key holds this sign
PIECE = 8 << 20           # bytes of a piece
CHUNK = 1 << 16           # elements of a block
PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"
PLACE = ("file", "block", "piece")

_SIGN = np.zeros(256, bool)
_SIGN[list(b"{}[],")] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
_COMMA, _LIST = ord(","), ord("[")


def _quotes(signs: np.ndarray) -> np.ndarray:
    """Places of the quotes that open or close a string."""
    quotes, slashes = np.flatnonzero(signs == ord('"')), np.flatnonzero(signs == ord("\\"))
    if not len(slashes):
        return quotes
    apart = np.diff(slashes) > 1
    first, last = slashes[np.append(True, apart)], slashes[np.append(apart, True)]
    escaped = (last + 1)[(last - first) % 2 == 0]
    return quotes[~np.isin(quotes, escaped, assume_unique=True)]


def totals(text: bytes) -> tuple[int, int, int]:
    """Quotes modulo 2, and the change of depth if the piece begins outside or inside a string."""
    signs = np.frombuffer(text, np.uint8)
    quotes, at = _quotes(signs), np.flatnonzero(_SIGN[signs])
    step, inside = _STEP[signs[at]], np.searchsorted(quotes, at) % 2 == 1
    return len(quotes) % 2, int(step[~inside].sum()), int(step[inside].sum())


def _key_before(text: bytes, at: int) -> str | None:
    """The key whose value begins at a place; None in a list, "" for a key that is cut."""
    before = text[max(0, at - 4096):at].rstrip()
    if not before.endswith(b":"):
        return None
    before = text[:at].rstrip()[:-1].rstrip()
    end = len(before) - 1
    begin = before.rfind(b'"', 0, end)
    while begin > 0 and (begin - len(before[:begin].rstrip(b"\\"))) % 2:
        begin = before.rfind(b'"', 0, begin)
    try:
        return json.loads(before[begin:end + 1]) if begin >= 0 else ""
    except ValueError:
        return ""


def walk(text: bytes, inside: bool, depth: int, stack: list, levels: int) -> tuple[dict, list]:
    """Follow the brackets of a piece down to some level.

    ``stack`` has [step, relative, commas, is a list] of each shallow bracket that is open at the beginning;
    a step is a key, or a place in a list, which is ``relative`` if the list is open from before.
    Gives what has changed at the end, and the stretches inside a bracket of the last level:
    (steps, commas before, first, end, opened here, closed here, commas inside).
    """
    signs = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_SIGN[signs])
    at = at[(np.searchsorted(_quotes(signs), at) + inside) % 2 == 0]
    sign = signs[at]
    step = _STEP[sign]
    level = depth + np.cumsum(step)
    comma = (sign == _COMMA) & (level <= levels)
    seen = np.cumsum(comma)
    last_commas = at[comma & (level == levels)]
    stack, low, roots, counted, stretches = [list(e) for e in stack], len(stack), 0, 0, []
    steps = lambda: [e[0] for e in stack]
    inner = (steps(), stack[-1][2], 0, False, stack[-1][3]) if len(stack) == levels else None

    def close(end: int, closed: bool) -> None:
        was, commas, first, opened, list_ = inner
        a, b = np.searchsorted(last_commas, [first, end])
        if list_:
            stretches.append((was, commas, first, end, opened, closed, last_commas[a:b]))

    for i in np.flatnonzero(((step == 1) & (level <= levels)) | ((step == -1) & (level < levels))):
        if stack:
            stack[-1][2] += int(seen[i]) - counted
        counted = int(seen[i])
        if step[i] == 1:
            key = _key_before(text, int(at[i])) if stack else None
            place = key is None and bool(stack)
            stack.append([stack[-1][2] if place else key, place and len(stack) == low, 0, bool(sign[i] == _LIST)])
            roots += len(stack) == 1
            if len(stack) == levels:
                inner = (steps(), 0, int(at[i]) + 1, True, stack[-1][3])
        elif stack:
            if len(stack) == levels:
                close(int(at[i]), True)
                inner = None
            stack.pop()
            low = min(low, len(stack))
    if stack:
        stack[-1][2] += (int(seen[-1]) if len(seen) else 0) - counted
    if inner is not None:
        close(len(text), False)
    return {"low": low, "commas": [e[2] for e in stack[:low]], "new": stack[low:], "roots": roots}, stretches


def steps_of(path: str) -> list:
    return [None, *[int(p) if p.isdigit() else p for p in path.split(".")]]


def elements_of(text: bytes, inside: bool, depth: int, stack: list, wanted: list) -> Iterator[tuple]:
    """(place in the list, text, whole) of the wanted list's elements inside a piece."""
    for was, before, first, end, opened, closed, commas in walk(text, inside, depth, stack, len(wanted))[1]:
        if was != wanted:
            continue
        bounds = [first - 1, *commas.tolist(), end]
        last = len(bounds) - 2
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield before + k, text[a + 1:b], (k > 0 or opened) and (k < last or closed)


def _pieces(fragments: DataFrame, size: int) -> DataFrame:
    """Fragments of the files, in order, to stored pieces with their sums."""
    def made(file, block, piece, length, held):
        text = b"".join(held)
        parity, outside, within = totals(text)
        row = ([file], [block], [piece], [length], [len(text)], [parity], [outside], [within], [text])
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

    names = ["file", "block", "piece", "length", "bytes", "parity", "outside", "within", "text"]
    kinds = [pa.string(), *[pa.int64()] * 7, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, piece, held, n = None, 0, [], 0
        for batch in batches:
            files, blocks, lengths, values = batch.columns
            for i, (block, value) in enumerate(zip(blocks.to_pylist(), values.to_pylist())):
                here = (files[i].as_py(), block, lengths[i].as_py())
                if held and (here != place or n >= size):
                    yield made(*place[:2], piece, place[2], held)
                    piece, held, n = piece + 1, [], 0
                place = here
                held += (value, CUT.encode())
                n += len(value) + 1
        if held:
            yield made(*place[:2], piece, place[2], held)

    cut = fragments.mapInArrow(run, "file string, block long, piece long, length long, bytes long, "
                                    "parity long, outside long, within long, text binary")
    return write_and_read(cut, "pieces")


def _beside(pieces: DataFrame, rows: DataFrame) -> DataFrame:
    """Pieces with a further row of each; texts are moved only if the rows are too many to send."""
    return pieces.select(*PLACE, "text").join(F.broadcast(rows) if is_small(rows) else rows, list(PLACE))


def _begun(pieces: DataFrame) -> DataFrame:
    """(place, inside, depth, and the file's sums) of every piece."""
    before = W.partitionBy("file").orderBy("block", "piece").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1
    known = pieces.drop("text").withColumn("inside", inside).withColumn(
        "change", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    return write_and_read(known.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))), "begun")


def _left_open(begun: DataFrame, levels: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for text, inside, depth in zip(*(batch.column(c).to_pylist() for c in ("text", "inside", "depth"))):
                unknown = [[None, False, 0, False]] * max(0, min(depth, levels))
                left.append(json.dumps(walk(text, inside, depth, unknown, levels)[0]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PLACE), pa.array(left)], names=[*PLACE, "left"])

    return begun.mapInArrow(run, "file string, block long, piece long, left string")


def _paths(rows: pd.DataFrame) -> pd.DataFrame:
    """The shallow brackets open at the beginning of every piece of a file, if the file is whole."""
    rows = rows.sort_values(["block", "piece"])
    stack, stacks, roots = [], [], 0
    for left in map(json.loads, rows["left"]):
        stacks.append(json.dumps(stack))
        low = left["low"]
        kept = [[e[0], False, e[2] + n, e[3]] for e, n in zip(stack[:low], left["commas"])]
        base = stack[low - 1][2] if low else 0
        stack = kept + [[e[0] + base if e[1] else e[0], False, *e[2:]] for e in left["new"]]
        roots += left["roots"]
    end = rows.iloc[-1]
    spare = int(rows["bytes"].sum() - end["length"])  # 1 if the file does not end with the cut's sign
    whole = roots == 1 and rows["parity"].sum() % 2 == 0 and end["depth"] + end["change"] == -spare
    out = rows.assign(stack=stacks, ordinal=np.arange(len(rows)))[[*PLACE, "inside", "depth", "stack", "ordinal"]]
    return out if whole else out[:0]


def split_elements(fragments: DataFrame, path: str, piece: int = PIECE) -> DataFrame:
    """(file, block, line, value) of each element of the list at a dotted path.

    ``fragments`` has file, block, length (of the file) and value, in the files' order inside every
    partition, a block in one partition. ``line`` is the place in the list, ``block`` a run of
    ``CHUNK`` places, so that running values over a long list can go by chunks.
    """
    wanted = steps_of(path)
    pieces = _pieces(fragments, piece)
    begun = _begun(pieces)
    left = write_and_read(_left_open(_beside(pieces, begun.select(*PLACE, "inside", "depth")), len(wanted)), "left")
    states = begun.join(left, list(PLACE)).groupBy("file").applyInPandas(
        _paths, "file string, block long, piece long, inside boolean, depth long, stack string, ordinal long")
    states = write_and_read(states, "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("file", "text", "inside", "depth", "stack", "ordinal")
        for batch in batches:
            for file, text, inside, depth, stack, ordinal in zip(*(batch.column(c).to_pylist() for c in names)):
                found = list(elements_of(text, inside, depth, json.loads(stack), wanted))
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([file] * n, pa.string()), pa.array([x[0] for x in found], pa.int64()),
                    pa.array([ordinal] * n, pa.int64()), pa.array([x[2] for x in found], pa.bool_()),
                    pa.array([x[1] for x in found], pa.binary())], names=["file", "line", "ordinal", "whole", "value"])

    found = write_and_read(_beside(pieces, states).mapInArrow(
        run, "file string, line long, ordinal long, whole boolean, value binary"), "elements")
    whole = found.filter("whole").select("file", "line", F.col("value").cast("string").alias("value"))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "value")))
    joined = found.filter("not whole").groupBy("file", "line").agg(parts.alias("parts")).select(
        "file", "line", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["value"])).cast("string").alias("value"))
    return whole.unionByName(joined).select(
        "file", F.floor(F.col("line") / CHUNK).alias("block"), "line", "value")


def read_elements(spark: SparkSession, globs, path: str, modified_after: str | None = None,
                  longer_than: int | None = None, piece: int = PIECE) -> DataFrame:
    """Elements of the list at a dotted path in every document: (file, block, line, rec).

    Documents of more than ``longer_than`` bytes (a partition's, if not stated) are split. Shorter
    and compressed ones are one row each, as are all if a key of the path holds the cut's sign.
    """
    if longer_than is None:
        longer_than = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
            spark.conf.get("spark.sql.files.maxPartitionBytes"))
    small = L.array_records(L.read_documents(spark, globs, modified_after, None if CUT in path else longer_than, PACKED), path)
    out = small.select("file", "block", "line", "rec")
    if CUT in path:
        return out
    for glob in L.expand(globs):
        try:
            read = L.since(spark, modified_after).text(glob, lineSep=CUT)
        except AnalysisException:
            continue  # as in ``discover``
        name, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
        fragments = read.filter((size > longer_than) & ~F.lower(name).rlike(PACKED)).select(
            name.alias("file"), F.col("_metadata.file_block_start").alias("block"), size.alias("length"),
            F.col("value").cast("binary").alias("value"))
        if fragments.isEmpty():
            continue
        out = out.unionByName(L.records(split_elements(fragments, path, piece)).select("file", "block", "line", "rec"))
    return out
