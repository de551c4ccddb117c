"""Best-fit packing of tokenized documents by exact-complement hashing.

Every document becomes token ids and an end mark; one longer than a sequence is cut into full
pieces, of which the first may be shorter. Pieces of one length are interchangeable, so the
plan is made on counts of lengths, of which there are at most ``capacity``, and is as small
for a trillion pieces as for a thousand.

The plan goes through the lengths, longest first. For the gap that a piece leaves it looks up
single lengths, then sums of two, then of three, that fill it exactly; a combination is used as
often as its counts allow. Counts only fall, so each sum's cursor over its combinations only
moves on and the index costs no more than one pass over all combinations. What finds no exact
complement is placed by best fit: the smallest gap that holds it, else a new sequence. The plan
is made with sums of up to three, two, one and no lengths, and the shortest one is taken.

Spark then deals the places out. A piece knows its ordinal among the pieces of its length in
its own part; counts per (part, length) give each part its range of ordinals in the whole
table; the plan maps ranges of ordinals to sequences and offsets. No length, however common,
meets in one task, and no piece goes through the driver.

Defined results. A null or empty text is the end mark alone. Strings of the vocabulary's
special token become that token, as they do in the tokenizer itself. Repeated rows are packed
one by one. Sequence ids are numbers without gaps; offsets in a sequence are gapless from 0.
An empty table gives an empty table. Only doc_id and text are read, so further columns may have
any name. A text is encoded in stretches that end before a blank between visible signs (no
pre-token reaches over one), so a very long text takes little memory besides its ids.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.cluster import lookup_join, write_and_read
from meterline.llm.texts import over_batches
from meterline.llm.token_trees import PATTERN, VOCABULARY, leaf_ends

CAPACITY = 1024
END = 2
# The vocabulary's special token and its id.
SPECIAL = {"<|endoftext|>": 50256}
STRETCH = 1 << 16


@lru_cache(maxsize=2)
def _encoding(data: bytes):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def _ids(text: str, data: bytes, end: int) -> np.ndarray:
    enc = _encoding(data)
    at, out = 0, []
    for stop in leaf_ends(text, STRETCH) if len(text) > STRETCH else [len(text)]:
        out += enc.encode(text[at:stop], allowed_special="all")
        at = stop
    return np.array([*out, end], "<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, k): documents as pieces of at most ``capacity`` tokens.

    ``ids`` holds little-endian 32-bit numbers, ``k`` is the ordinal of the piece among those of
    its length in ``part``.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    narrow = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = f"{narrow.schema['doc_id'].name} {narrow.schema['doc_id'].dataType.simpleString()}, " \
             "piece int, start bigint, length int, ids binary, part int, k bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = _ids(text, data, end)
                first = len(ids) % capacity or capacity
                for i, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity)
                    rows.append((row, i, start, stop - start, ids[start:stop].tobytes(), part, seen[stop - start]))
                    seen[stop - start] += 1
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))],
                names=["doc_id", "piece", "start", "length", "ids", "part", "k"])

    return write_and_read(over_batches(narrow, run, schema), "pieces")


class _Sums:
    """Lengths that are left, with an index of single, pair and triple sums.

    A cursor per sum stands on its first combination whose lengths are left; as counts only
    fall, what a cursor has passed never comes back.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [counts.get(n, 0) for n in range(capacity + 1)]
        self.pair_at = [s - 1 for s in range(capacity + 1)]
        self.triple_at = [s - 2 for s in range(capacity + 1)]

    def fits(self, lengths: tuple[int, ...]) -> int:
        """How often all the lengths can be taken together."""
        return min(self.left[n] // lengths.count(n) for n in lengths)

    def pair(self, total: int, *beside: int) -> tuple[int, int] | None:
        """Two lengths with this sum that can be taken together with those ``beside``."""
        a, alive = self.pair_at[total], False
        while a >= total - a > 0:
            if self.left[a] and self.left[total - a] >= (2 if 2 * a == total else 1):
                if not alive:
                    self.pair_at[total], alive = a, True
                if self.fits((*beside, a, total - a)):
                    return a, total - a
            a -= 1
        if not alive:
            self.pair_at[total] = 0
        return None

    def complement(self, length: int, gap: int, most: int) -> tuple[int, ...] | None:
        """At most ``most`` (up to 3) lengths that fill the gap beside ``length`` exactly, or None."""
        if gap == 0:
            return ()
        if most >= 1 and self.left[gap] and self.fits((length, gap)):
            return (gap,)
        if most >= 2 and (two := self.pair(gap, length)):
            return two
        for c in range(self.triple_at[gap] if most >= 3 else 0, 0, -1):
            if self.left[c] and (two := self.pair(gap - c, length, c)):
                return (c, *two)
            dead = not self.left[c] or not self.pair_at[gap - c]
            if dead and self.triple_at[gap] == c:
                self.triple_at[gap] = c - 1
        return None


Plan = list[tuple[int, dict[int, int]]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """(how many sequences, {length: pieces of it in each}) for all counted pieces.

    Filling gaps early with many short lengths can leave long ones alone, so sums of up to
    three, two, one and no lengths are tried; the plan of the fewest sequences is taken.
    """
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    best, size = [], None
    for most in (3, 2, 1, 0):
        made = _plan(counts, capacity, most)
        total = sum(times for times, _ in made)
        if size is None or total < size:
            best, size = made, total
        if size == least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, most: int) -> Plan:
    sums, out = _Sums(counts, capacity), []
    for length in range(capacity, 0, -1):
        while sums.left[length]:
            rest = sums.complement(length, capacity - length, most)
            if rest is None:
                break
            taken = (length, *rest)
            times = sums.fits(taken)
            for n in taken:
                sums.left[n] -= times
            out.append((times, {n: taken.count(n) for n in taken}))
    # Best fit of the rest: open sequences by their gap, each gap a stack of (how many, content).
    gaps: dict[int, list] = defaultdict(list)
    for length in range(capacity, 0, -1):
        count = sums.left[length]
        while count:
            gap = min((g for g, held in gaps.items() if held and g >= length), default=None)
            if gap is None:
                each = min(capacity // length, count)
                times = count // each
                gaps[capacity - each * length].append((times, {length: each}))
                count -= times * each
                continue
            held, content = gaps[gap].pop()
            times = min(held, count)
            if held > times:
                gaps[gap].append((held - times, content))
            gaps[gap - length].append((times, {**content, length: content.get(length, 0) + 1}))
            count -= times
    return out + [x for gap in sorted(gaps) for x in gaps[gap]]


def _places(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first ordinal, pieces a sequence, first sequence, offset), sorted."""
    rows, used, sequence = [], defaultdict(int), 0
    for times, content in patterns:
        offset = 0
        for length, each in sorted(content.items(), reverse=True):
            rows.append((length, used[length], each, sequence, offset))
            used[length] += times * each
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(length: Column, ordinal: Column, patterns: list) -> Column:
    """The struct (sequence_id, offset) of the piece with this ordinal among its length."""
    table = _places(patterns)
    bounds = {int(n): (int(a), int(b)) for n, a, b in zip(
        *np.unique(table[:, 0], return_index=True), [*np.unique(table[:, 0], return_index=True)[1][1:], len(table)])}

    @F.pandas_udf("sequence_id bigint, offset int")
    def find(lengths: pd.Series, ordinals: pd.Series) -> pd.DataFrame:
        n, k = lengths.to_numpy(), ordinals.to_numpy()
        row = np.zeros(len(n), np.int64)
        for length in np.unique(n):
            a, b = bounds[int(length)]
            mine = n == length
            row[mine] = a + np.searchsorted(table[a:b, 1], k[mine], side="right") - 1
        _, first, each, sequence, offset = table[row].T
        return pd.DataFrame({"sequence_id": sequence + (k - first) // each,
                             "offset": (offset + (k - first) % each * n).astype(np.int32)})
    return find(length, ordinal)


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece."""
    cut = pieces(docs, capacity, end, vocabulary)
    per_part = write_and_read(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    # One row per length, at most ``capacity`` of them, goes to the driver.
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = per_part.select(F.col("part").alias("b_part"), F.col("length").alias("b_length"),
                           F.coalesce(before, F.lit(0)).alias("before"))
    ranked = lookup_join(cut, base, (F.col("part") == F.col("b_part")) & (F.col("length") == F.col("b_length")),
                         spread=F.xxhash64("k"))
    place = _placed(F.col("length"), F.col("before") + F.col("k"), plan(counts, capacity))
    return ranked.withColumn("at", place).select(
        "doc_id", "piece", "start", "length", "ids", F.col("at.sequence_id").alias("sequence_id"),
        F.col("at.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences; one holds at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(0), lambda a, x: a + x["length"]).alias("length"),
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
