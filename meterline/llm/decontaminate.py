"""Benchmark decontamination on a distributed positional inverted index.

The index is partitioned by document: a block of documents, about ``BLOCK_WORDS`` words, is
one row that holds the sorted hashes of its terms and, term by term, the positions at which
each stands. Every token of every document is indexed, once, without a shuffle, and the
table can be searched for any number of test sets.

A search first sums how often each test term stands in the corpus. In every block it then
takes a window's rarest term, shifts its postings by the term's offset, and intersects them
with the shifted postings of the next rarest term and so on, for all windows at once in
numpy. Proximity matches are places where the rarest terms of a stretch of an item, ``slop``
words of it, all stand within ``slop`` words of the rarest one, in whatever order. Stretches
follow one another and the last one ends with the item, so an item of any length is near its
verbatim copies; equally rare terms go by their bytes.

A test set of more than ``CHUNK_WORDS`` words is searched in parts of at most twice as many, each
of which is small enough to be sent to the tasks; the hit spans of the parts are merged per
document. A longer item is cut into rows that share all but one of a window's words; sixteen
bytes count as a word at least.

Defined results. Words: A-Z lower-cased, runs of digits, letters and non-ASCII. A window is
``window`` consecutive words of an item; a shorter item is one window; an item or document
without words (null, empty) matches nothing. Rows of documents are judged one by one, also
repeated ones. Rows of one item_id are one item; an item without id hits but is not listed.
Empty tables: no items give documents without hits, no documents give no rows. Only the
named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.cluster import scratch_path
from meterline.llm.texts import NOT_WORD, fresh, over_batches, texts_of, word_hashes, words

WINDOW = 10
BLOCK_WORDS = 1 << 19
CHUNK_WORDS = 200_000
NEAR_TERMS, SLOP = 5, 20
WORDS = "[^" + NOT_WORD[1:-2] + "]+"
# Candidate places handled at once inside a block.
PLACES = 1 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()),
                                  T.StructField("last", T.IntegerType())]))


# ---------------------------------------------------------------- the index

def _block(ids: list, parts: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    sizes = np.array([len(p) for p in parts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])  # one free place between documents
    terms, term = np.unique(np.concatenate(parts), return_inverse=True)
    places = np.concatenate([np.arange(n, dtype=np.int64) + f for n, f in zip(sizes, first)])
    order = np.argsort(term, kind="stable")
    counts = np.bincount(term, minlength=len(terms)).astype(np.uint32)
    gaps = np.diff(places[order], prepend=0)
    starts = np.cumsum(counts) - counts
    gaps[starts] = places[order][starts]
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(kind)),
         pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
         pa.array([terms.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
         pa.array([gaps.astype(np.uint32).tobytes()], pa.binary())],
        names=["block", "ids", "sizes", "terms", "counts", "postings"])


def build_index(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Index (doc_id, text) and store it in the shared folder; doc_id may be of any type."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("block", T.StringType()),
        T.StructField("ids", T.ArrayType(narrow.schema["doc_id"].dataType)),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
        *[T.StructField(c, T.BinaryType()) for c in ("terms", "counts", "postings")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                found = word_hashes(words(text))
                if ids and held + len(found) > block_words:
                    yield _block(ids, parts, kind)
                    ids, parts, held = [], [], 0
                ids.append(doc_id)
                parts.append(found)
                held += len(found) + 1
        if ids:
            yield _block(ids, parts, kind)

    path = scratch_path(docs.sparkSession, "postings")
    over_batches(narrow, run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


class _Lists:
    """The posting lists of one block, as one sorted array of (term, place)."""

    def __init__(self, terms: bytes, counts: bytes, postings: bytes, sizes: np.ndarray):
        self.terms = np.frombuffer(terms, np.uint64)
        self.counts = np.frombuffer(counts, np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        total = np.cumsum(np.frombuffer(postings, np.uint32).astype(np.int64))
        before = np.concatenate([[0], total])[self.starts] if len(self.starts) else total
        self.places = total - np.repeat(before, self.counts)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else sizes
        self.span = int(sizes.sum() + len(sizes)) + 1
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * self.span + self.places

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Which term of the block a hash is; -1 if none."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def each(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every asked term its places: (index into ``term``, place), flattened."""
        n = self.counts[term]
        who = np.repeat(np.arange(len(term)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return who, self.places[self.starts[term][who] + inner]

    def stands(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the term stands at the place."""
        key = term * self.span + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (place >= 0) & (place < self.span) & (self.keys[at] == key)

    def near(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether the term stands within ``slop`` places, in the same document."""
        key = term * self.span + place
        at = np.searchsorted(self.keys, key)
        doc, ok = self.doc(place), np.zeros(len(place), bool)
        for k in (at, at - 1):
            k = np.clip(k, 0, len(self.keys) - 1)
            other = self.keys[k] - term * self.span
            fits = (np.abs(other - place) <= slop) & (other >= 0) & (other < self.span)
            ok |= fits & (self.doc(np.where(fits, other, place)) == doc)
        return ok

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1


# ---------------------------------------------------------------- the test set

@dataclass
class Tests:
    """Windows of a part of the test set: rows of ``grid`` are term numbers, -1 past the end.

    ``order`` has each row's offsets from the rarest term on; ``stretches`` the distinct terms of
    each stretch and ``stretch_of`` its item, ``rare`` the rarest of these terms; ``spelled`` the
    terms' rank by their bytes.
    """

    items: list
    vocabulary: np.ndarray
    grid: np.ndarray
    item: np.ndarray
    stretches: list
    stretch_of: np.ndarray
    spelled: np.ndarray
    order: np.ndarray | None = None
    rare: np.ndarray | None = None


def _tests(rows: list, window: int, slop: int) -> Tests:
    grids, owner, items, hashes, names = [], [], [], [], {}
    stretches, stretch_of = [], []
    for item_id, text in rows:
        found = words((text or "").encode())
        h = word_hashes(found)
        if not len(h):
            continue
        names.update(zip(h.tolist(), found))
        last = max(0, len(h) - slop)
        for first in sorted({*range(0, last + 1, max(1, slop)), last}):
            stretches.append(np.unique(h[first:first + max(1, slop)]))
            stretch_of.append(len(items))
        n = min(window, len(h))
        grid = np.zeros((len(h) - n + 1, window), np.uint64)
        mask = np.zeros(grid.shape, bool)
        grid[:, :n] = np.lib.stride_tricks.sliding_window_view(h, n)
        mask[:, :n] = True
        grids.append((grid, mask))
        owner += [len(items)] * len(grid)
        items.append(item_id)
        hashes.append(h)
    if not items:
        return Tests([], np.zeros(0, np.uint64), np.zeros((0, window), np.int64), np.zeros(0, np.int64),
                     [], np.zeros(0, np.int64), np.zeros(0, np.int64))
    vocabulary = np.unique(np.concatenate(hashes))
    rank = {w: k for k, w in enumerate(sorted(names.values()))}
    spelled = np.array([rank[names[v]] for v in vocabulary.tolist()])
    grid = np.concatenate([np.where(m, np.searchsorted(vocabulary, g), -1) for g, m in grids])
    stretches = [np.searchsorted(vocabulary, x) for x in stretches]
    return Tests(items, vocabulary, grid, np.array(owner), stretches, np.array(stretch_of), spelled)


def _by_rarity(tests: Tests, counts: dict[int, int], near_terms: int) -> None:
    count = np.array([counts.get(int(v), 0) for v in tests.vocabulary.view(np.int64)] + [1 << 62])
    tests.order = np.argsort(count[tests.grid], axis=1, kind="stable")
    rare = np.full((len(tests.stretches), near_terms), -1)
    for i, mine in enumerate(tests.stretches):
        if len(mine) >= near_terms:
            rare[i] = mine[np.lexsort((tests.spelled[mine], count[mine]))[:near_terms]]
    tests.rare = rare


def _term_counts(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each test term stands in the corpus; as many rows as test terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine, n = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32)
                at = np.searchsorted(vocabulary, mine)
                ok = at < len(vocabulary)
                ok[ok] = vocabulary[at[ok]] == mine[ok]
                np.add.at(total, at[ok], n[ok])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[some].view(np.int64)),
                                          pa.array(total[some])], names=["term", "n"])

    found = index.select("terms", "counts").mapInArrow(run, "term bigint, n bigint")
    return {r["term"]: r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _exact(lists: _Lists, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence of a window in the block."""
    known = np.append(lists.find(tests.vocabulary), 0)  # -1, past the end, counts as there
    rows = np.flatnonzero((known[tests.grid] >= 0).all(axis=1))
    if not len(rows):
        return rows, rows
    lead = known[tests.grid[rows, tests.order[rows, 0]]]
    cut = np.searchsorted(np.cumsum(lists.counts[lead]), np.arange(PLACES, lists.counts[lead].sum(), PLACES))
    windows, places = [], []
    for mine in np.split(np.arange(len(rows)), np.unique(cut)):
        who, place = lists.each(lead[mine])
        row = rows[mine][who]
        place = place - tests.order[row, 0]
        for k in range(1, tests.grid.shape[1]):
            offset = tests.order[row, k]
            term = tests.grid[row, offset]
            ok = (term < 0) | lists.stands(known[term], place + offset)
            row, place = row[ok], place[ok]
        windows.append(row)
        places.append(place)
    return np.concatenate(windows), np.concatenate(places)


def _near(lists: _Lists, tests: Tests, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of the block, item) with the rarest terms of a stretch of it close together."""
    known = np.append(lists.find(tests.vocabulary), -1)
    rows = np.flatnonzero((known[tests.rare] >= 0).all(axis=1) & (tests.rare[:, 0] >= 0))
    if not len(rows):
        return rows, rows
    who, place = lists.each(known[tests.rare[rows, 0]])
    row = rows[who]
    for k in range(1, tests.rare.shape[1]):
        ok = lists.near(known[tests.rare[row, k]], place, slop)
        row, place = row[ok], place[ok]
    return lists.doc(place), tests.stretch_of[row]


def _search_block(lists: _Lists, sizes: np.ndarray, tests: Tests, slop: int) -> tuple:
    """Per document of the block: merged hit spans, items and near items (as indexes)."""
    spans, items = [[] for _ in sizes], [[] for _ in sizes]
    near = [[] for _ in sizes]
    if not len(lists.keys) or not tests.items:
        return spans, items, near
    row, place = _exact(lists, tests)
    if len(row):
        step = np.zeros(lists.span + 1, np.int64)
        width = (tests.grid[row] >= 0).sum(axis=1)
        np.add.at(step, place, 1)
        np.add.at(step, place + width, -1)
        edge = np.diff((np.cumsum(step) > 0).astype(np.int8), prepend=0)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            d = int(lists.doc(np.array([a]))[0])
            spans[d].append({"first": int(a - lists.first[d]), "last": int(b - 1 - lists.first[d])})
        for d, i in np.unique(np.stack([lists.doc(place), tests.item[row]], 1), axis=0):
            items[d].append(int(i))
    doc, row = _near(lists, tests, slop)
    if len(row):
        for d, i in np.unique(np.stack([doc, row], 1), axis=0):
            near[d].append(int(i))
    return spans, items, near


def _search_part(index: DataFrame, tests: Tests, slop: int, item_type: T.DataType) -> DataFrame:
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("block", T.StringType()), T.StructField("place", T.IntegerType()),
        T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()),
        T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(item_type)),
        T.StructField("near", T.ArrayType(item_type))])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = tests.items.__getitem__
        for batch in batches:
            for block, ids, sizes, *data in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.array(sizes, np.int64)
                spans, items, near = _search_block(_Lists(*(bytes(x) for x in data), n), n, tests, slop)
                called = [[sorted({name(i) for i in x} - {None}) for x in y] for y in (items, near)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(v, f.type) for v, f in zip(
                        ([block] * len(ids), list(range(len(ids))), ids, sizes, spans, *called), arrow)],
                    schema=arrow)

    return over_batches(index, run, schema)


def _parts(tests: DataFrame, window: int, chunk_words: int) -> tuple[DataFrame, int, Column]:
    """The items' distinct rows (item_id, text), how many parts they make, and the part of a row."""
    rows = tests.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    long = F.regexp_count("text", F.lit(WORDS)) > chunk_words
    found = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(found) - window), F.lit(chunk_words))
    cut = rows.filter(long).select("item_id", F.posexplode(F.transform(starts, lambda a: F.array_join(
        F.slice(found, a + 1, F.lit(chunk_words + window - 1)), " "))).alias("cut", "text"))
    whole = rows.filter(~long).select("item_id", F.lit(0).alias("cut"), "text")
    size = F.greatest(F.regexp_count("text", F.lit(WORDS)), F.octet_length("text") / 16).cast("bigint")
    path = scratch_path(tests.sparkSession, "items")
    whole.unionByName(cut).withColumn("size", size).write.parquet(path)
    rows = tests.sparkSession.read.parquet(path)
    parts = -(-int(rows.agg(F.sum("size").alias("n")).first()["n"] or 1) // chunk_words)
    while True:
        place = F.lit(0) if parts == 1 else F.pmod(F.xxhash64("item_id", "cut", "text"), F.lit(parts))
        over = rows.groupBy(place.alias("part")).agg(F.sum("size").alias("n"), F.count("*").alias("rows")).filter(
            (F.col("n") > 2 * chunk_words) & (F.col("rows") > 1))
        if parts == 1 or over.isEmpty():
            return rows, parts, place
        parts *= 2


def search(index: DataFrame, tests: DataFrame, window: int = WINDOW, slop: int = SLOP,
           near_terms: int = NEAR_TERMS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Per indexed document: doc_id, n_words, n_hit, spans, items, near.

    ``spans`` are the stretches of words inside any occurrence of a window, ``items`` the
    item_ids that have one, ``near`` those with a proximity match.
    """
    rows, parts, place = _parts(tests, window, chunk_words)
    found = []
    for k in range(parts):
        part = rows.filter(place == k).select("item_id", "text")
        made = _tests([tuple(r) for r in part.collect()], window, slop)  # at most 2 * chunk_words words
        _by_rarity(made, _term_counts(index, made.vocabulary) if made.items else {}, near_terms)
        found.append(_search_part(index, made, slop, rows.schema["item_id"].dataType))
    out = found[0]
    if parts > 1:
        for more in found[1:]:
            out = out.unionByName(more)
        gather = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
        out = out.groupBy("block", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            gather("spans").alias("spans"), F.array_distinct(gather("items")).alias("items"),
            F.array_distinct(gather("near")).alias("near"))
    return out.select("doc_id", "n_words", _union_length(F.col("spans")).alias("n_hit"),
                      "spans", "items", "near")


def _union_length(spans: Column) -> Column:
    """Words covered by spans sorted by their first word."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end"))
    return F.aggregate(spans, start, lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"] - 1, s["end"]))).alias("n"),
        F.greatest(s["end"], x["last"].cast("bigint")).alias("end")), lambda s: s["n"])


def clean_of(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any window of the test set, all columns."""
    same, = fresh(docs.columns, "identity")
    identity = F.struct(docs["doc_id"].alias("id"), F.md5(docs["text"].cast("string")).alias("md5"))
    index = build_index(docs.select(identity.alias("doc_id"), "text"))
    hit = search(index, tests).filter("n_hit > 0").select(F.col("doc_id").alias(same)).distinct()
    path = scratch_path(docs.sparkSession, "contaminated")
    hit.write.parquet(path)
    hit = docs.sparkSession.read.schema(hit.schema).parquet(path)
    return (docs.withColumn(same, identity)
            .join(hit.withColumnRenamed(same, same + "_hit"),
                  F.col(same).eqNullSafe(F.col(same + "_hit")), "left_anti").select(*docs.columns))
