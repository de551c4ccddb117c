"""Line deduplication with levelled sorted runs of line hashes.

Documents are taken in rising order of id, batch by batch. A run is a table of line hashes
with the first document that held each, bucketed and sorted by hash. A batch is combined
to one row per hash, merge-joined to every run (buckets meet buckets: the runs are not
shuffled), and the hashes that no run holds become its own run. When ``fanout`` runs of
one level have gathered, they are merged into one run of the next level, so the number of
runs grows with the logarithm of the batches.

A line repeated in a third of all documents is one row per task before any shuffle. The rows
that must go are found by a join on the hash in which the ``HOT_LINES`` most frequent lost
hashes are broadcast and the rest meets by shuffle: a hash of the rest holds less than one in
``HOT_LINES`` of a batch's rows. What a row must lose is gathered by row, from its own lines.

Runs kept in a folder (``Runs(spark, folder=...)``, then ``save``) are opened again by a later
job with ``Runs.reopen``; documents that come after all earlier ones are then deduplicated
against them without those being read again.

Defined results. A line's key is the line without ASCII white space at its ends, A-Z
lower-cased; keys shorter than ``min_chars`` code points always stay. A null or empty text
is one empty line. Rows with one doc_id are one document. Rows without doc_id are together
one document that comes after all others. Repeated lines inside one document stay. An
empty table gives an empty table. Further columns are passed through by ``drop_lines``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.cluster import scratch_path, small_table, write_and_read
from meterline.llm.texts import code_points, fresh, over_batches, texts_of

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
HOT_LINES, HOT_ROWS = 10_000, 1_000  # how many lost hashes are broadcast, and from how many rows on
LAST = (1 << 63) - 1  # stands for a missing id


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a line's key; None for a key that is too short."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and code_points(key) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, r, h): every distinct key of every row of (d, r, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, hashes = [], [], []
            for d, r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                keys = {key_of(line, min_chars) for line in text.split(b"\n")}
                keys.discard(None)
                ids += [d] * len(keys)
                rows += [r] * len(keys)
                hashes += keys
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()),
                                              pa.array(hashes, pa.binary())], names=["d", "r", "h"])
    return over_batches(docs, run, "d bigint, r bigint, h binary")


class Runs:
    """The levelled runs: tables (h, owner) of first holders, bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, folder: str | None = None):
        self.spark, self.fanout, self.folder = spark, fanout, folder
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, "line-run") if self.folder is None else f"{self.folder}/{name}"
        (df.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h")
         .option("path", path).saveAsTable(name))
        self.paths[name] = path
        return name

    def save(self, path: str) -> None:
        """Write down which runs there are, at a new path; the runs themselves stay in ``folder``."""
        if self.folder is None:
            raise ValueError("runs in scratch tables cannot be opened again: give a folder")
        rows = [(k, i, self.paths[n], self.buckets, self.fanout) for k, level in enumerate(self.levels) for i, n in enumerate(level)]
        small_table(self.spark, rows, "level int, place int, path string, buckets int, fanout int").coalesce(1).write.parquet(path)

    @classmethod
    def reopen(cls, spark: SparkSession, folder: str, path: str) -> Runs:
        """The runs that ``save`` wrote down at ``path``; none if there were none."""
        runs = cls(spark, folder=folder)
        for r in spark.read.parquet(path).orderBy("level", "place").collect():  # a logarithm of the batches
            runs.buckets, runs.fanout = r["buckets"], r["fanout"]
            while len(runs.levels) <= r["level"]:
                runs.levels.append([])
            name = f"line_run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} (h BINARY, owner BIGINT, last BIGINT, n BIGINT, held BOOLEAN) USING parquet "
                      f"CLUSTERED BY (h) SORTED BY (h) INTO {runs.buckets} BUCKETS LOCATION '{r['path']}'")
            runs.paths[name] = r["path"]
            runs.levels[r["level"]].append(name)
        return runs

    def close(self) -> None:
        """Take the tables out of the catalog. Their files stay, and frames made from them still read."""
        for name in self.paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of (d, h), later in order than all before.

        Returns (h, keep, n) for the hashes that some line of the batch must lose: ``keep`` is
        the one document of the batch that holds on to it, null if an older one does, and
        ``n`` the rows of the batch that have the hash.
        """
        firsts = lines.groupBy("h").agg(F.min("d").alias("owner"), F.max("d").alias("last"), F.count("*").alias("n"))
        held = F.lit(False)
        for i, name in enumerate(self.names()):
            run = (self.spark.table(name).filter(~F.col("held"))
                   .select("h", F.lit(True).alias(f"in{i}")))
            firsts = firsts.join(run, "h", "left")
            held = held | F.coalesce(F.col(f"in{i}"), F.lit(False))
        name = self._write(firsts.select("h", "owner", "last", "n", held.alias("held")))
        self.levels[0].append(name)
        return (self.spark.table(name).filter("held or owner < last")
                .select("h", F.when(~F.col("held"), F.col("owner")).alias("keep"), "n"))

    def compact(self) -> None:
        """Merge every level that has gathered ``fanout`` runs into one run of the next."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fanout:
                continue
            parts = [self.spark.table(n).filter(~F.col("held")) for n in self.levels[k]]
            both = parts[0]
            for part in parts[1:]:
                both = both.unionByName(part)
            merged = self._write(both.repartition(self.buckets, "h"))
            self.levels[k] = []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(merged)


def _order(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("bigint"), F.lit(LAST))


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids at which the batches part; a few numbers."""
    cuts = [i / batches for i in range(1, batches)]
    if not cuts:
        return []
    found = docs.agg(F.percentile_approx("d", cuts, 1000).alias("q")).first()["q"]
    return sorted({int(x) for x in found or []})


def _losing(lines: DataFrame, lost: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose hash is lost; the hottest hashes never meet in one task."""
    hot = (lost.filter(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "h").limit(HOT_LINES).select("h", "keep"))
    hot = F.broadcast(write_and_read(hot, "hot-lines"))  # at most HOT_LINES rows of 24 bytes
    rest = lines.join(hot, "h", "left_anti").join(lost.join(hot, "h", "left_anti").select("h", "keep"), "h")
    return lines.join(hot, "h").unionByName(rest).filter("keep is null or d <> keep").select("d", "r", "h")


def doomed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES,
                 fanout: int = FANOUT, runs: Runs | None = None) -> DataFrame:
    """(d, r, h): the keys whose lines go, by document d and row r (a hash of the text).

    ``runs`` of earlier documents, all of smaller ids, are taken into account and added to.
    """
    narrow = docs.select(_order(docs).alias("d"), _row(docs).alias("r"), docs["text"].cast("string").alias("text"))
    mine = Runs(docs.sparkSession, fanout) if runs is None else runs
    cuts, found = _bounds(narrow.select("d"), batches), []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = narrow
        if low is not None:
            part = part.filter(F.col("d") > low)
        if high is not None:
            part = part.filter(F.col("d") <= high)
        lines = write_and_read(line_hashes(part, min_chars), "lines")
        found.append(_losing(lines, mine.add(lines)))
        if high is not None or runs is not None:
            mine.compact()
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    if runs is None:
        mine.close()
    return out


def _row(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def kept_text(text: bytes | None, doomed: set[bytes], min_chars: int) -> tuple[bytes, int, int]:
    lines = (text or b"").split(b"\n")
    if not doomed:
        return text or b"", len(lines), 0
    left = [x for x in lines if key_of(x, min_chars) not in doomed]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES,
               fanout: int = FANOUT, runs: Runs | None = None) -> DataFrame:
    """All columns of ``docs`` with the kept text, then n_lines and n_dropped.

    The two counts get an underscore more for every column of that name in ``docs``. With
    ``runs`` lines that earlier documents hold go as well, and the runs take in these.
    """
    at, row, doomed, n_lines, n_dropped = fresh(docs.columns, "d", "r", "doomed", "n_lines", "n_dropped")
    # By document and text: a list is never longer than one text has lines.
    lost = (doomed_lines(docs, min_chars, batches, fanout, runs)
            .groupBy(F.col("d").alias(at), F.col("r").alias(row)).agg(F.collect_set("h").alias(doomed)))
    joined = (docs.withColumns({at: _order(docs), row: _row(docs)}).join(lost, [at, row], "left")
              .select(*docs.columns, doomed))
    text_at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()),
                           T.StructField(n_dropped, T.LongType())])

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_in:
            texts, gone = texts_of(batch.column(text_at)), batch.column(batch.num_columns - 1)
            rows = [kept_text(t, set(g or ()), min_chars) for t, g in zip(texts, gone.to_pylist())]
            columns = list(batch.columns[:-1])
            new = pa.array([r[0] for r in rows], pa.binary()).cast(pa.string())
            columns[text_at] = pc.if_else(pa.array([r[2] > 0 for r in rows], pa.bool_()),
                                                  new, columns[text_at].cast(pa.string()))
            columns += [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return over_batches(joined, run, schema)


def brute_force(rows: list[tuple[int, str | None]], min_chars: int = MIN_CHARS) -> list[tuple]:
    """The rule itself over a list of (doc_id, text): for tests."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(
        {i: i + 32 for i in range(65, 91)})
    owners: dict[str, set[int]] = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            owners.setdefault(key(line), set()).add(LAST if d is None else d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(key(x)) < min_chars or min(owners[key(x)]) == (LAST if d is None else d)]
        out.append((d, len(lines), len(lines) - len(left),
                    hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out
