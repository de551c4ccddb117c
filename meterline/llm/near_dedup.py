"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A text's five-word shingles, weighted by 1 + ln(count), each start a Poisson process whose
rate is the weight; every arrival falls into a random slot, and a slot keeps the shingle
that arrives there first. Two signatures then agree in a slot with the probability Jaccard
similarity of the weighted sets. A shingle stops when its next arrival is later than the
latest first arrival of all slots, so a text costs about as many arrivals as it has shingles
and slots. Links are verified on plain sets, so a text with repeated shingles has a second
signature of equal weights: a few shingles that repeat often fill the weighted one.

From there on Spark does the work. Texts with the same words are one vertex. Both signatures
are cut into bands; in each bucket every vertex is paired with one hub (not with every other),
pairs are verified on whole shingle sets, and verified links make components: first each vertex
with the smallest of its hubs, then with those hubs that are still in another component (a pair
within one component could not add anything). Where a bucket
still holds several components, its outsiders are compared with the bucket block by block:
finer sketches name the pairs that may reach the threshold, each in the first bucket that it
shares, and the whole shingle sets beside them verify it there. A pair whose components the
block has linked already could not add anything, so a block returns fewer links than it has
vertices, and these join the components. No bucket is ever gathered whole and no partner is
capped.

Defined results. Words: A-Z lower-cased runs of digits, letters and non-ASCII. A text of
fewer words than a shingle has one shingle, all its words. A text without words (null,
empty) is alone in its class. Repeated rows and rows with one id and different texts are
separate documents. The class id is the smallest doc_id of the class (null if none has
one). An empty table gives an empty table. Only doc_id and text are read; ``one_of_each``
returns all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.cluster import is_small, scratch_path, write_and_read
from meterline.llm.components import components
from meterline.llm.texts import GOLDEN, fresh, mix, over_batches, texts_of, word_hashes, words

SHINGLE = 5
SIMILARITY = 0.8
SLOTS, BAND_ROWS = 96, 4
BANDS = SLOTS // BAND_ROWS
# Where a bucket is compared block by block: slots of the finer sketch, one byte each, and how
# many standard deviations an estimate may lie below the threshold before a pair is dropped.
FINE, DEVIATIONS = 1024, 4
OUTSIDERS, MEMBERS = 128, 1024  # rows of the two sides of a block
SIDE = 4 << 20  # shingles of a side, where the texts are so long that it has fewer rows


def shingles(found: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all shingles, in order, repeats included."""
    h = word_hashes(found)
    if not len(h):
        return h
    width = min(size, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix(out * np.uint64(0x100000001B3) + h[k:k + len(out)])
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """One row per weighted set (distinct hashes, weights): the first shingle of each slot."""
    sizes = np.array([len(s) for s, _ in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    shingle = np.concatenate([s for s, _ in sets]) if len(sets) else np.zeros(0, np.uint64)
    rate = np.concatenate([w for _, w in sets]) if len(sets) else np.zeros(0)
    first = np.full(len(sets) * slots, np.inf)
    holder = np.zeros(len(sets) * slots, np.uint64)
    single = np.flatnonzero(sizes == 1)  # every slot is theirs: nothing to wait for
    for i in single:
        holder[i * slots:(i + 1) * slots] = sets[i][0][0]
    first.reshape(-1, slots)[single] = 0
    time, seed = np.zeros(len(shingle)), mix(shingle)
    live = np.flatnonzero(sizes[owner] > 1)
    while len(live):
        seed[live] = mix(seed[live] + GOLDEN)
        uniform = ((seed[live] >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
        time[live] -= np.log(uniform) / rate[live]
        slot = owner[live] * slots + (mix(seed[live]) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, slot, time[live])
        won = first[slot] == time[live]
        holder[slot[won]] = shingle[live[won]]
        latest = first.reshape(-1, slots).max(axis=1)
        live = live[time[live] < latest[owner[live]]]
    return holder.reshape(-1, slots)


def sketch(docs: DataFrame, size: int = SHINGLE, slots: int = SLOTS) -> DataFrame:
    """(doc_id, tid, words, sig, plain): md5 of the text, a key of its words, its signatures.

    ``plain`` weighs all shingles alike; it is null where no shingle repeats, as ``sig`` is the
    same then. ``words`` and both signatures are null for a text without words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select("doc_id", F.md5(text).alias("tid"), text.alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("tid", T.StringType()),
                           T.StructField("words", T.BinaryType()),
                           T.StructField("sig", T.ArrayType(T.IntegerType())),
                           T.StructField("plain", T.ArrayType(T.IntegerType()))])

    def drawn(sets: list) -> Iterator[np.ndarray]:
        return iter(mix(signatures(sets, slots)).astype(np.uint32).view(np.int32) if sets else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, again = [], [], []
            for text in texts_of(batch.column(2)):
                found = words(text)
                keys.append(xxhash.xxh3_128_digest(b" ".join(found)) if found else None)
                if found:
                    s, n = np.unique(shingles(found, size), return_counts=True)
                    sets.append((s, 1 + np.log(n)))
                again.append(bool(found) and n.max() > 1)
            sig, plain = drawn(sets), drawn([(s, np.ones(len(s))) for s, w in sets if w.max() > 1])
            rows = [[None if k is None else next(sig) for k in keys], [next(plain) if x else None for x in again]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()),
                 *(pa.array(r, pa.list_(pa.int32())) for r in rows)], names=["doc_id", "tid", "words", "sig", "plain"])

    return over_batches(narrow, run, schema)


def shingle_sets(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(tid, shingles): the distinct shingle hashes of every text of (tid, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(words(t), size)).view(np.int64) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["tid", "shingles"])
    return over_batches(texts, run, "tid string, shingles array<bigint>")


def _bands(bands: int, rows: int) -> Column:
    """The hash of every band of both signatures; equal bands have equal hashes."""
    of = lambda sig: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                                 lambda b: F.xxhash64(b, F.slice(sig, b * rows + 1, rows)))
    return F.concat(of(F.col("sig")), of(F.coalesce("plain", "sig")))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets are similar enough."""
    one = sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(one, "a").join(two, "b")
            .filter(common / (F.size("sa") + F.size("sb") - common) >= similarity).select("a", "b"))


def _sets_of(buckets: DataFrame, vertices: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(v, shingles) of every vertex in a bucket, hubs included, read again from the texts."""
    asked = buckets.select("v").distinct()
    asked = write_and_read(vertices.join(asked, "v", "left_semi").select("v", "tid"), "asked")
    wanted = asked.select("tid")
    if is_small(asked):
        wanted = F.broadcast(wanted)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = (docs.select(F.md5(text).alias("tid"), text.alias("text"))
             .join(wanted, "tid", "left_semi").dropDuplicates(["tid"]))
    return write_and_read(shingle_sets(texts, size).join(asked, "tid").select("v", "shingles"), "shingles")


def _fine(sets: DataFrame) -> DataFrame:
    """(v, fine, own): a sketch of the plain set in ``FINE`` bytes, and the set as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [(np.array(s, np.int64).view(np.uint64), np.ones(len(s))) for s in batch.column(1).to_pylist()]
            drawn = (mix(signatures(every, FINE)) >> np.uint64(56)).astype(np.uint8) if every else ()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in drawn], pa.binary()),
                                              pa.array([s.tobytes() for s, _ in every], pa.binary())],
                                             names=["v", "fine", "own"])
    return over_batches(sets.select("v", "shingles"), run, "v bigint, fine binary, own binary")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links."""
    links = write_and_read(links, "links")
    if links.isEmpty():
        return roots
    edges = roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(links)
    return write_and_read(components(edges), "roots")


def _across(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of a vertex and a hub of its buckets that are in different components."""
    member = buckets.filter("v <> hub").select("v", "hub").join(roots, "v", "left")
    hubs = roots.select(F.col("v").alias("hub"), F.col("root").alias("hub_root"))
    apart = F.coalesce("root", "v") != F.coalesce("hub_root", "hub")
    return member.join(hubs, "hub", "left").filter(apart).select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct()


def _rest(buckets: DataFrame, roots: DataFrame, vertices: DataFrame, sets: DataFrame, bands: Column,
          similarity: float) -> DataFrame:
    """Verified pairs that link the components of a bucket, found block by block.

    ``buckets`` has (bucket, v, hub, n) of buckets with several members.
    """
    sizes = sets.select("v", F.size("shingles").cast("bigint").alias("size"))
    member = (buckets.filter("n > 2").join(roots, "v", "left").join(sizes, "v")
              .select("bucket", "hub", "n", "v", F.coalesce("root", "v").alias("root"), "size"))
    hubs = roots.select(F.col("v").alias("hub"), F.col("root").alias("hub_root"))
    member = write_and_read(member.join(hubs, "hub", "left").withColumn(
        "out", F.col("root") != F.coalesce("hub_root", "hub")), "members")
    out = F.when(F.col("out"), F.col("size"))
    counts = (member.groupBy("bucket").agg(F.count(out).alias("n_out"), F.sum(out).alias("s_out"),
                                            F.count("size").alias("n_all"), F.sum("size").alias("s"))
              .filter("n_out > 0")
              .select("bucket", F.ceil(F.greatest(F.col("n_out") / OUTSIDERS, F.col("s_out") / SIDE)).cast("int").alias("blocks"),
                      F.ceil(F.greatest(F.col("n_all") / MEMBERS, F.col("s") / SIDE)).cast("int").alias("columns")))
    member = write_and_read(member.join(counts, "bucket"), "members")
    open_ = member.select("v").distinct()
    drawn = write_and_read(_fine(sets.join(open_, "v", "left_semi")).join(
        vertices.select("v", bands.alias("bands")), "v"), "fine")
    member = member.join(drawn, "v")
    left = (member.filter("out").withColumn("o", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
            .withColumn("m", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).withColumn("side", F.lit(0)))
    right = (member.withColumn("m", F.pmod(F.xxhash64("v"), F.col("columns")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1)))
    # One in 256 unlike slots agrees by chance.
    expected = similarity + (1 - similarity) / 256
    least = int(FINE * (expected - DEVIATIONS * (expected * (1 - expected) / FINE) ** 0.5))

    def similar(one: np.ndarray, two: np.ndarray) -> bool:
        few, many = sorted((len(one), len(two)))
        if few / many < similarity:
            return False
        common = len(np.intersect1d(one, two, assume_unique=True))
        return common / (few + many - common) >= similarity

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        a, b, found = block[block.side == 0], block[block.side == 1], []
        if len(a) and len(b):
            bucket, vs, roots_ = block.bucket.iat[0], b.v.to_numpy(), b.root.to_numpy()
            fine = np.frombuffer(b"".join(b.fine), np.uint8).reshape(len(b), -1)
            band, last = np.stack(b.bands.to_numpy()), np.iinfo(np.int64).max
            whole = [np.frombuffer(s, np.int64) for s in b.own]
            linked: dict[int, int] = {}  # components that this block has linked to another

            def top(root: int) -> int:
                while root in linked:
                    linked[root] = root = linked.get(linked[root], linked[root])
                return root

            for v, root, mine, sketched, hashes in zip(a.v, a.root, a.own, a.fine, a.bands):
                near = np.flatnonzero(roots_ != root)
                agree = (fine[near] == np.frombuffer(sketched, np.uint8)).sum(axis=1)
                near = near[np.argsort(-agree, kind="stable")][:int((agree >= least).sum())]
                # A pair is verified in the first bucket that both are in, and only there.
                shared = np.where(np.isin(band[near], hashes), band[near], last).min(axis=1)
                mine = np.frombuffer(mine, np.int64)
                for at in near[shared == bucket]:
                    one, two = top(root), top(roots_[at])
                    if one != two and similar(mine, whole[at]):
                        linked[one] = two
                        found.append((v, vs[at]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    names = ["bucket", "o", "m", "side", "v", "root", "fine", "own", "bands"]
    blocks = left.select(*names).unionByName(right.select(*names))
    return (blocks.groupBy("bucket", "o", "m").applyInPandas(compare, "a bigint, b bigint")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def classes(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY,
            slots: int = SLOTS, rows: int = BAND_ROWS) -> DataFrame:
    """Every document (doc_id, tid) with root, class_id and class_size."""
    drawn = write_and_read(sketch(docs, size, slots), "sketch")
    texts = (drawn.filter("words is not null").groupBy("words")
             .agg(F.min("tid").alias("tid"), F.first("sig").alias("sig"), F.first("plain").alias("plain"), F.min("doc_id").alias("doc_id"),
                  F.count(F.lit(1)).alias("n")))
    vertices = write_and_read(texts.withColumn("v", F.monotonically_increasing_id()), "vertices")

    bands = _bands(slots // rows, rows)
    spread = vertices.select(F.explode(F.array_distinct(bands)).alias("bucket"), "v")
    hubs = spread.groupBy("bucket").agg(F.min("v").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = write_and_read(spread.join(hubs, "bucket"), "buckets")
    # One hub of each vertex, the smallest, links most of a class. Its other hubs are asked only
    # where they still lie in another component.
    first = write_and_read(buckets.filter("v <> hub").groupBy(F.col("v").alias("a")).agg(F.min("hub").alias("b")), "pairs")
    # A vertex may be the hub of some buckets only, and the smallest hub of none of their members.
    sets = _sets_of(buckets, vertices, docs, size)
    roots = write_and_read(components(write_and_read(_verified(first, sets, similarity), "links")), "roots")
    roots = _joined(roots, _verified(_across(buckets, roots), sets, similarity))
    roots = _joined(roots, _rest(buckets, roots, vertices, sets, bands, similarity))

    named = (vertices.join(roots, "v", "left")
             .select("words", "doc_id", "n", F.coalesce("root", "v").alias("root")))
    sizes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    named = named.select("words", "root").join(sizes, "root")
    return (drawn.select("doc_id", "tid", "words").join(named, "words", "left")
            .select("doc_id", "tid", "root",
                    F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size")))


def _rank(doc_id: Column, tid: Column) -> Column:
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), tid.alias("tid"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, with one document left of each class.

    It is the one with the smallest doc_id (then md5 of the text); of equal rows one stays.
    """
    many = classes(docs, **options).filter("class_size > 1")
    many = write_and_read(many.select("root", _rank(F.col("doc_id"), F.col("tid")).alias("row")), "copies")
    best = many.groupBy("root").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    marks = (many.groupBy("row", "root").agg(F.count(F.lit(1)).alias("times"))
             .join(best.select("root", F.col("row").alias("best")), "root")
             .filter("row <> best or times > 1")
             .select(F.col("row").alias("mark"), (F.col("row") == F.col("best")).alias("once")))
    path = scratch_path(docs.sparkSession, "marks")
    marks.write.parquet(path)
    marks = docs.sparkSession.read.schema(marks.schema).parquet(path)
    row, mark, once = fresh(docs.columns, "row_rank", "mark", "once")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    flagged = docs.withColumn(row, _rank(docs["doc_id"], F.md5(text))).join(
        marks.select(F.col("mark").alias(mark), F.col("once").alias(once)),
        F.col(row).eqNullSafe(F.col(mark)), "left")
    kept = flagged.filter(F.col(once).isNull()).select(*docs.columns)
    if marks.filter("once").isEmpty():
        return kept
    return kept.unionByName(flagged.filter(F.col(once)).dropDuplicates([row]).select(*docs.columns))
