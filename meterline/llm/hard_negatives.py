"""Hard negatives by slot-decomposed selection over blocks of exact integer scores.

An anchor's positives set windows of scores in which its negatives must lie. The windows
overlap, but their upper limits cut the scores into disjoint slots: slot 0 lies between the
largest limit and the next one, and so on down. A task keeps the best ``k`` negatives of every
(anchor, slot) that it sees, as does every combine after it; nothing else is shuffled. The
best ``k`` below a limit are then the best ``k`` of its slot followed by those of the slots
beneath, so one pass down the slots answers all windows of an anchor.

Anchors are a stated set of rows against all rows. Both sides are dealt out by hash to cells
(anchor block, row block), one task each: rows are copied once per anchor block, anchors once
per row block, with as many blocks of each as keep both copies small. A task holds one anchor
block and streams the rows past it, so no label, however common, is gathered anywhere, and
its work is the same at any size.

Defined results. Rows with a null label, a null vector or any null or non-finite component
take no part. A component x becomes floor(256 * x), x as double. Vectors of different lengths
are compared as if the shorter one went on with zeros; an empty vector scores 0. Scores beyond
2**55 in size count as 2**55. A higher score comes first, then the smaller id; rows without an
id come last and are never anchors. Repeated rows are rows of their own: each is another
anchor, positive or negative. An anchor without positives, or without a negative in a window,
gives no row. An empty table gives an empty table. Only the id, label and vector columns are
read, so further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterline.cluster import write_and_read
from meterline.llm.texts import over_batches

SCALE = 256
LIMIT = 1 << 55          # scores are cut to +-LIMIT: times 100 they still fit into 64 bits
ANCHORS = 8192           # anchors of one block, held by one task
PAIRS = 1 << 33          # pairs that one task scores
BATCH = 1024
NO_ID, NOTHING = np.iinfo(np.int64).max, -(1 << 62)


def prepared(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label",
             vector: str = "embedding") -> DataFrame:
    """(rid, vec_id, label, anchor, q, wide): usable rows with whole-number components.

    ``q`` holds 16-bit numbers, or 64-bit floats where ``wide``. ``rid`` tells rows apart.
    """
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(False)))
    narrow = usable.select(
        F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(4)
            at = np.asarray(v.offsets)
            whole = np.floor(SCALE * v.values.to_numpy(zero_copy_only=False))
            q, wide = [], []
            for a, b in zip(at[:-1], at[1:]):
                part = whole[a:b]
                wide.append(bool(len(part)) and bool(np.abs(part).max() >= 1 << 15))
                q.append((part if wide[-1] else part.astype("<i2")).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(q, pa.binary()), pa.array(wide, pa.bool_())],
                                             names=["rid", "vec_id", "label", "anchor", "q", "wide"])
    return write_and_read(over_batches(
        narrow, run, "rid bigint, vec_id bigint, label bigint, anchor boolean, q binary, wide boolean"), "vectors")


def _matrix(q: pa.Array, wide: np.ndarray) -> np.ndarray:
    """Rows of whole numbers, short ones filled up with zeros."""
    raw = q.to_pylist()
    kinds = np.where(wide, "<f8", "<i2")
    sizes = np.array([len(r) for r in raw]) // np.where(wide, 8, 2)
    if len(raw) and not wide.any() and (sizes == sizes[0]).all():
        return np.frombuffer(b"".join(raw), "<i2").reshape(len(raw), sizes[0]).astype(np.float32)
    out = np.zeros((len(raw), sizes.max(initial=0)))
    for row, data, kind, n in zip(out, raw, kinds, sizes):
        row[:n] = np.frombuffer(data, kind)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``, cut to +-LIMIT."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * n
    if most < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    wide = a.astype(np.longdouble) @ b.astype(np.longdouble).T
    return np.clip(wide, -LIMIT, LIMIT).astype(np.int64)


class Tops:
    """The best ``k`` (score, id) of every group seen so far: high scores, then small ids."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.score = np.full((groups, k), NOTHING)
        self.vec = np.full((groups, k), NO_ID)

    @property
    def least(self) -> np.ndarray:
        """A score below this cannot enter the group."""
        return self.score[:, -1]

    def offer(self, group: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        if not len(group):
            return
        touched = np.unique(group)
        group = np.concatenate([group, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        vec = np.concatenate([vec, self.vec[touched].ravel()])
        order = np.lexsort((vec, -score, group))
        group, score, vec = group[order], score[order], vec[order]
        start = np.searchsorted(group, group)
        rank = np.arange(len(group)) - start
        kept = rank < self.k
        self.score[group[kept], rank[kept]] = score[kept]
        self.vec[group[kept], rank[kept]] = vec[kept]


class _Positives:
    """Best rows of the anchor's own label."""

    def __init__(self, anchors: list[pa.RecordBatch], k: int):
        self.rid, self.label, self.m = _columns(anchors)
        self.by_label = {x: np.flatnonzero(self.label == x) for x in np.unique(self.label)}
        self.tops = Tops(len(self.rid), k)

    def see(self, rid, label, vec, m) -> None:
        for x in np.unique(label):
            mine = self.by_label.get(x)
            if mine is None:
                continue
            rows = np.flatnonzero(label == x)
            s = products(self.m[mine], m[rows])
            i, j = np.nonzero(s >= self.tops.least[mine][:, None].astype(s.dtype))
            other = self.rid[mine[i]] != rid[rows[j]]
            i, j = i[other], j[other]
            self.tops.offer(mine[i], s[i, j].astype(np.int64), vec[rows[j]])

    def out(self):
        a, r = np.nonzero(self.tops.score > NOTHING)
        return self.rid[a], np.zeros(len(a), np.int32), self.tops.score[a, r], self.tops.vec[a, r]


class _Negatives:
    """Best rows of other labels, per slot of the anchor's score limits."""

    def __init__(self, anchors: list[pa.RecordBatch], k: int):
        self.rid, self.label, self.m = _columns(anchors)
        limits = [u for b in anchors for u in b.column("uppers").to_pylist()]
        self.slots = max(map(len, limits), default=1)
        self.upper = np.full((len(limits), self.slots), NOTHING)
        for row, u in zip(self.upper, limits):
            row[:len(u)] = u
        self.floor = np.concatenate([np.asarray(b.column("floor")) for b in anchors])
        self.tops = Tops(len(limits) * self.slots, k)

    def see(self, rid, label, vec, m) -> None:
        s = products(self.m, m)
        inside = (s >= self.floor[:, None].astype(s.dtype)) & (s <= self.upper[:, :1].astype(s.dtype))
        i, j = np.nonzero(inside & (self.label[:, None] != label[None, :]))
        score = s[i, j].astype(np.int64)
        group = i * self.slots + (self.upper[i] >= score[:, None]).sum(axis=1) - 1
        good = score >= self.tops.least[group]
        self.tops.offer(group[good], score[good], vec[j[good]])

    def out(self):
        g, r = np.nonzero(self.tops.score > NOTHING)
        return self.rid[g // self.slots], (g % self.slots).astype(np.int32), self.tops.score[g, r], self.tops.vec[g, r]


def _columns(anchors: list[pa.RecordBatch]):
    ms = [_matrix(b.column("q"), np.asarray(b.column("wide"))) for b in anchors]
    width = max(m.shape[1] for m in ms)
    ms = [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in ms]
    return (np.concatenate([np.asarray(b.column("rid")) for b in anchors]),
            np.concatenate([np.asarray(b.column("label")) for b in anchors]), np.concatenate(ms))


def _cells(anchors: DataFrame, rows: DataFrame, kind, k: int, blocks: tuple[int, int]) -> DataFrame:
    """(rid, slot, score, vec_id): each cell's best rows of its anchors.

    ``anchors`` may have ``uppers`` and ``floor``. A cell's anchors come first, then its rows.
    """
    of_anchors, of_rows = blocks
    limits = [F.col(c) if c in anchors.columns else F.lit(None).cast(t).alias(c)
              for c, t in (("uppers", "array<bigint>"), ("floor", "bigint"))]
    place = lambda of: F.pmod(F.xxhash64("rid"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    own = ["rid", "vec_id", "label", "q", "wide"]
    left = anchors.select(*own, *limits, place(of_anchors).alias("a"), every(of_rows).alias("r"), F.lit(0).alias("side"))
    right = rows.select(*own, F.lit(None).cast("array<bigint>").alias("uppers"), F.lit(None).cast("bigint").alias("floor"),
                        place(of_rows).alias("r"), F.lit(1).alias("side"), every(of_anchors).alias("a"))
    cell = (F.col("a") * of_rows + F.col("r")).alias("cell")
    both = left.unionByName(right).select(cell, "side", *own, "uppers", "floor")
    dealt = both.repartitionById(of_anchors * of_rows, F.col("cell")).sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, job = None, [], None

        def finished():
            if job is not None:
                rid, slot, score, vec = job.out()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), pa.array(slot, pa.int32()), pa.array(score),
                     pa.array(vec, pa.int64(), mask=vec == NO_ID)], names=["rid", "slot", "score", "vec_id"])

        for batch in batches:
            mark = np.asarray(batch.column("cell")).astype(np.int64) * 2 + np.asarray(batch.column("side"))
            cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1), len(mark)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                part, at = batch.slice(lo, hi - lo), mark[lo] // 2
                if at != now:
                    yield from finished()
                    now, waiting, job = at, [], None
                if mark[lo] % 2 == 0:
                    waiting.append(part)
                elif waiting:
                    job = job or kind(waiting, k)
                    vec = part.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                    job.see(np.asarray(part.column("rid")), np.asarray(part.column("label")), vec,
                            _matrix(part.column("q"), np.asarray(part.column("wide"))))
        yield from finished()

    return over_batches(dealt, run, "rid bigint, slot int, score bigint, vec_id bigint", BATCH)


def _best(partial: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` of every key, with their rank; tasks cut to ``k`` before the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks_of(n_anchors: int, n_rows: int, tasks: int) -> tuple[int, int]:
    """How many blocks of anchors and of rows: enough for all tasks, with few copies of both."""
    cells = max(tasks, math.ceil(n_anchors * n_rows / PAIRS))
    of_anchors = max(1, math.ceil(n_anchors / ANCHORS), round(math.sqrt(cells * n_anchors / max(1, n_rows))))
    return of_anchors, max(1, math.ceil(cells / of_anchors))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3,
         window: tuple[int, int] = (50, 95), **columns: str) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` picks the anchors among the rows. A negative's score must lie between the two
    percentages of its positive's score; ``columns`` names the id, label and vector columns.
    """
    low, high = window
    rows = prepared(rows, is_anchor, **columns)
    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if(F.col("anchor") & F.col("vec_id").isNotNull())).first()
    blocks = blocks_of(n_anchors, n_rows, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    anchors = rows.filter(F.col("anchor") & F.col("vec_id").isNotNull())

    found = _best(_cells(anchors, rows, _Positives, positives, blocks), ["rid"], positives)
    limit = lambda p, up: F.expr(  # noqa: E731 - whole-number floor or ceiling of p% of the score
        f"({p}L * score - pmod({p}L * score, 100L)) div 100L" if not up else
        f"({p}L * score + pmod(-{p}L * score, 100L)) div 100L")
    windows = write_and_read(found.select(
        "rid", F.col("rank").alias("p_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        limit(low, True).alias("lower"), limit(high, False).alias("upper")).filter("lower <= upper"), "windows")
    limits = windows.groupBy("rid").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("floor"))
    limited = write_and_read(anchors.join(limits, "rid"), "anchors")

    slots = _best(_cells(limited, rows, _Negatives, negatives, blocks), ["rid", "slot"], negatives)
    # At most one list of ``negatives`` rows for each positive of an anchor.
    tops = slots.groupBy("rid").agg(F.sort_array(F.collect_list(
        F.struct("slot", "rank", "vec_id", "score"))).alias("tops"))
    asked = windows.join(limited.select("rid", F.col("vec_id").alias("anchor_id"), "uppers"), "rid").join(tops, "rid")
    own = F.array_position("uppers", F.col("upper")) - 1
    suffix = F.slice(F.filter("tops", lambda x: x["slot"] >= own), 1, negatives)
    chosen = F.filter(suffix, lambda x: x["score"] >= F.col("lower"))
    return asked.select("anchor_id", "positive_id", "positive_score", F.posexplode(chosen).alias("at", "n")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"),
        "positive_score", F.col("n.score").alias("negative_score"))
