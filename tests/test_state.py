"""Rows kept by key in buckets: what a batch writes, and batches that are run again."""

import os

from pyspark.sql import functions as F

from meterline.streaming.state import BucketedRows


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k string, n bigint")


def added(before, new):
    return before.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))


def files(path, batch):
    return sum(len([f for f in names if f.endswith(".parquet")])
               for _, _, names in os.walk(f"{path}/rows/batch={batch}"))


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    state = BucketedRows(spark, str(tmp_path / "s"))
    first = {f"k{i}": i for i in range(200)}
    assert len(state.merge(rows(spark, [*first.items(), (None, 5)]), "k", 0, 16, added)) == 16
    assert state.merge(rows(spark, [("k7", 1)]), "k", 1, 16, added) == state.merge(rows(spark, [("k7", 1)]), "k", 1, 16, added)
    assert files(state.path, 0) == 16 and files(state.path, 1) == 1
    want = {**first, "k7": 8, None: 5}
    assert dict(map(tuple, state.rows().collect())) == want
    assert state.merge(rows(spark, [("x", 1)]).limit(0), "k", 2, 16) == []
    # Without ``combine`` the newer row replaces; a bucket that only an older head names goes.
    state.merge(rows(spark, [("k7", 100), (None, 6)]), "k", 3, 16)
    assert dict(map(tuple, state.rows().collect())) == {**want, "k7": 100, None: 6}
    state.merge(rows(spark, [("k7", 101)]), "k", 4, 16)
    assert dict(map(tuple, state.rows().collect())) == {**want, "k7": 101, None: 6}
    assert state._heads() == [3, 4] and files(state.path, 1) == 0
