"""As-of joins and gap-filled turns that are kept up to date, against plain loops and full fills."""

import random

import pytest
from pyspark.sql import functions as F

from meterline.operators.asof import asof_join
from meterline.operators.attribution import Topology, gap_fill
from meterline.plans.filled import FilledTurns


def sides(spark, n, m, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", "c", None])
    at = lambda: rng.choice([None, *range(40)])
    facts = [(i, key(), at(), f"row {i}") for i in range(n)]
    versions = [(key() if i % 5 else "other", at(), rng.choice([None, 1, 2, 3]), f"v{i % 4}") for i in range(m)]
    return (facts, versions, spark.createDataFrame(facts, "id bigint, k string, at bigint, version string"),
            spark.createDataFrame(versions, "key string, since bigint, price bigint, note string"))


def plain(facts, versions, forward, strict):
    out = []
    for i, k, at, text in facts:
        fits = [] if k is None or at is None else [
            (s, -1 if p is None else p, n) for key, s, p, n in versions if key == k and s is not None
            and ((s > at if strict else s >= at) if forward else (s < at if strict else s <= at))]
        got = (min if forward else max)(fits, default=None)
        out.append((i, k, at, text, *((None, None) if got is None else (None if got[1] < 0 else got[1], got[2]))))
    return out


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_matches_a_plain_loop(spark, forward, strict):
    facts, versions, left, right = sides(spark, 120, 60, 1)
    take = {"price": "price", "note": "note"}
    want = sorted(plain(facts, versions, forward, strict))
    for rows in (10**6, 20):  # whole keys, then hot keys in chunks
        got = asof_join(left, right, {"k": "key"}, "at", "since", take, forward, strict, chunk_rows=rows)
        assert got.columns == ["id", "k", "at", "version", "price", "note"]
        assert sorted(tuple(r) for r in got.collect()) == want
    inner = asof_join(left, right, {"k": "key"}, "at", "since", take, forward, strict, "inner")
    assert inner.count() == sum(r[5] is not None for r in want)


def test_asof_of_empty_sides(spark):
    _, _, left, right = sides(spark, 20, 10, 2)
    args = ({"k": "key"}, "at", "since", {"note": "note"})
    assert asof_join(left, right.limit(0), *args).filter("note is null").count() == 20
    assert asof_join(left.limit(0), right, *args).count() == 0
    with pytest.raises(ValueError):
        asof_join(left, right, *args, how="right")


TOPOLOGY = Topology({"code_roots": ["/c"], "incidental_repos": ["scratch"]})


def some_turns(n, seed, days, sessions):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = None if rng.random() < 0.03 else 1_700_000_000 + rng.randrange(days) * 86_400 + rng.randrange(400)
        rows.append((rng.choice(sessions), at, seed * 10_000 + i, rng.choice([None, None, "", "r", "q", "scratch"]),
                     rng.choice([[], [], ["api"], ["ci", "x"]]), rng.choice([None, None, None, "kept", ""])))
    return rows


def as_turns(spark, rows):
    frame = spark.createDataFrame(rows, "session string, at bigint, seq bigint, repo string, surfaces array<string>, surface string")
    return frame.withColumn("ts", F.timestamp_seconds("at")).drop("at")


def told(frame):
    cells = frame.select("session", "seq", "repo", "surface", "inferred", "surfaces").collect()
    return sorted((repr(r[0]), *r[1:5], list(r[5])) for r in ((*c[:2], repr(c[2]), repr(c[3]), c[4], c[5]) for c in cells))


@pytest.mark.parametrize("chunk_rows", [10**6, 40])
def test_ingests_equal_the_full_fill(spark, tmp_path, chunk_rows):
    store = FilledTurns(spark, str(tmp_path / "filled"), TOPOLOGY, 4, chunk_rows)
    parts = [some_turns(120, 1, 6, ["a", "b", "", None]), some_turns(25, 2, 6, ["a", "b", None]),
             some_turns(8, 3, 9, ["a", "new"])]
    for n, part in enumerate(parts, 1):
        assert store.fold(as_turns(spark, part), n) >= len(part)
        whole = [r for p in parts[:n] for r in p]
        assert told(store.rows()) == told(gap_fill(as_turns(spark, whole), TOPOLOGY))
    assert store.fold(as_turns(spark, parts[2]), 3) == 0  # finished before
    assert store.fold(as_turns(spark, parts[2]).limit(0), 4) == 0
    want = told(store.rows())
    store.compact(5)
    assert store._numbers("rows") == [5] and told(store.rows()) == want
    more = some_turns(5, 6, 6, ["b"])
    store.fold(as_turns(spark, more), 6)
    assert told(store.rows()) == told(gap_fill(as_turns(spark, [r for p in parts for r in p] + more), TOPOLOGY))


def test_only_touched_segments_are_written(spark, tmp_path):
    """One session of 40 days, whose every day begins with an anchor."""
    rows = [("s", 1_700_006_400 + d * 86_400 + i, d * 100 + i, "r" if i == 0 else None, ["api"] if i == 0 else [], None)
            for d in range(40) for i in range(10)]
    store = FilledTurns(spark, str(tmp_path / "filled"), TOPOLOGY)
    assert store.fold(as_turns(spark, rows), 1) == 400
    late = [("s", 1_700_006_400 + 7 * 86_400 + 20, 10_000, None, [], None)]
    assert store.fold(as_turns(spark, late), 2) == 11  # that day only
    assert told(store.rows()) == told(gap_fill(as_turns(spark, rows + late), TOPOLOGY))
