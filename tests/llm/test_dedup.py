import random

import numpy as np
import pytest
from helpers import classes, near_copy, odd_docs, sentence, shingle_set, vocabulary
from pyspark.sql import functions as F

from meterline.llm import components, line_dedup, near_dedup
from meterline.llm.texts import words

VOCAB = vocabulary(2_000)


def lines_of(spark, docs, **options):
    out = line_dedup.drop_lines(docs, **options)
    return sorted(map(tuple, out.select("doc_id", out.columns[-2], out.columns[-1],
                                        F.sha2(F.coalesce("text", F.lit("")), 256)).collect()), key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2)])
def test_lines_match_the_rule(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [sentence(rng, VOCAB, 6) for _ in range(40)] + ["short", "Été " * 3, "x" * 9, "  Padded line here\t"]
    texts = [(100 + i, "\n".join(rng.choice(pool) for _ in range(8))) for i in range(60)]
    docs, rows = odd_docs(spark, texts)
    assert lines_of(spark, docs, batches=batches, fanout=fanout) == sorted(line_dedup.brute_force(rows), key=repr)


def test_lines_keep_all_columns_and_empty_tables(spark):
    docs, rows = odd_docs(spark)
    out = line_dedup.drop_lines(docs)
    assert out.columns[:len(docs.columns)] == docs.columns and out.count() == len(rows)
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


def test_runs_are_compacted_by_level(spark):
    runs = line_dedup.Runs(spark, fanout=2)
    for i in range(5):
        lines = spark.createDataFrame([(i, bytes([i])), (i, b"same")], "d bigint, h binary")
        lost = {bytes(r["h"]): r["keep"] for r in runs.add(lines).collect()}
        assert lost == ({b"same": None} if i else {})
        runs.compact()
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    runs.close()


def test_default_call_compacts_and_leaves_no_tables(spark, monkeypatch):
    made, compact = [], line_dedup.Runs.compact

    def noted(runs):
        compact(runs)
        made.append([len(level) for level in runs.levels])

    monkeypatch.setattr(line_dedup.Runs, "compact", noted)
    docs = spark.createDataFrame([(i, f"line number {i % 7} of the text") for i in range(100)], "doc_id bigint, text string")
    assert line_dedup.drop_lines(docs).filter("n_dropped = 0").count() == 7
    assert made[-1] == [1, 1]  # a merged run above level 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_hot_lines_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 20)
    monkeypatch.setattr(line_dedup, "HOT_LINES", 2)
    rng = random.Random(5)
    pool = [sentence(rng, VOCAB, 6) for _ in range(12)]
    texts = [(i, "\n".join([pool[0], *rng.sample(pool, 3)])) for i in range(90)] + [(90 + i, pool[i]) for i in range(5)]
    docs, rows = odd_docs(spark, texts)
    assert lines_of(spark, docs) == sorted(line_dedup.brute_force(rows), key=repr)


def test_runs_are_opened_again_by_a_later_job(spark, tmp_path):
    rng = random.Random(6)
    pool = [sentence(rng, VOCAB, 5) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(4))) for i in range(90)]
    folder, got = str(tmp_path / "runs"), []
    runs = line_dedup.Runs(spark, folder=folder)
    for n in range(3):
        docs = spark.createDataFrame(rows[30 * n:30 * n + 30], "doc_id bigint, text string")
        got += lines_of(spark, docs, batches=2, runs=runs)
        runs.save(f"{folder}/list-{n}")
        runs.close()
        runs = line_dedup.Runs.reopen(spark, folder, f"{folder}/list-{n}")
    assert sum(map(len, runs.levels)) < 6 and len(runs.levels) > 1
    runs.close()
    assert sorted(got, key=repr) == sorted(line_dedup.brute_force(rows), key=repr)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (1, 0)],
                                  "a bigint, b bigint")
    roots = {r["v"]: r["root"] for r in components.components(links).collect()}
    assert roots == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}
    assert components.components(links.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(3)
    a = sentence(rng, VOCAB, 900)
    for edits in (10, 40, 120):
        b = near_copy(rng, a, VOCAB, edits)
        sets = [(np.unique(near_dedup.shingles(words(t.encode()))), None) for t in (a, b)]
        drawn = near_dedup.signatures([(s, np.ones(len(s))) for s, _ in sets], 512)
        x, y = shingle_set(a), shingle_set(b)
        assert abs((drawn[0] == drawn[1]).mean() - len(x & y) / len(x | y)) < 0.09


def test_signature_prefers_heavy_shingles():
    s = np.arange(1, 11, dtype=np.uint64)
    weights = np.ones(10)
    weights[3] = 9
    drawn = near_dedup.signatures([(s, weights)], 4_000)[0]
    assert abs((drawn == 4).mean() - 0.5) < 0.05


@pytest.fixture(scope="module")
def copies():
    """Exact copies, a large group of near copies that are less like each other than like
    their source, a chain, and clean texts."""
    rng = random.Random(11)
    base = sentence(rng, VOCAB, 200)
    texts = [sentence(rng, VOCAB, rng.randint(3, 120)) for _ in range(80)]
    texts += [base] * 30 + [near_copy(rng, base, VOCAB, rng.randint(1, 6)) for _ in range(150)]
    link = sentence(rng, VOCAB, 300)
    for _ in range(8):
        link = near_copy(rng, link, VOCAB, 5)
        texts.append(link)
    texts += ["one two", "One, two!", "three"]
    rng.shuffle(texts)
    return texts


def test_near_copies_match_all_pairs(spark, copies):
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert [got[i] for i in range(len(copies))] == classes(copies)


def test_one_of_each_keeps_the_smallest_id(spark, copies):
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id bigint, text string").repartition(5)
    kept = sorted(r["doc_id"] for r in near_dedup.one_of_each(docs).collect())
    assert kept == sorted(set(classes(copies)))


def test_odd_rows(spark):
    docs, rows = odd_docs(spark)
    out = near_dedup.classes(docs).collect()
    assert len(out) == len(rows)
    sizes = sorted((r["doc_id"] or 0, r["class_size"]) for r in out)
    # a text, its repeat and one without id; the long text twice; "x" twice
    assert sizes.count((1, 3)) == 1 and sizes.count((6, 2)) == 2 and sizes.count((8, 2)) == 2
    assert {r["class_id"] for r in out if r["doc_id"] in (1, 7)} == {1}
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] or 0) for r in kept.collect())
    assert ids == [0, 0, 1, 2, 3, 4, 5, 6, 8, 8, 9]
    assert near_dedup.one_of_each(docs.limit(0)).count() == 0


def test_near_copies_with_often_repeated_lines_match_all_pairs(spark):
    rng, texts = random.Random(17), []
    for i in range(60):
        footer = "\n" + sentence(rng, VOCAB, 8)
        body = sentence(rng, VOCAB, 52)
        # one of two texts is a little longer and repeats its footer often; or both have the same shingles
        texts += [body + footer * 2, body + " " + sentence(rng, VOCAB, 4 * (i % 3 > 0)) + footer * (20, 200, 2000)[i % 3]]
        block = "\n" + sentence(rng, VOCAB, 90)
        long = sentence(rng, VOCAB, 400)
        texts += [long + block, long + " " + sentence(rng, VOCAB, 60) + block * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    want = classes(texts)
    assert len(set(want)) == 120
    assert [got[i] for i in range(len(texts))] == want


def test_a_hub_of_no_other_first_pair_keeps_its_links(spark):
    """The middle of three is alike to both others, which are hardly alike: often they share no bucket."""
    rng, texts = random.Random(8), []
    for i in range(400):
        middle = [f"w{i}x{rng.randrange(10**6)}" for _ in range(200)]
        texts += [(3 * i, " ".join(middle[38:])), (3 * i + 1, " ".join(middle)), (3 * i + 2, " ".join(middle[:-38]))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7)
    found = near_dedup.classes(docs).groupBy("class_id").count().collect()
    assert sorted(map(tuple, found)) == [(3 * i, 3) for i in range(400)]


def test_a_bucket_of_many_components_is_linked_by_few_pairs(spark):
    # 40 sets with 79 or 80 of 81 shingles, each its own component, and one set a little too far from all.
    sets = [(v, [s for s in range(81) if s != v]) for v in range(40)] + [(40, [*range(41, 81), *range(100, 124)])]
    sets = spark.createDataFrame(sets, "v bigint, shingles array<bigint>")
    vertices = sets.select("v")
    buckets = vertices.select(F.lit(7).cast("bigint").alias("bucket"), "v", F.lit(0).cast("bigint").alias("hub"),
                              F.lit(41).cast("bigint").alias("n"))
    roots = spark.createDataFrame([], "v bigint, root bigint")
    links = near_dedup._rest(buckets, roots, vertices, sets, F.array(F.lit(7).cast("bigint")), 0.8)
    assert links.count() < 40
    assert {(r["v"], r["root"]) for r in components.components(links).collect()} == {(v, 0) for v in range(40)}
