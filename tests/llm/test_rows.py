"""Operators that work on one text at a time, the queries beside their SQL, the pipeline."""

import random
import re
import sys

import duckdb
import pytest
from helpers import classes, odd_docs, sentence, vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from meterline.cluster import write_and_read
from meterline.llm import line_dedup, repetition, token_trees
from meterline.llm.queries import ORACLES, QUERIES
from verification.check import TABLES, compare

SF = "/root/testdata/sf0.001"
COUNT = token_trees.counter()
SPACE = " \t\n\x0b\x0c\r"


def plain_measure(text):
    ws = [w for w in re.split(f"[{SPACE}]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]

    def covered(n):
        grams = [tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)]
        return {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + n)}
    return (len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered(3)), {n: sum(len(ws[p]) for p in covered(n)) for n in (5, 7)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "bb", "#", "x&y", "\n", "\t", " ", "\x0b", "ß ", "a b c a b c"]), max_size=60))
def test_repetition_measures(parts):
    text = " ".join(parts)
    got = repetition.measure(text.encode(), (5, 7))
    assert (*got[:5], got[7]) == plain_measure(text)


def test_repetition_odd_rows(spark):
    docs, rows = odd_docs(spark, [(80, "same line here again\n" * 40)])
    out = repetition.judge(repetition.repetition(docs)).collect()
    assert len(out) == len(rows)
    kept = [r["doc_id"] for r in out if r["kept"]]
    assert sorted(x or 0 for x in kept) == [0, 1, 5, 6, 6, 7]
    assert repetition.repetition(docs.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é1' \n\t.😀"), max_size=120),
       st.lists(st.tuples(st.integers(0, 120), st.integers(0, 9), st.text(alphabet="xy 's\n", max_size=5)), max_size=6),
       st.integers(1, 12))
def test_edits_recount_like_the_whole_text(text, raw, leaf):
    ends = token_trees.leaf_ends(text, leaf)
    tree = token_trees.sums([COUNT(text[a:b]) for a, b in zip([0, *ends], ends)])
    assert token_trees.total(tree) == COUNT(text)
    edits = [(a, a + n, new) for a, n, new in raw]
    after, new_ends, new_tree, taken, _ = token_trees.apply_edits(text, ends, tree, edits, COUNT)
    want, at, last = [], 0, 0
    for a, b, new in sorted(edits):
        if b <= len(text) and a >= last:
            want += [text[at:a], new]
            at = last = b
    assert after == "".join(want) + text[at:]
    assert token_trees.total(new_tree) == COUNT(after)
    # the new tree can be edited again
    again = token_trees.apply_edits(after, new_ends, new_tree, [(0, min(1, len(after)), "q ")], COUNT)
    assert token_trees.total(again[2]) == COUNT(again[0])


def test_few_leaves_are_encoded(spark):
    text = sentence(random.Random(1), vocabulary(200), 3_000) + " mail me@example.org now"
    docs, rows = odd_docs(spark, [(90, text), (91, " " * 20_000), (92, "x" * 20_000)])
    out = {r["doc_id"]: r for r in token_trees.recount(token_trees.build(docs), token_trees.redactions).collect()}
    assert out[90]["n_leaves"] > 10 and out[90]["leaves_encoded"] == 1 and out[90]["n_edits"] == 1
    assert out[90]["n_tokens_after"] == COUNT(text.replace("me@example.org", "<email>"))
    assert out[91]["n_tokens"] == COUNT(" " * 20_000) and out[2]["n_tokens"] == 0
    assert token_trees.build(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    text, _, ok = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, text


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = write_and_read(stage(spark, docs, SF), "stage")
        after = docs.collect()
        if name == "toxicity":
            scores = {r["doc_id"]: r["score"] for r in QUERIES["op3_toxicity"](spark, SF).collect()}
            assert sorted(r["doc_id"] for r in after) == sorted(d for d, s in scores.items() if s < 0.5)
        elif name == "line_dedup":
            want = {d: (n, gone) for d, n, gone, _ in line_dedup.brute_force([(r["doc_id"], r["text"]) for r in before])}
            texts = {r["doc_id"]: r for r in after}
            assert len(after) == len(before)
            for r in before:
                new = texts[r["doc_id"]]
                assert len(new["text"]) == new["n_chars"] or not want[r["doc_id"]][1]
                assert (new["text"] == r["text"]) == (not want[r["doc_id"]][1])
        elif name == "near_dedup":
            rows = sorted(before, key=lambda r: r["doc_id"])
            best = classes([r["text"] for r in rows])
            assert sorted(r["doc_id"] for r in after) == sorted({rows[i]["doc_id"] for i in best})
        elif name == "decontamination":
            assert 0 < len(after) < len(before)
        if name != "mixing":
            assert docs.columns == columns
    assert all(r["copies"] > 0 for r in after) and "rate" in docs.columns


def test_stages_take_odd_rows(spark):
    docs, rows = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
        assert 0 < out.count() <= len(rows)
    assert sys.modules["corpus_pipeline"].ORACLE_SQL is None
