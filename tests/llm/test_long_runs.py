"""Texts without blanks: long letter runs in language fit and redaction; an empty rule list."""

import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meterline.llm import language_id, token_trees, url_filter

OLD_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+ é_", max_size=30))
def test_mails_are_those_of_the_plain_pattern(text):
    assert [(a, b) for a, b, _ in token_trees._mails(text)] == [m.span() for m in OLD_MAIL.finditer(text)]


def test_a_megabyte_of_letters_and_one_sign():
    start = time.perf_counter()
    assert token_trees.redactions("a" * 1_000_000 + "@") == []
    assert len(token_trees.redactions("a" * 1_000_000 + "@b.c")) == 1
    assert time.perf_counter() - start < 5


def trained(spark, langs):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return docs, language_id.train(docs)


def test_languages_without_blanks(spark):
    rng = random.Random(3)
    kana, han = [chr(c) for c in range(0x3042, 0x3092)], list("的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生")
    make = {"ja": lambda: "".join(rng.choice(kana) for _ in range(80)), "zh": lambda: "".join(rng.choice(han) for _ in range(80)),
            "en": lambda: " ".join(rng.choice(["the", "house", "of", "little", "trees", "was", "white"]) for _ in range(20))}
    docs, model = trained(spark, [(lang, make[lang]()) for _ in range(60) for lang in make])
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_expected_counts_of_long_runs(spark):
    _, model = trained(spark, [(lang, t) for lang, t in (("a", "abab baba abba"), ("b", "xyz yzx zyx")) for _ in range(9)])
    rng = random.Random(1)
    counts = np.array([[2.0, 1.0]])
    short = "".join(rng.choice("abxyz") for _ in range(30))
    was, language_id.UNSCALED = model.expected([short], counts), 0
    try:
        assert np.allclose(model.expected([short], counts), was, rtol=1e-9)
    finally:
        language_id.UNSCALED = 40
    # Letters come back: pieces weighted by their lengths make up the run, here of 5,000 letters.
    long = "".join(rng.choice("abxyz") for _ in range(5_000))
    total = model.expected([long], counts)
    assert np.isfinite(total).all() and total.sum() > 5_000 / model.max_piece
    ten = model.expected(["".join(long[i:i + 40]) for i in range(0, 5_000, 40)], np.repeat(counts, 125, axis=0))
    assert abs(total.sum() / ten.sum() - 1) < 0.1


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None), (3, "no host")], "page_id bigint, url string")
    got = url_filter.judge(pages, [], pages.selectExpr("url", "0.0 as blocked")).collect()
    assert {r["verdict"] for r in got} == {"allow"} and all(r["rule"] is None for r in got) and len(got) == 3
