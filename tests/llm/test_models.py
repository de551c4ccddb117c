import math
import random
import zlib

import numpy as np
import pytest
from helpers import odd_docs, sentence, vocabulary
from pyspark.sql import functions as F

from meterline.llm import language_id, mixing, toxicity, url_filter
from meterline.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def marked():
    """(doc_id, text, toxic): insults and an invented stem mark toxic texts."""
    rng, vocab = random.Random(4), vocabulary(500)
    rows = []
    for i in range(900):
        toxic = int(i % 6 == 0)
        ws = sentence(rng, vocab, rng.randint(20, 90)).split()
        for _ in range(4 * toxic):
            bad = rng.choice(["idiot", "scum", "moron"]) if i % 4 else "zzurk" + rng.choice(vocab)
            ws.insert(rng.randrange(len(ws)), bad)
        rows.append((i, " ".join(ws), toxic))
    return rows


def test_toxicity_held_out(spark, marked):
    docs = spark.createDataFrame([r[:2] for r in marked], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in marked] + [(None, 1), (5, None), (10**9, 1)],
                                   "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [r for r in marked if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 100
    assert sum((got[d] >= 0.5) == bool(y) for d, _, y in held) / len(held) > 0.97
    # held-out labels are not seen: turning them round changes nothing
    other = spark.createDataFrame([(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, _, y in marked],
                                  "doc_id bigint, toxic int")
    again = toxicity.train(docs, other)
    assert again.weights == model.weights and again.bias == model.bias


def test_toxicity_odd_rows(spark, marked):
    docs, rows = odd_docs(spark, [(60, "you are a stupid moron, idiot")])
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert [r["doc_id"] for r in got if r["score"] >= 0.5] == [60]
    kept = toxicity.toxic_free(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert toxicity.toxic_free(docs.limit(0), model).count() == 0


def test_label_model_finds_good_and_tied_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4_000) < 0.2
    rates = [(0.9, 0.02), (0.7, 0.05), (0.6, 0.1), (0.3, 0.3)]
    votes = np.stack([rng.random(4_000) < np.where(y, a, b) for a, b in rates], 1).astype(float)
    start = np.where(votes[:, :2].sum(1) > 0, 0.9, 0.05)
    q, hit, miss, share = toxicity.fit_voters(votes, start)
    assert ((q > 0.5) == y).mean() > 0.95
    assert abs(hit[0] - 0.9) < 0.08 and abs(miss[0] - 0.02) < 0.05 and share.min() > 0.8
    votes = np.concatenate([votes, votes[:, 2:3]], 1)  # a copy of a voter
    q, hit, miss, share = toxicity.fit_voters(votes, start)
    assert ((q > 0.5) == y).mean() > 0.93
    assert share[4] < 0.5 and share[2] < 0.5 < share[0] and share[3] > 0.9


def model_of(pieces, table):
    hashes = np.array([language_id._hash(language_id._codes(p)) for p in pieces], np.uint64)
    order = np.argsort(hashes)
    rows = np.concatenate([np.array(table)[order], [[1e-6, 1e-5]]])
    return language_id.Model(["xx", "yy"], hashes[order], rows, np.zeros(2), 4)


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"]
    rng = np.random.default_rng(2)
    table = rng.random((len(pieces), 2))
    model = model_of(pieces, table)
    p = dict(zip(pieces, table))

    def brute(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, 5):
            if len(word) >= k:
                one = p.get(word[:k], np.array([1e-6, 1e-5]) if k == 1 else None)
                if one is not None:
                    out = out + one * brute(word[k:])
        return out
    for word in ("a", "abab", "babaab", "xaby", "ab" * 200):
        if len(word) < 20:
            assert np.allclose(model.word_scores([word])[0], np.log(brute("▁" + word)))
    assert np.isfinite(model.word_scores(["ab" * 400])).all()
    # expected counts of pieces, weighted by their length, give back the letters
    total = model.expected(["abab", "ba"], np.array([[3.0, 1.0], [0.0, 2.0]]))
    sizes = np.array([len(x) for x in sorted(pieces, key=lambda x: language_id._hash(language_id._codes(x)))] + [1])
    assert np.allclose(sizes @ total, [3 * 5, 1 * 5 + 2 * 3])


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(2_500)
    got = language_id.identify(docs, language_id.train(docs, per_language=400)).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter(language_id.held_out(F.col("doc_id"))).collect()
    assert len(held) > 500 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.99


def test_language_odd_rows(spark):
    docs, rows = odd_docs(spark, [(70, "12 ½ ² --"), (71, "ein zwei drei")])
    out = language_id.identify(docs, language_id.train(docs)).collect()
    assert len(out) == len(rows)
    und = sorted((r["doc_id"] or 0) for r in out if r["lang_pred"] == "und")
    assert und == [0, 2, 3, 4, 70] and {r["lang_pred"] for r in out} == {"und", "en"}
    none = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def solved(tokens, p, want, pull):
    """The same least squares by many plain steps in numpy."""
    share = tokens / tokens.sum()
    m = (p * share[:, None]).T @ p
    scale = 1 / np.diag(m)
    r, step = np.ones(len(tokens)), 1 / (pull + np.abs(m * np.sqrt(np.outer(scale, scale))).sum(1).max())
    for _ in range(20_000):
        r = np.maximum(0, r - step * (p @ (((r * share) @ p - want) * scale) + pull * (r - 1)))
    return r


def test_rates_are_the_least_squares_solution(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 60)
    tokens = rng.integers(0, 500, 60)
    rows = [(i, i, "s", int(t), *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p))]
    members = spark.createDataFrame(rows, "row bigint, doc_id bigint, source string, tokens bigint, "
                                          "p0 double, p1 double, p2 double")
    fitted = {r["doc_id"]: r["rate"] for r in mixing.fit_rates(members, [2.0, 1.0, 7.0], rounds=120).collect()}
    want = solved(tokens.astype(float), p, np.array([0.2, 0.1, 0.7]), mixing.PULL)
    assert min(fitted.values()) >= 0
    assert np.allclose([fitted[i] for i in range(60)], want, atol=5e-3)


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(2_000)
    labelled = docs.filter("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("domain"))
    targets = {"en": 0.4, "de": 0.2, "fr": 0.3, "es": 0.1}
    out = mixing.mix(docs, labelled, targets)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["domain"] == r["lang"] for r in got) / len(got) > 0.97
    drawn = sum(r["rate"] * r["n_tokens"] for r in got)
    for lang, share in targets.items():
        mine = sum(r["rate"] * r["n_tokens"] for r in got if r["lang"] == lang)
        assert abs(mine / drawn - share) < 0.04
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in got)


def test_mixing_odd_rows(spark):
    docs, rows = odd_docs(spark)
    labelled = spark.createDataFrame([(1, "a"), (6, "b"), (None, "a"), (7, None), (9, "c")], "doc_id bigint, domain string")
    out = mixing.mix(docs, labelled, {"a": 1.0, "b": 1.0})
    got = out.collect()
    assert len(got) == len(rows) and all(r["rate"] >= 0 for r in got)
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] == 2) == [0]
    assert mixing.mix(docs.limit(0), labelled, {"a": 1.0, "b": 1.0}).count() == 0
    assert mixing.mix(docs, labelled.limit(0), {"a": 1.0}).count() == len(rows)


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/")]


def placed(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:cut].translate({i: i + 32 for i in range(65, 91)})
    path = rest[cut:]
    path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(r), r, v) for v, r in RULES for h, s, p in [r.partition("/")]
           if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
    return host, path, max(fit)[1:] if fit else None


def test_url_rules_and_trees(spark):
    rng = random.Random(8)
    urls = ["https://A.Example.ORG/es/1", "http://example.org/en/12?x", "http://notexample.org/es/1", "http://org", None,
            "no scheme", "http://x.com/de/?a=1&b=2#f", "ftp://x.com#/de/", "http://x.com/fr/://y", "://", "http://é.COM/de/ü"]
    for _ in range(400):
        bad = rng.random() < 0.5
        host = "".join(rng.choice("0123456789xqz-" if bad else "abcdeno") for _ in range(18 if bad else 7))
        urls.append(f"http://{host}.example.net/p/{rng.randint(1, 99)}" + "?a=1&b=2&c=3" * bad)
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)] + [(0, urls[0], 1)],
                                  "page_id bigint, url string, score int")
    labelled = spark.createDataFrame([(u, int("?a=1&b=2&c=3" in u)) for u in urls[11:211]], "url string, blocked int")
    got = url_filter.judge(pages, RULES, labelled).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, fit = placed(urls[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (fit[0] if fit else None)
        assert not fit or r["verdict"] == fit[1]
    rest = [(r["verdict"] == "block") == ("?a=1&b=2&c=3" in urls[r["page_id"]]) for r in got if r["page_id"] >= 211]
    assert sum(rest) / len(rest) > 0.95
    none = url_filter.judge(pages, RULES, labelled.limit(0))
    assert none.count() == len(urls) + 1 and none.filter("verdict = 'block' and rule is null").isEmpty()
    assert url_filter.judge(pages.limit(0), RULES, labelled.limit(0)).count() == 0


def test_url_statistics_count_all_labelled_rows(spark):
    rng = random.Random(9)
    urls = [(f"http://h{rng.randint(0, 9)}.dom{d:03}.net/p/{i:03}", d % 2) for d in range(200) for i in range(20)]
    rng.shuffle(urls)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id bigint, url string")
    labelled = spark.createDataFrame(urls[:3_000], "url string, blocked int")
    # one url is repeated as often as the trees take rows, and is the lowest in hash order
    low = labelled.orderBy(F.xxhash64("url")).first()
    often = labelled.union(spark.createDataFrame([tuple(low)] * 300, labelled.schema))
    for known in (labelled, often):
        got = url_filter.judge(pages, RULES[:1], known, max_rows=300).collect()
        right = [(r["verdict"] == "block") == urls[r["page_id"]][1] for r in got if r["page_id"] >= 3_000]
        assert len(right) == 1_000 and sum(right) / len(right) > 0.95


def test_url_entropy(spark):
    urls = url_filter.located(spark.createDataFrame([(1, "http://aab.cc/x")], "page_id bigint, url string"))
    r = url_filter.lexical(urls).first()
    counts = [2, 1, 1, 2]
    assert math.isclose(r["entropy"], -sum(c / 6 * math.log2(c / 6) for c in counts))
    assert r["depth"] == 1 and r["params"] == 0 and r["suffix"] == "cc"


def test_scorers_cover_whole_tables(spark):
    for name, t in (("op3_toxicity", "documents"), ("op5_url_filter", "pages")):
        sf = "/root/testdata/sf0.001"
        assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{t}.parquet").count()
