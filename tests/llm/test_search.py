import random

from helpers import odd_docs, sentence, vocabulary, words

from meterline.llm import decontaminate, licenses

VOCAB = vocabulary(60)


def hits(docs, items, window=10):
    out = []
    for d, text in docs:
        ws, hit, found = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            n = min(window, len(iw))
            grams = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1) if n else ():
                if tuple(ws[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(item)
        out.append((d, len(ws), len(hit), sorted(found - {None})))
    return sorted(out, key=repr)


def found(index, items, **options):
    rows = decontaminate.search(index, items, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in rows), key=repr)


def planted(spark):
    rng = random.Random(2)
    items = [(i, sentence(rng, VOCAB, rng.choice([3, 9, 10, 25]))) for i in range(20)]
    items += [(20, None), (21, ""), (22, "!!"), (3, items[3][1] + " again and more of it"), (None, "x")]
    texts = []
    for i in range(50):
        parts = [sentence(rng, VOCAB, 30) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(items[:20])[1].upper())
        texts.append((1000 + i, ", ".join(parts)))
    docs, rows = odd_docs(spark, texts)
    return docs, rows, spark.createDataFrame(items, "item_id bigint, text string"), items


def test_windows_match_plain_search(spark):
    docs, rows, tests, items = planted(spark)
    want = hits(rows, items)
    assert found(decontaminate.build_index(docs), tests) == want
    small = decontaminate.build_index(docs.repartition(3), block_words=500)
    assert found(small, tests) == want
    assert found(small, tests, chunk_words=60) == want  # in several parts


def test_spans_and_nearby_terms(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([
        (1, "so " + item + " end"), (2, "kappa so alpha the beta of gamma a delta epsilon"),
        (3, "alpha " + "filler " * 30 + "beta gamma delta epsilon"), (4, None),
        (6, "kappa a iota b theta c eta d zeta e epsilon delta gamma beta alpha")], "doc_id bigint, text string")
    tests = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.search(decontaminate.build_index(docs), tests).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(1, 10)] and got[1]["items"] == [5]
    assert got[2]["items"] == [] and got[2]["n_hit"] == 0
    near = {d: r["near"] for d, r in got.items()}
    assert near == {1: [5], 2: [], 3: [], 4: [], 6: [5]}
    assert got[6]["n_hit"] == 0
    assert got[4]["n_words"] == 0


def test_long_items_are_near_their_copies(spark):
    """An item of 500 words, in one part and in many; rows of an item that share all but one word of a window."""
    item = " ".join(f"w{i % 170}x{i}" for i in range(500))
    shuffled = " ".join(reversed(item.split()[240:280]))
    apart = " pad pad pad ".join(item.split()[::20])
    docs = spark.createDataFrame([(1, "so " + item), (2, shuffled), (3, apart), (4, item.replace(" ", "-"))],
                                 "doc_id bigint, text string")
    tests = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "...")], "item_id bigint, text string")
    index = decontaminate.build_index(docs)
    for chunk in (200_000, 240):
        got = {r["doc_id"]: r for r in decontaminate.search(index, tests, chunk_words=chunk).collect()}
        assert {d: r["near"] for d, r in got.items() if d != 3} == {1: [7], 2: [7], 4: [7]}
        assert got[3]["near"] == []
        assert {d: r["n_hit"] for d, r in got.items()} == {1: 500, 2: 0, 3: 0, 4: 500}


def test_clean_documents_keep_their_columns(spark):
    docs, rows, tests, items = planted(spark)
    kept = decontaminate.clean_of(docs, tests)
    assert kept.columns == docs.columns
    dirty = {(d, t) for (d, t), h in zip(rows, [hits([r], items)[0] for r in rows]) if h[2]}
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        (x for x in rows if x not in dirty), key=repr)
    empty = tests.limit(0)
    assert decontaminate.clean_of(docs, empty).count() == len(rows)
    assert decontaminate.clean_of(docs.limit(0), tests).count() == 0


def scanned(rows):
    """Base places and labels by going through the words."""
    index = [(x[0], x[1].split(), x[2].split(), x[3]) for x in licenses.TEMPLATES]
    out = []
    for d, text in rows:
        ws, base, places = words(text), set(), []
        for label, phrase, _, is_base in index:
            if is_base:
                at = [i for i in range(len(ws)) if ws[i:i + len(phrase)] == phrase]
                places += at
                base |= {label} if at else set()
        out.append((d, len(ws), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base))))
    return sorted(out, key=repr)


def test_licenses(spark):
    texts = [(50, "Licensed under CC BY-NC 4.0. cc by"), (51, "ALL rights reserved, all rights\nreserved"),
             (52, "This work is licensed under the GNU General Public License, version 3."),
             (53, "Released under the MIT License."), (54, "license mit the under released"),
             (55, "Permission is hereby granted, free of charge, to any person having a copy of this software"),
             (56, "cc " * 3_000 + "by"), (57, "by cc")]
    docs, rows = odd_docs(spark, texts)
    out = licenses.license_scan(docs)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                                               "base_labels").collect()), key=repr)
    assert got == scanned(rows)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in out.collect()}
    assert labels[50] == ("cc-by,cc-by-nc", 1.0)
    assert labels[52] == ("gpl,gpl-3.0", 1.0)
    assert labels[53] == ("mit", 1.0) and labels[54] == ("", 0.0)
    assert labels[55][0] == "mit" and 0.7 <= labels[55][1] < 1
    assert licenses.license_scan(docs.limit(0)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_idf_counts_all_documents(spark):
    docs = spark.createDataFrame([(i, "the license" if i % 2 else "the cc") for i in range(200)],
                                 "doc_id bigint, text string")
    weights = {r["word"]: r["weight"] for r in licenses.weighted_index(licenses.scan(docs)).collect()}
    assert weights["the"] < weights["license"] < weights["hereby"]
