"""Small tables with every kind of odd row, and plain Python forms of the word rules."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = {i: i + 32 for i in range(65, 91)}
# Further columns, named as the operators name their own helpers.
EXTRA = ("n_words, d, row, sig, words, root, score, identity, doomed, mark, once, row_rank, n_lines, "
         "n_dropped, class_size, hit, block, keep, h, tid, label, tokens, rate, fit")


def lower(text):
    return (text or "").translate(A_TO_Z)


def words(text):
    return WORD.findall(lower(text))


def vocabulary(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstuéß") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def sentence(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


def odd_docs(spark, texts=()):
    """documents with nulls, empty and very long texts, ties, repeated rows and further columns."""
    rng, vocab = random.Random(5), vocabulary(300)
    long = "\n".join(sentence(rng, vocab, 12) for _ in range(2_000))
    plain = sentence(rng, vocab, 80)
    rows = [(1, plain), (2, None), (3, ""), (4, " \n\t"), (5, plain.upper()), (6, long), (6, long), (7, plain),
            (None, plain), (None, "all rights reserved CC-BY"), (None, None), (8, "x"), (8, "x"), (8, "y z"),
            (9, "Kelvin K sign, 1/2 ½, \U0001f600!"), *texts]
    full = [(d, t, "en" if i % 2 else None, f"s{i % 3}", None if t is None else len(t),
             *[i] * len(EXTRA.split(", "))) for i, (d, t) in enumerate(rows)]
    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
              + ", ".join(f"{c} bigint" for c in EXTRA.split(", ")))
    return spark.createDataFrame(full, schema), rows


def near_copy(rng, text, vocab, edits):
    ws = text.split(" ")
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = rng.choice(vocab)
    return " ".join(ws)


def shingle_set(text, size=5):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def classes(texts, similarity=0.8):
    """Smallest index of each text's class, by comparing all pairs."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= similarity:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]
