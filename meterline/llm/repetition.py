"""Quality rules: how much of a text is repetition.

Rolling hashes of several n-gram lengths mark the words that lie in an n-gram found twice
or more in the text; their code points, and those of repeated lines, are measured against
the whole. A text is one row and one independent piece of work: no shuffle, and memory of
one batch of texts.

Defined results: a null or empty text has no words, every measure is 0 and it fails the
base rule (fewer than 50 words). Repeated rows are judged one by one. An empty table gives
an empty table. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
A doc_id of null stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.texts import code_points, mix, over_batches, texts_of

# Highest percentage of word characters inside repeated n-grams, by n. A short
# text that repeats one of its lines stays below them.
MAX_COVERED = {5: 30, 7: 28, 10: 25}
MAX_LINE_SHARE = 30       # percent of the text's line characters, in lines equal to an earlier line
MAX_SYMBOLS_PER_WORD = 10  # percent
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = ("doc_id {id}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, dup_line_chars bigint, line_chars bigint, "
          "covered map<int,bigint>")


def _rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n words: a polynomial in the word hashes, modulo 2**64."""
    size = len(h) - n + 1
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x100000001B3) + h[k:k + size]
    return out


def _covered(h: np.ndarray, n: int) -> np.ndarray | None:
    """Which words lie in an n-gram that occurs at least twice; None if there is none."""
    if len(h) <= n:
        return None
    grams = _rolling(h, n)
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return None
    step = np.zeros(len(h) + 1, np.int32)
    at = np.flatnonzero(np.isin(grams, twice))
    step[at] += 1
    step[at + n] -= 1
    return np.cumsum(step[:-1]) > 0


def measure(text: bytes, lengths: tuple[int, ...]) -> tuple:
    """Counts of one text: words, code points, symbols, repeated lines and n-grams."""
    found = text.split()
    plain = text.isascii()
    ids: dict[bytes, int] = {}
    index = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, len(found))
    seen, dup_lines, dup_chars, line_chars = set(), 0, 0, 0
    for line in text.split(b"\n"):
        if not line.strip():
            continue
        size = len(line) if plain else code_points(line)
        line_chars += size
        if line in seen:
            dup_lines += 1
            dup_chars += size
        seen.add(line)
    h = mix(index)
    three = _covered(h, 3)
    chars = code_points(text) - sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    covered = dict.fromkeys(lengths, 0)
    if three is not None:
        sizes = np.fromiter((len(w) if plain else code_points(w) for w in found), np.int64, len(found))
        for n in lengths:
            mask = _covered(h, n)
            if mask is None:
                break  # a longer repeated n-gram would hold a shorter one
            covered[n] = int(sizes[mask].sum())
    symbols = sum(text.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS)))
    repeat = 0 if three is None else int(three.sum())
    return len(found), chars, symbols, dup_lines, repeat, dup_chars, line_chars, covered


def repetition(docs: DataFrame, lengths: tuple[int, ...] = tuple(MAX_COVERED)) -> DataFrame:
    """Measures of every text, in one pass over it; ``lengths`` rise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t, lengths) for t in texts_of(batch.column(1))]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
            shares = pa.array([list(r[7].items()) for r in rows], pa.map_(pa.int32(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, shares],
                                             names=[f.split()[0] for f in SCHEMA.split(", ")])

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    return over_batches(narrow, run, SCHEMA.format(id=kind))


def judge(measured: DataFrame, limits: dict[int, int] | None = None) -> DataFrame:
    """Adds base_failed and kept: every share within its limit."""
    limits = MAX_COVERED if limits is None else limits
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = ((100 * F.col("dup_line_chars") <= MAX_LINE_SHARE * F.col("line_chars"))
            & (100 * F.col("n_symbols") <= MAX_SYMBOLS_PER_WORD * F.col("n_words")))
    for n, limit in limits.items():
        fine = fine & (100 * F.col("covered")[n] <= limit * F.col("word_chars"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
