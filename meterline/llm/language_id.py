"""Language identification by unigram pieces, summed over all segmentations.

Every language has its own probabilities over one fixed public vocabulary of pieces. The
probability of a word is the sum over all ways to cut it into pieces, found by the forward
algorithm; a text's score adds up its words. Probabilities are fitted by expectation
maximisation: forward and backward sums give expected counts of pieces, Spark adds them up,
and one small matrix (pieces times languages) comes to the driver each round.

Words are handled in groups of one length with numpy, all languages at once; a task
remembers the words it has met. Scoring is one row at a time: no shuffle, no skew. The fit
uses about ``per_language`` documents of each language, the lowest in hash order, outside the
held-out fold.

Defined results. A text that is null or has no letter is ``und`` with score 0, and so is
every text where nothing was learned. Letters are lower-cased; digits, signs and white space
only separate words. Documents without language or text are left out of the fit; ties go to
the language first in order. Repeated rows get equal results. An empty table gives an empty
table. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.cluster import write_and_read
from meterline.llm.texts import bucket, over_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PER_LANGUAGE, ROUNDS, MAX_PIECE, MAX_LANGUAGES = 3_000, 3, 10, 256
# Letter runs up to this long need no scaling in the fit; longer ones are scaled as they go.
UNSCALED = 40
FOLDS, HELD_OUT = 3, 1
WORDS = re.compile(r"[^\W\d_]+")
START = "▁"
REMEMBERED = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def load_pieces(path: str = VOCABULARY, max_piece: int = MAX_PIECE) -> list[str]:
    """The lower-case letter pieces of a public vocabulary, with the mark of a word's start."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    fits = (p for p in every if len(p) <= max_piece and (p == START or p.removeprefix(START).isalpha())
            and p == p.lower())
    return sorted(dict.fromkeys([START, *fits]))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hash(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of the last axis."""
    out = np.zeros(codes.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[-1]):
            out = out * BASE + codes[..., k] + np.uint64(1)
    return out


@dataclass
class Model:
    """log and plain probabilities: ``table`` has a row per piece and one for unknown signs."""

    languages: list[str]
    hashes: np.ndarray      # sorted hashes of the pieces, in the order of the table's rows
    table: np.ndarray
    prior: np.ndarray
    max_piece: int

    def _pieces(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece number at each place of each word; -1 if none."""
        n, size = codes.shape
        out = []
        h = np.zeros((n, size + 1), np.uint64)
        for k in range(1, min(self.max_piece, size) + 1):
            with np.errstate(over="ignore"):
                h = h[:, :size - k + 1] * BASE + codes[:, k - 1:] + np.uint64(1)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = np.where(self.hashes[at] == h, at, -1)
            if k == 1:
                found = np.where(found < 0, len(self.hashes), found)
            out.append(found)
        return out

    def _forward(self, pieces: list[np.ndarray], n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the segmentations of every beginning, and what was scaled out of them."""
        a = np.zeros((size + 1, n, len(self.languages)))
        a[0] = 1
        scaled = np.zeros((n, len(self.languages)))
        for j in range(1, size + 1):
            for k in range(1, min(self.max_piece, j) + 1):
                which = pieces[k - 1][:, j - k]
                rows = np.flatnonzero(which >= 0)
                if len(rows):
                    a[j, rows] += a[j - k, rows] * self.table[which[rows]]
            low = (a[j] < 1e-200) & (a[j] > 0)
            if low.any():
                a[max(0, j - self.max_piece):j + 1, low] *= 1e180
                scaled[low] -= np.log(1e180)
        return a, scaled

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, mine in by_size.items():
            step = max(1, 200_000 // (size + 1))
            for lo in range(0, len(mine), step):
                part = mine[lo:lo + step]
                codes = _codes("".join(START + words[i] for i in part)).reshape(len(part), size + 1)
                a, scaled = self._forward(self._pieces(codes), len(part), size + 1)
                out[part] = np.log(a[-1] + 1e-320) + scaled
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected pieces: counts[word, language] spread over all segmentations."""
        total = np.zeros_like(self.table)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, mine in by_size.items():
            step = max(1, 200_000 // (size + 1))
            for lo in range(0, len(mine), step):
                part = mine[lo:lo + step]
                size_ = size + 1
                codes = _codes("".join(START + words[i] for i in part)).reshape(len(part), size_)
                pieces = self._pieces(codes)
                if size > UNSCALED:
                    self._add_scaled(total, pieces, counts[part], size_)
                    continue
                a, scaled = self._forward(pieces, len(part), size_)
                b = np.zeros_like(a)
                b[size_] = 1
                for i in range(size_ - 1, -1, -1):
                    for k in range(1, min(self.max_piece, size_ - i) + 1):
                        which = pieces[k - 1][:, i]
                        rows = np.flatnonzero(which >= 0)
                        if len(rows):
                            b[i, rows] += b[i + k, rows] * self.table[which[rows]]
                weight = np.where((a[-1] > 0) & (scaled == 0), counts[part] / np.maximum(a[-1], 1e-300), 0)
                for k, found in enumerate(pieces, 1):
                    for i in range(found.shape[1]):
                        which = found[:, i]
                        rows = np.flatnonzero(which >= 0)
                        if len(rows):
                            value = a[i, rows] * b[i + k, rows] * self.table[which[rows]] * weight[rows]
                            np.add.at(total, which[rows], value)
        return total

    def _scaled(self, pieces: list[np.ndarray], rows: int, size: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all segmentations of every beginning (``back``: end) of words of any length.

        Returned with the logarithms of what the sums have been multiplied by on the way.
        """
        a = np.zeros((size + 1, rows, len(self.languages)))
        s = np.zeros_like(a)
        a[size if back else 0] = 1
        for j in (range(size - 1, -1, -1) if back else range(1, size + 1)):
            s[j] = s[j + 1 if back else j - 1]
            for k in range(1, min(self.max_piece, size - j if back else j) + 1):
                start, other = (j, j + k) if back else (j - k, j - k)
                which = pieces[k - 1][:, start]
                rows_ = np.flatnonzero(which >= 0)
                if len(rows_):
                    a[j, rows_] += a[other, rows_] * self.table[which[rows_]] * np.exp(s[j, rows_] - s[other, rows_])
            low = (a[j] < 1e-100) & (a[j] > 0)
            a[j, low] *= 1e90
            s[j, low] += np.log(1e90)
        return a, s

    def _add_scaled(self, total: np.ndarray, pieces: list[np.ndarray], counts: np.ndarray, size: int) -> None:
        """Expected pieces of long words, added to ``total``."""
        a, sa = self._scaled(pieces, len(counts), size, False)
        b, sb = self._scaled(pieces, len(counts), size, True)
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b, table = np.log(a) - sa, np.log(b) - sb, np.log(self.table)
            for k, found in enumerate(pieces, 1):
                for i in range(found.shape[1]):
                    which = found[:, i]
                    rows = np.flatnonzero(which >= 0)
                    if len(rows):
                        value = np.exp(a[i, rows] + b[i + k, rows] + table[which[rows]] - a[-1, rows]) * counts[rows]
                        np.add.at(total, which[rows], np.nan_to_num(value))

    def scorer(self):
        """A function from text to (language, probability); it remembers words."""
        number: dict[str, int] = {}
        grown = [np.zeros((0, len(self.languages)))]

        def score(texts: list[str | None]) -> list[tuple[str, float]]:
            found = [WORDS.findall(t.lower()) if t else [] for t in texts]
            if len(number) > REMEMBERED:
                number.clear()
                grown[0] = grown[0][:0]
            new = [w for w in dict.fromkeys(w for ws in found for w in ws) if w not in number]
            if new and self.languages:
                number.update(zip(new, range(len(number), len(number) + len(new))))
                grown[0] = np.concatenate([grown[0], self.word_scores(new)])
            out = []
            for ws in found:
                if not self.languages or not any(c.isalpha() for w in ws for c in w):
                    out.append(("und", 0.0))
                    continue
                at = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
                logit = self.prior + grown[0][at].sum(axis=0)
                best = int(np.argmax(logit))
                out.append((self.languages[best], float(1 / np.exp(logit - logit[best]).sum())))
            return out
        return score


def training_docs(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text): about ``per_language`` documents of each language outside the held-out fold."""
    usable = (docs.select("doc_id", F.col("lang").cast("string").alias("lang"),
                          F.col("text").cast("string").alias("text"))
              .filter("lang is not null and text is not null").filter(~held_out(F.col("doc_id"))))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chosen = F.lit(False)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    for r in counts:
        cut = min(1 << 20, -(-per_language * (1 << 20) // r["count"]))
        chosen = chosen | ((F.col("lang") == r["lang"]) & (place < cut))
    return usable.filter(chosen).select("lang", "text")


def _word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of the training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((lang, w) for w in WORDS.findall(text.lower()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                 pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])
    made = over_batches(rows, run, "lang string, word string, n bigint")
    return made.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, vocabulary: str = VOCABULARY, per_language: int = PER_LANGUAGE,
          rounds: int = ROUNDS, max_piece: int = MAX_PIECE) -> Model:
    pieces = load_pieces(vocabulary, max_piece)
    hashes = np.array([_hash(_codes(p)) for p in pieces], np.uint64)
    hashes = np.sort(hashes)
    counts = write_and_read(_word_counts(training_docs(docs, per_language)), "words")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    place = {lang: i for i, lang in enumerate(languages)}
    start = np.full((len(hashes) + 1, len(languages)), 1 / (len(hashes) + 1))
    # Neither the number of documents nor of words speaks for a language.
    model = Model(languages, hashes, start, np.zeros(len(languages)), max_piece)
    for _ in range(rounds if languages else 0):
        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(model.table)
            for batch in batches:
                index: dict[str, int] = {}
                at = [index.setdefault(w, len(index)) for w in batch.column(1).to_pylist()]
                n = np.zeros((len(index), len(languages)))
                np.add.at(n, (at, [place[x] for x in batch.column(0).to_pylist()]), batch.column(2).to_numpy())
                total += model.expected(list(index), n)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)),
                                              pa.array(total[piece, lang])], names=["piece", "lang", "n"])
        found = (over_batches(counts, run, "piece int, lang int, n double", 50_000).groupBy("piece", "lang")
                 .agg(F.sum("n").alias("n")).toArrow())
        total = np.zeros_like(start)
        total[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        pooled = total.sum(axis=1, keepdims=True)
        total += 0.01 * total.sum(axis=0) * pooled / max(pooled.sum(), 1) + 1e-3
        model = Model(languages, hashes, total / total.sum(axis=0), model.prior, max_piece)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            got = of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])
    return over_batches(narrow, run, schema)


def held_out(doc_id: Column) -> Column:
    return bucket(doc_id, FOLDS) == HELD_OUT
