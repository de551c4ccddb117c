"""Toxicity by weak supervision.

Many weak voters look at a text: a small insult lexicon, word lists dealt out from the words
and word beginnings that stand out in labelled toxic rows (each list has terms of every
language, so that lists agree on what is toxic and not on what is French), and patterns
(shouting, address, strings of signs). A generative label model - two classes, each voter firing at its own rate in
either - is fitted by expectation maximisation without labels; voters whose residuals move
together share one vote. A linear classifier over words and word beginnings is trained on
the model's posterior labels and scores every text in one pass.

The model is fitted on at most ``max_rows`` labelled rows (the lowest in hash order) outside
the held-out fold; term statistics of those rows are counted by Spark and at most
``max_terms`` terms reach the driver. Scoring is one row at a time: no shuffle, no skew.

Defined results. Inputs of a score are the text's words and signs, nothing else. A null or
empty text gets the bias alone. Repeated rows get equal scores. Null labels, labels without
document and documents without label are left out of the fit; without any labelled row the
lexicon alone decides. An empty table gives an empty table. ``toxic_free`` returns all
columns whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.cluster import write_and_read
from meterline.llm.texts import bucket, over_batches, texts_of, words

MAX_ROWS, MAX_TERMS, MAX_STRONG, LEXICONS = 20_000, 2_000, 800, 16
BEGINNINGS = (3, 4, 5, 6)
TIMES = (2, 4, 8)
FOLDS, HELD_OUT = 5, 0
CANDIDATES = 60_000
REMEMBERED, COUNTED = 150_000, 400_000  # words and terms that a task holds at once
# Common insults of four languages, lower case.
LEXICON = ("idiot idiots stupid moron morons loser losers scum trash clown pathetic worthless disgusting "
           "dumb retard bastard bitch asshole jerk filth vermin imbecile "
           "idiota imbécil basura asqueroso patético estúpido "
           "imbécile ordure dégoûtant pathétique crétin connard salaud "
           "trottel abschaum widerlich erbärmlich dumm arschloch dreck").split()
PATTERNS = (
    re.compile(rb"!{3,}"),
    re.compile(rb"\byou(?:'re| are)\b"),
    re.compile(rb"(?:\b[A-Z]{4,}\b\W+){3}"),
    re.compile(rb"[@#$%&*]{4,}"),
    re.compile(rb"\b(?:shut up|go away|hate you|drop dead)\b"),
)


def terms_of(word: bytes) -> list[str]:
    """A word and its beginnings, which carry the marks of inflected insults."""
    text = word.decode("utf-8", "replace")
    return [text, *("^" + text[:n] for n in BEGINNINGS if len(text) >= n)]


def remembered() -> Callable[[bytes], list[str]]:
    """``terms_of``, quicker for words met before."""
    seen: dict[bytes, list[str]] = {}

    def terms(word: bytes) -> list[str]:
        mine = seen.get(word)
        if mine is None:
            if len(seen) >= REMEMBERED:
                seen.clear()
            mine = seen[word] = terms_of(word)
        return mine
    return terms


def features_of(text: bytes, terms: Callable[[bytes], Iterable[str]]) -> list[str]:
    """The terms in a text; one that stands 2, 4 or 8 times is a feature for that as well."""
    tally = Counter(t for w in words(text) for t in terms(w))
    return [*tally, *(f"{t}#{k}" for t, n in tally.items() if n >= TIMES[0] for k in TIMES if n >= k)]


class Features:
    """Features by number: the place of a term among ``bases`` and a level, how often it stands."""

    def __init__(self, features: Iterable[str]):
        self.bases = sorted({f.split("#")[0] for f in features})
        self.place = {t: i for i, t in enumerate(self.bases)}
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def name(self, place: int, level: int) -> str:
        return self.bases[place] + (f"#{TIMES[level - 1]}" if level else "")

    def grid(self, value: dict[str, float], missing: float) -> np.ndarray:
        """``value`` of every feature, by place and level."""
        return np.array([[value.get(self.name(i, k), missing) for k in range(len(TIMES) + 1)]
                         for i in range(len(self.bases))]).reshape(-1, len(TIMES) + 1)

    def tally(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms in a text and the highest level of each."""
        found, seen, place = words(text), self.seen, self.place
        if len(seen) >= REMEMBERED:
            seen.clear()
        for w in set(found):
            if w not in seen:
                seen[w] = tuple(place[t] for t in terms_of(w) if t in place)
        at, n = np.unique(np.array([i for w in found for i in seen[w]], np.int64), return_counts=True)
        return at, np.searchsorted(TIMES, n, "right")


@dataclass
class Toxicity:
    """Weights of terms; the voters' estimated firing rates are kept for inspection."""

    weights: dict[str, float]
    bias: float
    voters: list[str]
    fires_toxic: np.ndarray
    fires_clean: np.ndarray
    share: np.ndarray  # of a full vote that each voter has after correlations

    def scorer(self):
        """A function from text to score; it remembers the terms of words it has seen."""
        features, bias = Features(self.weights), self.bias
        upto = features.grid(self.weights, 0.0).cumsum(axis=1)  # a higher level has the lower ones

        def score(text: bytes) -> float:
            at, level = features.tally(text)
            return float(1 / (1 + np.exp(-np.clip(bias + upto[at, level].sum(), -30, 30))))
        return score


def fit_voters(votes: np.ndarray, start: np.ndarray, rounds: int = 40) -> tuple:
    """Posterior of the toxic class per row, firing rates in either class, shares of a vote.

    Two passes of expectation maximisation; between them a voter's share becomes one over
    one plus its summed positive residual correlation with the others.
    """
    n, m = votes.shape
    share, q = np.ones(m), start.copy()
    if not n:
        return q, np.zeros(m), np.zeros(m), share
    for step in (0, 1):
        for _ in range(rounds):
            prior = (q.sum() + 1) / (n + 10)
            hit = (q @ votes + 0.5) / (q.sum() + 1)
            miss = ((1 - q) @ votes + 0.02) / ((1 - q).sum() + 2)
            on = share * (np.log(hit) - np.log(miss))
            off = share * (np.log1p(-np.minimum(hit, 1 - 1e-6)) - np.log1p(-np.minimum(miss, 1 - 1e-6)))
            logit = np.log(prior / (1 - prior)) + votes @ (on - off) + off.sum()
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            done, q = np.abs(new - q).max() < 1e-6, new
            if done:
                break
        if step == 0:
            rest = votes - np.outer(q, hit) - np.outer(1 - q, miss)
            spread = rest.std(axis=0) + 1e-9
            tied = (rest / spread).T @ (rest / spread) / max(n, 1)
            np.fill_diagonal(tied, 0)
            share = 1 / (1 + np.maximum(tied - 0.05, 0).sum(axis=1))
    return q, hit, miss, share


def fit_linear(where: np.ndarray, what: np.ndarray, target: np.ndarray, prior: np.ndarray,
               steps: int = 250, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on terms (``what``) of rows (``where``) and soft targets.

    The weights are drawn to ``prior``, so that unseen lexicon words keep their meaning.
    """
    n = len(target)
    w, bias = prior.copy(), -3.0
    mean, var = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps + 1 if n else 0):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(where, w[what], n), -30, 30)))
        gap = (p - target) / n
        grad = np.append(np.bincount(what, gap[where], len(w)) + ridge * (w - prior), gap.sum())
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad ** 2
        move = 0.05 * (mean / (1 - 0.9 ** k)) / (np.sqrt(var / (1 - 0.99 ** k)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled documents outside the held-out fold."""
    chosen = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
              .filter("doc_id is not null and toxic is not null")
              .filter(bucket(F.col("doc_id"), FOLDS) != HELD_OUT)
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows))
    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "doc_id").filter("text is not null")
            .select("text", "toxic").limit(max_rows))


def _terms_in(rows: DataFrame) -> DataFrame:
    """(term, n): in how many rows a term occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = remembered(), Counter()

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return made
        for batch in batches:
            for text in texts_of(batch.column(0)):
                counts.update(features_of(text, found))
                if len(counts) > COUNTED:
                    yield told()
        yield told()
    return over_batches(rows.select("text"), run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _counts_of(rows: DataFrame, terms: Iterable[str]) -> dict[str, int]:
    """In how many rows each of the terms occurs."""
    features = Features(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(features.bases), len(TIMES) + 1), np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                at, level = features.tally(text)
                counts[at, level] += 1
        counts = counts[:, ::-1].cumsum(axis=1)[:, ::-1]  # a higher level has the lower ones
        at, level = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([features.name(i, k) for i, k in zip(at, level)], pa.string()),
                                          pa.array(counts[at, level])], names=["term", "n"])
    made = over_batches(rows.select("text"), run, "term string, n bigint")
    return {r["term"]: r["n"] for r in made.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def telling_terms(rows: DataFrame, toxic: int, clean: int, max_terms: int) -> list[tuple[str, float, int, int]]:
    """(term, z, toxic rows, clean rows) of the terms that mark toxic rows most.

    Terms are sought in the toxic rows, then counted in the clean ones.
    """
    if not toxic or not clean:
        return []
    inside = {r["term"]: r["n"] for r in _terms_in(rows.filter("toxic > 0")).filter("n >= 2")
              .orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    outside = _counts_of(rows.filter("toxic <= 0"), inside)
    out = []
    for term, n in inside.items():
        other = outside.get(term, 0)
        share = (n + other) / (toxic + clean)
        z = (n / toxic - other / clean) / (share * (1 - share) * (1 / toxic + 1 / clean) + 1e-12) ** 0.5
        out.append((term, z, n, other))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:max_terms]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS,
          max_terms: int = MAX_TERMS) -> Toxicity:
    """Fit voters, label model and classifier; everything collected is bounded."""
    rows = write_and_read(training_rows(docs, labels, max_rows), "labelled")
    n = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic"))
         .agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    found = telling_terms(rows, toxic, clean, max_terms)
    strong = [t for t, z, a, b in found if z > 3 and a >= 3 and a * clean > 10 * b * toxic][:MAX_STRONG]
    terms = list(dict.fromkeys([*LEXICON, *(t[0] for t in found)]))
    number = {t: i for i, t in enumerate(terms)}
    features = Features(terms)
    numbers = features.grid(number, -1).astype(np.int32)
    lists = [list(LEXICON), *(strong[k::LEXICONS] for k in range(LEXICONS) if strong[k::LEXICONS])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, fired = [], []
            for text in texts_of(batch.column(0)):
                at, level = features.tally(text)
                mine = np.concatenate([numbers[at[level >= k], k] for k in range(len(TIMES) + 1)])
                sets.append(np.sort(mine[mine >= 0]))
                fired.append([i for i, p in enumerate(PATTERNS) if p.search(text)])
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32())),
                                              pa.array(fired, pa.list_(pa.int32()))], names=["terms", "fired"])

    sample = over_batches(rows, run, "terms array<int>, fired array<int>").toArrow().combine_chunks()
    flat = [(np.repeat(np.arange(sample.num_rows), pc.list_value_length(c)), pc.list_flatten(c).to_numpy())
            for c in (sample["terms"], sample["fired"])]
    votes = np.zeros((sample.num_rows, len(lists) + len(PATTERNS)))
    for j, mine in enumerate(lists):
        votes[flat[0][0][np.isin(flat[0][1], [number[t] for t in mine])], j] = 1
    votes[flat[1][0], len(lists) + flat[1][1]] = 1
    start = np.where(votes[:, :len(lists)].sum(axis=1) >= min(2, len(lists)), 0.9, 0.02)
    q, hit, miss, share = fit_voters(votes, start)
    prior = np.array([4.0 if t in LEXICON else 0.0 for t in terms])
    w, bias = fit_linear(*flat[0], q, prior)
    return Toxicity({t: float(x) for t, x in zip(terms, w) if abs(x) > 1e-3}, bias,
                    [*(" ".join(x) for x in lists), *(p.pattern.decode() for p in PATTERNS)], hit, miss, share)


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """(doc_id, score) of every row."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([of(t) for t in texts_of(batch.column(1))], pa.float64())],
                names=["doc_id", "score"])
    return over_batches(narrow, run, schema)


def toxic_free(docs: DataFrame, model: Toxicity, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the limit."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t) < limit for t in texts_of(batch.column(at).cast(pa.string()))],
                                        pa.bool_()))
    return over_batches(docs, run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return bucket(doc_id, FOLDS) == HELD_OUT
