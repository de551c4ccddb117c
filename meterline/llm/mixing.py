"""Mixing to target weights by soft membership; column expressions and joins only.

A multinomial classifier over hashed words, counted from a labelled table, gives every
document a posterior over domains. Then each document gets a rate (how often it should be
drawn): nonnegative least squares finds rates near 1 whose expected tokens per domain, rate
times tokens times posterior, meet the target shares. Projected gradient solves it: one
iteration is one sum per domain over all documents and one update of each rate by itself;
nothing but those few sums reaches the driver. Residuals are divided by a domain's natural
weight, so that small domains converge as fast as large ones.

Words are combined per document before the only shuffle, so neither a long text nor a
source with a third of all rows makes a large group. The classifier counts at most
``max_labelled`` labelled rows, the lowest in hash order.

Defined results. Words are what blanks and line ends separate. A document without words
(null, empty) has 0 tokens, the prior as posterior and a rate like any other. Labels of
domains without target and null labels are ignored; a domain that no document belongs to
cannot be met and is left out of the residual. Repeated rows are documents of their own,
with equal rates. An empty table gives an empty table. Ties in the most likely domain go to
the first in order. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.cluster import write_and_read

BUCKETS = 1 << 14
MAX_LABELLED = 20_000
EVIDENCE = 20.0      # a posterior is as sharp as this many words would make it
PULL = 1e-3          # weight of staying near rate 1
ROUNDS, TOLERANCE, KEEP_EVERY = 30, 1e-7, 6


def _words(text: Column) -> Column:
    clean = F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")),
                      F.lit("\t"), F.lit(" "))
    return F.split(clean, " ")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str],
               max_labelled: int = MAX_LABELLED, buckets: int = BUCKETS) -> tuple[DataFrame, list[float]]:
    """(bucket, w0, w1, ...): log probability of a hashed word in each domain; log priors."""
    chosen = write_and_read(
        labelled.select("doc_id", F.col("domain").cast("string").alias("domain"))
        .filter("doc_id is not null").filter(F.col("domain").isin(domains))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(max_labelled), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    each = [F.count_if(F.col("domain") == d) for d in domains]
    priors = chosen.agg(*each).first()
    counts = (rows.select("domain", F.explode(_words(F.col("text"))).alias("word")).filter("word <> ''")
              .groupBy(_bucket(F.col("word"), buckets).alias("bucket"))
              .agg(*[c.alias(f"n{i}") for i, c in enumerate(each)]))
    counts = write_and_read(docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
                            .join(counts, "bucket", "left").na.fill(0), "domain-words")
    totals = counts.agg(*[F.sum(f"n{i}") for i in range(len(domains))]).first()
    table = counts.select("bucket", *[
        F.log((F.col(f"n{i}") + 0.1) / (totals[i] + 0.1 * buckets)).alias(f"w{i}") for i in range(len(domains))])
    all_ = sum(priors) + len(domains)
    return table, [log((p + 1) / all_) for p in priors]


def memberships(docs: DataFrame, table: DataFrame, priors: list[float], evidence: float = EVIDENCE,
                buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, source, tokens, p0, p1, ...) of every document; stored."""
    d = range(len(priors))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", _words(F.col("text")).alias("ws"))
    words = (rows.select("row", "doc_id", "source", F.explode("ws").alias("word"))
             .select("row", "doc_id", "source", (F.col("word") != "").alias("real"),
                     _bucket(F.col("word"), buckets).alias("bucket")))
    summed = (words.join(F.broadcast(table), "bucket").groupBy("row", "doc_id", "source")
              .agg(F.count_if("real").alias("tokens"),
                   *[F.sum(F.when(F.col("real"), F.col(f"w{i}")).otherwise(0.0)).alias(f"s{i}") for i in d]))
    logit = [F.lit(priors[i]) + F.col(f"s{i}") * (evidence / F.greatest(F.col("tokens"), F.lit(1))) for i in d]
    top = F.greatest(*logit) if len(priors) > 1 else logit[0]
    raw = summed.select("row", "doc_id", "source", "tokens", *[F.exp(x - top).alias(f"e{i}") for i, x in enumerate(logit)])
    total = reduce(lambda a, b: a + b, [F.col(f"e{i}") for i in d])
    return write_and_read(raw.select("row", "doc_id", "source", "tokens",
                                     *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in d]), "memberships")


def fit_rates(members: DataFrame, targets: list[float], pull: float = PULL, rounds: int = ROUNDS,
              tolerance: float = TOLERANCE) -> DataFrame:
    """``members`` with a nonnegative ``rate``, by projected gradient from rate 1."""
    d = range(len(targets))
    p = [F.col(f"p{i}") for i in d]
    sums = members.agg(F.sum("tokens").alias("t"), *[
        F.sum(F.col("tokens") * p[i] * p[j]).alias(f"m{i}_{j}") for i in d for j in d]).first()
    total = float(sums["t"] or 0)
    if not total:
        return members.withColumn("rate", F.lit(1.0))
    m = [[sums[f"m{i}_{j}"] / total for j in d] for i in d]
    scale = [1 / m[i][i] if m[i][i] > 1e-9 else 0.0 for i in d]
    # No eigenvalue of the scaled matrix exceeds its largest absolute row sum.
    step = 1 / (pull + max(sum(abs(m[i][j]) * (scale[i] * scale[j]) ** 0.5 for j in d) for i in d))
    want = [t / sum(targets) for t in targets]
    state, rate, before = members, F.lit(1.0), None
    for k in range(1, rounds + 1):
        got = state.agg(*[F.sum(rate * F.col("tokens") * p[i]) for i in d]).first()
        gap = [(got[i] / total - want[i]) for i in d]
        if before is not None and max(abs(a - b) for a, b in zip(gap, before)) < tolerance:
            break
        before = gap
        slope = reduce(lambda a, b: a + b, [p[i] * F.lit(step * gap[i] * scale[i]) for i in d])
        rate = F.greatest(F.lit(0.0), rate * F.lit(1 - step * pull) + F.lit(step * pull) - slope)
        if k % KEEP_EVERY == 0:
            state, rate = write_and_read(state.withColumn("rate", rate), "rates"), F.col("rate")
    return state.withColumn("rate", rate)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """(doc_id, source, n_tokens, domain, rate, copies) of every document.

    ``labelled`` has (doc_id, domain); ``targets`` the wanted share of tokens per domain.
    ``copies`` is the rate rounded up or down by a hash of the id, so that its mean is kept.
    """
    domains = sorted(targets)
    table, priors = classifier(docs, labelled, domains)
    members = memberships(docs, table, priors)
    fitted = fit_rates(members, [targets[x] for x in domains], **options)
    best = F.greatest(*[F.col(f"p{i}") for i in range(len(domains))]) if len(domains) > 1 else F.col("p0")
    domain = F.coalesce(*[F.when(F.col(f"p{i}") == best, F.lit(x)) for i, x in enumerate(domains)])
    spin = F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor("rate") + (spin < F.col("rate") - F.floor("rate")).cast("bigint")
    return fitted.select("doc_id", "source", F.col("tokens").alias("n_tokens"), domain.alias("domain"),
                         "rate", copies.alias("copies"))
