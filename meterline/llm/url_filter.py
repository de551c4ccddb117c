"""URL verdicts: stated rules first, gradient-boosted trees on lexical features for the rest.

A rule such as ``example.org/es/`` fits its host and every subdomain where the url's path
starts with the rule's; the longest fitting rule decides. Urls without a rule are judged by
boosted trees over length, depth, digit share, entropy, parameter counts and statistics of
the host's suffix, trained on labelled urls. The rows to learn from are few and bounded, so
the trees are grown on the driver in numpy; urls are featured and scored where they are.

Suffix statistics are combined per suffix over all urls and joined back through a lookup
that is broadcast only when its size is proven and salted otherwise, so a host suffix with a
third of all urls is no hot task. Blocked shares of a suffix count every labelled row of one
part of the urls, the trees learn from the other, so that no row's label is among its own
features. The trees see at most ``max_rows`` distinct urls, the lowest in hash order, each
with the mean of its labels.

Defined results. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there to ``?``, ``#`` or the end; both empty for null or no ``://``.
Rules of equal length that both fit: the first in order of the rule's text. Without labelled
rows of both kinds every url without rule is allowed. Repeated rows are judged one by one.
An empty table gives an empty table. Only page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.cluster import lookup_join, write_and_read
from meterline.llm.texts import ascii_lower, bucket, over_batches

MAX_ROWS, TREES, DEPTH, BINS, RATE, RIDGE = 20_000, 30, 4, 32, 0.3, 1.0
BATCH = 10_000
FEATURES = ("url_chars host_chars path_chars depth dots hyphens digits entropy params secure www "
            "fragment page_ext first_segment_chars last_segment_digits "
            "suffix_pages suffix_blocked domain_pages domain_blocked segment_pages segment_blocked").split()
SUFFIXES = ("suffix", "domain", "segment")


def located(pages: DataFrame, *keep: str) -> DataFrame:
    """(url, host, path) and the columns to keep."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract("after", r"^[^/?#]*", 0)
    path = F.regexp_extract("after", r"^[^/?#]*([^?#]*)", 1)
    return (pages.select(*keep, url.alias("url")).withColumn("after", after)
            .select(*keep, "url", ascii_lower(host).alias("host"), path.alias("path")))


def fitting_rule(rules: list[tuple[str, str]]) -> Column:
    """struct(size, order, rule, verdict) of the longest rule that fits (host, path); else null."""
    fits = []
    for i, (verdict, rule) in enumerate(sorted(rules, key=lambda x: x[1])):
        host, slash, path = rule.partition("/")
        on = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits.append(F.when(on & F.startswith(F.col("path"), F.lit(slash + path)), F.struct(
            F.lit(len(rule)).alias("size"), F.lit(-i).alias("order"), F.lit(rule).alias("rule"),
            F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<size:int,order:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits))) if fits else none


def _share(of: Column, pattern: str) -> Column:
    return F.length(of) - F.length(F.regexp_replace(of, pattern, ""))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` with the features that a url shows by itself, and its three suffixes."""
    host, path, url = F.col("host"), F.col("path"), F.col("url")
    size = F.greatest(F.length(host), F.lit(1))
    entropy = F.aggregate(F.array_distinct(F.split(host, "")), F.lit(0.0), lambda s, c: s - F.when(
        c == "", 0.0).otherwise(((F.length(host) - F.length(F.replace(host, c))) / size)
                                * F.log2(F.greatest((F.length(host) - F.length(F.replace(host, c))) / size, F.lit(1e-9)))))
    segments = F.split(path, "/")
    first = F.coalesce(F.get(segments, F.lit(1)), F.lit(""))
    last = F.coalesce(F.element_at(segments, -1), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.select(
        "*", F.length(url).alias("url_chars"), F.length(host).alias("host_chars"), F.length(path).alias("path_chars"),
        (F.size(segments) - 1).alias("depth"), _share(host, r"\.").alias("dots"), _share(url, "-").alias("hyphens"),
        (_share(url, "[0-9]") / F.greatest(F.length(url), F.lit(1))).alias("digits"), entropy.alias("entropy"),
        F.when(query == "", 0).otherwise(1 + _share(query, "&")).alias("params"),
        F.startswith(url, F.lit("https")).cast("int").alias("secure"),
        F.startswith(host, F.lit("www.")).cast("int").alias("www"), F.contains(url, F.lit("#")).cast("int").alias("fragment"),
        F.contains(last, F.lit(".")).cast("int").alias("page_ext"), F.length(first).alias("first_segment_chars"),
        _share(last, "[0-9]").alias("last_segment_digits"),
        F.substring_index(host, ".", -1).alias("suffix"), F.substring_index(host, ".", -2).alias("domain"),
        F.concat_ws("/", F.substring_index(host, ".", -1), first).alias("segment"))


def suffix_statistics(urls: DataFrame, labelled: DataFrame) -> dict[str, DataFrame]:
    """Per kind of suffix: how many urls share one, and which part of its labelled ones is blocked.

    ``labelled`` has the three suffixes, n labelled rows and how many of them are blocked.
    """
    out = {}
    for name in SUFFIXES:
        pages = urls.groupBy(name).agg(F.count(F.lit(1)).alias("pages"))
        known = labelled.groupBy(name).agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n"))
        n = F.coalesce("n", F.lit(0))
        out[name] = write_and_read(pages.join(known, name, "left").select(
            F.col(name).alias("key"), F.log1p("pages").alias(f"{name}_pages"),
            ((F.coalesce("blocked", F.lit(0.0)) + 1) / (n + 2)).alias(f"{name}_blocked")), "suffixes")
    return out


def with_statistics(urls: DataFrame, statistics: dict[str, DataFrame]) -> DataFrame:
    for name, stats in statistics.items():
        urls = lookup_join(urls, stats, urls[name] == stats["key"], "left", spread=F.xxhash64("url")).drop("key")
    return urls.na.fill({f"{n}_pages": 0.0 for n in SUFFIXES} | {f"{n}_blocked": 0.5 for n in SUFFIXES})


@dataclass
class Trees:
    """Boosted trees of one depth over binned features.

    A tree has its inner nodes in heap order: at node k a row goes to 2k + 1 if its bin of
    ``feature[k]`` is at most ``cut[k]``, else to 2k + 2; the nodes of the last level are
    the leaves.
    """

    edges: list[np.ndarray]
    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a row is blocked."""
        bins, rows, total = self.bins(x), np.arange(len(x)), np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            total += leaf[node - len(cut)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Fit boosted trees to rows of features and 0/1 labels: Newton steps on the log loss."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    inner, n_features, n_bins = 2 ** depth - 1, x.shape[1], BINS + 1
    model = Trees(edges, float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64),
                  np.zeros((trees, inner), np.int64), np.zeros((trees, inner + 1)))
    bins, rows = model.bins(x), np.arange(len(x))
    columns, total = bins + np.arange(n_features) * n_bins, np.full(len(x), model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend, node = y - p, p * (1 - p), np.zeros(len(x), np.int64)
        for level in range(depth):
            width, first = 2 ** level, 2 ** level - 1
            at = ((node - first)[:, None] * (n_features * n_bins) + columns).ravel()
            size = width * n_features * n_bins
            g, h = (np.bincount(at, np.repeat(v, n_features), size).reshape(width, n_features, n_bins).cumsum(axis=2)
                    for v in (slope, bend))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE)
            best = gain.reshape(width, -1).argmax(axis=1)
            model.feature[t, first:first + width], model.cut[t, first:first + width] = np.divmod(best, n_bins)
            node = 2 * node + 1 + (bins[rows, model.feature[t, node]] > model.cut[t, node])
        leaf = node - inner
        model.leaf[t] = RATE * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + RIDGE)
        total += model.leaf[t, leaf]
    return model


def scored(urls: DataFrame, model: Trees) -> DataFrame:
    """(page_id, host, path, fit, score) of urls with ``FEATURES``."""
    plain = ["page_id", "host", "path", "fit"]
    rows = urls.select(*plain, *[F.col(f).cast("double").alias(f) for f in FEATURES])
    schema = T.StructType([*(rows.schema[c] for c in plain), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(plain):]], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(plain)], pa.array(model.score(x))], names=schema.names)
    return over_batches(rows, run, schema, BATCH)


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(url, blocked) of the urls on which a rule decides."""
    urls = located(pages).withColumn("fit", fitting_rule(rules)).filter("fit is not null")
    return urls.select("url", (F.col("fit.verdict") == "block").cast("double").alias("blocked"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame,
          max_rows: int = MAX_ROWS, **options) -> DataFrame:
    """Per page: host, path, rule, verdict and the trees' score (null where a rule decides).

    ``labelled`` has (url, blocked as 0 or 1).
    """
    urls = located(pages, "page_id").withColumn("fit", fitting_rule(rules))
    known = labelled.filter("blocked is not null").select("url", F.col("blocked").cast("double").alias("blocked"))
    for_statistics = bucket(F.col("url"), 5) < 2
    learn = (known.filter(~for_statistics).groupBy("url").agg(F.avg("blocked").alias("blocked"))
             .orderBy(F.xxhash64("url"), "url").limit(max_rows))
    learn = write_and_read(lexical(located(learn, "blocked")), "labelled-urls")
    verdict, rule, score = F.col("fit.verdict"), F.col("fit.rule").alias("rule"), F.lit(None).cast("double")
    if 0 < (learn.agg(F.avg("blocked").alias("share")).first()["share"] or 0) < 1:
        urls = lexical(urls)
        counts = lexical(located(known.filter(for_statistics), "blocked")).groupBy(*SUFFIXES).agg(
            F.sum("blocked").alias("blocked"), F.count(F.lit(1)).alias("n"))
        statistics = suffix_statistics(urls, write_and_read(counts, "labelled-suffixes"))
        table = with_statistics(learn, statistics).select(
            *[F.col(f).cast("double").alias(f) for f in FEATURES], "blocked").toArrow()
        x = np.stack([table[f].to_numpy() for f in FEATURES], 1)
        urls = scored(with_statistics(urls, statistics), train(x, table["blocked"].to_numpy(), **options))
        score = F.col("score")
    judged = F.when(F.coalesce(score, F.lit(0.0)) >= 0.5, "block").otherwise("allow")
    return urls.select("page_id", "host", "path", rule, F.coalesce(verdict, judged).alias("verdict"),
                       F.when(F.col("fit").isNull(), score).alias("score"))
