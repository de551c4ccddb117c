"""License scans with a positional index of rare licence words; column expressions only.

A template is a short licence text with a mandatory key phrase. Its index says at which
place which word stands. One narrow pass over the texts keeps the places of template words;
document frequencies, counted over all documents, weigh them. A document is looked at only
where the rarest word of some key phrase stands: that word's posting gives the place where
the template would start. All template words of such documents then vote for (template,
start), so that agreeing relative positions meet; a template is found where the votes carry
at least ``COVERAGE`` of its weight and the whole key phrase stands in its place. Since the
key phrase is mandatory, starting from its rarest word loses nothing.

The base phrases are templates that are all key phrase. The votes are combined per document,
template and place, so neither a frequent word nor a licence that stands in a third of all
documents makes a large group.

Defined results. Words: A-Z lower-cased runs of digits, letters and non-ASCII, counted from
0. A null or empty text has no words and no labels. Repeated rows are scanned one by one.
An empty table gives an empty table. Places of one label may overlap; all are counted. Only
doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.cluster import write_and_read
from meterline.llm.texts import ascii_lower

# Label, words of the text, words of its key phrase, base phrase or not.
TEMPLATES = (
    ("cc-by", "cc by", "cc by", True),
    ("gpl", "general public license", "general public license", True),
    ("reserved", "all rights reserved", "all rights reserved", True),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license", False),
    ("mit", "released under the mit license", "mit license", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source", False),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3", False),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     "gnu general public license version 2", False),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license", False),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license", False),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license", False),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", False),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", False),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd", False),
)
COVERAGE = 0.7
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def index_rows(templates: tuple = TEMPLATES) -> list[tuple[int, int, str, bool]]:
    """The positional index: (template, place, word, in the key phrase)."""
    rows = []
    for t, (_, text, phrase, _) in enumerate(templates):
        words, key = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        rows += [(t, i, w, at <= i < at + len(key)) for i, w in enumerate(words)]
    return rows


def _literal(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of constants."""
    made = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*made)).alias("x")).select("x.*")


def _lowered(text: Column) -> Column:
    # Of all other signs only the Kelvin sign has a lower-case form within ASCII.
    return F.when(text.contains("\u212A"), ascii_lower(text)).otherwise(F.lower(text))


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """(row, doc_id, n_words, hits): where the templates' words stand in each text; stored."""
    vocabulary = sorted({w for _, _, w, _ in index_rows(templates)})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(_lowered(text), F.lit(WORD), F.lit(0))
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(
        w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("word")))))
    made = (docs.select("doc_id", words.alias("words"))
            .select(F.monotonically_increasing_id().alias("row"), "doc_id",
                    F.size("words").cast("bigint").alias("n_words"), hits.alias("hits")))
    return write_and_read(made, "license-words")


def weighted_index(scanned: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """The index with integer IDF weights over all documents; a row per template word."""
    spark = scanned.sparkSession
    index = _literal(spark, index_rows(templates), ["t", "place", "word", "key"])
    seen = (scanned.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    total = scanned.agg(F.count(F.lit(1)).alias("n"))
    idf = F.round(1000 * F.log((F.col("n") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0))).cast("bigint") + 1
    return (index.join(F.broadcast(seen), "word", "left").join(F.broadcast(total))
            .select("t", "place", "word", "key", idf.alias("weight")))


def find(docs: DataFrame, templates: tuple = TEMPLATES, coverage: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """The scanned documents, and (row, t, start, share) of every template found."""
    scanned = scan(docs, templates)
    index = write_and_read(weighted_index(scanned, templates).coalesce(1), "license-index")
    rarest = (index.filter("key").groupBy("t")
              .agg(F.max(F.struct("weight", F.negative("place").alias("p"), "word")).alias("best"))
              .select("t", F.col("best.word").alias("word"), (-F.col("best.p")).alias("place")))
    leads = rarest.collect()  # one row per template
    names = sorted({r["word"] for r in leads})
    index = index.join(F.broadcast(rarest.select("t", "place", F.lit(True).alias("lead"))), ["t", "place"], "left")
    posting = F.struct("t", "place", "key", "weight", F.coalesce("lead", F.lit(False)).alias("lead"))
    postings = index.groupBy("word").agg(F.collect_list(posting).alias("postings"))
    totals = index.groupBy("t").agg(F.sum("weight").alias("total"), F.count_if("key").alias("keys"))
    votes = (scanned.filter(F.exists("hits", lambda h: h["word"].isin(names)))
             .select("row", F.explode("hits").alias("hit"))
             .select("row", F.col("hit.pos").alias("pos"), F.col("hit.word").alias("word"))
             .join(F.broadcast(postings), "word").select("row", "pos", F.explode("postings").alias("p"))
             .select("row", "p.*", (F.col("pos") - F.col("p.place")).alias("start")))
    agreed = votes.groupBy("row", "t", "start").agg(
        F.sum("weight").alias("weight"), F.count_if("key").alias("n_key"), F.max("lead").alias("lead"))
    found = (agreed.filter("lead").join(F.broadcast(totals), "t")
             .filter((F.col("n_key") == F.col("keys")) & (F.col("weight") >= coverage * F.col("total")))
             .select("row", "t", "start", (F.col("weight") / F.col("total")).alias("share")))
    return scanned, found


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    scanned, found = find(docs, templates, coverage)
    called = F.element_at(F.array(*[F.lit(x[0]) for x in templates]), F.col("t") + 1)
    base = F.element_at(F.array(*[F.lit(x[3]) for x in templates]), F.col("t") + 1)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_row = found.select("row", "start", "share", called.alias("label"), base.alias("base")).groupBy("row").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"))
    return (scanned.select("row", "doc_id", "n_words").join(per_row, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
                    F.col("first_word").cast("bigint").alias("first_word"),
                    F.col("last_word").cast("bigint").alias("last_word"),
                    F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                    F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")))
