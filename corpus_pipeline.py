"""A corpus pipeline of five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept;
its result is written and read again before the next. All but the last return the columns of
``documents``. The stages' docstrings in ``meterline.llm`` say what happens to nulls, empty
and repeated rows, further columns and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.cluster import write_and_read
from meterline.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from meterline.llm.mixing_queries import TARGETS, labelled_domains
from meterline.llm.registry import query
from meterline.llm.texts import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go. The model learns from the whole
    tables of ``sf_dir``."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.toxic_free(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are cut out; ``n_chars`` follows the new text."""
    kept = line_dedup.drop_lines(docs)
    changed = F.col(kept.columns[-1]) > 0
    columns = [F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
               if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.clean_of(docs, table(spark, sf_dir, "benchmark"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is drawn, so that tokens per language meet the targets.

    One row per document that is drawn at all: doc_id, source, n_tokens, domain, rate, copies.
    """
    labelled = labelled_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, TARGETS).filter("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("mixing", mix_languages),
]

# The trained models and the iterative fit have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


query("pipeline", ORACLE_SQL)(run)
