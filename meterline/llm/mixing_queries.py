"""The query that mixes documents to target weights of languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import mixing
from meterline.llm.registry import query
from meterline.llm.texts import table

# Wanted shares of tokens.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the documents that the labels table covers."""
    return (docs.select("doc_id", F.col("lang").alias("domain")).filter("lang is not null")
            .join(labels.select("doc_id"), "doc_id", "left_semi"))


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)
