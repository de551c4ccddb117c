"""Queries of near-duplicate detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterline.llm import near_dedup
from meterline.llm.registry import query
from meterline.llm.texts import table


@query("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the smallest doc_id of its class and the size of the class."""
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
