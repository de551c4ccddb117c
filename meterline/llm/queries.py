"""Imports every module of queries of this subpackage."""

from meterline.llm import dedup_queries, filter_queries, mixing_queries  # noqa: F401
from meterline.llm import model_queries, search_queries, selection_queries  # noqa: F401
from meterline.llm.registry import ORACLES, QUERIES  # noqa: F401
