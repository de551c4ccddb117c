"""Imports every module that registers queries."""

from verification import pricing_queries  # noqa: F401
from verification import rollup_queries  # noqa: F401
from verification import cube_queries  # noqa: F401
from verification import attribution_queries  # noqa: F401
from verification import detector_queries  # noqa: F401
from verification import trend_queries  # noqa: F401
from verification import source_queries  # noqa: F401
from verification import privacy_queries  # noqa: F401
from verification import stream_queries  # noqa: F401
from verification import kept_queries  # noqa: F401
