"""Names for missing values; '' counts as missing everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an absent value is called in a breakdown and in the cube.
BREAKDOWN_MISSING = {
    "model": "unknown", "workspace": "unknown", "lane": "unknown", "provider": "unknown",
    "entrypoint": "unknown", "phase": "unknown", "effort": "unset",
    "repo": "unattributed", "surface": "unattributed", "agent": "unnamed",
}
CUBE_MISSING = {
    "repo": "unattributed", "surface": "unattributed", "effort": "unset",
    "hour": "unknown", "phase": "flat",
}
MAIN_THREAD = "main thread"
UNKNOWN_HOUR = "??"
PLACEHOLDER_MODEL = "<synthetic>"


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def breakdown_label(name: str) -> Column:
    return F.coalesce(blank_to_null(F.col(name)), F.lit(BREAKDOWN_MISSING.get(name, "unknown")))


def cube_label(name: str, col: Column | None = None) -> Column:
    col = F.col(name) if col is None else col
    return F.coalesce(blank_to_null(col), F.lit(CUBE_MISSING.get(name, "unknown")))
