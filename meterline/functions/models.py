"""Model names as they arrive and as the rate card spells them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gateway wrappers and vendor prefixes that are known to be seen,
# and the dated-snapshot suffix.
GATEWAY_PREFIXES = ("llm-gateway--",)
VENDOR_PREFIXES = ("openai", "anthropic", "google", "azure", "bedrock", "vertex")
DATE_SUFFIX = r"-[0-9]{8}$"


def strip_gateway(model: Column) -> Column:
    """Drop a known wrapper and vendor slash; a wrapper around nothing stays."""
    name = F.regexp_replace(model, r"^\s+|\s+$", "")
    for prefix in GATEWAY_PREFIXES:
        name = F.when(F.startswith(name, F.lit(prefix)) & (F.length(name) > len(prefix)),
                      F.substring(name, len(prefix) + 1, 1_000)).otherwise(name)
    name = F.regexp_replace(name, "^(?:" + "|".join(VENDOR_PREFIXES) + ")/(?=.)", "")
    return F.nullif(name, F.lit(""))


def drop_snapshot_date(model: Column) -> Column:
    return F.regexp_replace(model, DATE_SUFFIX, "")


def card_name(model: Column) -> Column:
    """Gateway and snapshot date removed; the alias hop is a join, see pricing."""
    return F.coalesce(drop_snapshot_date(strip_gateway(model)), F.lit(""))


def known_model(model: Column) -> Column:
    """The model as grouped and shown: gateway-stripped, otherwise as spelled."""
    return F.coalesce(strip_gateway(model), model)
