"""A provider described by a JSON spec, compiled to column expressions.

The spec names dotted paths for the fields of a turn, which records are turns,
and where tool calls live. Adding a provider is writing a dictionary.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.clock import epoch_to_iso
from meterline.functions.models import drop_snapshot_date, strip_gateway
from meterline.operators.attribution import Topology, session_id, workspace
from meterline.operators.scan import Scan, running
from meterline.schema import COUNTERS, conform
from meterline.sources import logs as L
from meterline.sources.elements import read_elements

# The counters that make a record a priced turn.
PRICED_BY = ("input", "output", "cache_create", "cache_read")


@dataclass
class SpecSource:
    spec: dict
    topology: Topology
    aliases: dict | None = None

    @property
    def provider(self) -> str:
        return self.spec["provider"]

    @property
    def fields(self) -> dict:
        return self.spec.get("fields") or {}

    def load(self, spark: SparkSession, modified_after: str | None = None) -> DataFrame:
        """Turns of every file behind the spec's roots, or of those changed since."""
        roots = self.spec.get("roots", [])
        if self.spec.get("format") == "json" and self.spec.get("records"):
            recs = read_elements(spark, roots, self.spec["records"], modified_after)
            return self.of_records(recs, L.split_chunk(spark, roots))
        if self.spec.get("format") == "json":
            return self.turns(L.read_documents(spark, roots, modified_after))
        return self.turns(L.read_lines(spark, roots, modified_after), L.split_chunk(spark, roots))

    def turns(self, lines: DataFrame, chunk: str | None = None) -> DataFrame:
        """Lines or documents -> turn events."""
        if self.spec.get("format") == "json":
            recs = L.array_records(lines, self.spec.get("records"))
        else:
            recs = L.records(lines)
        return self.of_records(recs, chunk)

    def of_records(self, recs: DataFrame, chunk: str | None = None) -> DataFrame:
        """Parsed records -> turn events."""
        return self.numbered(self._shape(recs.filter(self.is_turn()), recs), chunk=chunk)[0]

    def parsed(self, lines: DataFrame) -> DataFrame:
        """Lines of a JSONL log -> its turns without their numbers."""
        return self._shape(L.records(lines).filter(self.is_turn()), lines)

    def numbered(self, parsed: DataFrame, topology: Topology | None = None, provider: str | None = None,
                 chunk: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Numbered turns, and how many there are of each file for a later read to go on from."""
        base = F.col("base") if "base" in parsed.columns else F.lit(None).cast("bigint")
        # Only turns are numbered, so the filter came first.
        recs = running(parsed, ["file"], ["block", "line"], [Scan("turn", "total", F.coalesce(base, F.lit(1)))], chunk)
        turns = recs.filter(base.isNull()).withColumn("provider", F.lit(provider or self.provider))
        left = recs.groupBy("file").agg(F.max("turn").cast("bigint").alias("base"))
        return finish(turns, topology or self.topology), left

    def is_turn(self) -> Column:
        """The ``where`` paths match and some token counter is not zero."""
        counted = F.lit(False)
        for name in PRICED_BY:
            if self.fields.get(name):
                counted = counted | (L.counter("rec", self.fields[name]) != 0)
        return L.equals("rec", self.spec.get("where")) & counted

    def _text(self, name: str) -> Column:
        return L.dig("rec", self.fields.get(name))

    def from_path(self) -> tuple[Column, Column]:
        """(session id, sidechain flag) as the file's own path states them."""
        cfg = self.spec.get("from_path") or {}
        patterns = cfg.get("session") or []
        patterns = [patterns] if isinstance(patterns, str) else patterns
        usable = [p for p in patterns if _groups(p)]
        ids = [F.nullif(F.regexp_extract("file", p, 1), F.lit("")) for p in usable]
        side = cfg.get("sidechain")
        flag = F.col("file").rlike(side) if side and _groups(side) is not None else F.lit(False)
        return (F.coalesce(*ids) if ids else F.lit(None).cast("string")), flag

    def _shape(self, recs: DataFrame, lines: DataFrame) -> DataFrame:
        spec = self.spec
        path_session, path_side = self.from_path()
        entry = L.truthy(self._text("entrypoint"))
        mapped = F.coalesce(entry, F.lit(spec.get("default_entrypoint")))
        for raw, name in (spec.get("entrypoint_map") or {}).items():
            mapped = F.when(entry == raw, F.lit(name)).otherwise(mapped)
        model = F.coalesce(L.truthy(self._text("model")), F.lit(spec.get("default_model")))
        counts = {c: L.counter("rec", self.fields.get(c)) for c in COUNTERS}
        if spec.get("input_is_total"):
            counts["input"] = F.greatest(
                F.lit(0), counts["input"] - counts["cache_read"] - counts["cache_create"])
        side = F.coalesce(L.dig("rec", self.fields.get("sidechain"), "boolean"), F.lit(False))
        cfg = spec.get("tools") or {}
        blocks = F.filter(L.items("rec", cfg.get("list")),
                          lambda b: L.equals(b, cfg.get("where")))
        names = F.transform(blocks, lambda b: L.truthy(L.dig(b, cfg.get("name", "name"))))
        keys = cfg.get("path_args", ("file_path", "path"))
        return recs.select(
            "file", "block", "line", *(c for c in ("fresh",) if c in lines.columns),
            epoch_to_iso(self._text("ts"), spec.get("ts_unit")).alias("ts_raw"),
            session_id(F.coalesce(L.truthy(self._text("session")), path_session))
            .alias("session"),
            F.coalesce(self._text("cwd"), F.lit("")).alias("_cwd"),
            self._text("branch").alias("branch"), mapped.alias("entrypoint"),
            canonical(model, self.aliases).alias("model"), self._text("effort").alias("effort"),
            self._text("speed").alias("speed"), (side | path_side).alias("sidechain"),
            self._text("agent").alias("agent"), self._text("stop").alias("stop"),
            *[v.alias(c) for c, v in counts.items()],
            F.filter(names, lambda n: n.isNotNull()).alias("tools"),
            L.path_args(blocks, cfg.get("args", "input"), keys).alias("_paths"))


def _groups(pattern: str) -> int | None:
    """Capture groups of a pattern; None when it does not compile."""
    try:
        return re.compile(pattern).groups
    except re.error:
        return None


def canonical(model: Column, aliases: dict | None) -> Column:
    """Gateway and snapshot date removed, then one alias hop."""
    name = drop_snapshot_date(strip_gateway(model))
    if not aliases:
        return name
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), name)


def finish(framed: DataFrame, topology: Topology) -> DataFrame:
    """Workspace, repo, surfaces and lane from ``_cwd`` and ``_paths``; drop the paths."""
    placed = framed if "workspace" in framed.columns else \
        framed.withColumn("workspace", workspace(F.col("_cwd")))
    placed = topology.attribute(placed, F.col("_cwd"), F.col("_paths"))
    placed = placed.withColumn("lane", topology.lane(
        F.col("repo"), F.col("entrypoint"), F.col("provider")))
    return conform(placed.withColumn("seq", F.col("line")).drop("_cwd", "_paths"))


def load_specs(paths: list[str], topology: Topology, aliases: dict | None = None) -> list:
    """Spec files that parse and name a provider and roots; broken ones are left out."""
    out = []
    for path in sorted(paths):
        try:
            with open(path, encoding="utf-8") as handle:
                spec = json.load(handle)
        except (OSError, ValueError):
            continue
        if spec.get("provider") and spec.get("roots"):
            out.append(SpecSource(spec, topology, aliases))
    return out
