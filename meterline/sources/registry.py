"""Log sources that know where their files lie and how to read them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from meterline.operators.attribution import Topology
from meterline.sources import logs as L
from meterline.sources import native as N
from meterline.sources.resume import GrowingLogs
from meterline.sources.spec import load_specs
from meterline.sources.store import Source

# Where the tools of the four native log shapes keep their logs.
ROOTS = {
    "claude-code": ["~/.claude/projects/*/*.jsonl", "~/.claude/projects/*/*/*.jsonl"],
    "codex": ["~/.codex/sessions/*/*/*/rollout-*.jsonl"],
    "kimi-code": ["~/.kimi-code/sessions/*/*/agents/*/wire.jsonl", "~/.kimi-code/sessions/*/*/wire.jsonl"],
    "antigravity": ["~/.gemini/antigravity/brain/*/.system_generated/logs/transcript.jsonl"],
}
INDEX, WORKSPACES = "~/.kimi-code/session_index.jsonl", "~/.kimi-code/workspaces.json"


@dataclass
class LogSource:
    """Files of one provider. A changed file is read whole; the store's keys tell what is new."""

    provider: str
    globs: list[str]
    read: Callable[..., DataFrame]
    topology: Topology
    # Small side tables: name of the reader's parameter -> how to read it.
    sides: dict[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)

    def load(self, spark: SparkSession, modified_after: str | None = None) -> DataFrame:
        lines = L.read_lines(spark, self.globs, modified_after)
        sides = {name: read(spark) for name, read in self.sides.items()}
        return self.read(lines, self.topology, provider=self.provider,
                         chunk=L.split_chunk(spark, self.globs), **sides)

    def source(self) -> Source:
        return Source(self.provider, self.load)


def _side_tables(index: str, workspaces: str) -> dict[str, Callable[[SparkSession], DataFrame]]:
    return {"index": lambda spark: N.session_index(L.read_lines(spark, index)),
            "workspaces": lambda spark: N.workspace_names(L.read_documents(spark, workspaces))}


def growing_sources(topology: Topology, store: str, roots: dict[str, list[str]] | None = None, index: str = INDEX,
                    workspaces: str = WORKSPACES, specs: list[str] | None = None) -> list[GrowingLogs]:
    """Native sources and JSONL specs that read on where the last ingest ended, for ``resume.sync_grown``.

    Specs of whole JSON documents are not among them: such a document is read anew when it changes.
    """
    at = {**ROOTS, **(roots or {})}
    shapes = {"claude-code": N.TRANSCRIPT, "codex": N.ROLLOUT, "kimi-code": N.OPLOG, "antigravity": N.PLANNER}
    native = [GrowingLogs(name, L.expand(at[name]), shape, topology, store,
                          _side_tables(index, workspaces) if shape is N.OPLOG else {}) for name, shape in shapes.items()]
    return native + [GrowingLogs(s.provider, L.expand(s.spec["roots"]), N.Shape(s.parsed, s.numbered), topology, store)
                     for s in load_specs(specs or [], topology) if s.spec.get("format") != "json"]


def native_sources(topology: Topology, roots: dict[str, list[str]] | None = None,
                   index: str = INDEX, workspaces: str = WORKSPACES) -> list[LogSource]:
    """The four native log shapes at their usual places, or at the given ones."""
    at = {**ROOTS, **(roots or {})}
    sides = _side_tables(index, workspaces)
    return [LogSource("claude-code", at["claude-code"], N.transcript, topology),
            LogSource("codex", at["codex"], N.rollout, topology),
            LogSource("kimi-code", at["kimi-code"], N.oplog, topology, sides),
            LogSource("antigravity", at["antigravity"], N.planner, topology)]


def all_sources(topology: Topology, specs: list[str] | None = None, **places) -> list[Source]:
    """Native sources, then those that spec files describe, ready for ``store.sync``."""
    described = load_specs(specs or [], topology)
    return [*(s.source() for s in native_sources(topology, **places)),
            *(Source(s.provider, s.load) for s in described)]
