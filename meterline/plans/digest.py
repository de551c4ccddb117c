"""The digest: every report frame over one enriched turn table.

``Digest`` holds lazy DataFrames. On a big store call ``Digest.stored`` so that
gap-fill and pricing are computed once and every report reads pruned columns of
the stored table instead.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from meterline.cluster import write_and_read
from meterline.config import RateCard
from meterline.operators import rollups as R
from meterline.operators.attribution import Topology
from meterline.operators.pricing import RateTables, peak_premium, unpriced_models

WRITERS = 4  # reports written at a time


@dataclass
class Digest:
    priced: DataFrame
    turns: DataFrame
    card: RateCard
    rates: RateTables

    @classmethod
    def of(cls, turns: DataFrame, topology: Topology, card: RateCard,
           rates: RateTables | None = None, zone: str | float = 0) -> "Digest":
        rates = rates or RateTables.from_card(turns.sparkSession, card)
        return cls(R.enrich(turns, topology, rates, zone), turns, card, rates)

    def stored(self) -> "Digest":
        """Write the enriched turns to the shared folder and report from there."""
        return Digest(write_and_read(self.priced, "priced"), self.turns, self.card, self.rates)

    @cached_property
    def totals(self) -> DataFrame:
        return R.totals(self.priced)

    @cached_property
    def sidechain(self) -> DataFrame:
        return R.sidechain_totals(self.priced)

    @cached_property
    def window(self) -> DataFrame:
        return R.window_span(self.priced)

    @cached_property
    def by_day(self) -> DataFrame:
        return R.by_day(self.priced)

    def by(self, name: str) -> DataFrame:
        return R.by_agent(self.priced) if name == "agent" else R.breakdown(self.priced, name)

    @cached_property
    def by_model(self) -> DataFrame:
        return self.by("model")

    @cached_property
    def by_tool(self) -> DataFrame:
        return R.by_tool(self.priced)

    @cached_property
    def by_hour(self) -> DataFrame:
        return R.by_hour(self.priced)

    @cached_property
    def by_phase(self) -> DataFrame:
        return self.by("phase")

    @cached_property
    def peak_premium(self) -> DataFrame:
        return peak_premium(self.priced)

    @cached_property
    def sessions(self) -> DataFrame:
        return R.session_facts(self.priced)

    @cached_property
    def unpriced(self) -> DataFrame:
        return R.unpriced(self.priced)

    @cached_property
    def unpriced_models(self) -> DataFrame:
        return unpriced_models(self.priced)

    @cached_property
    def duplicates(self) -> DataFrame:
        """Keys are taken after gap-fill and gateway strip, as grouped and shown."""
        return R.duplicates(self.priced)

    @cached_property
    def synthetic(self) -> DataFrame:
        return R.synthetic_count(self.priced)

    @cached_property
    def windows(self) -> DataFrame:
        return R.active_windows(self.priced, self.rates)

    @cached_property
    def cube(self) -> DataFrame:
        return R.main_cube(self.priced)

    @cached_property
    def hours(self) -> DataFrame:
        return R.hours_cube(self.priced)

    @cached_property
    def tools(self) -> DataFrame:
        return R.tools_cube(self.priced)

    def frames(self) -> dict[str, DataFrame]:
        """Every report by name."""
        out = {"totals": self.totals, "sidechain": self.sidechain, "window": self.window,
               "by_day": self.by_day, "by_tool": self.by_tool, "by_hour": self.by_hour,
               "by_agent": self.by("agent"), "duplicates": self.duplicates,
               "synthetic": self.synthetic, "unpriced": self.unpriced,
               "unpriced_models": self.unpriced_models, "windows": self.windows,
               "peak_premium": self.peak_premium, "sessions": self.sessions,
               "cube": self.cube, "hours": self.hours, "tools": self.tools}
        out.update({f"by_{n}": self.by(n) for n in R.BREAKDOWNS})
        return out

    def write(self, path: str, fmt: str = "parquet") -> None:
        """Digest sink: one folder per report; a few are written at a time, so that the last tasks
        of one leave no core idle. The first error is raised when the others have ended."""
        def put(report: tuple[str, DataFrame]) -> None:
            name, frame = report
            frame.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")

        with ThreadPoolExecutor(WRITERS) as pool:
            # Listed first: some reports run jobs of their own when they are built.
            list(pool.map(inheritable_thread_target(self.priced.sparkSession)(put), list(self.frames().items())))
