"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from verification.check import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = ["p05_rate_in_force", "p12_turn_cost", "p15_peak_spend", "p22_rolling_usage", "g01_totals",
         "g10_by_surface", "g17_duplicates", "g20_main_cube", "g23_session_facts",
         "g24_reconcile", "c02_group_by", "c08_trailing_mean", "c10_peak_mask",
         "c15_rolling_behaviour", "a01_split_path", "a10_gap_fill_surface",
         "a10_gap_fill_one_session", "d12_peak_window", "d10_investment_concentration",
         "t05_change_points", "t06_events", "s12_turn_ordinal", "s15_running_total",
         "s20_step_calls", "s30_dedupe", "h02_share_metrics", "k02_person_days",
         "k08_merged_quantile", "x04_hourly_rollup", "x06_session_rollup", "p05_asof_last",
         "t10_asof_next", "a10_kept_fill"]


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    text, _, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_floor_never_exceeds_cost(spark):
    cube = entry.queries()["g20_main_cube"](spark, SF)
    assert cube.filter("cost_floor_micro > cost_micro").count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3
