"""Registered queries against their SQL on the smallest tables. PANELCAST_CORE=1 runs a few of each kind."""

import os

import duckdb
import pytest
from check_oracles import TABLES, compare

import __spark_entry__ as entry

CORE = [
    "naive_delay_by_route", "clean_flights", "daily_route_agg", "panel", "ffill_limit", "weather_pair_features",
    "holiday_asof_next", "build_features", "metrics_overall", "walk_forward_eval", "paired_t_test", "carrier_performance",
    "corr_matrix", "sequence_windows", "scan_flights_csv", "sink_report", "score_sequences", "segment_box_stats",
]
ORACLES = entry.oracle_sql()
NAMES = [n for n in (CORE if os.environ.get("PANELCAST_CORE") else entry.queries()) if n in ORACLES]


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    _, _, verdict, detail = compare(spark, con, name, sf_dir, ORACLES[name])
    assert verdict.startswith("ok"), (verdict, detail)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
