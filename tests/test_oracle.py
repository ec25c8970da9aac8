"""Queries against their SQL on the smallest test tables."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from turnwake.plans import queries as core  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("raw_flights", "stg_flights", "fct_legs", "fct_turns", "agg_airport_hour", "carrier_rotations", "network_summary", "hinge_fit", "holdout_scores", "contagion_events", "carrier_adjusted", "chain_replay", "marginal_score", "greedy_policy", "rounded_policy", "fixture_sample", "dq_report", "airports", "contagion_events_by_day", "robustness_points", "scenario_legs_of_month", "steps_in_order", "mean_gain_by_size", "stations_without_test", "superspreaders", "multiplier_curve", "gbm_root_gains", "dense_flight_ids", "aircraft_without_test")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return f"{x:.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


#: These find no row in the smallest tables, or in any.
MAYBE_EMPTY = {"stations_without_test"}


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, db, name):
    df = core.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in names) for r in df.collect()), key=str)
    assert got or name in MAYBE_EMPTY
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    place = [rel.columns.index(c) for c in names]
    assert got == sorted((tuple(value(r[i]) for i in place) for r in rel.fetchall()), key=str)


def test_every_query_has_sql_or_is_known_to_have_none():
    assert set(core.ORACLE_SQL) == set(core.QUERIES)
    assert not set(core.UNCHECKED) & set(core.QUERIES)
    assert set(entry.queries()) >= set(core.QUERIES) | set(core.UNCHECKED)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
