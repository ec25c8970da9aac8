from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from turnwake.functions.clock import clock_minutes, minutes_between
from turnwake.plans import quality
from turnwake.plans import warehouse as W
from turnwake.sources.airports import airports

from .toy import CLOCKS, ROTATION, flight, raw


@pytest.fixture(scope="module")
def built(spark):
    return W.build(raw(spark, [c[0] for c in CLOCKS] + ROTATION), airports(spark))


def test_clock_times_in_utc(built):
    got = {r[0]: (r[1], r[2]) for r in built.stg_flights.select("flight_number", *(F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("crs_dep_utc", "crs_arr_utc"))).collect()}
    for row, dep, arr in CLOCKS:
        assert got[row[3]] == (dep, arr), row[3]


def test_block_time_comes_back(built):
    assert built.stg_flights.agg(F.max(F.abs("block_time_residual_min"))).first()[0] == 0


def test_midnight_departure_keeps_its_published_date(built):
    r = built.stg_flights.filter("flight_number = 6").first()
    assert str(r["flight_date"]) == "2026-07-01" and r["flight_id"] == "AA-6-PHX-202607020000"


def test_repeated_record_keeps_the_one_with_a_tail(built):
    rows = built.stg_flights.filter("flight_number = 42").collect()
    assert [r["tail_number"] for r in rows] == ["R4"]


def test_chain_of_one_aircraft(built):
    rows = built.legs.filter("tail_number = 'R1'").orderBy("crs_dep_utc").collect()
    got = [(r["flight_id"].split("-")[1], r["leg_seq"], r["chain_legs"], r["legs_remaining"], r["sched_turn_min"], r["inbound_arr_delay"]) for r in rows]
    assert got == [("11", 1, 3, 2, None, None), ("12", 2, 3, 1, 50, 25.0), ("14", 3, 3, 0, 70, 28.0), ("15", 1, 1, 0, None, None)]


def test_only_real_turns_link(built):
    rows = built.turns.orderBy("turn_id").collect()
    assert [(r["in_flight_id"].split("-")[1], r["out_flight_id"].split("-")[1]) for r in rows] == [("11", "12"), ("12", "14")]
    assert (rows[1]["actual_turn_min"], rows[1]["available_turn_min"]) == (52, 42)


def test_longer_turns_can_be_allowed(spark):
    w = W.build(raw(spark, ROTATION), airports(spark), max_turn_min=600)
    assert w.turns.filter("tail_number = 'R1'").count() == 3


def test_one_shuffle_by_aircraft(built):
    plan = built.turns._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(carrier") == 1
    assert "SortMergeJoin" not in plan


def test_times_at_minute_marks(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:50", "2024-01-01 00:01:10", "2400"), ("2024-01-01 00:00:00", "2024-01-01 01:00:00", "605")], "a string, b string, c string")
    got = df.select(minutes_between(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")), clock_minutes(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(1, 1440), (60, 365)]


def test_empty_input(spark):
    w = W.build(raw(spark, []), airports(spark))
    assert all(w.tables[t].count() == 0 for t in ("stg_flights", "fct_legs", "fct_turns", "agg_carrier_month"))


def test_expectations(spark, built):
    assert quality.check(spark, built.tables) == []
    assert len(quality.EXPECTATIONS) == 37
    bad = W.build(raw(spark, [flight(1, "2026-07-01", "XX", "T", "ATL", "QQQ", "0600", "0710", 130.0)]), airports(spark))
    status = {r["expectation"]: (r["broken"], r["status"]) for r in quality.report(bad.tables).collect()}
    assert status["accepted_stg_flights_carrier"] == (1, "warn")
    assert status["related_stg_flights_dest_airports"] == (1, "error")
    assert status["not_null_stg_flights_crs_arr_utc"] == (1, "error")
    with pytest.raises(ValueError, match="related_stg_flights_dest"):
        quality.check(spark, bad.tables)


def test_written_tables_are_read_back(spark, built, tmp_path):
    W.write(built, str(tmp_path))
    assert W.read_table(spark, str(tmp_path), "fct_turns").count() == 2


def test_rows_are_counted_while_tables_are_written(spark, tmp_path):
    """The same report as one that looks again, without reading what single rows break."""
    rows = [flight(1, "2026-07-01", "XX", "T", "ATL", "QQQ", "0600", "0710", 130.0), flight(2, "2026-07-01", "WN", "T", "ATL", "ORD", "0600", "0710", 500.0), flight(3, "2026-07-01", "WN", "U", "DAL", "HOU", "0700", "0800", 60.0), flight(4, "2026-07-01", "WN", "U", "HOU", "DAL", "0830", "0930", 60.0)]
    done = W.write(W.build(raw(spark, rows), airports(spark)), str(tmp_path))
    of_rows = {e.name for e in quality.EXPECTATIONS if e.table}
    assert set(done.counted) == of_rows and done.counted["accepted_stg_flights_carrier"] == 1
    short = quality.report(done.tables, counted=done.counted)
    key = lambda r: r["expectation"]
    assert sorted(short.collect(), key=key) == sorted(quality.report(done.tables).collect(), key=key)
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "block_time_residual_min" not in scans(short) and "block_time_residual_min" in scans(quality.report(done.tables))
    with pytest.raises(ValueError, match="not met"):
        quality.check(spark, done.tables, done.counted)
