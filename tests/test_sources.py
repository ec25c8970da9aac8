from __future__ import annotations

import datetime as dt
import io
import json
import urllib.error
import zipfile

import pandas as pd
import pytest

from turnwake import cli
from turnwake.plans import publish, warehouse
from turnwake.session import only_row
from turnwake.sources import adapter, airports, flights, sample

from .toy import ROTATION, flight, raw


def test_month_before():
    assert flights.month_before((2026, 1)) == (2025, 12) and flights.month_before((2026, 12)) == (2026, 11)


def test_newest_window():
    there = {(2025, m) for m in range(8, 13)} | {(2026, m) for m in range(1, 8)}
    window = flights.newest_window(12, dt.date(2026, 10, 2), exists=there.__contains__)
    assert window[0] == (2025, 8) and window[-1] == (2026, 7) and len(window) == 12
    with pytest.raises(RuntimeError, match="missing"):
        flights.newest_window(12, dt.date(2026, 10, 2), exists=(there - {(2026, 3)}).__contains__)
    with pytest.raises(RuntimeError, match="no file"):
        flights.newest_window(12, dt.date(2026, 10, 2), exists=lambda m: False)


class Answer(io.BytesIO):
    status = 200


def opener(codes):
    def open_(request, timeout):
        if (code := codes.get(request.get_method(), 200)) != 200:
            raise urllib.error.HTTPError(request.full_url, code, "no", None, None)
        return Answer()

    return open_


@pytest.mark.parametrize(("code", "there"), [(200, True), (404, False), (410, False)])
def test_published_or_not(code, there):
    assert flights.is_published((2026, 7), opener({"HEAD": code})) is there


def test_other_errors_are_raised():
    with pytest.raises(urllib.error.HTTPError):
        flights.is_published((2026, 7), opener({"HEAD": 429}))


def test_fetch_cache_and_read(spark, tmp_path):
    header = ",".join(["Year", *flights.RAW.names, "Extra"])
    line = "2026,2026-07-01,WN,N1,7,ATL,ORD,0605,0606,1.0,2400,,-3.0,0.0,0.0,120.0,606.0,,,,,,x"
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("readme.html", "no")
        z.writestr("july.csv", f"{header}\n{line}\n")
    calls = []

    def once(address, timeout):
        calls.append(address)
        return Answer(archive.getvalue())

    path = flights.fetch((2026, 7), tmp_path, once)
    assert flights.fetch((2026, 7), tmp_path, once) == path and len(calls) == 1 and not list(tmp_path.glob("*.part"))
    target = flights.cache_month(spark, path, str(tmp_path / "flights_2026_07.parquet"))
    r = flights.read(spark, target).first()
    assert (r["CRSDepTime"], r["CRSArrTime"], r["ArrTime"], r["CarrierDelay"], r["FlightDate"]) == ("0605", "2400", None, None, dt.date(2026, 7, 1))
    assert flights.read(spark, target).schema.names == flights.RAW.names
    (tmp_path / "f.csv").write_text(f"{header}\n{line}\n")
    assert flights.read(spark, str(tmp_path / "f.csv")).first() == r


def test_sample_takes_whole_tails(spark, tmp_path):
    df = raw(spark, ROTATION)
    got = sample.whole_tails(df, ["2026-07-01"], 1)
    tails = {(r["Reporting_Airline"], r["Tail_Number"]) for r in got.collect()}
    assert len(tails) == 3 and got.filter("Reporting_Airline = 'WN'").count() in (5, 2)
    assert sample.whole_tails(df, ["2026-07-02"]).count() == 0
    sample.write_csv(got, str(tmp_path / "s"))
    assert flights.read_csv(spark, str(tmp_path / "s")).count() == got.count()


def test_adapter_is_in_the_published_layout(spark):
    df, _ = adapter.test_flights(spark, "/root/testdata/sf0.001")
    assert df.schema.names == flights.RAW.names and [f.dataType for f in df.schema] == [f.dataType for f in flights.RAW]


def results():
    tables = {
        "reactionary_by_hour": pd.DataFrame({"dep_hour_local": [6, 18], "primary_per_flight": [3.0, 4.0], "reactionary_per_flight": [1.0, 9.0]}),
        "cause_shares_by_carrier": pd.DataFrame({"name": ["Delta", "United", "Alaska"], "reactionary_share": [0.5, 0.25, 0.25]}),
        "hinge_carriers": pd.DataFrame([{"group": "WN", "tau": 48.0, "tau_lo": 47.0, "tau_hi": 49.0, "beta": 0.98, "beta_lo": 0.9, "beta_hi": 1.0, "mae_constant": 22.5, "mae_hinge": 11.25}]),
    }
    summary = {"network": {"flights": 1234567, "turns": 10, "chains_with_turns": 5, "first_month": "2025-08", "last_month": "2026-07", "reactionary_share": 0.397426}, "propagation": {"mae": {"hinge": 11.25}}, "nan": float("nan")}
    return tables, summary


def test_results_come_back_and_make_a_page(tmp_path):
    tables, summary = results()
    publish.write(tables, summary, tmp_path)
    back, told = publish.read(tmp_path)
    assert told["nan"] is None and set(back) == set(tables) and json.loads((tmp_path / "summary.json").read_text())["network"]["flights"] == 1234567
    h = publish.headlines(back, told)
    assert h["flights"] == "1,234,567" and h["peak_hour"] == "18:00" and h["reactionary_share"] == "39.7%" and h["period"] == "Aug 2025 - Jul 2026"
    assert h["share_range"] == "25% (Alaska, United) to 50% (Delta)"
    assert "| Southwest | 48 [47, 49] | 0.98 [0.90, 1.00] | 22.5 / 11.2 |" in h["carriers_table"]
    assert publish.page("$flights $chart_causes $table_hinge_carriers", back, told).startswith("1,234,567 [{")
    with pytest.raises(KeyError):
        publish.page("$nothing", back, told)
    (tmp_path / "t.html").write_text("<p>$turns</p>")
    cli.main(["report", "--results", str(tmp_path), "--template", str(tmp_path / "t.html"), "--out", str(tmp_path / "o.html")])
    assert (tmp_path / "o.html").read_text() == "<p>10</p>"
    cli.main(["report", "--results", str(tmp_path), "--out", str(tmp_path / "p.html")])
    assert "1,234,567 flights from Aug 2025 - Jul 2026" in (tmp_path / "p.html").read_text()


def test_headlines_of_a_whole_run():
    tables, summary = results()
    # A night hour with few flights is no peak.
    tables["reactionary_by_hour"] = pd.DataFrame({"dep_hour_local": [2, 6, 18, 19], "primary_per_flight": 3.0, "reactionary_per_flight": [40.0, 1.0, 9.0, 9.0]})
    tables["carrier_rotations"] = pd.DataFrame({"carrier": ["WN", "DL"], "legs_per_aircraft_day": [5.5, 4.0], "median_sched_turn_min": [45.0, 60.0]})
    tables["contagion_robustness"] = pd.DataFrame([{"variant": n, "n_events": 10, "multiplier": 0.9, "multiplier_lo": 0.8, "multiplier_hi": 1.0, "small_slip_multiplier": 1.5} for n in "abcd"])
    tables["superspreaders"] = pd.DataFrame({"origin": ["A", "B"], "city": ["X", "Y"], "multiplier": [1.0, 1.2], "carrier_mix": 0.9, "excess_over_mix": [0.3, 0.1], "excess_over_mix_lo": [0.2, 0.0], "excess_over_mix_hi": [0.4, 0.15]})
    row = {"avoided_test": 1000.0, "avoided_test_lo": 900.0, "avoided_test_hi": 1100.0, "gain_vs_uniform": 400.0, "gain_vs_uniform_lo": 300.0, "gain_vs_uniform_hi": 500.0, "buffer_test": 700.0, "avoided_per_buffer_min": 1.5, "cells_padded": 12}
    tables["buffer_frontier"] = pd.DataFrame([row | {"policy": p, "budget": 600.0} for p in publish.QUOTED.values()])
    tables["buffer_sensitivity"] = pd.DataFrame([{"tau_eval": 30.0, "beta_eval": 0.9, "policy": "LP-optimised", "avoided_test": 10.0, "per_min_vs_uniform": v} for v in (1.5, 1.9)])
    summary["contagion"] = {"overall": {"multiplier": 0.98, "multiplier_lo": 0.96, "multiplier_hi": 1.0, "n_events": 7}, "matched_events": 9, "late_aircraft_coded": {"share_events": 0.1, "share_primary_min": 0.2}}
    summary["buffer"] = {"carrier": "WN", "reference_budget": 600.0, "turns_per_day_train": 3000.0, "uniform_at_lp_spend": 650.0, "baseline_delay_per_day_test": 20000.0, "reference": {p: row for p in publish.QUOTED.values()}}
    h = publish.headlines(tables, summary)
    assert h["peak_hour"] == "18:00" and h["carrier_legs_rank"] == "1" and h["shortest_median_turn"] == "45 min (Southwest)"
    assert h["worst_airports"] == "A (X) and B (Y)" and h["worst_airport_stands_out"] == "yes" and h["multiplier_with_origin"] == "0.90"
    assert h["lp_avoided"] == "1,000 [900, 1,100]" and h["uniform_seconds"] == "12" and h["lp_share_of_delay"] == "5.0%" and h["lp_times_uniform_range"] == "1.5 to 1.9"
    assert len(h) > 60


def test_airports_from_a_table(spark, tmp_path):
    rows = [f"S{i:02d},Field {i},City {i},State,{zone},{30 + i / 7},{-90 - i / 7},US" for i, zone in enumerate(["America/Chicago", "America/Denver", "America/New_York"] * 10)]
    (tmp_path / "a.csv").write_text("\n".join(["iata,name,city,subd,tz,lat,lon,country", *rows, "FRA,F,F,H,Europe/Berlin,50,8,DE", ",x,x,x,America/Denver,1,2,US"]))
    got = airports.load(spark, str(tmp_path / "a.csv"))
    assert got.columns == list(airports.FIELDS) and [r["iata"] for r in got.collect()] == [f"S{i:02d}" for i in range(30)]
    assert got.first()["lat"] == 30.0 and got.collect()[1]["lon"] == -90.14286
    flown = [flight(i, "2026-07-01", "WN", f"N{i}", f"S{i:02d}", f"S{(i + 1) % 30:02d}", "0800", "0930", 90.0) for i in range(30)]
    raw(spark, flown).write.parquet(str(tmp_path / "flights" / "m.parquet"))
    built = warehouse.build(flights.read(spark, str(tmp_path / "flights" / "*")), got)
    assert built.stg_flights.filter("crs_dep_utc IS NOT NULL AND crs_arr_utc IS NOT NULL").count() == 30


def test_one_row_or_an_error(spark):
    assert only_row(spark.range(1))["id"] == 0
    for n in (0, 2):
        with pytest.raises(ValueError):
            only_row(spark.range(n))


def test_tables_of_policies():
    f = pd.DataFrame([{"policy": "Uniform", "budget": 40.0, "avoided_test": 30.0, "avoided_test_lo": 20.0, "avoided_test_hi": 41.0, "buffer_test": 39.0, "avoided_per_buffer_min": 0.77}])
    assert "| Uniform | 30 [20, 41] | 39 | 0.77 |" in publish.policy_table(f, 40.0)
    s = pd.DataFrame([{"tau_eval": 30.0, "beta_eval": 0.9, "policy": p, "per_min_vs_uniform": v} for p, v in (("Uniform", 1.0), ("Greedy", 1.5))])
    assert "| 30 | 0.90 |" in publish.sensitivity_table(s)
    r = pd.DataFrame([{"variant": "Headline", "n_events": 1000, "multiplier": 0.98, "multiplier_lo": 0.96, "multiplier_hi": 1.0, "small_slip_multiplier": 1.2}])
    assert "| Headline | 1,000 | 0.98 [0.96, 1.00] | 1.20 |" in publish.robustness_table(r)


def test_airports_of_a_wider_table(spark):
    """Rows without code or zone and places abroad go; of two rows with one code the first by name stays."""
    world = [
        ("US", "ATL", "Hartsfield", "Atlanta", "Georgia", "America/New_York", 33.6366996, -84.4278640), ("US", "ATL", "A second row", "Atlanta", "Georgia", "America/New_York", 33.0, -84.0),
        ("US", "", "Private", "Nowhere", "Ohio", "America/New_York", 40.0, -82.0), ("US", "XXZ", "No Zone", "Nowhere", "Ohio", "", 40.0, -82.0), ("DE", "FRA", "F", "F", "H", "Europe/Berlin", 50.0, 8.5),
        ("PR", "SJU", "San Juan", "San Juan", None, "America/Puerto_Rico", 18.4393997, -66.0018005),
    ]
    got = airports.seeded(spark.createDataFrame(world, "country string, iata string, name string, city string, subd string, tz string, lat double, lon double")).collect()
    assert [(r["iata"], r["name"], r["lat"]) for r in got] == [("ATL", "A second row", 33.0), ("SJU", "San Juan", 18.4394)]
