"""Months added one by one against a build of all at once."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.toy import flight, raw
from turnwake.plans import incremental, quality, warehouse
from turnwake.sources import airports

ZONES = {"ATL": -5, "DEN": -7, "HNL": -10, "GUM": 10, "LAX": -8}


def year_of_flights(seed: int = 1) -> list[tuple[str, tuple]]:
    """(month, flight) of aircraft that fly through the ends of months, also across the date line."""
    rng, out, number = random.Random(seed), [], 1
    for tail in range(14):
        at, now = rng.choice(list(ZONES)), dt.datetime(2025, 11, 29, rng.randint(0, 23))
        while now < dt.datetime(2026, 2, 3):
            to = rng.choice([z for z in ZONES if z != at])
            block = rng.choice([60, 180, 400])
            local, there = now + dt.timedelta(hours=ZONES[at]), now + dt.timedelta(minutes=block, hours=ZONES[to])
            delay = float(rng.randint(-5, 40))
            out.append((f"{local:%Y-%m}", flight(number, f"{local:%Y-%m-%d}", "WN" if tail % 2 else "AA", f"N{tail}", at, to, f"{local:%H%M}", f"{there:%H%M}", float(block), dep_delay=delay, arr_delay=delay + rng.randint(-9, 9))))
            number += 1
            at = to if rng.random() < 0.9 else at
            now += dt.timedelta(minutes=block + rng.choice([40, 90, 200, 500, 2000]))
            if now.day > 3 and now.day < 27:  # only the ends of months are of interest
                now += dt.timedelta(days=27 - now.day)
    return out


def places(spark):
    return airports.airports(spark)


def same(spark, a: str, b: str) -> None:
    for name in ("stg_flights", "int_chains", "int_leg_sequence", "int_rotations", "fct_legs", "fct_turns", "agg_airport_hour", "agg_carrier_month", "agg_delay_causes", "int_open/after=2026-02", "int_aircraft/after=2026-02"):
        tables = [warehouse.read_table(spark, f, name) for f in (a, b)]
        assert sorted(tables[0].columns) == sorted(tables[1].columns), name
        one, two = (df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes))) for df in tables)
        assert one.count() == two.count() and one.exceptAll(two).isEmpty(), name


@pytest.fixture(scope="module")
def flown():
    return year_of_flights()


def built(spark, rows, folder: str) -> warehouse.Warehouse:
    return warehouse.write(warehouse.build(raw(spark, rows), places(spark)), folder)


def test_months_added_equal_all_at_once(spark, flown, tmp_path):
    months = sorted({m for m, _ in flown})
    assert len(months) == 4
    built(spark, [f for _, f in flown], f"{tmp_path}/all")
    built(spark, [f for m, f in flown if m == months[0]], f"{tmp_path}/some")
    for m in months[1:-1]:
        incremental.add_months(spark, raw(spark, [f for x, f in flown if x == m]), f"{tmp_path}/some")
    last = raw(spark, [f for x, f in flown if x == months[-1]])
    done = incremental.add_months(spark, last, f"{tmp_path}/some")
    same(spark, f"{tmp_path}/all", f"{tmp_path}/some")
    over = warehouse.read_table(spark, f"{tmp_path}/all", "int_chains").groupBy("chain_id").agg(F.count_distinct("flight_month").alias("n")).filter("n > 1").count()
    assert over > 3, "no chain goes through the end of a month"
    assert quality.check(spark, done.tables) is not None
    # Again, as after a run that broke off: the same tables.
    incremental.add_months(spark, last, f"{tmp_path}/some")
    same(spark, f"{tmp_path}/all", f"{tmp_path}/some")
    with pytest.raises(ValueError, match="not kept"):
        incremental.add_months(spark, last, f"{tmp_path}/all")
    with pytest.raises(ValueError, match="in order"):
        incremental.add_months(spark, raw(spark, [f for x, f in flown if x == months[1]]), f"{tmp_path}/some")


def test_only_months_that_change_are_written(spark, flown, tmp_path):
    months = sorted({m for m, _ in flown})
    built(spark, [f for m, f in flown if m in months[:3]], str(tmp_path))
    written = lambda: {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in (tmp_path / "fct_legs").glob("*/*.parquet")}
    before = written()
    incremental.add_months(spark, raw(spark, [f for x, f in flown if x == months[3]]), str(tmp_path))
    after = written()
    assert set(after) - set(before) == {f"flight_month={months[3]}"}
    assert [k for k in before if before[k] != after[k]] == [f"flight_month={months[2]}"]


def test_a_plan_over_a_month_reads_that_month(spark, flown, tmp_path):
    w = built(spark, [f for _, f in flown], str(tmp_path))
    for df in (w.stg_flights, w.wide, w.legs):
        files = df.filter("flight_month = '2026-01'").select(F.input_file_name().alias("f")).distinct().collect()
        assert files and all("flight_month=2026-01" in r["f"] for r in files)


def test_no_new_flights(spark, flown, tmp_path):
    built(spark, [f for m, f in flown if m == "2025-12"], str(tmp_path))
    n = warehouse.read_table(spark, str(tmp_path), "fct_legs").count()
    assert incremental.add_months(spark, raw(spark, []), str(tmp_path)).legs.count() == n
