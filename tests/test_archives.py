"""Archives as a data source."""

from __future__ import annotations

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from turnwake.sources import archives, flights

HEADER = [*flights.RAW.names, "Unused"]


def line(day: str, number: int, **other) -> str:
    values = {"FlightDate": day, "Reporting_Airline": "WN", "Tail_Number": "", "Flight_Number_Reporting_Airline": str(number), "Origin": "ATL", "Dest": "DEN", "CRSDepTime": "0005", "DepDelay": "-3.00", "Cancelled": "0.00"} | other
    return ",".join(f'"{values.get(n, "")}"' for n in HEADER)


def archive(folder, year: int, month: int, lines: list[str]):
    path = folder / f"On_Time_{year}_{month}.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.html", "x")
        z.writestr("flights.csv", "\n".join([",".join(f'"{n}"' for n in HEADER), *lines]))
    return path


@pytest.fixture
def folder(tmp_path):
    archive(tmp_path, 2025, 12, [line(f"2025-12-{d:02d}", d) for d in range(1, 32)])
    archive(tmp_path, 2026, 1, [line(f"2026-01-{d:02d}", 100 + d, DepDelay="no number" if d == 3 else "7.5") for d in range(1, 32)])
    archive(tmp_path, 2026, 2, [line("2026-02-01", 200, FlightDate="not a day"), line("2026-02-02", 201, Tail_Number="N1")])
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def test_equal_rows_to_the_other_readers(spark, folder):
    got = archives.scan(spark, str(folder))
    assert got.columns == [*flights.RAW.names, "archive_month"] and got.rdd.getNumPartitions() == 3
    other = flights.read_archives(spark, *(str(p) for p in folder.glob("*.zip")))
    assert got.drop("archive_month").schema == other.schema
    assert sorted(map(str, got.drop("archive_month").collect())) == sorted(map(str, other.collect()))
    with zipfile.ZipFile(folder / "On_Time_2026_1.zip") as z:
        z.extract("flights.csv", folder)
    text = flights.read_csv(spark, str(folder / "flights.csv"))
    assert sorted(map(str, text.collect())) == sorted(map(str, got.filter("archive_month = '2026-01'").drop("archive_month").collect()))


@pytest.mark.parametrize(
    "condition, opened",
    [
        ("archive_month = '2026-01'", {"2026-01"}),
        ("archive_month IN ('2026-01', '2025-12')", {"2026-01", "2025-12"}),
        ("FlightDate = DATE '2026-01-31'", {"2026-01"}),
        ("FlightDate >= DATE '2026-01-31' AND FlightDate < DATE '2026-02-01'", {"2026-01"}),
        ("FlightDate > DATE '2025-12-31' AND Origin = 'ATL'", {"2026-01", "2026-02"}),
        ("FlightDate < DATE '2025-12-01'", set()),
        ("Origin = 'ATL' OR FlightDate = DATE '2026-01-31'", {"2025-12", "2026-01", "2026-02"}),
    ],
)
def test_a_filter_opens_only_archives_that_can_hold_rows(spark, folder, condition, opened):
    want = archives.scan(spark, str(folder)).persist()
    want = sorted(r["Flight_Number_Reporting_Airline"] for r in want.filter(condition).collect())
    for p in folder.glob("*.zip"):  # an archive that must not be opened cannot be
        year, month = p.stem.split("_")[-2:]
        if f"{year}-{int(month):02d}" not in opened:
            p.write_bytes(b"no archive")
    got = archives.scan(spark, str(folder)).filter(condition)
    assert sorted(r["Flight_Number_Reporting_Airline"] for r in got.collect()) == want
    if len(opened) < 3:
        assert got.rdd.getNumPartitions() == max(1, len(opened))


def test_only_the_columns_asked_for_are_parsed(spark, folder):
    got = archives.scan(spark, str(folder / "*_2026_*.zip"), ["Origin", "DepDelay"])
    assert got.columns == ["DepDelay", "Origin", "archive_month"] or got.columns == ["Origin", "DepDelay", "archive_month"]
    assert got.agg(F.count("DepDelay"), F.count("*")).first() == (32, 33)
    with pytest.raises(ValueError, match="no columns"):
        archives.scan(spark, str(folder), ["Nothing"])


def test_months_of_filters():
    assert archives._first_days("2025-12") == (dt.date(2025, 12, 1), dt.date(2026, 1, 1))
    assert archives.may_hold(None, archives.EqualTo(("archive_month",), "2026-01"))
    assert not archives.may_hold("2026-02", archives.In(("FlightDate",), (dt.date(2026, 1, 31), None)))


def test_a_folder_of_archives_feeds_the_build(spark, folder):
    assert flights.read(spark, str(folder / "*.zip")).count() == 64
