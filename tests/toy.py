"""A hand-made schedule in the published layout, with what it has to become."""

from __future__ import annotations

import datetime as dt

from turnwake.sources.flights import RAW


def flight(number, day, carrier, tail, origin, dest, dep, arr, block, dep_delay=0.0, arr_delay=0.0, cancelled=0.0, diverted=0.0, causes=(None,) * 5):
    d = dt.date.fromisoformat(day)
    return (d, carrier, tail, number, origin, dest, dep, None, dep_delay, arr, None, arr_delay, cancelled, diverted, block, 100.0, *causes)


#: Clock changes, the date line and midnight; (departure, arrival) in UTC.
CLOCKS = [
    (flight(1, "2026-07-01", "AA", "T1", "LAX", "JFK", "2330", "0755", 325.0), "2026-07-02 06:30", "2026-07-02 11:55"),
    (flight(2, "2026-03-08", "AA", "T2", "JFK", "MIA", "0130", "0430", 120.0), "2026-03-08 06:30", "2026-03-08 08:30"),
    (flight(3, "2025-11-02", "AA", "T3", "ORD", "LGA", "0030", "0245", 135.0), "2025-11-02 05:30", "2025-11-02 07:45"),
    (flight(4, "2026-07-01", "HA", "T4", "HNL", "LAX", "2200", "0600", 300.0), "2026-07-02 08:00", "2026-07-02 13:00"),
    (flight(5, "2026-07-01", "UA", "T5", "GUM", "HNL", "2300", "1100", 480.0), "2026-07-01 13:00", "2026-07-01 21:00"),
    (flight(6, "2026-07-01", "AA", "T6", "PHX", "ORD", "2400", "0530", 210.0), "2026-07-02 07:00", "2026-07-02 10:30"),
    (flight(7, "2026-03-08", "DL", "T7", "ATL", "MCO", "0230", "0400", 30.0), "2026-03-08 07:30", "2026-03-08 08:00"),
    (flight(8, "2025-11-02", "AA", "T8", "ORD", "DTW", "0130", "0300", 90.0), "2025-11-02 06:30", "2025-11-02 08:00"),
    (flight(9, "2026-07-01", "AA", "T9", "DEN", "PHX", "605", "0650", None), "2026-07-01 12:05", "2026-07-01 13:50"),
]
#: One aircraft's day with a cancelled leg and a long stay, and three pairs that do not link.
ROTATION = [
    flight(11, "2026-07-01", "WN", "R1", "MDW", "DEN", "0600", "0710", 130.0, 20.0, 25.0, causes=(25.0, 0.0, 0.0, 0.0, 0.0)),
    flight(12, "2026-07-01", "WN", "R1", "DEN", "PHX", "0800", "0820", 80.0, 30.0, 28.0, causes=(3.0, 0.0, 0.0, 0.0, 25.0)),
    flight(13, "2026-07-01", "WN", "R1", "PHX", "MDW", "0900", "1400", 180.0, None, None, cancelled=1.0),
    flight(14, "2026-07-01", "WN", "R1", "PHX", "LAS", "0930", "1035", 65.0, 10.0, 5.0),
    flight(15, "2026-07-01", "WN", "R1", "LAS", "MDW", "2000", "0130", 210.0, 0.0, -5.0),
    flight(21, "2026-07-01", "WN", "R2", "DAL", "HOU", "0700", "0800", 60.0, 0.0, 90.0, causes=(0.0, 0.0, 90.0, 0.0, 0.0)),
    flight(22, "2026-07-01", "WN", "R2", "HOU", "DAL", "0830", "0930", 60.0),
    flight(31, "2026-07-01", "DL", "R3", "ATL", "BWI", "0700", "0900", 120.0),
    flight(32, "2026-07-01", "DL", "R3", "DCA", "ATL", "1000", "1200", 120.0),
    flight(41, "2026-07-01", "AS", "R4", "SEA", "PDX", "0800", "0900", 60.0, 0.0, None, diverted=1.0),
    flight(42, "2026-07-01", "AS", "R4", "PDX", "SEA", "1000", "1100", 60.0),
    flight(42, "2026-07-01", "AS", None, "PDX", "SEA", "1000", "1100", 60.0),
]


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)
