"""Raw flight records made of the ``events`` test table, in the published layout.

A user is an aircraft, an event a departure, and the user's next event tells where to. Local
dates and clock fields are written as a carrier would publish them, so staging has all its
work to do. ``RAW_SQL`` is the same in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import plus_minutes, utc_to_local
from .airports import airports
from .flights import RAW

#: Carriers by user_id modulo 5; airports by event type.
CARRIER_CODES = ("AA", "DL", "OO", "UA", "WN")
STATIONS = {"view": "ATL", "click": "ORD", "purchase": "DEN", "signup": "PHX", "error": "LAX"}
ZONES = {"ATL": "America/New_York", "ORD": "America/Chicago", "DEN": "America/Denver", "PHX": "America/Phoenix", "LAX": "America/Los_Angeles", "HNL": "Pacific/Honolulu"}


def flights_of_events(events: DataFrame) -> DataFrame:
    known = F.create_map(*(F.lit(x) for kv in STATIONS.items() for x in kv))
    zones = F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv))
    carriers = F.array(*map(F.lit, CARRIER_CODES))
    rows = events.select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"), F.element_at(known, F.col("event_type")).alias("origin"))
    following = F.lead("origin").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = rows.withColumn("dest", F.when((F.col("event_id") % 17 == 0) | following.isNull(), "HNL").otherwise(following))
    number = F.col("event_id")
    void = lambda c, when: F.when(~when, c)
    cancelled, diverted = number % 97 == 0, number % 89 == 0
    dep = void(F.round("value") - 30, cancelled)
    rows = rows.select(
        "*", F.date_trunc("minute", "ts").alias("dep_utc"), (20 + number % 41).cast("double").alias("block"), cancelled.alias("cancelled"), diverted.alias("diverted"), dep.alias("dep")
    )
    rows = rows.withColumn("arr", void(F.col("dep") + number * 13 % 31 - 15, F.col("diverted")))
    late = F.floor(F.col("arr") * (number % 5) / 5)
    weather = F.floor((F.col("arr") - late) * (number % 3) / 6)
    nas = F.floor((F.col("arr") - late) * (number % 7) / 14)
    coded = F.col("arr") >= 15
    cause = lambda c: F.when(coded, c.cast("double"))
    out = utc_to_local(F.col("dep_utc"), F.element_at(zones, F.col("origin")))
    there = utc_to_local(plus_minutes(F.col("dep_utc"), F.col("block")), F.element_at(zones, F.col("dest")))
    clock = lambda c, late=None: F.date_format(c if late is None else plus_minutes(c, late), "HHmm")
    made = {
        "FlightDate": out.cast("date"),
        "Reporting_Airline": F.element_at(carriers, (F.col("user_id") % 5 + 1).cast("int")),
        "Tail_Number": F.when(number % 101 != 0, F.concat(F.lit("N"), F.col("user_id").cast("string"))),
        "Flight_Number_Reporting_Airline": number.cast("int"),
        "Origin": F.col("origin"),
        "Dest": F.col("dest"),
        "CRSDepTime": clock(out),
        "DepTime": clock(out, F.col("dep")),
        "DepDelay": F.col("dep"),
        "CRSArrTime": clock(there),
        "ArrTime": clock(there, F.col("arr")),
        "ArrDelay": F.col("arr"),
        "Cancelled": F.col("cancelled").cast("double"),
        "Diverted": F.col("diverted").cast("double"),
        "CRSElapsedTime": F.col("block"),
        "Distance": (100 + number % 2000).cast("double"),
        "CarrierDelay": cause(F.col("arr") - late - weather - nas),
        "WeatherDelay": cause(weather),
        "NASDelay": cause(nas),
        "SecurityDelay": cause(F.lit(0)),
        "LateAircraftDelay": cause(late),
    }
    return rows.select(*(made[n].alias(n) for n in RAW.names))


def test_flights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(raw flights, airports) of a folder of test tables."""
    return flights_of_events(spark.read.parquet(f"{sf_dir}/events.parquet")), airports(spark)


_ZONE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ZONES.items()) + " END"
RAW_SQL = f"""
ev AS (SELECT event_id AS n, user_id AS u, value AS v, CAST(ts AS TIMESTAMP) AS ts, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATIONS.items())} END AS o FROM events),
go AS (SELECT *, lead(o) OVER (PARTITION BY u ORDER BY ts, n) AS nxt FROM ev),
fl AS (SELECT *, CASE WHEN n % 17 = 0 OR nxt IS NULL THEN 'HNL' ELSE nxt END AS d, date_trunc('minute', ts) AS t0, 20 + n % 41 AS block,
              CASE WHEN n % 97 <> 0 THEN round(v) - 30 END AS dep FROM go),
fd AS (SELECT *, CASE WHEN n % 89 <> 0 THEN dep + n * 13 % 31 - 15 END AS arr FROM fl),
fc AS (SELECT *, floor(arr * (n % 5) / 5) AS late FROM fd),
fw AS (SELECT *, floor((arr - late) * (n % 3) / 6) AS wx, floor((arr - late) * (n % 7) / 14) AS ns,
              timezone({_ZONE.format("o")}, timezone('UTC', t0)) AS lo, timezone({_ZONE.format("d")}, timezone('UTC', t0 + to_minutes(block))) AS la FROM fc),
raw AS (SELECT CAST(lo AS DATE) AS day, CASE u % 5 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CARRIER_CODES))} END AS carrier, CASE WHEN n % 101 <> 0 THEN 'N' || u END AS tail,
               CAST(n AS INTEGER) AS number, o AS origin, d AS dest, strftime(lo, '%H%M') AS dep_clock, strftime(la, '%H%M') AS arr_clock, dep, arr,
               n % 97 = 0 AS cancelled, n % 89 = 0 AS diverted, CAST(block AS DOUBLE) AS block, CAST(100 + n % 2000 AS DOUBLE) AS miles,
               CASE WHEN arr >= 15 THEN arr - late - wx - ns END AS c_carrier, CASE WHEN arr >= 15 THEN wx END AS c_weather, CASE WHEN arr >= 15 THEN ns END AS c_nas,
               CASE WHEN arr >= 15 THEN 0.0::DOUBLE END AS c_security, CASE WHEN arr >= 15 THEN late END AS c_late FROM fw)
"""
