"""Airports with their time zones: a table given by the caller, and a small fixed one for tests.

Clock times are local, so every station of the flights needs its zone. ``load`` reads a CSV or
Parquet table with a row per airport; a file of all the world's airports has some ten thousand
rows, and what is kept of it some hundred, so the planner broadcasts it by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Iata, name, city, state, zone, latitude, longitude.
AIRPORTS = (
    ("ATL", "Hartsfield-Jackson Atlanta", "Atlanta", "Georgia", "America/New_York", 33.6367, -84.42786),
    ("BWI", "Baltimore/Washington", "Baltimore", "Maryland", "America/New_York", 39.17542, -76.66819),
    ("DAL", "Dallas Love Field", "Dallas", "Texas", "America/Chicago", 32.84594, -96.85089),
    ("DCA", "Ronald Reagan Washington National", "Washington", "District of Columbia", "America/New_York", 38.85144, -77.03772),
    ("DEN", "Denver International", "Denver", "Colorado", "America/Denver", 39.86167, -104.67317),
    ("DTW", "Detroit Metropolitan", "Detroit", "Michigan", "America/Detroit", 42.21243, -83.35339),
    ("GUM", "Antonio B. Won Pat International", "Hagatna", "Guam", "Pacific/Guam", 13.48345, 144.79598),
    ("HNL", "Daniel K. Inouye International", "Honolulu", "Hawaii", "Pacific/Honolulu", 21.31782, -157.92023),
    ("HOU", "William P. Hobby", "Houston", "Texas", "America/Chicago", 29.64542, -95.27889),
    ("JFK", "John F. Kennedy International", "New York", "New York", "America/New_York", 40.63993, -73.77869),
    ("LAS", "Harry Reid International", "Las Vegas", "Nevada", "America/Los_Angeles", 36.08004, -115.15223),
    ("LAX", "Los Angeles International", "Los Angeles", "California", "America/Los_Angeles", 33.9425, -118.40805),
    ("LGA", "LaGuardia", "New York", "New York", "America/New_York", 40.77725, -73.87261),
    ("MCO", "Orlando International", "Orlando", "Florida", "America/New_York", 28.42939, -81.309),
    ("MDW", "Chicago Midway", "Chicago", "Illinois", "America/Chicago", 41.78598, -87.75242),
    ("MIA", "Miami International", "Miami", "Florida", "America/New_York", 25.79325, -80.29056),
    ("ORD", "Chicago O'Hare", "Chicago", "Illinois", "America/Chicago", 41.97862, -87.90484),
    ("PDX", "Portland International", "Portland", "Oregon", "America/Los_Angeles", 45.58872, -122.5975),
    ("PHX", "Phoenix Sky Harbor", "Phoenix", "Arizona", "America/Phoenix", 33.43429, -112.01158),
    ("SEA", "Seattle-Tacoma International", "Seattle", "Washington", "America/Los_Angeles", 47.44895, -122.30934),
)


#: The countries and territories whose carriers report.
COUNTRIES = ("US", "PR", "VI", "GU", "MP", "AS")
FIELDS = ("iata", "name", "city", "state", "tz", "lat", "lon")


def seeded(table: DataFrame, countries: tuple[str, ...] = COUNTRIES) -> DataFrame:
    """(iata, name, city, state, tz, lat, lon) of the airports with code and zone in ``countries``, by iata.

    The state may be called ``subd``; a table without ``country`` is taken whole. Of rows with one
    code the first by name stays, so that no flight is doubled.
    """
    state = "state" if "state" in table.columns else "subd"
    own = table.filter(F.col("country").isin(*countries)) if "country" in table.columns else table
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    place = lambda c: F.round(F.col(c).cast("double"), 5)
    own = own.select(text("iata").alias("iata"), *(text(c).alias(n) for c, n in (("name", "name"), ("city", "city"), (state, "state"), ("tz", "tz"))), place("lat").alias("lat"), place("lon").alias("lon"))
    rest = FIELDS[1:]
    one = own.filter("iata IS NOT NULL AND tz IS NOT NULL").groupBy("iata").agg(F.min_by(F.struct(*rest), F.struct(*rest)).alias("x"))
    return one.select("iata", *(F.col(f"x.{c}").alias(c) for c in rest)).orderBy("iata")


def load(spark: SparkSession, path: str, countries: tuple[str, ...] = COUNTRIES) -> DataFrame:
    """``seeded`` from a CSV file with a header or a Parquet table."""
    return seeded(spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path), countries)


def airports(spark: SparkSession, rows: tuple = AIRPORTS) -> DataFrame:
    """(iata, name, city, state, tz, lat, lon), by iata; rows without code or zone are left out."""
    kept = sorted((*r[:5], round(r[5], 5), round(r[6], 5)) for r in rows if r[0] and r[4])
    quoted = lambda v: "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else f"{v!r}D"
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in kept)
    # Inline values, so that the planner knows how small the table is.
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(iata, name, city, state, tz, lat, lon)")
