"""From raw records to marts, as one lazy plan.

Two shuffles carry everything: one by flight key to keep one record of each, one by aircraft
(carrier, tail) under which legs are ordered, linked, chained and counted. Every table
downstream is a projection of that wide leg table, so nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import at_midnight, clock_minutes, local_to_utc, minutes_between, plus_minutes
from ..functions.columns import cause_sums, day_period

MAX_TURN_MIN = 300
BLOCK_TOLERANCE_MIN = 30


def typed(raw: DataFrame) -> DataFrame:
    """Raw columns under their own names and types; blanks are null."""
    number = lambda c: F.col(c).try_cast("double")
    flag = lambda c: F.coalesce(number(c), F.lit(0.0)) == 1
    delays = {"carrier_delay": "CarrierDelay", "weather_delay": "WeatherDelay", "nas_delay": "NASDelay", "security_delay": "SecurityDelay", "late_aircraft_delay": "LateAircraftDelay"}
    return raw.select(
        F.col("FlightDate").try_cast("date").alias("flight_date"),
        F.col("Reporting_Airline").cast("string").alias("carrier"),
        F.nullif(F.trim(F.col("Tail_Number").cast("string")), F.lit("")).alias("tail_number"),
        F.col("Flight_Number_Reporting_Airline").try_cast("int").alias("flight_number"),
        F.col("Origin").cast("string").alias("origin"),
        F.col("Dest").cast("string").alias("dest"),
        clock_minutes(F.col("CRSDepTime")).alias("dep_clock"),
        clock_minutes(F.col("CRSArrTime")).alias("arr_clock"),
        number("DepDelay").alias("dep_delay"),
        number("ArrDelay").alias("arr_delay"),
        flag("Cancelled").alias("is_cancelled"),
        flag("Diverted").alias("is_diverted"),
        number("CRSElapsedTime").alias("crs_elapsed_min"),
        number("Distance").alias("distance_mi"),
        *(number(source).alias(name) for name, source in delays.items()),
    )


def staged(raw: DataFrame, airports: DataFrame) -> DataFrame:
    """One row per scheduled flight with both schedule times in UTC.

    The arrival's date is not published. It is the day on which the arrival clock, read in
    its own zone, comes nearest to departure plus block time; without a block time, the next
    day if the arrival clock is earlier.
    """
    # Sent to every task if the planner finds it small; shuffled otherwise.
    zone = lambda side: airports.select(F.col("iata").alias(side), F.col("tz").alias(f"{side}_tz"))
    t = typed(raw).join(zone("origin"), "origin", "left").join(zone("dest"), "dest", "left")
    dep_local = plus_minutes(at_midnight(F.col("flight_date")), F.col("dep_clock").cast("double"))
    same_day = plus_minutes(at_midnight(F.col("flight_date")), F.col("arr_clock").cast("double"))
    t = t.withColumns({"crs_dep_local": dep_local, "same_day": same_day})
    t = t.withColumn("crs_dep_utc", local_to_utc(F.col("crs_dep_local"), F.col("origin_tz")))
    short = minutes_between(local_to_utc(F.col("same_day"), F.col("dest_tz")), plus_minutes(F.col("crs_dep_utc"), F.col("crs_elapsed_min")))
    days = F.coalesce(F.round(short / 1440.0).cast("int"), F.when(F.col("arr_clock") < F.col("dep_clock"), 1).otherwise(0))
    t = t.withColumn("crs_arr_local", F.timestamp_add("DAY", days, F.col("same_day")))
    t = t.withColumn("crs_arr_utc", local_to_utc(F.col("crs_arr_local"), F.col("dest_tz")))
    key = F.concat("carrier", F.lit("-"), F.col("flight_number").cast("string"), F.lit("-"), "origin", F.lit("-"), F.date_format("crs_dep_local", "yyyyMMddHHmm"))
    t = t.withColumn("flight_id", key)
    # A record may come more than once; ties beyond the tail are broken by what the record says.
    best = Window.partitionBy("flight_id").orderBy(F.col("tail_number").asc_nulls_last(), F.xxhash64("dest", "dep_delay", "arr_delay", "is_cancelled", "is_diverted", "arr_clock"))
    t = t.withColumn("copy", F.row_number().over(best)).filter("copy = 1")
    return t.select(
        "flight_id",
        "flight_date",
        F.date_format("flight_date", "yyyy-MM").alias("flight_month"),
        *("carrier", "tail_number", "flight_number", "origin", "dest", "origin_tz", "dest_tz"),
        *("crs_dep_local", "crs_arr_local", "crs_dep_utc", "crs_arr_utc"),
        F.hour("crs_dep_local").alias("dep_hour_local"),
        "crs_elapsed_min",
        (minutes_between(F.col("crs_dep_utc"), F.col("crs_arr_utc")) - F.col("crs_elapsed_min")).alias("block_time_residual_min"),
        *("dep_delay", "arr_delay"),
        plus_minutes(F.col("crs_dep_utc"), F.col("dep_delay")).alias("act_dep_utc"),
        plus_minutes(F.col("crs_arr_utc"), F.col("arr_delay")).alias("act_arr_utc"),
        *("is_cancelled", "is_diverted", "distance_mi"),
        ((F.col("arr_delay") >= 15) & F.col("carrier_delay").isNotNull()).alias("has_cause_codes"),
        *("carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay"),
    )


def is_operated() -> Column:
    """Legs that took place by an aircraft that is known, with a consistent schedule."""
    there = [F.col(c).isNotNull() for c in ("tail_number", "crs_dep_utc", "crs_arr_utc", "dep_delay")]
    consistent = F.abs(F.coalesce("block_time_residual_min", F.lit(0.0))) <= BLOCK_TOLERANCE_MIN
    out = ~F.col("is_cancelled") & consistent & (F.col("crs_arr_utc") > F.col("crs_dep_utc"))
    for c in there:
        out = out & c
    return out


def sequenced(staging: DataFrame, max_turn_min: int = MAX_TURN_MIN) -> DataFrame:
    """Every operated leg with its place in its aircraft's chain: all staging columns and
    chain_no, chain_id, leg_seq, chain_legs, chain_date, is_linked and the turn before it.

    A leg is linked to the one before when the aircraft goes on from there: same station,
    not diverted, a scheduled stay of 0 to ``max_turn_min`` minutes and an actual one that
    is not negative. A leg that is not linked begins a chain.
    """
    aircraft = Window.partitionBy("carrier", "tail_number").orderBy("crs_dep_utc", "flight_id")
    before = F.lag(F.struct("flight_id", "dest", "crs_arr_utc", "arr_delay", "is_diverted")).over(aircraft)
    t = staging.filter(is_operated()).withColumn("before", before)
    t = t.withColumn("stay", minutes_between(F.col("before.crs_arr_utc"), F.col("crs_dep_utc")))
    t = t.withColumn("actual_stay", F.col("stay") + F.col("dep_delay") - F.col("before.arr_delay"))
    goes_on = (F.col("before.dest") == F.col("origin")) & ~F.col("before.is_diverted") & F.col("stay").between(0, max_turn_min) & (F.col("actual_stay") >= 0)
    t = t.withColumn("is_linked", F.coalesce(goes_on, F.lit(False)))
    t = t.withColumn("chain_no", F.sum((~F.col("is_linked")).cast("long")).over(aircraft.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chain = Window.partitionBy("carrier", "tail_number", "chain_no")
    place = chain.orderBy("crs_dep_utc", "flight_id")
    if_linked = lambda c: F.when(F.col("is_linked"), c)
    return t.select(
        *staging.columns,
        "chain_no",
        F.concat("carrier", F.lit("-"), "tail_number", F.lit("-"), F.col("chain_no").cast("string")).alias("chain_id"),
        F.row_number().over(place).cast("long").alias("leg_seq"),
        F.count("*").over(chain).alias("chain_legs"),
        F.first("flight_date").over(place).alias("chain_date"),
        "is_linked",
        if_linked(F.col("before.flight_id")).alias("prev_flight_id"),
        if_linked(F.col("stay")).alias("sched_turn_min"),
        if_linked(F.col("actual_stay")).alias("actual_turn_min"),
        if_linked(F.col("before.arr_delay")).alias("inbound_arr_delay"),
        if_linked(F.col("before.crs_arr_utc")).alias("inbound_crs_arr_utc"),
    )


def leg_sequence(wide: DataFrame, *more: str) -> DataFrame:
    return wide.select(
        *("flight_id", "carrier", "tail_number", "chain_id", "leg_seq", "chain_legs", "chain_date", "is_linked"),
        *("prev_flight_id", "sched_turn_min", "actual_turn_min", "inbound_arr_delay", "inbound_crs_arr_utc", *more),
    )


def rotations(wide: DataFrame, *more: str) -> DataFrame:
    """One row per turn: an inbound leg and the leg that the aircraft flies next."""
    return wide.filter("is_linked").select(
        F.col("flight_id").alias("turn_id"),
        F.col("prev_flight_id").alias("in_flight_id"),
        F.col("flight_id").alias("out_flight_id"),
        "chain_id",
        F.col("leg_seq").alias("out_leg_seq"),
        *("carrier", "tail_number"),
        F.col("origin").alias("station"),
        F.col("inbound_crs_arr_utc").alias("in_crs_arr_utc"),
        F.col("crs_dep_utc").alias("out_crs_dep_utc"),
        *("sched_turn_min", "actual_turn_min", "inbound_arr_delay"),
        F.col("dep_delay").alias("outbound_dep_delay"),
        *more,
    )


def legs(wide: DataFrame) -> DataFrame:
    return wide.select(
        *("flight_id", "flight_date", "flight_month", "carrier", "tail_number", "chain_id", "chain_date", "leg_seq", "chain_legs"),
        (F.col("chain_legs") - F.col("leg_seq")).alias("legs_remaining"),
        *("origin", "dest", "dep_hour_local"),
        day_period(F.col("dep_hour_local")).alias("dep_period"),
        *("crs_dep_utc", "crs_arr_utc", "is_linked", "prev_flight_id", "sched_turn_min", "inbound_arr_delay", "dep_delay", "arr_delay", "is_diverted"),
        *("carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay"),
    )


def turns(wide: DataFrame) -> DataFrame:
    return wide.filter("is_linked").select(
        F.col("flight_id").alias("turn_id"),
        F.col("prev_flight_id").alias("in_flight_id"),
        F.col("flight_id").alias("out_flight_id"),
        *("chain_id", "carrier", "tail_number"),
        F.col("origin").alias("station"),
        *("flight_date", "flight_month", "dep_hour_local", "sched_turn_min", "actual_turn_min", "inbound_arr_delay"),
        F.col("dep_delay").alias("outbound_dep_delay"),
        F.col("arr_delay").alias("outbound_arr_delay"),
        (F.col("sched_turn_min") - F.greatest(F.col("inbound_arr_delay"), F.lit(0.0))).alias("available_turn_min"),
        F.col("late_aircraft_delay").alias("outbound_late_aircraft_delay"),
    )


def share(c: Column) -> Column:
    """The share of rows for which a condition holds; unknown counts as no."""
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def airport_hour(staging: DataFrame) -> DataFrame:
    flown = staging.filter("NOT is_cancelled").groupBy(F.col("origin").alias("airport"), "dep_hour_local")
    return flown.agg(F.count("*").alias("flights"), F.avg("dep_delay").alias("mean_dep_delay"), share(F.col("dep_delay") >= 15).alias("share_dep_delayed_15"), *cause_sums())


def carrier_month(staging: DataFrame) -> DataFrame:
    flown = ~F.col("is_cancelled") & ~F.col("is_diverted")
    on_time = F.avg(F.when(flown, F.when(F.col("arr_delay") < 15, 1.0).otherwise(0.0)))
    return staging.groupBy("carrier", "flight_month").agg(
        F.count("*").alias("flights"), share(F.col("is_cancelled")).alias("cancel_rate"), on_time.alias("on_time_rate"), *cause_sums()
    )


def delay_causes(staging: DataFrame) -> DataFrame:
    out = staging.filter("NOT is_cancelled").groupBy("carrier", "dep_hour_local").agg(F.count("*").alias("flights"), *cause_sums())
    return out.withColumn("total_cause_min", F.col("carrier_min") + F.col("weather_min") + F.col("nas_min") + F.col("security_min") + F.col("late_aircraft_min"))


@dataclass(frozen=True)
class Warehouse:
    """The tables of one build, each a lazy plan until written or cached."""

    airports: DataFrame
    stg_flights: DataFrame
    wide: DataFrame
    max_turn_min: int = MAX_TURN_MIN
    counted: dict[str, int] | None = None  # rows that break expectations, if the tables were counted as they were written

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {
            "airports": self.airports,
            "stg_flights": self.stg_flights,
            "int_leg_sequence": leg_sequence(self.wide),
            "int_rotations": rotations(self.wide),
            "fct_legs": legs(self.wide),
            "fct_turns": turns(self.wide),
            "agg_airport_hour": airport_hour(self.stg_flights),
            "agg_carrier_month": carrier_month(self.stg_flights),
            "agg_delay_causes": delay_causes(self.stg_flights),
        }

    @property
    def legs(self) -> DataFrame:
        return legs(self.wide)

    @property
    def turns(self) -> DataFrame:
        return turns(self.wide)


def build(raw: DataFrame, airports: DataFrame, max_turn_min: int = MAX_TURN_MIN) -> Warehouse:
    staging = staged(raw, airports)
    return Warehouse(airports, staging, sequenced(staging, max_turn_min), max_turn_min)


#: Tables that are stored by month, and those of them whose rows do not have it themselves.
MONTHLY = ("stg_flights", "int_chains", "int_leg_sequence", "int_rotations", "fct_legs", "fct_turns", "agg_carrier_month")
WITHOUT_MONTH = ("int_leg_sequence", "int_rotations")


def of_chains(wide: DataFrame) -> dict[str, DataFrame]:
    """The tables that are projections of the chains, with the month under which they are stored."""
    return {"int_leg_sequence": leg_sequence(wide, "flight_month"), "int_rotations": rotations(wide, "flight_month"), "fct_legs": legs(wide), "fct_turns": turns(wide)}


def store(df: DataFrame, folder: str, name: str) -> DataFrame:
    """A table as Parquet, and the plan that reads it. Of a table by month only the months of ``df`` are replaced."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if name in MONTHLY:
        writer = writer.partitionBy("flight_month").option("partitionOverwriteMode", "dynamic")
    writer.parquet(f"{folder}/{name}")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")  # also of no rows
    return stored.drop("flight_month") if name in WITHOUT_MONTH else stored


def write(warehouse: Warehouse, folder: str) -> Warehouse:
    """All tables as Parquet, and the warehouse that reads them; by month, so that a plan over some
    months reads only those.

    Staging and chains are written first and read by what follows: each shuffle runs once. What another month
    needs to go on from here is kept beside them (``incremental``). ``folder`` is new, or has the same months.
    """
    from . import incremental, quality

    counts = quality.Counts()
    put = lambda df, name: store(counts.watched(name, df), folder, name)
    staging = put(warehouse.stg_flights, "stg_flights").select(*warehouse.stg_flights.columns)
    wide = store(sequenced(staging, warehouse.max_turn_min), folder, "int_chains")
    airports = put(warehouse.airports, "airports")
    for name, df in of_chains(wide).items():
        put(df, name)
    store_marts(staging, staging, put)
    incremental.keep_state(wide, None, incremental.last_month(staging), warehouse.max_turn_min, folder)
    return Warehouse(airports, staging, wide, warehouse.max_turn_min, counts.broken())


def store_marts(staging: DataFrame, months: DataFrame, put: Callable[[DataFrame, str], DataFrame]) -> None:
    """The marts: those by month of ``months``, the others of all of ``staging``."""
    put(carrier_month(months), "agg_carrier_month")
    put(airport_hour(staging), "agg_airport_hour")
    put(delay_causes(staging), "agg_delay_causes")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    stored = spark.read.parquet(f"{folder}/{name}")
    return stored.drop("flight_month") if name in WITHOUT_MONTH else stored
