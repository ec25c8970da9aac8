"""Expectations on tables: each is a plan for the rows that break it.

Those that a row breaks by itself are counted together, by the job that writes their table or in one pass over
it; keys and references take a plan each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .warehouse import BLOCK_TOLERANCE_MIN

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Expectation:
    """``broken`` gives the breaking rows; above ``warn`` rows it warns, above ``error`` it fails (None: never).

    ``table`` and ``bad`` say the same of an expectation that single rows break.
    """

    name: str
    broken: Callable[[Tables], DataFrame]
    warn: int | None = None
    error: int | None = 0
    table: str | None = None
    bad: Callable[[], Column] | None = None


def of_rows(name: str, table: str, bad: Callable[[], Column], warn: int | None = None, error: int | None = 0) -> Expectation:
    return Expectation(name, lambda t: t[table].filter(bad()), warn, error, table, bad)


def not_null(table: str, column: str) -> Expectation:
    return of_rows(f"not_null_{table}_{column}", table, lambda: F.col(column).isNull())


def unique(table: str, column: str) -> Expectation:
    return Expectation(f"unique_{table}_{column}", lambda t: t[table].filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1"))


def accepted(table: str, column: str, values: tuple, warn_only: bool = False) -> Expectation:
    return of_rows(f"accepted_{table}_{column}", table, lambda: ~F.col(column).isin(*values), 0 if warn_only else None, None if warn_only else 0)


def related(table: str, column: str, parent: str, field: str) -> Expectation:
    def bad(t: Tables) -> DataFrame:
        known = t[parent].select(F.col(field).alias("__known")).distinct()
        return t[table].filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__known"), "left_anti").select(column)

    return Expectation(f"related_{table}_{column}_{parent}", bad)


def _unordered(t: Tables) -> DataFrame:
    landed = F.lag("crs_arr_utc").over(Window.partitionBy("chain_id").orderBy("leg_seq"))
    rows = t["fct_legs"].select("chain_id", "leg_seq", "crs_dep_utc", "crs_arr_utc").withColumn("landed", landed)
    return rows.filter((F.col("crs_arr_utc") <= F.col("crs_dep_utc")) | (F.col("landed") > F.col("crs_dep_utc")))


#: Carriers that are expected.
KNOWN_CARRIERS = ("AA", "AS", "B6", "DL", "F9", "G4", "HA", "MQ", "NK", "OH", "OO", "UA", "WN", "YX", "9E", "QX", "ZW", "PT", "C5", "G7", "EV", "CP")

EXPECTATIONS: tuple[Expectation, ...] = (
    unique("airports", "iata"),
    not_null("airports", "iata"),
    not_null("airports", "tz"),
    unique("stg_flights", "flight_id"),
    *(not_null("stg_flights", c) for c in ("flight_id", "carrier", "origin", "dest", "crs_dep_utc", "crs_arr_utc", "is_cancelled")),
    accepted("stg_flights", "carrier", KNOWN_CARRIERS, warn_only=True),
    related("stg_flights", "origin", "airports", "iata"),
    related("stg_flights", "dest", "airports", "iata"),
    unique("int_leg_sequence", "flight_id"),
    not_null("int_leg_sequence", "flight_id"),
    related("int_leg_sequence", "flight_id", "stg_flights", "flight_id"),
    not_null("int_leg_sequence", "chain_id"),
    unique("int_rotations", "turn_id"),
    not_null("int_rotations", "turn_id"),
    not_null("int_rotations", "in_flight_id"),
    unique("int_rotations", "in_flight_id"),
    related("int_rotations", "in_flight_id", "stg_flights", "flight_id"),
    not_null("int_rotations", "sched_turn_min"),
    unique("fct_turns", "turn_id"),
    not_null("fct_turns", "turn_id"),
    related("fct_turns", "out_flight_id", "fct_legs", "flight_id"),
    not_null("fct_turns", "inbound_arr_delay"),
    not_null("fct_turns", "outbound_dep_delay"),
    unique("fct_legs", "flight_id"),
    not_null("fct_legs", "flight_id"),
    not_null("fct_legs", "chain_id"),
    accepted("fct_legs", "dep_period", ("night", "morning", "afternoon", "evening")),
    accepted("agg_airport_hour", "dep_hour_local", tuple(range(24))),
    of_rows("block_time_consistent", "stg_flights", lambda: F.abs("block_time_residual_min") > BLOCK_TOLERANCE_MIN, 0, 1000),
    Expectation("legs_ordered", _unordered),
    of_rows("turns_nonnegative", "fct_turns", lambda: (F.col("sched_turn_min") < 0) | (F.col("actual_turn_min") < 0)),
)


class Counts:
    """How many rows break each expectation that single rows break, counted by the jobs that write the tables."""

    def __init__(self, expectations: tuple[Expectation, ...] = EXPECTATIONS) -> None:
        self.expectations, self._met = expectations, []

    def watched(self, table: str, df: DataFrame) -> DataFrame:
        """``df`` with its rows counted as they pass by."""
        own = {f"b{i}": e.name for i, e in enumerate(self.expectations) if e.table == table}
        if not own:
            return df
        seen = Observation()
        self._met.append((seen, own))
        bad = {e.name: e.bad for e in self.expectations if e.bad}
        return df.observe(seen, *(F.sum(F.when(bad[name](), 1).otherwise(0)).alias(k) for k, name in own.items()))

    def broken(self) -> dict[str, int]:
        """To be asked when the tables are written."""
        return {name: seen.get[k] or 0 for seen, own in self._met for k, name in own.items()}


def report(tables: Tables, expectations: tuple[Expectation, ...] = EXPECTATIONS, counted: dict[str, int] | None = None) -> DataFrame:
    """(expectation, broken, status): how many rows break each; one job for all.

    Those ``counted`` already, as the tables were written, are not looked for again.
    """
    known = {e.name: counted[e.name] for e in expectations if counted and e.name in counted}
    limits = lambda e: (F.lit(e.warn).cast("long").alias("warn"), F.lit(e.error).cast("long").alias("error"))
    parts = []
    if known:
        spark = next(iter(tables.values())).sparkSession
        rows = [(e.name, known[e.name], e.warn, e.error) for e in expectations if e.name in known]
        parts.append(spark.createDataFrame(rows, "expectation string, broken long, warn long, error long"))
    expectations = tuple(e for e in expectations if e.name not in known)
    for table in dict.fromkeys(e.table for e in expectations if e.table):
        own = [e for e in expectations if e.table == table]
        once = tables[table].agg(*(F.count_if(e.bad()).alias(e.name) for e in own))
        each = F.explode(F.array(*(F.struct(F.lit(e.name).alias("expectation"), F.col(e.name).alias("broken"), *limits(e)) for e in own)))
        parts.append(once.select(each.alias("x")).select("x.*"))
    for e in expectations:
        if not e.table:
            parts.append(e.broken(tables).agg(F.count("*").alias("broken")).select(F.lit(e.name).alias("expectation"), "broken", *limits(e)))
    all_ = reduce(DataFrame.unionByName, parts)
    status = F.when(F.col("broken") > F.col("error"), "error").when(F.col("broken") > F.col("warn"), "warn").otherwise("pass")
    return all_.select("expectation", "broken", status.alias("status"))


def check(spark: SparkSession, tables: Tables, counted: dict[str, int] | None = None) -> list[str]:
    """Names of expectations that warn; raises if any fails."""
    rows = report(tables, counted=counted).filter("status <> 'pass'").collect()
    if failed := [r["expectation"] for r in rows if r["status"] == "error"]:
        raise ValueError(f"expectations not met: {failed}")
    return [r["expectation"] for r in rows]
