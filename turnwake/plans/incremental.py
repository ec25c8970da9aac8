"""Months added to stored tables, without building the months before again.

A new month's flights are staged alone. Their legs go on the chains that were open when the month before ended,
so beside the tables two small ones are kept: ``int_aircraft``, for each aircraft the number of the first chain that
may still change, and ``int_open``, the legs of these chains. Open legs and new legs are put in chains
together and numbered on from there. A leg can only be followed by one that departs at most the longest
turn after it arrives, and no flight of a month departs earlier than the month begins in the most eastern zone, so
every other chain is final.

Written are the new months and, where a chain that went on reaches back, the months of its first legs: each table
replaces just those partitions. Marts by month get the new months; the two marts over all months are summed
again from the stored staging table, a scan of their own columns.

Months must be later than all stored ones, or be the last addition again: both tables are kept as of each
addition, so that one that broke off can be run anew. A record that says its departure is at 24:00 of the month's last day and one at 00:00 of
the next have one key: the one stored first stays.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled
from . import warehouse as W

#: Fixed value: hours by which the earliest zone is ahead of UTC.
EARLIEST_ZONE_HOURS = 14
AIRCRAFT = ["carrier", "tail_number"]


def month_start(month: str, later: int = 0) -> dt.datetime:
    """The first instant of a month (or of one ``later``) as a clock in UTC."""
    year, m = map(int, month.split("-"))
    n = year * 12 + m - 1 + later
    return dt.datetime(n // 12, n % 12 + 1, 1)


def last_month(staging: DataFrame) -> str | None:
    return staging.agg(F.max("flight_month")).first()[0]


def state(spark: SparkSession, folder: str, after: str | None) -> tuple[DataFrame, DataFrame]:
    """(open legs, aircraft) as they were when ``after`` was the last month."""
    try:
        return tuple(W.read_table(spark, folder, f"{name}/after={after}") for name in ("int_open", "int_aircraft"))
    except AnalysisException as missing:
        raise ValueError(f"it is not kept which chains were open after {after}") from missing


def first_open(wide: DataFrame, cut: dt.datetime, max_turn_min: int) -> DataFrame:
    """(carrier, tail_number, carry_from): the first chain of each aircraft that a leg departing at ``cut`` or later can change."""
    at = F.lit(cut)
    early = F.col("crs_dep_utc") < at
    last = F.max_by(F.when(early, F.struct("chain_no", "crs_arr_utc")), F.when(early, F.struct("crs_dep_utc", "flight_id"))).alias("last")
    own = wide.groupBy(*AIRCRAFT).agg(last, F.min("chain_no").alias("least"))
    goes_on = F.col("last.crs_arr_utc") >= F.lit(cut - dt.timedelta(minutes=max_turn_min))
    carry = F.when(F.col("last").isNull(), F.col("least")).when(goes_on, F.col("last.chain_no")).otherwise(F.col("last.chain_no") + 1)
    return own.select(*AIRCRAFT, carry.alias("carry_from"))


def keep_state(wide: DataFrame, before: DataFrame | None, after: str | None, max_turn_min: int, folder: str) -> None:
    """What a month later than ``after`` needs: from ``wide``, and from ``before`` for aircraft that it does not have.

    It is stored by ``after``, so that a month can be added again.
    """
    if after is None:
        return
    cut = month_start(after, 1) - dt.timedelta(hours=EARLIEST_ZONE_HOURS)
    now = settled(first_open(wide, cut, max_turn_min))
    open_ = wide.join(now, AIRCRAFT).filter("chain_no >= carry_from").select(*(c for c in wide.columns if c not in _PLACES))
    all_ = now if before is None else now.unionByName(before.join(now, AIRCRAFT, "left_anti"))
    for name, df in (("int_open", open_), ("int_aircraft", all_)):
        W.store(df, folder, f"{name}/after={after}")


#: Columns that a leg has by its place in a chain; the rest of the chains' table is staging.
_PLACES = ("chain_no", "chain_id", "leg_seq", "chain_legs", "chain_date", "is_linked", "prev_flight_id", "sched_turn_min", "actual_turn_min", "inbound_arr_delay", "inbound_crs_arr_utc")


def chained_on(open_: DataFrame, new: DataFrame, aircraft: DataFrame, max_turn_min: int) -> DataFrame:
    """Open and new legs in chains, numbered on from the chains before."""
    both = W.sequenced(open_.select(*new.columns).unionByName(new), max_turn_min)
    numbered = both.join(aircraft, AIRCRAFT, "left")
    no: Column = F.col("chain_no") + F.coalesce(F.col("carry_from") - 1, F.lit(0))
    named = F.concat("carrier", F.lit("-"), "tail_number", F.lit("-"), no.cast("string"))
    return numbered.select(*(no.alias(c) if c == "chain_no" else named.alias(c) if c == "chain_id" else F.col(c) for c in both.columns))


def add_months(spark: SparkSession, raw: DataFrame, folder: str, max_turn_min: int = W.MAX_TURN_MIN) -> W.Warehouse:
    """Adds the raw flights of one or more whole months to the tables in ``folder``; the warehouse that reads them."""
    old = W.read_table(spark, folder, "stg_flights")
    airports = settled(W.read_table(spark, folder, "airports"))
    new = settled(W.staged(raw, airports))
    span = new.agg(F.min("flight_month"), F.max("flight_month"), F.collect_set("flight_month")).first()
    if span[0] is None:
        return _stored(spark, folder, new.columns, airports, max_turn_min)
    stored = {r[0] for r in old.select("flight_month").distinct().collect()}
    if {m for m in stored if m >= span[0]} - set(span[2]):
        raise ValueError(f"months are added in order; {max(stored)} is stored, these begin with {span[0]}")
    # Of the stored months only the clock's 24:00 of the last day can have a key of the new ones.
    late = old.filter((F.col("flight_month") < span[0]) & (F.col("crs_dep_local") >= F.lit(month_start(span[0])))).select("flight_id")
    new = settled(new.join(late, "flight_id", "left_anti"))
    before = W.read_table(spark, folder, "int_chains").filter(F.col("flight_month") < span[0])
    open_, aircraft = state(spark, folder, max((m for m in stored if m < span[0]), default=None))
    legs = settled(chained_on(open_, new, aircraft, max_turn_min))
    # Months in which a leg's place in its chain is another now are written anew, with the legs that stay as they are.
    again = legs.filter(F.col("flight_month") < span[0])
    moved = again.join(before.select("flight_id", *(F.col(c).alias(f"old_{c}") for c in _PLACES)), "flight_id")
    moved = moved.filter(~reduce_and(F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in _PLACES))
    touched = [r[0] for r in moved.select("flight_month").distinct().collect()]
    kept = before.filter(F.col("flight_month").isin(touched)).join(again.select("flight_id"), "flight_id", "left_anti")
    wide = settled(kept.select(*legs.columns).unionByName(legs.filter((F.col("flight_month") >= span[0]) | F.col("flight_month").isin(touched))))
    W.store(new, folder, "stg_flights")
    W.store(wide, folder, "int_chains")
    for name, df in W.of_chains(wide).items():
        W.store(df, folder, name)
    W.store_marts(W.read_table(spark, folder, "stg_flights"), new, lambda df, name: W.store(df, folder, name))
    keep_state(legs, aircraft, span[1], max_turn_min, folder)
    return _stored(spark, folder, new.columns, airports, max_turn_min)


def reduce_and(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _stored(spark: SparkSession, folder: str, columns: list[str], airports: DataFrame, max_turn_min: int) -> W.Warehouse:
    return W.Warehouse(airports, W.read_table(spark, folder, "stg_flights").select(*columns), W.read_table(spark, folder, "int_chains"), max_turn_min)
