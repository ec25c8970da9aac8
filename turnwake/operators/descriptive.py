"""How much delay is reactionary: for whom, when in the day, and how hard aircraft work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CAUSES, carrier_name

NAMES = [name for name, _ in CAUSES]
PRIMARY = NAMES[:-1]
LATE = NAMES[-1]


def _total(names: list[str]):
    out = F.col(names[0])
    for n in names[1:]:
        out = out + F.col(n)
    return out


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("flights").alias("flights"), *(F.sum(n).alias(n) for n in NAMES))


def cause_shares(carrier_month: DataFrame) -> DataFrame:
    """Causes by carrier, the most reactionary first."""
    t = _sums(carrier_month, "carrier")
    t = t.select("*", F.try_divide(F.col(LATE), _total(NAMES)).alias("reactionary_share"), (_total(NAMES) / F.col("flights")).alias("delay_min_per_flight"), carrier_name(F.col("carrier")).alias("name"))
    return t.orderBy(F.col("reactionary_share").desc_nulls_last(), "carrier")


def by_hour(delay_causes: DataFrame) -> DataFrame:
    """Cause minutes per departing flight by local hour."""
    t = _sums(delay_causes, "dep_hour_local")
    return t.select(
        "*",
        (_total(PRIMARY) / F.col("flights")).alias("primary_per_flight"),
        (F.col(LATE) / F.col("flights")).alias("reactionary_per_flight"),
        F.try_divide(F.col(LATE), _total(NAMES)).alias("reactionary_share"),
    ).orderBy("dep_hour_local")


def network(carrier_month: DataFrame, legs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row about everything; the three tables are counted side by side."""
    a = carrier_month.agg(F.sum("flights").alias("flights"), F.min("flight_month").alias("first_month"), F.max("flight_month").alias("last_month"), *(F.sum(n).alias(n) for n in NAMES))
    b = legs.agg(F.count("*").alias("operated_legs_in_chains"))
    c = turns.agg(F.count("*").alias("turns"), F.countDistinct("chain_id").alias("chains_with_turns"))
    one = F.lit(1)
    t = a.withColumn("k", one).join(b.withColumn("k", one), "k").join(c.withColumn("k", one), "k")
    return t.select(
        *("flights", "operated_legs_in_chains", "turns", "chains_with_turns", "first_month", "last_month"),
        F.try_divide(F.col(LATE), _total(NAMES)).alias("reactionary_share"), _total(NAMES).alias("total_cause_minutes"),
    )


def rotations_by_carrier(legs: DataFrame, turns: DataFrame) -> DataFrame:
    """Legs per aircraft-day (a tail on a chain date) and scheduled turns, by carrier."""
    days = legs.groupBy("carrier").agg(F.count("*").alias("legs"), F.countDistinct(F.struct("tail_number", "chain_date")).alias("tail_days"))
    turn = F.col("sched_turn_min").cast("double")
    stays = turns.groupBy("carrier").agg(F.percentile(turn, 0.5).alias("median_sched_turn_min"), F.percentile(turn, 0.25).alias("p25_sched_turn_min"))
    t = days.join(stays, "carrier").withColumn("legs_per_aircraft_day", F.col("legs") / F.col("tail_days"))
    return t.withColumn("name", carrier_name(F.col("carrier"))).orderBy(F.col("legs_per_aircraft_day").desc(), "carrier")


def top_hubs(turns: DataFrame, k: int = 15) -> DataFrame:
    return turns.groupBy("station").agg(F.count("*").alias("turns")).orderBy(F.col("turns").desc(), "station").limit(k)


def months_of(df: DataFrame) -> list[str]:
    """The months a table holds, in order."""
    return [r[0] for r in df.select("flight_month").distinct().orderBy("flight_month").collect()]
