"""Chains of legs as arrays, and their replay under other schedules.

A chain is one row with an array of its legs in order. The delay recursion runs down the
array as a fold, so all chains replay in parallel in one stage and without a UDF:

    z = max(0, A_before - (s + b) + tau),   D = p + beta * z,   A = D + e

s is the scheduled turn, b the buffer put on it, p the primary delay and e the change en
route, both backed out of what was observed, so that b = 0 replays every delay exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("origin", "dep_hour_local")


def scenario_legs(legs: DataFrame, carrier: str, days: DataFrame | None = None) -> DataFrame:
    """The carrier's legs of whole chains that begin on ``days`` (column d), without diverted ones."""
    own = legs.filter((F.col("carrier") == carrier) & ~F.col("is_diverted") & F.col("arr_delay").isNotNull())
    own = own.select("chain_id", "leg_seq", F.col("chain_date").alias("day"), *CELL, "sched_turn_min", "dep_delay", "arr_delay")
    return own if days is None else own.join(days.select(F.col("d").alias("day")).distinct(), "day", "left_semi")


def scenario_days(legs: DataFrame, carrier: str, months: list[str] | None = None) -> DataFrame:
    """(d): days on which a chain of the carrier begins."""
    own = legs.filter(F.col("carrier") == carrier).select(F.col("chain_date").alias("d"))
    return (own if months is None else own.filter(F.date_format("d", "yyyy-MM").isin(*months))).distinct()


def runs(legs: DataFrame) -> DataFrame:
    """Legs with run (which stretch of its chain without a gap), s (null at its start) and inbound (0 there)."""
    chain = Window.partitionBy("chain_id").orderBy("leg_seq")
    fresh = F.coalesce(F.col("leg_seq") != F.lag("leg_seq").over(chain) + 1, F.lit(True))
    t = legs.withColumn("start", fresh).withColumn("inbound", F.when(fresh, F.lit(0.0)).otherwise(F.lag("arr_delay").over(chain)))
    t = t.withColumn("run", F.sum(F.col("start").cast("int")).over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return t.withColumn("s", F.when(~F.col("start"), F.col("sched_turn_min").cast("double")))


def decomposed(legs: DataFrame, tau: float, beta: float) -> DataFrame:
    """``runs`` with z (observed), p and e under a hinge."""
    z = F.when(F.col("start"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("inbound") - F.col("s") + F.lit(float(tau))))
    t = runs(legs).withColumn("z", z)
    return t.withColumns({"p": F.col("dep_delay") - F.lit(float(beta)) * F.col("z"), "e": F.col("arr_delay") - F.col("dep_delay")})


def with_buffers(legs: DataFrame, buffers: DataFrame | None) -> DataFrame:
    """Legs with b: the buffer of their cell (origin, dep_hour_local, buffer), 0 at a start or without one."""
    if buffers is None:
        return legs.withColumn("b", F.lit(0.0))
    t = legs.join(buffers.select(*CELL, F.col("buffer").alias("cell_buffer")), list(CELL), "left")
    return t.withColumn("b", F.when(F.col("start"), F.lit(0.0)).otherwise(F.coalesce("cell_buffer", F.lit(0.0)))).drop("cell_buffer")


def folded(legs: Column, tau: float, beta: float) -> Column:
    """The arrival delay of each leg of a run: array<double> for array<struct<.., s, b, p, e>> in order."""
    start = F.struct(F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, leg: Column) -> Column:
        z = F.when(leg["s"].isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), acc["a"] - leg["s"] - leg["b"] + F.lit(float(tau))))
        a = leg["p"] + F.lit(float(beta)) * z + leg["e"]
        return F.struct(a.alias("a"), F.concat(acc["all"], F.array(a)).alias("all"))

    return F.aggregate(legs, start, step)["all"]


def replay(legs: DataFrame, buffers: DataFrame | None, tau: float, beta: float) -> DataFrame:
    """(chain_id, leg_seq, day, origin, dep_hour_local, dep_delay, arr_delay, b, shift, arrival) of every leg.

    ``legs`` as from scenario_legs; arrival is the delay against the padded timetable, shift
    how far the timetable has moved by then.
    """
    t = with_buffers(decomposed(legs, tau, beta), buffers)
    one = F.struct("leg_seq", "s", "b", "p", "e", "origin", "dep_hour_local", "dep_delay", "arr_delay")
    chained = t.groupBy("chain_id", "run", "day").agg(F.sort_array(F.collect_list(one)).alias("legs"))
    arrivals = chained.withColumn("arrivals", folded(F.col("legs"), tau, beta))
    out = arrivals.select("chain_id", "run", "day", F.posexplode(F.arrays_zip("legs", "arrivals")).alias("i", "x"))
    out = out.select("chain_id", "run", "day", *(F.col(f"x.legs.{c}").alias(c) for c in ("leg_seq", *CELL, "dep_delay", "arr_delay", "b")), F.col("x.arrivals").alias("arrival"))
    so_far = Window.partitionBy("chain_id", "run").orderBy("leg_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("shift", F.sum("b").over(so_far)).drop("run")


def timetable_shift(legs: DataFrame, buffers: DataFrame) -> DataFrame:
    """(chain_id, leg_seq, day, shift): how far each leg moves back in the timetable."""
    t = with_buffers(runs(legs), buffers)
    so_far = Window.partitionBy("chain_id", "run").orderBy("leg_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select("chain_id", "leg_seq", "day", F.sum("b").over(so_far).alias("shift"))


def delay_by_day(replayed: DataFrame, column: str = "arrival") -> DataFrame:
    """(day, delay): positive minutes; every day of the scenarios is there, with 0 if nothing was late."""
    return replayed.groupBy("day").agg(F.sum(F.greatest(F.col(column), F.lit(0.0))).alias("delay"))


def buffer_by_day(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("day").agg(F.sum("b").alias("buffer"))


def avoided_by_day(replayed: DataFrame) -> DataFrame:
    """(day, avoided): observed minus replayed positive minutes, from one replay."""
    late = lambda c: F.sum(F.greatest(F.col(c), F.lit(0.0)))
    return replayed.groupBy("day").agg((late("arr_delay") - late("arrival")).alias("avoided"))


def replays_exactly(legs: DataFrame, tau: float, beta: float, tolerance: float = 1e-6) -> bool:
    """Whether the recursion without buffers gives back every observed delay."""
    worst = replay(legs, None, tau, beta).agg(F.max(F.abs(F.col("arrival") - F.col("arr_delay")))).first()[0]
    return worst is None or worst < tolerance


def schedule_metrics(replayed: DataFrame) -> DataFrame:
    """One row: on-time shares against the padded and the original timetable, and lateness by the clock per day."""
    clock = F.col("arrival") + F.col("shift")
    on_time = lambda c: F.avg((c < 15).cast("int"))
    late = F.sum(F.greatest(clock, F.lit(0.0))) / F.countDistinct("day")
    return replayed.agg(on_time(F.col("arrival")).alias("ontime15"), on_time(clock).alias("ontime15_clock"), late.alias("clock_late_per_day"))
