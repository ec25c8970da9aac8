"""Where to put buffer: scores of cells (station, local hour) and policies under a budget.

Cell tables are some thousand rows (stations x 24) whatever the number of flights, so a policy
that orders all cells does so in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import CELL, decomposed, runs


def cells(legs: DataFrame) -> DataFrame:
    """(origin, dep_hour_local, nbar): turns a day of every cell that has a turn. A turn after a
    gap makes its cell known but is no turn of the replay."""
    days = legs.agg(F.countDistinct("day").alias("days"))
    known = runs(legs).groupBy(*CELL).agg(F.sum((~F.col("start")).cast("long")).alias("turns"), F.max((F.col("leg_seq") > 1).cast("int")).alias("seen"))
    one = F.lit(1)
    t = known.filter("seen = 1").withColumn("k", one).join(days.withColumn("k", one), "k")
    return t.select(*CELL, (F.col("turns") / F.col("days")).alias("nbar"))


def propagated_score(legs: DataFrame, tau: float, beta: float) -> DataFrame:
    """(origin, dep_hour_local, score): mean observed propagated delay of a cell's turns."""
    return decomposed(legs, tau, beta).filter(~F.col("start")).groupBy(*CELL).agg(F.avg(F.lit(float(beta)) * F.col("z")).alias("score"))


def marginal_score(legs: DataFrame, known: DataFrame, tau: float, beta: float, b_max: float) -> DataFrame:
    """(origin, dep_hour_local, score): delay avoided per buffer minute if one cell alone gets ``b_max``.

    A buffer takes minutes off the delay that its turn hands on, at most what is handed on, z. What is taken off one
    leg's arrival is again taken off the next leg's z, and so on: d -> beta * min(z, d + own buffer). So one
    sweep down a run replies for all its cells: it holds those whose buffer still takes something off, and drops
    all of them at a turn that hands nothing on. The work grows with the legs and the late stretches, not with
    legs times cells.
    """
    t = decomposed(legs, tau, beta)
    days = legs.agg(F.countDistinct("day").alias("days"))
    one = F.struct("leg_seq", "start", "z", F.col("arr_delay").alias("late"), F.struct(*CELL).alias("cell"))
    chained = t.groupBy("chain_id", "run").agg(F.sort_array(F.collect_list(one)).alias("legs"))
    kept = f"array<struct<cell:{_type_of(t)},off:double,gain:double>>"
    start = F.struct(F.array().cast(kept).alias("held"), F.array().cast(kept).alias("ended"))

    def step(acc: Column, leg: Column) -> Column:
        new = F.struct(leg["cell"].alias("cell"), F.lit(0.0).alias("off"), F.lit(0.0).alias("gain"))
        all_ = F.when(F.exists(acc["held"], lambda h: h["cell"] == leg["cell"]), acc["held"]).otherwise(F.array_append(acc["held"], new))

        def passed(h: Column) -> Column:
            own = F.when(h["cell"] == leg["cell"], F.lit(float(b_max))).otherwise(F.lit(0.0))
            off = F.lit(float(beta)) * F.least(leg["z"], h["off"] + own)
            saved = F.greatest(leg["late"], F.lit(0.0)) - F.greatest(leg["late"] - off, F.lit(0.0))
            return F.struct(h["cell"].alias("cell"), off.alias("off"), (h["gain"] + saved).alias("gain"))

        late = leg["z"] > 0
        return F.struct(
            F.when(late, F.transform(all_, passed)).otherwise(F.array().cast(kept)).alias("held"),
            F.when(late | (F.size(acc["held"]) == 0), acc["ended"]).otherwise(F.concat(acc["ended"], acc["held"])).alias("ended"),
        )

    swept = chained.select("legs", F.aggregate("legs", start, step).alias("acc"))
    # Cells whose turns never hand anything on are there with 0.
    turns = F.transform(F.filter("legs", lambda x: ~x["start"]), lambda x: F.struct(x["cell"].alias("cell"), F.lit(0.0).alias("off"), F.lit(0.0).alias("gain")))
    each = swept.select(F.explode(F.concat(turns, F.col("acc.ended"), F.col("acc.held"))).alias("x"))
    total = each.groupBy("x.cell").agg(F.sum("x.gain").alias("gain")).select("cell.*", "gain", F.lit(1).alias("k"))
    scored = total.join(days.withColumn("k", F.lit(1)), "k").join(known, list(CELL))
    return scored.select(*CELL, (F.col("gain") / F.col("days") / (F.lit(float(b_max)) * F.col("nbar"))).alias("score"))


def _type_of(legs: DataFrame) -> str:
    return legs.select(F.struct(*CELL).alias("cell")).schema["cell"].dataType.simpleString()


def uniform(known: DataFrame, budget: float, b_max: float) -> DataFrame:
    """The same minutes on every turn of cells that have turns."""
    all_ = known.agg(F.sum("nbar").alias("all")).withColumn("k", F.lit(1))
    per = F.when(F.col("all") > 0, F.least(F.lit(float(b_max)), F.lit(float(budget)) / F.col("all"))).otherwise(F.lit(0.0))
    return known.withColumn("k", F.lit(1)).join(all_, "k").select(*CELL, F.when(F.col("nbar") > 0, per).otherwise(F.lit(0.0)).alias("buffer"))


def greedy(scores: DataFrame, known: DataFrame, budget: float, b_max: float) -> DataFrame:
    """``b_max`` to cells by falling score until the budget is spent; the last gets what is left.

    What the cells before have taken is a running sum, so no loop is needed.
    """
    t = known.join(scores, list(CELL), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    able = (F.col("nbar") > 0) & (F.col("score") > 0)
    order = Window.orderBy(F.col("score").desc(), *CELL).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(able, F.col("nbar") * b_max).otherwise(F.lit(0.0))).over(order), F.lit(0.0))
    t = t.withColumn("before", before)
    rest = F.greatest(F.lit(0.0), (F.lit(float(budget)) - F.col("before")) / F.col("nbar"))
    return t.select(*CELL, F.when(able, F.least(F.lit(float(b_max)), rest)).otherwise(F.lit(0.0)).alias("buffer"))


def rounded(buffers: DataFrame, step: float = 5.0) -> DataFrame:
    """Buffers in whole steps, halves to the even step."""
    return buffers.select(*CELL, (F.bround(F.col("buffer") / step) * step).alias("buffer"))


def steps_in_order(placed: DataFrame, budget: float, step: float = 5.0) -> DataFrame:
    """One ``step`` on each cell of (origin, dep_hour_local, nbar, place) that the rest of the budget holds,
    by place; a cell that would exceed it is passed over, and later ones may still fit.

    What is left depends on every cell before, so the cells, some thousand, are one ordered array
    and the rest a fold over it.
    """
    line = placed.agg(F.sort_array(F.collect_list(F.struct("place", *CELL, (F.lit(float(step)) * F.col("nbar")).alias("cost")))).alias("line"))
    start = F.struct(F.lit(float(budget)).alias("left"), F.array().cast("array<boolean>").alias("given"))

    def take(acc: Column, cell: Column) -> Column:
        fits = (cell["cost"] > 0) & (cell["cost"] <= acc["left"])
        return F.struct((acc["left"] - F.when(fits, cell["cost"]).otherwise(F.lit(0.0))).alias("left"), F.array_append(acc["given"], fits).alias("given"))

    each = line.select("line", F.aggregate("line", start, take)["given"].alias("given")).select(F.explode(F.arrays_zip("line", "given")).alias("x"))
    return each.select(*(F.col(f"x.line.{c}").alias(c) for c in CELL), F.when(F.col("x.given"), F.lit(float(step))).otherwise(F.lit(0.0)).alias("buffer"))


def uniform_steps(known: DataFrame, budget: float, step: float = 5.0, seed: int = 0) -> DataFrame:
    """``steps_in_order`` with the cells in random order: NumPy's permutation of them by their key."""
    number = known.withColumn("i", F.row_number().over(Window.orderBy(*CELL)) - 1)
    order = np.random.default_rng(seed).permutation(known.count())
    places = known.sparkSession.createDataFrame([(int(i), place) for place, i in enumerate(order)], "i int, place int")
    return steps_in_order(number.join(places, "i").drop("i"), budget, step)
