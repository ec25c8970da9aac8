"""The buffer program: least mean daily delay under a budget of buffer minutes a day.

    f(b) = 1/S * sum over legs of max(0, A(b))  ->  min,   sum nbar * b <= B,   0 <= b <= b_max

f is convex and piecewise linear in the cells' buffers, as every step of the recursion is
non-decreasing for beta >= 0. It is solved by cutting planes: Spark evaluates f and one
subgradient by a fold forwards and one backwards over each chain, a row per cell comes back,
and a small master program over the cuts is solved on the driver. Master and best value
bound the optimum from both sides; that gap is the certificate. Cuts do not depend on the
budget and serve all budgets. Small instances are solved as one linear program instead.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import CELL, decomposed

FULL_LIMIT = 400  # rows of a program that is solved whole


def simplex(spark, cost: np.ndarray, rows: list[tuple[dict[int, float], str, float]]) -> np.ndarray:
    """min cost @ x over x >= 0 under sparse rows (coefficients, '<=' or '>=', value), by the bundled solver."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    linear = jvm.org.apache.commons.math3.optim.linear
    relation = {"<=": linear.Relationship.LEQ, ">=": linear.Relationship.GEQ}

    def doubles(values: np.ndarray):
        # One call for all numbers, as bytes, and not one for each.
        out = gateway.new_array(jvm.double, len(values))
        jvm.java.nio.ByteBuffer.wrap(bytearray(np.asarray(values, ">f8").tobytes())).asDoubleBuffer().get(out)
        return out

    constraints = jvm.java.util.ArrayList()
    for row, kind, value in rows:
        dense = np.zeros(len(cost))
        dense[list(row)] = list(row.values())
        constraints.add(linear.LinearConstraint(doubles(dense), relation[kind], float(value)))
    parts = [linear.LinearObjectiveFunction(doubles(cost), 0.0), linear.LinearConstraintSet(constraints), jvm.org.apache.commons.math3.optim.nonlinear.scalar.GoalType.MINIMIZE, linear.NonNegativeConstraint(True), jvm.org.apache.commons.math3.optim.MaxIter(200_000)]
    data = gateway.new_array(jvm.org.apache.commons.math3.optim.OptimizationData, len(parts))
    for i, p in enumerate(parts):
        data[i] = p
    return np.array(list(linear.SimplexSolver().optimize(data).getPoint()))


@dataclass
class Program:
    """One training set, solved for any budget."""

    legs: DataFrame
    known: DataFrame
    tau: float
    beta: float
    b_max: float
    chains: DataFrame = field(init=False)
    cuts: list[tuple[float, np.ndarray]] = field(default_factory=list)
    evaluations: int = 0

    def __post_init__(self) -> None:
        self.spark = self.legs.sparkSession
        rows = self.known.orderBy(*CELL).collect()
        self.keys = [(r["origin"], r["dep_hour_local"]) for r in rows]
        self.nbar = np.array([r["nbar"] for r in rows], float)
        self.upper = np.where(self.nbar > 0, self.b_max, 0.0)
        self.days = self.legs.select("day").distinct().count()
        ids = self.spark.createDataFrame([(*k, i) for i, k in enumerate(self.keys)], "origin string, dep_hour_local int, cell int")
        t = decomposed(self.legs, self.tau, self.beta).join(ids, list(CELL), "left")
        unknown = t.filter(~F.col("start") & F.col("cell").isNull())
        if not unknown.isEmpty():
            raise ValueError("every training turn must belong to a cell")
        one = F.struct("leg_seq", "s", (F.col("p") + F.col("e")).alias("c"), F.when(F.col("start"), -1).otherwise(F.col("cell")).alias("cell"))
        self.chains = t.groupBy("chain_id", "run").agg(F.sort_array(F.collect_list(one)).alias("legs")).persist()

    def value(self, b: np.ndarray) -> tuple[float, np.ndarray]:
        """f and a subgradient at b."""
        self.evaluations += 1
        at = F.array(*(F.lit(float(x)) for x in b))
        tau, beta = F.lit(float(self.tau)), F.lit(float(self.beta))
        zero = F.lit(0.0)
        empty = F.array().cast("array<struct<cell:int,late:boolean,pushed:boolean>>")
        start = F.struct(zero.alias("a"), zero.alias("f"), empty.alias("marks"))

        def forward(acc, leg):
            room = F.when(leg["cell"] < 0, F.lit(-1.0)).otherwise(acc["a"] - leg["s"] - F.element_at(at, leg["cell"] + 1) + tau)
            a = leg["c"] + beta * F.greatest(zero, room)
            mark = F.struct(leg["cell"].cast("int").alias("cell"), (a > 0).alias("late"), (room > 0).alias("pushed"))
            return F.struct(a.alias("a"), (acc["f"] + F.greatest(zero, a)).alias("f"), F.concat(acc["marks"], F.array(mark)).alias("marks"))

        slopes = F.array().cast("array<struct<cell:int,g:double>>")

        def backward(acc, mark):
            # What a minute more on this arrival costs: itself, and what it pushes on.
            own = mark["late"].cast("double") + acc["g"]
            on = F.when(mark["pushed"], beta * own).otherwise(zero)
            return F.struct(on.alias("g"), F.concat(acc["all"], F.array(F.struct(mark["cell"].alias("cell"), on.alias("g")))).alias("all"))

        run = self.chains.select(F.aggregate("legs", start, forward).alias("r"))
        back = F.aggregate(F.reverse("r.marks"), F.struct(zero.alias("g"), slopes.alias("all")), backward)["all"]
        # The value travels as a cell of its own, so one job gives both.
        f = F.array(F.struct(F.lit(-2).alias("cell"), F.col("r.f").alias("g")))
        rows = run.select(F.explode(F.concat(f, back)).alias("x")).filter("x.cell <> -1").groupBy("x.cell").agg(F.sum("x.g").alias("g"))
        total, grad = 0.0, np.zeros(len(b))
        for r in rows.collect():
            if r["cell"] < 0:
                total = r["g"]
            else:
                grad[r["cell"]] = -r["g"] / self.days
        return total / self.days, grad

    def _master(self, budget: float) -> tuple[np.ndarray, float]:
        n = len(self.nbar)
        rows = [({i: float(g) for i, g in enumerate(-grad) if g} | {n: 1.0}, ">=", float(c)) for c, grad in self.cuts]
        rows.append(({i: float(x) for i, x in enumerate(self.nbar) if x}, "<=", float(budget)))
        rows += [({i: 1.0}, "<=", float(self.upper[i])) for i in range(n)]
        x = simplex(self.spark, np.append(np.zeros(n), 1.0), rows)
        return np.clip(x[:n], 0, self.upper), float(x[n])

    def solve(self, budget: float, tolerance: float = 1e-6, most: int = 200) -> tuple[np.ndarray, float, float]:
        """(buffers by cell, value, relative gap); raises if the gap stays above the tolerance."""
        if len(self.nbar) == 0:
            return np.zeros(0), self.value(np.zeros(0))[0], 0.0
        if self._rows() <= FULL_LIMIT:
            return (*self._whole(budget), 0.0)
        spend = float(self.nbar.sum())
        at = np.where(self.nbar > 0, min(self.b_max, budget / spend if spend else 0.0), 0.0)
        best, value = at, np.inf
        for _ in range(most):
            f, g = self.value(at)
            self.cuts.append((f - float(g @ at), g))
            if f < value:
                best, value = at, f
            point, low = self._master(budget)
            gap = (value - low) / max(abs(value), 1e-9)
            if gap <= tolerance:
                return best, value, max(gap, 0.0)
            # A step towards the master's point, short of it, steadies the cuts.
            at = point if gap < 1e-3 else 0.7 * point + 0.3 * best
        raise RuntimeError(f"the program is within {gap:.2e} of its optimum, not {tolerance:.0e}")

    def _rows(self) -> int:
        got = self.chains.agg(F.sum(F.size("legs")).alias("legs"), F.sum(F.size(F.filter("legs", lambda x: x["cell"] >= 0))).alias("turns")).first()
        return (got["legs"] or 0) + (got["turns"] or 0) + len(self.nbar) + 1

    def _whole(self, budget: float) -> tuple[np.ndarray, float]:
        """The full program: buffers, z of every turn and positive delay of every leg."""
        n, rows, cost = len(self.nbar), [], [0.0] * len(self.nbar)
        for r in self.chains.orderBy("chain_id", "run").collect():
            z_before, c_before = None, 0.0
            for leg in r["legs"]:
                z = None
                if leg["cell"] >= 0:
                    z = len(cost)
                    cost.append(0.0)
                    row = {z: 1.0, leg["cell"]: 1.0} | ({z_before: -self.beta} if z_before is not None else {})
                    rows.append((row, ">=", c_before - leg["s"] + self.tau))
                a = len(cost)
                cost.append(1.0 / self.days)
                rows.append(({a: 1.0} | ({z: -self.beta} if z is not None else {}), ">=", leg["c"]))
                z_before, c_before = z, leg["c"]
        rows.append(({i: float(x) for i, x in enumerate(self.nbar) if x}, "<=", float(budget)))
        rows += [({i: 1.0}, "<=", float(self.upper[i])) for i in range(n)]
        x = simplex(self.spark, np.array(cost), rows)
        return x[:n], float(np.array(cost) @ x)

    def table(self, b: np.ndarray) -> DataFrame:
        return self.spark.createDataFrame([(*k, float(x)) for k, x in zip(self.keys, b, strict=True)], "origin string, dep_hour_local int, buffer double")
