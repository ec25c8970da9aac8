"""Queries over the test tables, with their SQL where it can say the same.

Flights come from the ``events`` adapter. Its time is one month, so days up to the 22nd are
for training and the rest is held out, and contagion is matched on carrier, part of day and
legs left, without the day.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..operators import buffers as B
from ..operators import chains as C
from ..operators import contagion, descriptive, evaluate, hinge, trees
from ..operators.ids import dense_ids
from ..operators.lp import Program
from ..session import prepared, settled
from ..sources.adapter import RAW_SQL, ZONES, test_flights
from ..sources.airports import AIRPORTS, seeded
from ..sources.sample import whole_tails
from . import quality
from . import warehouse as W

SPLIT = "2024-01-22"
MATCH = ("carrier", "dep_period", "rem")
CARRIER, TAU, BETA, B_MAX, BUDGET = "WN", 30.0, 0.9, 20.0, 40.0
HINGE_MONTHS = ("2023-12", "2024-01")


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Times as text, doubles rounded and without a negative zero, so that engines can be compared."""
    as_text = {T.TimestampType: "yyyy-MM-dd HH:mm:ss", T.DateType: "yyyy-MM-dd"}

    def one(f: T.StructField):
        if type(f.dataType) in as_text:
            return F.date_format(f.name, as_text[type(f.dataType)]).alias(f.name)
        return (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)

    return df.select(*map(one, df.schema))


def _warehouse(spark: SparkSession, sf_dir: str) -> W.Warehouse:
    return W.build(*test_flights(prepared(spark), sf_dir))


def _query(f: Callable[[W.Warehouse], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(f(_warehouse(spark, sf_dir)))


def _early(df: DataFrame, day: str = "flight_date") -> DataFrame:
    return df.filter(F.col(day) <= F.lit(SPLIT).cast("date"))


def _late(df: DataFrame, day: str = "flight_date") -> DataFrame:
    return df.filter(F.col(day) > F.lit(SPLIT).cast("date"))


def _events(w: W.Warehouse) -> DataFrame:
    return contagion.events(w.legs, MATCH)


def _fit(turns: DataFrame) -> DataFrame:
    return hinge.fit(hinge.day_sums(_early(turns), "carrier"))


def _scores(w: W.Warehouse) -> DataFrame:
    return hinge.score(hinge.features(_early(w.turns)), hinge.features(_late(w.turns)), _fit(w.turns), "carrier")


def _legs(w: W.Warehouse) -> DataFrame:
    legs = C.scenario_legs(w.legs, CARRIER)
    return _early(legs, "day")


def _test_legs(w: W.Warehouse) -> DataFrame:
    return _late(C.scenario_legs(w.legs, CARRIER), "day")


def _by_hour(w: W.Warehouse) -> DataFrame:
    """A buffer for every cell, by its hour alone."""
    return B.cells(_legs(w)).select(*C.CELL, ((F.col("dep_hour_local") % 4) * 5).cast("double").alias("buffer"))


def _replay(w: W.Warehouse) -> DataFrame:
    return C.replay(_legs(w), _by_hour(w), TAU, BETA)


def _greedy(w: W.Warehouse) -> DataFrame:
    return B.greedy(B.propagated_score(_legs(w), TAU, BETA), B.cells(_legs(w)), BUDGET, B_MAX)


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, _ = test_flights(prepared(spark), sf_dir)
    return plain(whole_tails(raw, ["2024-01-10", "2024-01-11"], 5))


def _designs(w: W.Warehouse) -> DataFrame:
    """The multiplier of late departures under every design, without intervals."""
    parts = []
    for name, how in contagion.DESIGNS:
        options = dict(how)
        ev = contagion.events(w.legs, (*MATCH, *options.pop("more", ())), **options).withColumn("variant", F.lit(name))
        parts.append(contagion.by(ev, "variant"))
    return reduce(DataFrame.unionByName, parts)


def _placed(w: W.Warehouse) -> DataFrame:
    """Cells in an order that SQL can say too: by the digest of their key."""
    return B.cells(_legs(w)).withColumn("place", F.md5(F.concat_ws("|", *C.CELL).cast("binary")))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of airports as carriers would send it in: a row each time a flight uses one, under several names, some without code or zone, some abroad."""
    raw, known = test_flights(prepared(spark), sf_dir)
    used = raw.select("Flight_Number_Reporting_Airline", F.explode(F.array("Origin", "Dest")).alias("iata")).withColumnRenamed("Flight_Number_Reporting_Airline", "n")
    blank = lambda c, every: F.when(F.col("n") % every != 0, F.col(c)).otherwise(F.lit(""))
    named = F.concat("name", F.lit(" "), (F.col("n") % 3).cast("string"))
    return used.join(known, "iata").select(
        F.when(F.col("n") % 7 != 0, F.lit("US")).otherwise(F.lit("DE")).alias("country"), blank("iata", 11).alias("iata"), named.alias("name"), "city", F.col("state").alias("subd"), blank("tz", 13).alias("tz"), "lat", "lon"
    )


SIZES = (5, 10, 15)


def _gains(w: W.Warehouse) -> DataFrame:
    """(replicate, scenario_days, gain_train, gain_test): minutes a day that buffers by hour avoid, on drawn days and on the others."""
    draws = F.array(*(F.struct(F.lit(r).alias("replicate"), F.lit(n).alias("scenario_days")) for r in range(3) for n in SIZES))
    days = C.avoided_by_day(_replay(w)).select("day", "avoided", F.explode(draws).alias("x")).select("day", "avoided", "x.*")
    order = Window.partitionBy("replicate", "scenario_days").orderBy(F.md5(F.concat_ws("|", F.date_format("day", "yyyy-MM-dd"), "replicate").cast("binary")))
    drawn = days.withColumn("drawn", F.row_number().over(order) <= F.col("scenario_days"))
    mean = lambda c, name: F.avg(F.when(c, F.col("avoided"))).alias(name)
    return drawn.groupBy("replicate", "scenario_days").agg(mean(F.col("drawn"), "gain_train"), mean(~F.col("drawn"), "gain_test"))


#: Fixed value: the days on which an aircraft is held out.
LAST_DAYS = "2024-01-28"


def _aircraft_without_test(w: W.Warehouse) -> DataFrame:
    own = lambda df: hinge.usable(df).select(F.col("tail_number").alias("g")).distinct()
    return hinge.without_test(own(_early(w.turns)), own(w.turns.filter(F.col("flight_date") > F.lit(LAST_DAYS).cast("date"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "raw_flights": lambda spark, d: plain(test_flights(prepared(spark), d)[0]),
    "stg_flights": _query(lambda w: w.stg_flights),
    "leg_sequence": _query(lambda w: W.leg_sequence(w.wide)),
    "rotations": _query(lambda w: W.rotations(w.wide)),
    "fct_legs": _query(lambda w: w.legs),
    "fct_turns": _query(lambda w: w.turns),
    "agg_airport_hour": _query(lambda w: W.airport_hour(w.stg_flights)),
    "agg_carrier_month": _query(lambda w: W.carrier_month(w.stg_flights)),
    "agg_delay_causes": _query(lambda w: W.delay_causes(w.stg_flights)),
    "cause_shares_by_carrier": _query(lambda w: descriptive.cause_shares(W.carrier_month(w.stg_flights))),
    "reactionary_by_hour": _query(lambda w: descriptive.by_hour(W.delay_causes(w.stg_flights))),
    "carrier_rotations": _query(lambda w: descriptive.rotations_by_carrier(w.legs, w.turns)),
    "network_summary": _query(lambda w: descriptive.network(W.carrier_month(w.stg_flights), w.legs, w.turns)),
    "top_hubs": _query(lambda w: descriptive.top_hubs(w.turns, 3)),
    "hinge_stats": _query(lambda w: hinge.day_sums(hinge.in_months(w.turns, list(HINGE_MONTHS)), "carrier")),
    "hinge_fit": _query(lambda w: _fit(w.turns)),
    "hinge_fit_stations": _query(lambda w: hinge.fit(hinge.day_sums(_early(w.turns), "station"))),
    "hinge_binned": _query(lambda w: hinge.shape(_late(w.turns), least=3)),
    "holdout_scores": _query(_scores),
    "holdout_pooled": _query(lambda w: hinge.pooled(_scores(w))),
    "gbm_root_gains": _query(lambda w: trees.root_gains(hinge.features(_early(w.turns)))),
    "filter_excluded_share": _query(lambda w: hinge.excluded_share(_late(w.turns))),
    "contagion_events": _query(_events),
    "multiplier_curve": _query(lambda w: contagion.curve(_events(w))),
    "multiplier_by_carrier": _query(lambda w: contagion.by(_events(w), "carrier")),
    "multiplier_by_hour": _query(lambda w: contagion.by(_events(w), "dep_hour_local", 5)),
    "carrier_adjusted": _query(lambda w: contagion.over_carrier_mix(_events(w), "origin", contagion.by(_events(w), "carrier"))),
    "late_aircraft_coded": _query(lambda w: contagion.coded_late(_events(w))),
    "scenario_legs": _query(_legs),
    "chain_replay": _query(_replay),
    "avoided_by_day": _query(lambda w: C.avoided_by_day(_replay(w))),
    "schedule_shift": _query(lambda w: C.timetable_shift(_legs(w), _by_hour(w))),
    "schedule_metrics": _query(lambda w: C.schedule_metrics(_replay(w))),
    "cell_turns": _query(lambda w: B.cells(_legs(w))),
    "propagated_score": _query(lambda w: B.propagated_score(_legs(w), TAU, BETA)),
    "marginal_score": _query(lambda w: B.marginal_score(_legs(w), B.cells(_legs(w)), TAU, BETA, B_MAX)),
    "uniform_policy": _query(lambda w: B.uniform(B.cells(_legs(w)), BUDGET, B_MAX)),
    "greedy_policy": _query(_greedy),
    "rounded_policy": _query(lambda w: B.rounded(_greedy(w))),
    "daily_delay": _query(lambda w: C.delay_by_day(_replay(w))),
    "daily_buffer": _query(lambda w: C.buffer_by_day(_replay(w))),
    "turn_features": _query(lambda w: hinge.features(w.turns)),
    "superspreaders": _query(lambda w: contagion.superspreaders(_events(w), w.airports, 5)),
    "ranked_hubs": _query(lambda w: evaluate.ranked(descriptive.top_hubs(w.turns, 100), "turns")),
    "stations_without_test": _query(lambda w: hinge.without_test(hinge.fit(hinge.day_sums(_early(w.turns), "station")), hinge.usable(_late(w.turns)).select(F.col("station").alias("g")).distinct())),
    "aircraft_without_test": _query(_aircraft_without_test),
    "airports": lambda spark, d: plain(seeded(_places(spark, d))),
    "contagion_events_by_day": _query(lambda w: contagion.events(w.legs)),
    "robustness_points": _query(_designs),
    "scenario_legs_of_month": _query(lambda w: C.scenario_legs(w.legs, CARRIER, C.scenario_days(w.legs, CARRIER, [HINGE_MONTHS[1]]))),
    "steps_in_order": _query(lambda w: B.steps_in_order(_placed(w), BUDGET)),
    "mean_gain_by_size": _query(lambda w: evaluate.mean_gain_by_size(_gains(w))),
    "dense_flight_ids": _query(lambda w: dense_ids(w.stg_flights, "carrier", "flight_id")),
    "fixture_sample": _sample,
    "dq_report": _query(lambda w: quality.report(w.tables)),
}


# ---------------------------------------------------------------- without SQL: draws, trees, the program


def _frame(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return contagion.to_spark(spark, f(_warehouse(spark, sf_dir)))

    return run


def _boosted(w: W.Warehouse) -> DataFrame:
    # Cells, fits, lines and both sides of the test read the turns: they are made once.
    turns = settled(hinge.usable(w.turns).select("flight_date", "flight_month", "carrier", "station", "dep_hour_local", "inbound_arr_delay", "sched_turn_min", "outbound_dep_delay"))
    train, test = hinge.features(_early(turns)), hinge.features(_late(turns))
    held = hinge.boosted(train, test)
    return hinge.score(train, held, _fit(turns), "carrier", {"gbm": "p_gbm"})


def _program(w: W.Warehouse) -> Program:
    legs = _legs(w).persist()
    return Program(legs, B.cells(legs).persist(), TAU, BETA, B_MAX)


def _optimal(w: W.Warehouse) -> DataFrame:
    program = _program(w)
    buffers, value, gap = program.solve(BUDGET)
    return program.table(buffers).withColumns({"objective": F.lit(value), "gap": F.lit(gap)})


#: The program is solved to the same gap in every query; the rest are the run's own values.
CONFIG = Config(tolerance=1e-6, budgets=tuple(BUDGET * x for x in (0, 0.25, 0.5, 1, 1.5, 2, 3, 4)), reference_budget=BUDGET)


@dataclass
class Solved:
    """The program on the training days, the held-out days, and both scores of cells."""

    w: W.Warehouse

    def __post_init__(self) -> None:
        self.program, self.test = _program(self.w), _test_legs(self.w).persist()
        train = self.program.legs
        self.scores = [s.persist() for s in (B.propagated_score(train, TAU, BETA), B.marginal_score(train, self.program.known, TAU, BETA, B_MAX))]

    def policies(self, budget: float = BUDGET) -> dict[str, DataFrame]:
        return evaluate.policies(self.program, budget, CONFIG, *self.scores)

    def frontier(self):
        named = {(p, b): df for b in CONFIG.budgets for p, df in self.policies(b).items()}
        return evaluate.frontier(self.program.legs, self.test, named, TAU, BETA, CONFIG)

    def allocation(self) -> DataFrame:
        return evaluate.allocation(self.program, self.policies()[evaluate.LP], *self.scores)

    def sensitivity(self):
        return evaluate.sensitivity(self.test, self.policies(), TAU, BETA, CONFIG)

    def schedule(self):
        return evaluate.schedule(self.test, self.policies(), TAU, BETA)

    def sizes(self):
        return evaluate.size_study(self.program.legs, self.test, TAU, BETA, CONFIG)


UNCHECKED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hinge_intervals": _frame(lambda w: hinge.fit_groups(_early(w.turns), "carrier")),
    "multiplier_curve_intervals": _frame(lambda w: contagion.curve_intervals(_events(w))),
    "multiplier_by_carrier_intervals": _frame(lambda w: contagion.by_intervals(_events(w), "carrier")),
    "contagion_robustness": _frame(lambda w: contagion.robustness(w.legs, MATCH)),
    "gbm_scores": _query(_boosted),
    "uniform_steps_policy": _query(lambda w: B.uniform_steps(B.cells(_legs(w)), BUDGET)),
    "lp_allocation": _query(_optimal),
    "buffer_frontier": _frame(lambda w: Solved(w).frontier()),
    "buffer_allocation": _query(lambda w: Solved(w).allocation()),
    "buffer_sensitivity": _frame(lambda w: Solved(w).sensitivity()),
    "buffer_schedule": _frame(lambda w: Solved(w).schedule()),
    "buffer_scenario_sizes": _frame(lambda w: Solved(w).sizes()),
}


# ---------------------------------------------------------------- SQL


def _local(ts: str, tz: str) -> str:
    return f"least(timezone('UTC', timezone({tz}, {ts})), timezone('UTC', timezone({tz}, {ts} - INTERVAL 1 HOUR)) + INTERVAL 1 HOUR)"


def _zone(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ZONES.items()) + " END"


_CLOCK = "(CAST({0}[1:2] AS INTEGER) * 60 + CAST({0}[3:4] AS INTEGER))"
_CODES = ("c_carrier", "c_weather", "c_nas", "c_security", "c_late")
_DELAYS = ("carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay")
_BASE = f"""WITH RECURSIVE {RAW_SQL},
z AS (SELECT *, {_zone("origin")} AS zo, {_zone("dest")} AS zd, {_CLOCK.format("dep_clock")} AS dm, {_CLOCK.format("arr_clock")} AS am FROM raw),
l AS (SELECT *, day + to_minutes(dm) AS dep_l, day + to_minutes(am) AS arr_0 FROM z),
u AS (SELECT *, {_local("dep_l", "zo")} AS dep_u FROM l),
g AS (SELECT *, coalesce(CAST(round(date_diff('minute', {_local("arr_0", "zd")}, dep_u + to_minutes(CAST(block AS BIGINT))) / 1440.0) AS INTEGER), CASE WHEN am < dm THEN 1 ELSE 0 END) AS days FROM u),
a AS (SELECT *, arr_0 + to_days(days) AS arr_l, {_local("arr_0 + to_days(days)", "zd")} AS arr_u FROM g),
stg AS (SELECT carrier || '-' || number || '-' || origin || '-' || strftime(dep_l, '%Y%m%d%H%M') AS flight_id, day AS flight_date, strftime(day, '%Y-%m') AS flight_month, carrier,
  tail AS tail_number, number AS flight_number, origin, dest, zo AS origin_tz, zd AS dest_tz, dep_l AS crs_dep_local, arr_l AS crs_arr_local, dep_u AS crs_dep_utc, arr_u AS crs_arr_utc,
  CAST(hour(dep_l) AS INTEGER) AS dep_hour_local, block AS crs_elapsed_min, date_diff('minute', dep_u, arr_u) - block AS block_time_residual_min, dep AS dep_delay, arr AS arr_delay,
  dep_u + to_minutes(CAST(dep AS BIGINT)) AS act_dep_utc, arr_u + to_minutes(CAST(arr AS BIGINT)) AS act_arr_utc, cancelled AS is_cancelled, diverted AS is_diverted, miles AS distance_mi,
  arr >= 15 AND c_carrier IS NOT NULL AS has_cause_codes, {", ".join(f"{c} AS {d}" for c, d in zip(_CODES, _DELAYS, strict=True))}
  FROM a QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY tail NULLS LAST) = 1),
o AS (SELECT *, lag(flight_id) OVER w AS p_id, lag(dest) OVER w AS p_dest, lag(crs_arr_utc) OVER w AS p_arr, lag(arr_delay) OVER w AS p_late, lag(is_diverted) OVER w AS p_div FROM stg
  WHERE NOT is_cancelled AND tail_number IS NOT NULL AND crs_dep_utc IS NOT NULL AND crs_arr_utc IS NOT NULL AND dep_delay IS NOT NULL AND abs(coalesce(block_time_residual_min, 0)) <= 30 AND crs_arr_utc > crs_dep_utc
  WINDOW w AS (PARTITION BY carrier, tail_number ORDER BY crs_dep_utc, flight_id)),
k AS (SELECT *, date_diff('minute', p_arr, crs_dep_utc) AS stay FROM o),
k2 AS (SELECT *, stay + dep_delay - p_late AS real_stay FROM k),
k3 AS (SELECT *, coalesce(p_dest = origin AND NOT p_div AND stay BETWEEN 0 AND 300 AND real_stay >= 0, false) AS is_linked FROM k2),
k4 AS (SELECT *, sum(CASE WHEN is_linked THEN 0 ELSE 1 END) OVER (PARTITION BY carrier, tail_number ORDER BY crs_dep_utc, flight_id ROWS UNBOUNDED PRECEDING) AS no FROM k3),
wide AS (SELECT * EXCLUDE (no), carrier || '-' || tail_number || '-' || no AS chain_id, row_number() OVER c AS leg_seq, count(*) OVER (PARTITION BY carrier, tail_number, no) AS chain_legs,
  first_value(flight_date) OVER c AS chain_date, CASE WHEN is_linked THEN p_id END AS prev_flight_id, CASE WHEN is_linked THEN stay END AS sched_turn_min, CASE WHEN is_linked THEN real_stay END AS actual_turn_min,
  CASE WHEN is_linked THEN p_late END AS inbound_arr_delay, CASE WHEN is_linked THEN p_arr END AS inbound_crs_arr_utc FROM k4 WINDOW c AS (PARTITION BY carrier, tail_number, no ORDER BY crs_dep_utc, flight_id)),
legs AS (SELECT *, chain_legs - leg_seq AS legs_remaining, CASE WHEN dep_hour_local < 6 THEN 'night' WHEN dep_hour_local < 12 THEN 'morning' WHEN dep_hour_local < 18 THEN 'afternoon' ELSE 'evening' END AS dep_period FROM wide),
turns AS (SELECT flight_id AS turn_id, prev_flight_id AS in_flight_id, flight_id AS out_flight_id, chain_id, carrier, tail_number, origin AS station, flight_date, flight_month, dep_hour_local, sched_turn_min, actual_turn_min,
  inbound_arr_delay, dep_delay AS outbound_dep_delay, arr_delay AS outbound_arr_delay, sched_turn_min - greatest(inbound_arr_delay, 0) AS available_turn_min, late_aircraft_delay AS outbound_late_aircraft_delay FROM wide WHERE is_linked),
"""
_AIRPORT_ROWS = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in r) + ")" for r in AIRPORTS)
_T = lambda *cols: ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in cols)
_D = lambda *cols: ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)
_SUMS = ", ".join(f"sum(coalesce({d}, 0)) AS {n}" for d, n in zip(_DELAYS, descriptive.NAMES, strict=True))
_AGG = ", ".join(f"sum({n}) AS {n}" for n in descriptive.NAMES)
_ALL = " + ".join(descriptive.NAMES)
_CM = f"cm AS (SELECT carrier, flight_month, count(*) AS flights, avg(CASE WHEN is_cancelled THEN 1.0 ELSE 0.0 END) AS cancel_rate, avg(CASE WHEN NOT is_cancelled AND NOT is_diverted THEN CASE WHEN arr_delay < 15 THEN 1.0 ELSE 0.0 END END) AS on_time_rate, {_SUMS} FROM stg GROUP BY ALL)"
_DC = f"dc AS (SELECT carrier, dep_hour_local, count(*) AS flights, {_SUMS}, sum({' + '.join(f'coalesce({d}, 0)' for d in _DELAYS)}) AS total_cause_min FROM stg WHERE NOT is_cancelled GROUP BY ALL)"
_NAMES = "CASE carrier " + " ".join(f"WHEN '{c}' THEN '{descriptive_name}'" for c, descriptive_name in (("AA", "American"), ("DL", "Delta"), ("OO", "SkyWest"), ("UA", "United"), ("WN", "Southwest"))) + " END"
_USE = "inbound_arr_delay BETWEEN -90 AND 600 AND outbound_dep_delay BETWEEN -60 AND 600"
_SUM6 = "count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy, sum(y * y) AS syy"


def _stats(group: str, where: str) -> str:
    return f"""xs AS (SELECT {group} AS g, flight_date AS d, CAST(tau AS INTEGER) AS tau, outbound_dep_delay AS y, greatest(0, inbound_arr_delay - (sched_turn_min - tau)) AS x FROM turns, range(0, 121) r(tau) WHERE {_USE} AND {where}),
    st AS (SELECT g, d, tau, {_SUM6} FROM xs GROUP BY ALL)"""


def _fits(group: str) -> str:
    return f"""{_stats(group, f"flight_date <= DATE '{SPLIT}'")},
    t1 AS (SELECT g, tau, sum(n)::BIGINT AS n, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy, sum(syy) AS syy FROM st GROUP BY ALL),
    t2 AS (SELECT *, sxx - sx * sx / n AS cxx, sxy - sx * sy / n AS cxy, syy - sy * sy / n AS cyy FROM t1),
    t3 AS (SELECT *, CASE WHEN cxx > 1e-9 THEN cxy / cxx ELSE 0.0::DOUBLE END AS beta FROM t2),
    t4 AS (SELECT *, cyy - beta * cxy AS sse, (sy - beta * sx) / n AS a FROM t3),
    ft AS (SELECT b.g, b.n AS n_turns, b.a, b.beta, b.tau, b.sse, z.a AS a_tau0, z.beta AS beta_tau0 FROM (SELECT * FROM t4 QUALIFY row_number() OVER (PARTITION BY g ORDER BY sse, tau) = 1) b JOIN t4 z ON z.g = b.g AND z.tau = 0)"""


_SCORES = f"""{_fits("carrier")},
    tr AS (SELECT carrier AS g, inbound_arr_delay::DOUBLE AS i, sched_turn_min::DOUBLE AS s, outbound_dep_delay::DOUBLE AS y FROM turns WHERE {_USE} AND flight_date <= DATE '{SPLIT}'),
    te AS (SELECT carrier AS g, inbound_arr_delay::DOUBLE AS i, sched_turn_min::DOUBLE AS s, outbound_dep_delay::DOUBLE AS y FROM turns WHERE {_USE} AND flight_date > DATE '{SPLIT}'),
    mm AS (SELECT g, avg(i) AS mi, avg(s) AS ms, avg(y) AS my, var_pop(i) AS cii, covar_pop(i, s) AS cis, covar_pop(i, y) AS ciy, var_pop(s) AS css, covar_pop(s, y) AS csy FROM tr GROUP BY g),
    ml AS (SELECT *, ciy / cii AS li, (ciy * css - csy * cis) / (cii * css - cis * cis) AS pi, (csy * cii - ciy * cis) / (cii * css - cis * cis) AS ps FROM mm),
    er AS (SELECT te.g, y - my AS e_constant, y - (my - li * mi + li * i) AS e_linear, y - (my - pi * mi - ps * ms + pi * i + ps * s) AS e_linear_slack, y - (a_tau0 + beta_tau0 * greatest(0, i - s)) AS e_hinge_tau0,
       y - (a + beta * greatest(0, i - (s - tau))) AS e_hinge FROM te JOIN ft USING (g) JOIN ml USING (g)),
    sc AS (SELECT g, count(*) AS n_test, {", ".join(f"avg(abs(e_{m})) AS mae_{m}, sqrt(avg(e_{m} * e_{m})) AS rmse_{m}" for m in ("constant", "linear", "linear_slack", "hinge_tau0", "hinge"))} FROM er GROUP BY g)"""
_MODELS = ("constant", "linear", "linear_slack", "hinge_tau0", "hinge")
_EVENTS = f"""dn AS (SELECT *, sum(greatest(coalesce(arr_delay, 0), 0)) OVER (PARTITION BY chain_id ORDER BY leg_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM legs),
    ss AS (SELECT flight_id, carrier, origin, flight_date, dep_hour_local, dep_period, least(legs_remaining, 4) AS rem, dep_delay AS x, s, late_aircraft_delay FROM dn WHERE legs_remaining >= 1 AND (leg_seq = 1 OR inbound_arr_delay <= 0) AND dep_delay BETWEEN -60 AND 600),
    ct AS (SELECT {", ".join(MATCH)}, avg(s) AS baseline, count(*) AS n_ctrl FROM ss WHERE x <= 0 GROUP BY ALL),
    ce AS (SELECT ss.*, baseline, n_ctrl, s - baseline AS excess FROM ss JOIN ct USING ({", ".join(MATCH)}) WHERE n_ctrl >= 5)"""
_BIN = "CASE WHEN x >= 1 AND x < 15 THEN '1-14' WHEN x >= 15 AND x < 30 THEN '15-29' WHEN x >= 30 AND x < 60 THEN '30-59' WHEN x >= 60 AND x < 120 THEN '60-119' WHEN x >= 120 AND x < 240 THEN '120-239' WHEN x >= 240 AND x < 601 THEN '240-600' END"


def _ratio(key: str, name: str, where: str, more: str = "", having: str = "") -> str:
    return f"SELECT {key} AS {name}, count(*) AS n_events, round(sum(x), 6) AS primary_min, round(sum(excess), 6) AS excess_min, round(sum(excess) / sum(x), 6) AS multiplier{more} FROM ce WHERE {where} GROUP BY {key} {having}"


_CELLS = f"""sl AS (SELECT chain_id, leg_seq, chain_date AS day, origin, dep_hour_local, sched_turn_min, dep_delay, arr_delay FROM legs WHERE carrier = '{CARRIER}' AND NOT is_diverted AND arr_delay IS NOT NULL AND chain_date <= DATE '{SPLIT}'),
    rn AS (SELECT *, coalesce(leg_seq <> lag(leg_seq) OVER w + 1, true) AS st, lag(arr_delay) OVER w AS inb FROM sl WINDOW w AS (PARTITION BY chain_id ORDER BY leg_seq)),
    dz AS (SELECT *, CASE WHEN st THEN 0.0 ELSE greatest(0, inb - sched_turn_min + {TAU}) END AS z FROM rn),
    dp AS (SELECT *, dep_delay - {BETA} * z AS p, arr_delay - dep_delay AS e, CASE WHEN st THEN 0.0 ELSE (dep_hour_local % 4) * 5.0 END AS b FROM dz),
    nd AS (SELECT count(DISTINCT day) AS days FROM sl),
    cl AS (SELECT origin, dep_hour_local, count(*) FILTER (NOT st) / (SELECT days FROM nd) AS nbar FROM rn GROUP BY ALL HAVING max(leg_seq) > 1),
    ps AS (SELECT origin, dep_hour_local, avg({BETA} * z) AS score FROM dz WHERE NOT st GROUP BY ALL)"""
_REPLAY = f"""{_CELLS},
    kn AS (SELECT dp.* REPLACE (CASE WHEN st OR cl.nbar IS NULL THEN 0.0 ELSE b END AS b) FROM dp LEFT JOIN cl USING (origin, dep_hour_local)),
    rec AS (SELECT chain_id, leg_seq, CAST(p + e AS DOUBLE) AS arrival, CAST(b AS DOUBLE) AS shift FROM kn WHERE st
      UNION ALL SELECT n.chain_id, n.leg_seq, CAST(n.p + {BETA} * greatest(0, r.arrival - n.sched_turn_min - n.b + {TAU}) + n.e AS DOUBLE), CAST(r.shift + n.b AS DOUBLE) FROM rec r JOIN kn n ON n.chain_id = r.chain_id AND n.leg_seq = r.leg_seq + 1 AND NOT n.st),
    rp AS (SELECT kn.chain_id, kn.leg_seq, day, origin, dep_hour_local, dep_delay, arr_delay, CAST(b AS DOUBLE) AS b, shift, arrival FROM kn JOIN rec USING (chain_id, leg_seq))"""
_GREEDY = f"""{_CELLS},
    gs AS (SELECT origin, dep_hour_local, nbar, coalesce(score, 0) AS score FROM cl LEFT JOIN ps USING (origin, dep_hour_local)),
    gb AS (SELECT *, nbar > 0 AND score > 0 AS able, coalesce(sum(CASE WHEN nbar > 0 AND score > 0 THEN nbar * {B_MAX} ELSE 0 END) OVER (ORDER BY score DESC, origin, dep_hour_local ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM gs),
    gr AS (SELECT origin, dep_hour_local, CASE WHEN able THEN least({B_MAX}, greatest(0, ({BUDGET} - bef) / nbar)) ELSE 0.0 END::DOUBLE AS buffer FROM gb)"""
_MARGINAL = f"""{_CELLS},
    rr AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY chain_id ORDER BY leg_seq ROWS UNBOUNDED PRECEDING) AS run FROM dp),
    tc AS (SELECT DISTINCT chain_id, run, origin AS co, dep_hour_local AS ch FROM rr WHERE NOT st),
    te AS (SELECT rr.*, co, ch, CASE WHEN NOT st AND origin = co AND dep_hour_local = ch THEN {B_MAX} ELSE 0.0 END AS pad FROM rr JOIN tc USING (chain_id, run)),
    rec AS (SELECT chain_id, leg_seq, co, ch, CAST(p + e AS DOUBLE) AS arrival FROM te WHERE st
      UNION ALL SELECT n.chain_id, n.leg_seq, n.co, n.ch, CAST(n.p + {BETA} * greatest(0, r.arrival - n.sched_turn_min - n.pad + {TAU}) + n.e AS DOUBLE) FROM rec r JOIN te n ON n.chain_id = r.chain_id AND n.leg_seq = r.leg_seq + 1 AND NOT n.st AND n.co = r.co AND n.ch = r.ch),
    ga AS (SELECT co AS origin, ch AS dep_hour_local, sum(greatest(te.arr_delay, 0) - greatest(arrival, 0)) AS gain FROM rec JOIN te USING (chain_id, leg_seq, co, ch) GROUP BY ALL)"""



def _events_sql(match: tuple[str, ...], rem: str = "least(legs_remaining, 4)", where: str = "true") -> str:
    """``_EVENTS`` under another design."""
    return f"""dn AS (SELECT *, sum(greatest(coalesce(arr_delay, 0), 0)) OVER (PARTITION BY chain_id ORDER BY leg_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM legs),
    ss AS (SELECT flight_id, carrier, origin, flight_date, dep_hour_local, dep_period, {rem} AS rem, dep_delay AS x, s, late_aircraft_delay FROM dn WHERE legs_remaining >= 1 AND (leg_seq = 1 OR inbound_arr_delay <= 0) AND dep_delay BETWEEN -60 AND 600 AND {where}),
    ct AS (SELECT {", ".join(match)}, avg(s) AS baseline, count(*) AS n_ctrl FROM ss WHERE x <= 0 GROUP BY ALL),
    ce AS (SELECT ss.*, baseline, n_ctrl, s - baseline AS excess FROM ss JOIN ct USING ({", ".join(match)}) WHERE n_ctrl >= 5)"""


def _designs_sql() -> str:
    ways = ((MATCH, {}), ((*MATCH, "origin"), {}), (MATCH, {"rem": "legs_remaining"}), (MATCH, {"where": "coalesce(late_aircraft_delay, 0) = 0"}))
    # The parts are chained under one WITH, each with names of its own.
    chained, picks = [], []
    for i, ((name, _), (match, how)) in enumerate(zip(contagion.DESIGNS, ways, strict=True)):
        sql = _events_sql(match, **how)
        for t in ("dn", "ss", "ct", "ce"):
            sql = re.sub(rf"\b{t}\b", f"{t}{i}", sql)
        chained.append(sql)
        picks.append(_ratio(f"'{name}'", "variant", "x >= 15").replace("FROM ce", f"FROM ce{i}").replace(f"GROUP BY '{name}'", "HAVING count(*) > 0"))
    return ", ".join(chained) + " " + " UNION ALL ".join(picks)


_SQL: dict[str, str] = {
    "stg_flights": f"SELECT * REPLACE ({_T('crs_dep_local', 'crs_arr_local', 'crs_dep_utc', 'crs_arr_utc', 'act_dep_utc', 'act_arr_utc')}, {_D('flight_date')}) FROM stg",
    "leg_sequence": f"SELECT flight_id, carrier, tail_number, chain_id, leg_seq, chain_legs, {_D('chain_date')}, is_linked, prev_flight_id, sched_turn_min, actual_turn_min, inbound_arr_delay, {_T('inbound_crs_arr_utc')} FROM wide",
    "rotations": "SELECT flight_id AS turn_id, prev_flight_id AS in_flight_id, flight_id AS out_flight_id, chain_id, leg_seq AS out_leg_seq, carrier, tail_number, origin AS station, strftime(inbound_crs_arr_utc, '%Y-%m-%d %H:%M:%S') AS in_crs_arr_utc, strftime(crs_dep_utc, '%Y-%m-%d %H:%M:%S') AS out_crs_dep_utc, sched_turn_min, actual_turn_min, inbound_arr_delay, dep_delay AS outbound_dep_delay FROM wide WHERE is_linked",
    "fct_legs": f"SELECT flight_id, {_D('flight_date')}, flight_month, carrier, tail_number, chain_id, {_D('chain_date')}, leg_seq, chain_legs, legs_remaining, origin, dest, dep_hour_local, dep_period, {_T('crs_dep_utc', 'crs_arr_utc')}, is_linked, prev_flight_id, sched_turn_min, inbound_arr_delay, dep_delay, arr_delay, is_diverted, {', '.join(_DELAYS)} FROM legs",
    "fct_turns": f"SELECT * REPLACE ({_D('flight_date')}) FROM turns",
    "agg_airport_hour": f"SELECT origin AS airport, dep_hour_local, count(*) AS flights, round(avg(dep_delay), 6) AS mean_dep_delay, round(avg(CASE WHEN dep_delay >= 15 THEN 1.0 ELSE 0.0 END), 6) AS share_dep_delayed_15, {_SUMS} FROM stg WHERE NOT is_cancelled GROUP BY ALL",
    "agg_carrier_month": f"{_CM} SELECT * REPLACE (round(cancel_rate, 6) AS cancel_rate, round(on_time_rate, 6) AS on_time_rate) FROM cm",
    "agg_delay_causes": f"{_DC} SELECT * FROM dc",
    "cause_shares_by_carrier": f"{_CM}, s AS (SELECT carrier, sum(flights)::BIGINT AS flights, {_AGG} FROM cm GROUP BY carrier) SELECT *, round(late_aircraft_min / ({_ALL}), 6) AS reactionary_share, round(({_ALL}) / flights, 6) AS delay_min_per_flight, {_NAMES} AS name FROM s",
    "reactionary_by_hour": f"{_DC}, s AS (SELECT dep_hour_local, sum(flights)::BIGINT AS flights, {_AGG} FROM dc GROUP BY 1) SELECT *, round((carrier_min + weather_min + nas_min + security_min) / flights, 6) AS primary_per_flight, round(late_aircraft_min / flights, 6) AS reactionary_per_flight, round(late_aircraft_min / nullif({_ALL}, 0), 6) AS reactionary_share FROM s",
    "carrier_rotations": f"""dy AS (SELECT carrier, count(*) AS legs, count(DISTINCT (tail_number, chain_date)) AS tail_days FROM legs GROUP BY carrier),
        tn AS (SELECT carrier, quantile_cont(sched_turn_min::DOUBLE, 0.5) AS median_sched_turn_min, quantile_cont(sched_turn_min::DOUBLE, 0.25) AS p25_sched_turn_min FROM turns GROUP BY carrier)
        SELECT carrier, legs, tail_days, median_sched_turn_min, p25_sched_turn_min, round(legs / tail_days, 6) AS legs_per_aircraft_day, {_NAMES} AS name FROM dy JOIN tn USING (carrier)""",
    "network_summary": f"""{_CM}, s AS (SELECT sum(flights)::BIGINT AS flights, min(flight_month) AS first_month, max(flight_month) AS last_month, {_AGG} FROM cm)
        SELECT flights, (SELECT count(*) FROM legs) AS operated_legs_in_chains, (SELECT count(*) FROM turns) AS turns, (SELECT count(DISTINCT chain_id) FROM turns) AS chains_with_turns, first_month, last_month, round(late_aircraft_min / ({_ALL}), 6) AS reactionary_share, {_ALL} AS total_cause_minutes FROM s""",
    "top_hubs": "SELECT station, count(*) AS turns FROM turns GROUP BY station ORDER BY turns DESC, station LIMIT 3",
    "hinge_stats": f"{_stats('carrier', 'true')} SELECT * REPLACE ({_D('d')}) FROM st",
    "hinge_fit": f"{_fits('carrier')} SELECT g, n_turns, round(a, 6) AS a, round(beta, 6) AS beta, tau, round(sse, 6) AS sse, round(a_tau0, 6) AS a_tau0, round(beta_tau0, 6) AS beta_tau0 FROM ft",
    "hinge_fit_stations": f"{_fits('station')} SELECT g, n_turns, round(a, 6) AS a, round(beta, 6) AS beta, tau, round(sse, 6) AS sse, round(a_tau0, 6) AS a_tau0, round(beta_tau0, 6) AS beta_tau0 FROM ft",
    "hinge_binned": f"SELECT carrier, least(greatest(round((sched_turn_min - inbound_arr_delay) / 5) * 5, -120), 180) AS ground_left, count(*) AS n, round(avg(outbound_dep_delay), 6) AS mean_out FROM turns WHERE {_USE} AND flight_date > DATE '{SPLIT}' GROUP BY ALL HAVING count(*) >= 3",
    "holdout_scores": f"{_SCORES} SELECT g, n_test, {', '.join(f'round(mae_{m}, 6) AS mae_{m}, round(rmse_{m}, 6) AS rmse_{m}' for m in _MODELS)} FROM sc",
    "holdout_pooled": f"{_SCORES} SELECT sum(n_test)::BIGINT AS n_test, {', '.join(f'round(sum(mae_{m} * n_test) / sum(n_test), 6) AS mae_{m}, round(sqrt(sum(rmse_{m} * rmse_{m} * n_test) / sum(n_test)), 6) AS rmse_{m}' for m in _MODELS)} FROM sc",
    "gbm_root_gains": f"""tr AS (SELECT floor(inbound_arr_delay) AS i, floor(sched_turn_min) AS s, dep_hour_local AS hour, carrier, outbound_dep_delay AS y FROM turns WHERE {_USE} AND flight_date <= DATE '{SPLIT}'),
        v AS (SELECT 'i' AS feature, CAST(i AS BIGINT) AS value, CAST(NULL AS VARCHAR) AS name, count(*) AS n, sum(y) AS sy FROM tr GROUP BY i UNION ALL SELECT 's', CAST(s AS BIGINT), NULL, count(*), sum(y) FROM tr GROUP BY s
              UNION ALL SELECT 'hour', CAST(hour AS BIGINT), NULL, count(*), sum(y) FROM tr GROUP BY hour UNION ALL SELECT 'carrier', NULL, carrier, count(*), sum(y) FROM tr GROUP BY carrier),
        c AS (SELECT feature, value, row_number() OVER w AS place, sum(n) OVER w AS nl, sum(sy) OVER w AS yl, sum(n) OVER (PARTITION BY feature) AS n, sum(sy) OVER (PARTITION BY feature) AS y
              FROM v WINDOW w AS (PARTITION BY feature ORDER BY coalesce(value, -sy / n), name ROWS UNBOUNDED PRECEDING)),
        d AS (SELECT feature, coalesce(value, place)::BIGINT AS upto, nl::BIGINT AS n_low, nl, n - nl AS nr, n, nl * (y / n) - yl AS gl, (n - nl) * (y / n) - (y - yl) AS gr, n * (y / n) - y AS g FROM c WHERE nl < n)
        SELECT feature, upto, n_low, round(gl * gl / nl + gr * gr / nr - g * g / n, 6) AS gain FROM d""",
    "dense_flight_ids": "SELECT carrier, flight_id, row_number() OVER (ORDER BY carrier, flight_id) - 1 AS id FROM stg",
    "filter_excluded_share": f"SELECT round(1 - count(*) FILTER ({_USE}) / count(*), 6) AS excluded_share FROM turns WHERE flight_date > DATE '{SPLIT}' AND inbound_arr_delay IS NOT NULL AND outbound_dep_delay IS NOT NULL",
    "contagion_events": f"{_EVENTS} SELECT * REPLACE ({_D('flight_date')}, round(baseline, 6) AS baseline, round(excess, 6) AS excess) FROM ce",
    "multiplier_curve": f"{_EVENTS} {_ratio(_BIN, 'x_bin', 'x >= 1', ', ' + ', '.join(f'round(avg({c}), 6) AS {n}' for c, n in (('x', 'mean_x'), ('excess', 'mean_excess'), ('s', 'mean_downstream'), ('baseline', 'mean_baseline'))))}",
    "multiplier_by_carrier": f"{_EVENTS} {_ratio('carrier', 'carrier', 'x >= 15')}",
    "multiplier_by_hour": f"{_EVENTS} {_ratio('dep_hour_local', 'dep_hour_local', 'x >= 15', having='HAVING count(*) >= 5')}",
    "carrier_adjusted": f"{_EVENTS}, m AS (SELECT carrier, sum(excess) / sum(x) AS m FROM ce WHERE x >= 15 GROUP BY carrier) SELECT origin, count(*) AS n_events, sum(x) AS primary_min, round(sum(excess - m * x) / sum(x), 6) AS excess_over_mix, round(sum(m * x) / sum(x), 6) AS carrier_mix FROM ce JOIN m USING (carrier) WHERE x >= 15 GROUP BY origin",
    "late_aircraft_coded": f"{_EVENTS} SELECT count(*) AS events, round(avg((coalesce(late_aircraft_delay, 0) > 0)::INT), 6) AS share_events, round(sum(x) FILTER (coalesce(late_aircraft_delay, 0) > 0) / sum(x), 6) AS share_primary_min FROM ce WHERE x >= 15",
    "scenario_legs": f"{_CELLS} SELECT * REPLACE ({_D('day')}) FROM sl",
    "chain_replay": f"{_REPLAY} SELECT * REPLACE ({_D('day')}, round(arrival, 6) AS arrival) FROM rp",
    "avoided_by_day": f"{_REPLAY} SELECT {_D('day')}, round(sum(greatest(arr_delay, 0)) - sum(greatest(arrival, 0)), 6) AS avoided FROM rp GROUP BY rp.day",
    "schedule_shift": f"{_REPLAY} SELECT chain_id, leg_seq, {_D('day')}, shift FROM rp",
    "schedule_metrics": f"{_REPLAY} SELECT round(avg((arrival < 15)::INT), 6) AS ontime15, round(avg((arrival + shift < 15)::INT), 6) AS ontime15_clock, round(sum(greatest(arrival + shift, 0)) / count(DISTINCT day), 6) AS clock_late_per_day FROM rp",
    "daily_delay": f"{_REPLAY} SELECT {_D('day')}, round(sum(greatest(arrival, 0)), 6) AS delay FROM rp GROUP BY rp.day",
    "daily_buffer": f"{_REPLAY} SELECT {_D('day')}, sum(b) AS buffer FROM rp GROUP BY rp.day",
    "turn_features": f"SELECT carrier, station, flight_month, dep_hour_local AS hour, inbound_arr_delay::DOUBLE AS i, sched_turn_min::DOUBLE AS s, outbound_dep_delay::DOUBLE AS y FROM turns WHERE {_USE}",
    "superspreaders": f"""{_EVENTS}, m AS (SELECT carrier, sum(excess) / sum(x) AS m FROM ce WHERE x >= 15 GROUP BY carrier), ap(origin, name, city, state, tz, lat, lon) AS (VALUES {", ".join(str(r).replace('"', "'").replace("O'H", "O''H") for r in AIRPORTS)})
        SELECT origin, n_events, primary_min, excess_min, multiplier, carrier_mix, excess_over_mix, name, city, state, round(lat, 5)::DOUBLE AS lat, round(lon, 5)::DOUBLE AS lon FROM
        (SELECT origin, count(*) AS n_events, round(sum(x), 6) AS primary_min, round(sum(excess), 6) AS excess_min, round(sum(excess) / sum(x), 6) AS multiplier, round(sum(m * x) / sum(x), 6) AS carrier_mix, round(sum(excess - m * x) / sum(x), 6) AS excess_over_mix
         FROM ce JOIN m USING (carrier) WHERE x >= 15 GROUP BY origin HAVING count(*) >= 5) LEFT JOIN ap USING (origin)""",
    "ranked_hubs": "SELECT station, count(*) AS turns, CAST(rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS rank FROM turns GROUP BY station",
    "aircraft_without_test": f"SELECT DISTINCT tail_number AS g FROM turns WHERE {_USE} AND flight_date <= DATE '{SPLIT}' AND tail_number NOT IN (SELECT tail_number FROM turns WHERE {_USE} AND flight_date > DATE '{LAST_DAYS}')",
    "airports": f"""ap AS (SELECT * FROM (VALUES {_AIRPORT_ROWS}) v(iata, name, city, state, tz, lat, lon)),
        pl AS (SELECT ap.*, number % 3 AS i FROM raw JOIN ap ON ap.iata = raw.origin WHERE number % 11 <> 0 AND number % 13 <> 0 AND number % 7 <> 0
               UNION ALL SELECT ap.*, number % 3 FROM raw JOIN ap ON ap.iata = raw.dest WHERE number % 11 <> 0 AND number % 13 <> 0 AND number % 7 <> 0)
        SELECT iata, min(name || ' ' || i) AS name, min(city) AS city, min(state) AS state, min(tz) AS tz, min(lat)::DOUBLE AS lat, min(lon)::DOUBLE AS lon FROM pl GROUP BY iata""",
    "mean_gain_by_size": f"""{_REPLAY}, ad AS (SELECT day, sum(greatest(arr_delay, 0)) - sum(greatest(arrival, 0)) AS avoided FROM rp GROUP BY day),
        dr AS (SELECT r AS replicate, n AS scenario_days, avoided, row_number() OVER (PARTITION BY r, n ORDER BY md5(CAST(day AS DATE)::VARCHAR || '|' || r)) <= n AS drawn FROM ad, range(3) q(r), (VALUES {", ".join(f"({n})" for n in SIZES)}) z(n)),
        gn AS (SELECT replicate, scenario_days, avg(avoided) FILTER (drawn) AS gain_train, avg(avoided) FILTER (NOT drawn) AS gain_test FROM dr GROUP BY ALL)
        SELECT scenario_days, round(avg(gain_train), 6) AS gain_train, round(avg(gain_test), 6) AS gain_test FROM gn GROUP BY scenario_days""",
    "stations_without_test": f"SELECT DISTINCT station AS g FROM turns WHERE {_USE} AND flight_date <= DATE '{SPLIT}' AND station NOT IN (SELECT station FROM turns WHERE {_USE} AND flight_date > DATE '{SPLIT}')",
    "contagion_events_by_day": f"{_events_sql(contagion.MATCH)} SELECT * REPLACE ({_D('flight_date')}, round(baseline, 6) AS baseline, round(excess, 6) AS excess) FROM ce",
    "robustness_points": _designs_sql(),
    "scenario_legs_of_month": f"SELECT chain_id, leg_seq, CAST(chain_date AS VARCHAR) AS day, origin, dep_hour_local, sched_turn_min, dep_delay, arr_delay FROM legs WHERE carrier = '{CARRIER}' AND NOT is_diverted AND arr_delay IS NOT NULL AND chain_date IN (SELECT chain_date FROM legs WHERE carrier = '{CARRIER}' AND strftime(chain_date, '%Y-%m') = '{HINGE_MONTHS[1]}')",
    "steps_in_order": f"""{_CELLS}, pl AS (SELECT origin, dep_hour_local, 5.0 * nbar AS cost, row_number() OVER (ORDER BY md5(origin || '|' || dep_hour_local)) AS i FROM cl),
        kn AS (SELECT 0::BIGINT AS i, {BUDGET}::DOUBLE AS rest, 0.0::DOUBLE AS buffer, ''::VARCHAR AS origin, 0 AS dep_hour_local
          UNION ALL SELECT p.i, CASE WHEN p.cost > 0 AND p.cost <= k.rest THEN k.rest - p.cost ELSE k.rest END, CASE WHEN p.cost > 0 AND p.cost <= k.rest THEN 5.0 ELSE 0.0 END, p.origin, p.dep_hour_local FROM kn k JOIN pl p ON p.i = k.i + 1)
        SELECT origin, dep_hour_local, buffer FROM kn WHERE i > 0""",
    "cell_turns": f"{_CELLS} SELECT origin, dep_hour_local, round(nbar, 6) AS nbar FROM cl",
    "propagated_score": f"{_CELLS} SELECT origin, dep_hour_local, round(score, 6) AS score FROM ps",
    "marginal_score": f"{_MARGINAL} SELECT origin, dep_hour_local, round(gain / (SELECT days FROM nd) / ({B_MAX} * nbar), 6) + 0.0 AS score FROM ga JOIN cl USING (origin, dep_hour_local)",
    "uniform_policy": f"{_CELLS} SELECT origin, dep_hour_local, round(CASE WHEN nbar > 0 THEN least({B_MAX}, {BUDGET} / (SELECT sum(nbar) FROM cl)) ELSE 0 END, 6)::DOUBLE AS buffer FROM cl",
    "greedy_policy": f"{_GREEDY} SELECT origin, dep_hour_local, round(buffer, 6) AS buffer FROM gr",
    "rounded_policy": f"{_GREEDY} SELECT origin, dep_hour_local, round_even(buffer / 5, 0) * 5 AS buffer FROM gr",
}
_RAW_COLUMNS = """day::VARCHAR AS "FlightDate", carrier AS "Reporting_Airline", tail AS "Tail_Number", number AS "Flight_Number_Reporting_Airline", origin AS "Origin", dest AS "Dest", dep_clock AS "CRSDepTime", DepTime, dep AS "DepDelay", arr_clock AS "CRSArrTime", ArrTime,
    arr AS "ArrDelay", cancelled::INT::DOUBLE AS "Cancelled", diverted::INT::DOUBLE AS "Diverted", block AS "CRSElapsedTime", miles AS "Distance", c_carrier AS "CarrierDelay", c_weather AS "WeatherDelay", c_nas AS "NASDelay", c_security AS "SecurityDelay", c_late AS "LateAircraftDelay" """
_RAW_TIMES = f"(SELECT *, strftime(day + to_minutes({_CLOCK.format('dep_clock')}) + to_minutes(dep::BIGINT), '%H%M') AS DepTime, strftime(day + to_minutes({_CLOCK.format('arr_clock')}) + to_minutes(arr::BIGINT), '%H%M') AS ArrTime FROM raw)"

ORACLE_SQL: dict[str, str] = {k: _BASE.rstrip().removesuffix(",") + (", " if not v.startswith("SELECT") else " ") + v for k, v in _SQL.items()}


def _quality_sql() -> str:
    """The expectations' names say what they count."""
    stations = ", ".join(f"('{r[0]}', '{r[4]}')" for r in AIRPORTS)
    tables = {
        "airports": f"(SELECT * FROM (VALUES {stations}) v(iata, tz))", "stg_flights": "stg", "int_leg_sequence": "wide", "fct_legs": "legs", "fct_turns": "turns",
        "int_rotations": "turns", "agg_airport_hour": "(SELECT DISTINCT dep_hour_local FROM stg WHERE NOT is_cancelled)",
    }
    fields = {"stg_flights": "flight_id", "airports": "iata", "fct_legs": "flight_id"}
    values = {"carrier": quality.KNOWN_CARRIERS, "dep_period": ("night", "morning", "afternoon", "evening"), "dep_hour_local": tuple(range(24))}
    special = {
        "block_time_consistent": "SELECT * FROM stg WHERE abs(block_time_residual_min) > 30",
        "legs_ordered": "SELECT * FROM (SELECT *, lag(crs_arr_utc) OVER (PARTITION BY chain_id ORDER BY leg_seq) AS landed FROM legs) WHERE crs_arr_utc <= crs_dep_utc OR landed > crs_dep_utc",
        "turns_nonnegative": "SELECT * FROM turns WHERE sched_turn_min < 0 OR actual_turn_min < 0",
    }

    def broken(name: str) -> str:
        if name in special:
            return special[name]
        kind = next(k for k in ("not_null", "unique", "accepted", "related") if name.startswith(k))
        rest = name.removeprefix(kind + "_")
        table = next(t for t in tables if rest.startswith(t + "_"))
        column, source = rest.removeprefix(table + "_"), tables[table]
        if kind == "not_null":
            return f"SELECT * FROM {source} WHERE {column} IS NULL"
        if kind == "unique":
            return f"SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
        if kind == "accepted":
            return f"SELECT * FROM {source} WHERE {column} NOT IN ({', '.join(map(repr, values[column]))})"
        parent = next(t for t in fields if column.endswith("_" + t))
        column = column.removesuffix("_" + parent)
        return f"SELECT * FROM {source} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {fields[parent]} FROM {tables[parent]})"

    parts = [f"SELECT '{e.name}' AS expectation, count(*) AS broken, {'NULL' if e.warn is None else e.warn} AS w, {'NULL' if e.error is None else e.error} AS e FROM ({broken(e.name)})" for e in quality.EXPECTATIONS]
    return f"SELECT expectation, broken, CASE WHEN broken > e THEN 'error' WHEN broken > w THEN 'warn' ELSE 'pass' END AS status FROM ({' UNION ALL '.join(parts)})"


ORACLE_SQL["dq_report"] = _BASE.rstrip().removesuffix(",") + " " + _quality_sql()
ORACLE_SQL["raw_flights"] = f"WITH {RAW_SQL} SELECT {_RAW_COLUMNS} FROM {_RAW_TIMES}"
ORACLE_SQL["fixture_sample"] = f"""WITH {RAW_SQL}, picked AS (SELECT * FROM {_RAW_TIMES} WHERE day IN (DATE '2024-01-10', DATE '2024-01-11')),
    first5 AS (SELECT carrier, tail FROM (SELECT DISTINCT carrier, tail FROM picked WHERE tail IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY carrier ORDER BY md5(tail), tail) <= 5)
    SELECT {_RAW_COLUMNS} FROM picked JOIN first5 USING (carrier, tail)"""
