from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwake.config import Config
from turnwake.operators import buffers as B
from turnwake.operators import chains as C
from turnwake.operators import evaluate, lp
from turnwake.plans import analysis

TAU, BETA = 30.0, 1.0
SCHEMA = "chain_id string, leg_seq long, day date, origin string, dep_hour_local int, sched_turn_min double, dep_delay double, arr_delay double"
DAY = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def toy(spark):
    """One chain: turns of 40 and 45 minutes after legs that are 60 and 50 minutes late."""
    rows = [("c", 1, DAY, "AAA", 8, None, 60.0, 60.0), ("c", 2, DAY, "BBB", 10, 40.0, 50.0, 50.0), ("c", 3, DAY, "CCC", 12, 45.0, 35.0, 35.0)]
    return spark.createDataFrame(rows, SCHEMA)


def cell(spark, **buffer):
    hours = {"BBB": 10, "CCC": 12}
    return spark.createDataFrame([(k, hours[k], float(v)) for k, v in buffer.items()], "origin string, dep_hour_local int, buffer double")


def random_legs(spark, n_chains=60, days=6, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for c in range(n_chains):
        for seq in range(1, int(rng.integers(2, 6))):
            rows.append((f"c{c}", seq, DAY + dt.timedelta(days=c % days), "XYZW"[rng.integers(4)], int(rng.integers(6, 9)), None if seq == 1 else float(rng.integers(30, 80)), float(rng.integers(-5, 90)), float(rng.integers(-15, 95))))
    return spark.createDataFrame(rows, SCHEMA)


def test_replay_gives_back_what_was_observed(spark, toy):
    assert C.replays_exactly(toy, TAU, BETA) and C.replays_exactly(random_legs(spark), 41.0, 0.8)
    assert C.delay_by_day(C.replay(toy, None, TAU, BETA)).first()["delay"] == 145


def test_replay_under_buffers_and_shift(spark, toy):
    rows = C.replay(toy, cell(spark, BBB=15, CCC=5), TAU, BETA).orderBy("leg_seq").collect()
    assert [r["arrival"] for r in rows] == [60, 35, 15] and [r["shift"] for r in rows] == [0, 15, 20]
    assert [r["shift"] for r in C.timetable_shift(toy, cell(spark, BBB=15, CCC=5)).orderBy("leg_seq").collect()] == [0, 15, 20]


def test_a_gap_begins_a_new_run(spark):
    rows = [("c", 1, DAY, "AAA", 8, None, 10.0, 10.0), ("c", 3, DAY, "BBB", 10, 40.0, 50.0, 50.0)]
    t = C.runs(spark.createDataFrame(rows, SCHEMA)).orderBy("leg_seq").collect()
    assert [r["start"] for r in t] == [True, True] and t[1]["s"] is None
    known = B.cells(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["origin"], r["nbar"]) for r in known] == [("BBB", 0.0)]


def known_cells(spark, nbar):
    return spark.createDataFrame([(chr(65 + i), i, float(n)) for i, n in enumerate(nbar)], "origin string, dep_hour_local int, nbar double")


def by_cell(df):
    return [r["buffer"] for r in df.orderBy("origin").collect()]


def test_policies(spark):
    known = known_cells(spark, (10, 5, 0))
    scores = known.select("origin", "dep_hour_local").withColumn("score", F.element_at(F.array(F.lit(1.0), F.lit(3.0), F.lit(9.0)), F.col("dep_hour_local") + 1))
    assert by_cell(B.uniform(known, 30, 15)) == [2, 2, 0]
    assert by_cell(B.greedy(scores, known, 100, 15)) == [2.5, 15, 0]
    b = spark.createDataFrame([("A", 0, 17.57), ("B", 1, 2.4), ("C", 2, 12.5)], "origin string, dep_hour_local int, buffer double")
    assert by_cell(B.rounded(b)) == [20, 0, 10]
    steps = by_cell(B.uniform_steps(known, 60, seed=3))
    assert set(steps) <= {0.0, 5.0} and steps[2] == 0 and 10 * steps[0] + 5 * steps[1] <= 60


def test_scores(spark, toy):
    known = B.cells(toy)
    assert [(r["origin"], r["nbar"]) for r in known.orderBy("origin").collect()] == [("BBB", 1.0), ("CCC", 1.0)]
    assert [r["score"] for r in B.propagated_score(toy, TAU, BETA).orderBy("origin").collect()] == [50, 35]
    assert [r["score"] for r in B.marginal_score(toy, known, TAU, BETA, 15.0).orderBy("origin").collect()] == [2, 1]


def test_one_sweep_replies_as_a_replay_for_each_cell(spark):
    """Chains that meet a cell more than once, hold delay, lose it and gain it again."""
    legs = random_legs(spark, n_chains=40, seed=3)
    known, tau, beta, b_max = B.cells(legs), 38.0, 0.85, 20.0
    got = {(r["origin"], r["dep_hour_local"]): r["score"] for r in B.marginal_score(legs, known, tau, beta, b_max).collect()}
    runs: dict = {}
    for r in C.decomposed(legs, tau, beta).orderBy("chain_id", "run", "leg_seq").collect():
        runs.setdefault((r["chain_id"], r["run"]), []).append(r)
    n_days = legs.select("day").distinct().count()
    want = {}
    for k in known.collect():
        at, saved = (k["origin"], k["dep_hour_local"]), 0.0
        for own in runs.values():
            a = 0.0
            for r in own:
                b = b_max if (r["origin"], r["dep_hour_local"]) == at else 0.0
                a = r["p"] + r["e"] + (0.0 if r["start"] else beta * max(0.0, a - r["s"] - b + tau))
                saved += max(0.0, r["arr_delay"]) - max(0.0, a)
        if k["nbar"] > 0:
            want[at] = saved / n_days / (b_max * k["nbar"])
    assert got == pytest.approx(want, abs=1e-9) and max(want.values()) > 0


def test_program_on_the_toy(spark, toy):
    p = lp.Program(toy, B.cells(toy), TAU, BETA, 15.0)
    b, value, _ = p.solve(20)
    assert b == pytest.approx([15, 5]) and value == pytest.approx(110)
    b, value, _ = p.solve(100)
    assert b == pytest.approx([15, 15]) and value == pytest.approx(100)


def test_cutting_planes_reach_the_whole_program(spark, monkeypatch):
    legs = random_legs(spark, n_chains=25)
    p = lp.Program(legs, B.cells(legs), 35.0, 0.9, 20.0)
    best, whole, _ = p.solve(15)
    assert p.value(best)[0] == pytest.approx(whole, rel=1e-6)
    monkeypatch.setattr(lp, "FULL_LIMIT", 0)
    b, value, gap = p.solve(15, 1e-3)
    assert value == pytest.approx(whole, rel=2e-3) and gap <= 1e-3 and p.nbar @ b <= 15 + 1e-6


def test_subgradient_is_the_slope(spark):
    legs = random_legs(spark, n_chains=30, seed=5)
    p = lp.Program(legs, B.cells(legs), 35.0, 0.9, 20.0)
    at = np.full(len(p.nbar), 3.137)
    f, g = p.value(at)
    for i in range(min(3, len(at))):
        step = at.copy()
        step[i] += 1e-4
        assert (p.value(step)[0] - f) / 1e-4 == pytest.approx(g[i], abs=1e-6)


def test_all_policies_on_unseen_days(spark):
    train, test = random_legs(spark, 40, 6, 1), random_legs(spark, 30, 15, 2)
    cfg = Config(budgets=(0, 20), reference_budget=20, sizes=(2,), replicates=1, policy_boot=50, tau_offsets=(5,), tolerance=5e-2)
    tables, summary = analysis.place_buffers(train, test, 35.0, 0.9, cfg)
    f = tables["buffer_frontier"].set_index(["policy", "budget"])
    assert len(f) == 12 and f.loc[(evaluate.LP, 0.0), "avoided_test"] == pytest.approx(0, abs=1e-9)
    assert np.isnan(f.loc[(evaluate.UNIFORM, 0.0), "avoided_per_buffer_min"])
    assert f.loc[(evaluate.LP, 20.0), "avoided_train"] >= f.loc[(evaluate.UNIFORM, 20.0), "avoided_train"] - 1e-6
    s = tables["buffer_sensitivity"]
    assert len(s) == 18 and s[s["policy"] == evaluate.UNIFORM]["per_min_vs_uniform"].dropna().eq(1).all()
    assert list(tables["buffer_schedule_metrics"]["policy"])[0] == "No buffer"
    assert list(tables["buffer_scenario_sizes"]["scenario_days"]) == [2, 6]
    assert summary["buffer"]["test_weeks"] == 3
