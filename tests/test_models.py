from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnwake.functions.columns import delay_bin, ground_left, unabsorbed
from turnwake.operators import bootstrap, contagion, hinge
from turnwake.operators.ids import dense_ids


def turns(spark, inbound, slack, out, days=10, group="G"):
    n = len(inbound)
    day = [dt.date(2026, 1, 1) + dt.timedelta(days=int(i % days)) for i in range(n)]
    return spark.createDataFrame(
        pd.DataFrame({"carrier": group, "station": "S", "flight_date": day, "flight_month": "2026-01", "dep_hour_local": 9, "inbound_arr_delay": inbound, "sched_turn_min": slack, "outbound_dep_delay": out})
    )


def synthetic(n=6000, a=4.0, beta=0.85, tau=37.0, seed=1):
    rng = np.random.default_rng(seed)
    inbound, slack = np.round(rng.normal(15, 40, n).clip(-60, 300)), np.round(rng.uniform(30, 120, n))
    out = a + beta * np.maximum(0, inbound - (slack - tau)) + rng.normal(0, 5, n)
    return inbound, slack, out.clip(-60, 600)


def test_sums_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    i, s, y = rng.integers(-80, 300, 500).astype(float), rng.integers(20, 200, 500).astype(float), rng.integers(-30, 300, 500).astype(float)
    got = hinge.day_sums(turns(spark, i, s, y, days=1), "carrier").toPandas().sort_values("tau")
    for r in got.itertuples():
        x = np.maximum(0, i - (s - r.tau))
        assert (r.n, r.sx, r.sxx, r.sy, r.sxy, r.syy) == (500, x.sum(), (x * x).sum(), y.sum(), (x * y).sum(), (y * y).sum())
    assert len(got) == 121


def test_hinge_is_recovered_with_intervals(spark):
    t = turns(spark, *synthetic(), days=40)
    r = hinge.fit(hinge.day_sums(t, "carrier")).first()
    assert abs(r["a"] - 4) < 0.5 and abs(r["beta"] - 0.85) < 0.03 and abs(r["tau"] - 37) <= 2
    ci = hinge.fit_groups(t, "carrier", n_boot=60).iloc[0]
    assert ci["n_turns"] == r["n_turns"] and ci["tau"] == r["tau"] and abs(ci["beta"] - r["beta"]) < 1e-9
    assert ci["beta_lo"] <= 0.85 <= ci["beta_hi"]
    again = hinge.fit_groups(t, "carrier", n_boot=60).iloc[0]
    assert ci.equals(again)


def test_scores_put_the_hinge_first(spark):
    train, test = turns(spark, *synthetic(seed=1)), turns(spark, *synthetic(2000, seed=2))
    fits = hinge.fit(hinge.day_sums(train, "carrier"))
    both = hinge.features(train), hinge.features(test)
    r = hinge.score(*both, fits, "carrier").first()
    assert r["mae_hinge"] < r["mae_hinge_tau0"] and r["mae_hinge"] < r["mae_linear_slack"] < r["mae_constant"]
    x = np.column_stack([np.ones(6000), *synthetic(seed=1)[:2]])
    b = np.linalg.lstsq(x, synthetic(seed=1)[2], rcond=None)[0]
    i, s, y = synthetic(2000, seed=2)
    assert r["mae_linear_slack"] == pytest.approx(np.abs(y - (b[0] + b[1] * i + b[2] * s)).mean())
    assert hinge.without_test(fits, hinge.score(both[0], both[1].limit(0), fits, "carrier")).count() == 1


def test_plane_without_spread_takes_the_smallest_coefficients(spark):
    rows = spark.createDataFrame([("g", float(i), 2.0 * i, 3.0 * i + 1) for i in range(5)], "carrier string, i double, s double, y double")
    r = hinge.linear_baselines(rows, "carrier").first()
    b = np.linalg.pinv(np.array([[i - 2.0, 2 * i - 4.0] for i in range(5)])) @ np.array([3.0 * i - 6 for i in range(5)])
    assert (r["pl_i"], r["pl_s"]) == pytest.approx(tuple(b))


def test_boosted_trees_beat_a_line(spark):
    i, s, y = synthetic(1500, seed=4)
    rows = hinge.features(turns(spark, i, s, y))
    p = hinge.boosted(rows, rows, rounds=25, leaves=15, least=10).select("y", "p_gbm").toPandas()
    slope = np.polyfit(i, y, 1)
    assert (p["y"] - p["p_gbm"]).abs().mean() < np.abs(y - np.polyval(slope, i)).mean()


def test_columns(spark):
    df = spark.createDataFrame([(60.0, 45.0, 0.0), (10.0, 45.0, 14.0), (999.0, 0.0, 601.0)], "i double, s double, x double")
    got = df.select(unabsorbed(F.col("i"), F.col("s"), 30.0), ground_left(F.col("s"), F.col("i")), delay_bin(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(45.0, -15.0, None), (0.0, 35.0, "1-14"), (1029.0, -120.0, None)]


def legs(spark, mult=0.8, n_days=20, craft=40, seed=0, carriers=("C",), by_carrier=None):
    """Three-leg chains; each event's downstream delay is ``mult`` times its primary delay."""
    rng, rows = np.random.default_rng(seed), []
    for d in range(n_days):
        day = dt.date(2026, 1, 1) + dt.timedelta(days=d)
        for c in carriers:
            m = (by_carrier or {}).get(c, mult)
            for k in range(craft):
                x = float(rng.integers(15, 120)) if k % 2 else 0.0
                noise = float(rng.integers(0, 5))
                for seq in (1, 2, 3):
                    down = m * x if seq == 2 else noise if seq == 3 else 0.0
                    rows.append((f"{c}{d}-{k}-{seq}", f"{c}{d}-{k}", seq, 3 - seq, c, "HUB" if k % 4 < 2 else "OUT", day, "2026-01", "morning", 8, None if seq == 1 else 20.0, x if seq == 1 else 30.0, down, None))
    schema = "flight_id string, chain_id string, leg_seq long, legs_remaining long, carrier string, origin string, flight_date date, flight_month string, dep_period string, dep_hour_local int, inbound_arr_delay double, dep_delay double, arr_delay double, late_aircraft_delay double"
    return spark.createDataFrame(rows, schema)


def test_multiplier_is_recovered(spark):
    ev = contagion.events(legs(spark)).persist()
    o = contagion.overall(ev).iloc[0]
    assert abs(o["multiplier"] - 0.8) < 0.03 and o["multiplier_lo"] <= 0.8 <= o["multiplier_hi"]
    for r in contagion.by(ev, "origin").collect():
        assert abs(r["multiplier"] - 0.8) < 0.06
    curve = contagion.curve_intervals(ev)
    assert curve["mean_x"].is_monotonic_increasing and curve["n_events"].sum() == ev.filter("x >= 1").count()
    assert contagion.coded_late(ev).first()["share_events"] == 0


def test_carrier_mix_is_taken_out(spark):
    ev = contagion.events(legs(spark, carriers=("P", "Q"), by_carrier={"P": 0.7, "Q": 1.3})).persist()
    by = {r["carrier"]: r["multiplier"] for r in contagion.by(ev, "carrier").collect()}
    assert abs(by["P"] - 0.7) < 0.05 and abs(by["Q"] - 1.3) < 0.05
    for r in contagion.over_carrier_mix(ev, "origin", contagion.by(ev, "carrier")).collect():
        assert abs(r["excess_over_mix"]) < 0.06 and 0.9 < r["carrier_mix"] < 1.1
    ci = contagion.over_carrier_mix_intervals(ev, "origin", contagion.by(ev, "carrier"))
    assert {"origin", "n_events", "excess_over_mix_lo", "carrier_mix"} <= set(ci.columns)


def test_designs_side_by_side(spark):
    out = contagion.robustness(legs(spark, n_days=8, craft=40))
    assert list(out["variant"]) == [n for n, _ in contagion.DESIGNS]
    assert np.allclose(out["multiplier"], 0.8, atol=0.05)


def test_too_few_controls_match_nothing(spark):
    assert contagion.events(legs(spark, n_days=2, craft=8)).count() == 0


def test_blocks_of_days(spark):
    days = spark.createDataFrame([(dt.date(2026, 1, 1) + dt.timedelta(days=i),) for i in range(17)], "day date")
    first = F.lit(dt.date(2026, 1, 1))
    assert [r[0] for r in days.orderBy("day").select(bootstrap.block_of(F.col("day"), first)).collect()] == [0] * 7 + [1] * 7 + [2] * 3


def test_ratio_intervals():
    """Means over days with whole blocks drawn, against weights spread over the days."""
    rng = np.random.default_rng(5)
    value, block = rng.normal(10, 3, 17), np.repeat([0, 1, 2], [7, 7, 3])
    w = bootstrap.draws(3, 400, 1)
    spread = w[:, block]
    want = np.quantile(spread @ value / spread.sum(1), [0.025, 0.975])
    assert bootstrap.ratio_interval(w, np.bincount(block, value), np.bincount(block).astype(float)) == pytest.approx(tuple(want))


def test_intervals_by_key_equal_one_table_of_all(spark):
    rng, days = np.random.default_rng(2), [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(9)]
    rows = [(f"k{k}", d, float(rng.normal()), float(rng.integers(1, 9)), int(rng.integers(1, 5))) for k in range(4) for d in days if rng.random() < 0.8 for _ in range(2)]
    df = spark.createDataFrame(rows, "k string, flight_date date, excess double, x double, n long")
    got = bootstrap.ratio_by_day(df, "k", n_boot=200, seed=3)
    frame, used = df.toPandas(), sorted({r[1] for r in rows})
    cell = lambda c: frame.pivot_table(index="flight_date", columns="k", values=c, aggfunc="sum").reindex(used).fillna(0).to_numpy()
    w = np.random.default_rng(3).multinomial(len(used), np.full(len(used), 1 / len(used)), size=200)
    with np.errstate(divide="ignore", invalid="ignore"):
        lo, hi = np.nanquantile((w @ cell("excess")) / (w @ cell("x")), [0.025, 0.975], axis=0)
    assert np.allclose(got["multiplier_lo"], lo) and np.allclose(got["multiplier_hi"], hi) and list(got["k"]) == [f"k{k}" for k in range(4)]
    assert np.allclose(got["multiplier"], cell("excess").sum(0) / cell("x").sum(0)) and got["n_events"].sum() == frame["n"].sum()
    assert len(bootstrap.ratio_by_day(df.limit(0), "k")) == 0


def test_many_groups_draw_as_they_would_alone(spark):
    """Each group's interval from its own seed and the days of all groups."""
    i, s, y = synthetic(3000, seed=8)
    t = turns(spark, i, s, y, days=12).withColumn("station", F.concat(F.lit("S"), F.pmod(F.xxhash64("inbound_arr_delay", "sched_turn_min"), F.lit(25)).cast("string")))
    got = hinge.fit_groups(t, "station", n_boot=40, seed=7)
    sums = hinge.day_sums(t, "station").toPandas().sort_values(["g", "d", "tau"])
    days, groups = sorted(sums["d"].unique()), sorted(sums["g"].unique())
    assert list(got["group"]) == groups and len(groups) == 25
    for k in (0, 11, 24):
        own = sums[sums["g"] == groups[k]]
        table = np.zeros((len(days), hinge.TAUS, 6))
        for d, part in own.groupby("d"):
            table[days.index(d)] = part[list(hinge.SUMS)].to_numpy(float)
        w = np.random.default_rng(7 + k).multinomial(len(days), np.full(len(days), 1 / len(days)), size=40)
        with np.errstate(divide="ignore", invalid="ignore"):
            lo, hi = np.nanquantile(hinge.best_lines(np.tensordot(w, table, axes=1)), [0.025, 0.975], axis=0)
        r = got.iloc[k]
        assert np.allclose([r["a_lo"], r["beta_lo"], r["tau_lo"]], lo) and np.allclose([r["a_hi"], r["beta_hi"], r["tau_hi"]], hi)


def test_dense_ids(spark):
    rows = spark.range(0, 300_000).selectExpr("concat('k', pmod(xxhash64(id), 200000)) k", "if(id % 1000 = 0, null, pmod(id, 3)) j").repartition(9)
    got = dense_ids(rows, "k", "j").toPandas()
    want = rows.distinct().toPandas().sort_values(["k", "j"], na_position="first", ignore_index=True)
    got = got.sort_values("id", ignore_index=True)
    assert list(got["id"]) == list(range(len(want))) and got[["k", "j"]].equals(want[["k", "j"]])
    assert dense_ids(rows.limit(0), "k").count() == 0
