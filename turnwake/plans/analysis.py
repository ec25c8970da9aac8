"""The whole analysis: from marts to small result tables and a summary."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import Config
from ..operators import buffers as B
from ..operators import chains as C
from ..operators import contagion, descriptive, evaluate, hinge
from ..operators.bootstrap import BLOCK_DAYS
from ..operators.lp import Program
from ..session import only_row
from .warehouse import Warehouse

Results = dict[str, pd.DataFrame]


def split_months(months: list[str], held_out: int) -> tuple[list[str], list[str]]:
    """Training and held-out months, in time's order."""
    return months[:-held_out], months[-held_out:]


def describe(w: Warehouse) -> tuple[Results, dict]:
    t = w.tables
    tables = {
        "cause_shares_by_carrier": descriptive.cause_shares(t["agg_carrier_month"]).toPandas(),
        "reactionary_by_hour": descriptive.by_hour(t["agg_delay_causes"]).toPandas(),
        "carrier_rotations": descriptive.rotations_by_carrier(w.legs, w.turns).toPandas(),
    }
    return tables, {"network": only_row(descriptive.network(t["agg_carrier_month"], w.legs, w.turns)).asDict()}


def propagate(turns: DataFrame, train: list[str], test: list[str], cfg: Config, trees: bool = True) -> tuple[Results, dict, pd.DataFrame]:
    """Fits and held-out scores; also the fits at full precision, which the buffer program takes."""
    spark = turns.sparkSession
    seen, unseen = hinge.in_months(turns, train), hinge.in_months(turns, test)
    fits = {"carrier": hinge.fit_groups(seen, "carrier", n_boot=cfg.n_boot, seed=cfg.seed)}
    hubs = [r["station"] for r in descriptive.top_hubs(seen, cfg.hubs).collect()]
    fits["station"] = hinge.fit_groups(seen, "station", hubs, cfg.n_boot, cfg.seed)
    x, y = hinge.features(seen).persist(), hinge.features(unseen).persist()
    held = hinge.boosted(x, y, cfg.seed) if trees else y
    scores = {}
    for group, f in fits.items():
        scores[group] = hinge.score(x, held, spark.createDataFrame(f.rename(columns={"group": "g"})), group, {"gbm": "p_gbm"} if trees else None)
    by_carrier = scores["carrier"].persist()
    tables = {f"hinge_{name}": fits[g].merge(s.toPandas().rename(columns={"g": "group"}), on="group") for g, name, s in (("carrier", "carriers", by_carrier), ("station", "airports", scores["station"]))}
    tables["hinge_binned_test"] = hinge.shape(unseen).orderBy("carrier", "ground_left").toPandas()
    c = tables["hinge_carriers"]
    total = only_row(hinge.pooled(by_carrier)).asDict()
    beats = lambda m: int((c["mae_hinge"] < c[f"mae_{m}"]).sum())
    models = [k.removeprefix("mae_") for k in total if k.startswith("mae_")]
    summary = {
        "train_months": train, "test_months": test, "turns_train": int(c["n_turns"].sum()), "turns_test": int(total["n_test"] or 0),
        "test_filter_excluded_share": only_row(hinge.excluded_share(unseen))[0],
        "mae": {m: total[f"mae_{m}"] for m in models}, "rmse": {m: total[f"rmse_{m}"] for m in models},
        **{f"carriers_hinge_beats_{m}_mae": beats(m) for m in models if m in ("linear", "linear_slack", "gbm")},
        "n_carriers": len(c), "carriers_without_test": sorted(set(fits["carrier"]["group"]) - set(c["group"])), "hubs": hubs,
        "tau_range": [c["tau"].min(), c["tau"].max()], "beta_range": [c["beta"].min(), c["beta"].max()],
    }
    for df in (x, y, by_carrier):
        df.unpersist()
    return tables, {"propagation": summary}, fits["carrier"]


def spread(w: Warehouse, months: list[str], cfg: Config, match: tuple[str, ...] = contagion.MATCH) -> tuple[Results, dict]:
    legs = hinge.in_months(w.legs, months)
    ev = contagion.events(legs, match).persist()
    by_carrier = contagion.by(ev, "carrier")
    airports = contagion.by_intervals(ev, "origin", cfg.least_airport_events, cfg.seed)
    mix = contagion.over_carrier_mix_intervals(ev, "origin", by_carrier, seed=cfg.seed).drop(columns=["n_events", "primary_min"])
    place = w.airports.toPandas().rename(columns={"iata": "origin"}).drop(columns="tz")
    worst = airports.merge(mix, on="origin", how="left").merge(place, on="origin", how="left").sort_values("excess_over_mix", ascending=False, ignore_index=True)
    tables = {
        "contagion_curve": contagion.curve_intervals(ev, cfg.seed),
        "contagion_by_hour": contagion.by_intervals(ev, "dep_hour_local", cfg.least_hour_events, cfg.seed),
        "contagion_by_carrier": contagion.by_intervals(ev, "carrier", seed=cfg.seed),
        "superspreaders": worst,
        "contagion_robustness": contagion.robustness(legs, match, cfg.seed),
    }
    summary = {"matched_events": ev.count(), "overall": contagion.overall(ev, cfg.seed).drop(columns="k").iloc[0].to_dict(), "late_aircraft_coded": only_row(contagion.coded_late(ev)).asDict(), "n_airports_ranked": len(worst)}
    ev.unpersist()
    return tables, {"contagion": summary}


def place_buffers(train: DataFrame, test: DataFrame, tau: float, beta: float, cfg: Config, study: bool = True) -> tuple[Results, dict]:
    """``train`` and ``test``: scenario legs. Raises if the recursion does not replay the held-out days."""
    if cfg.scenarios is not None:
        days = [r["day"] for r in train.select("day").distinct().orderBy("day").collect()]
        pick = np.random.default_rng(cfg.seed).choice(len(days), size=min(cfg.scenarios, len(days)), replace=False)
        train = train.filter(train["day"].isin([days[i] for i in sorted(pick)]))
    train, test = train.persist(), test.persist()
    if not C.replays_exactly(test, tau, beta):
        raise AssertionError("the recursion does not replay the observed days")
    program = Program(train, B.cells(train).persist(), tau, beta, cfg.b_max)
    propagated = B.propagated_score(train, tau, beta).persist()
    marginal = B.marginal_score(train, program.known, tau, beta, cfg.b_max).persist()
    by_budget = {b: evaluate.policies(program, b, cfg, propagated, marginal) for b in cfg.budgets}
    rows = evaluate.frontier(train, test, {(p, b): df for b, all_ in by_budget.items() for p, df in all_.items()}, tau, beta, cfg)
    reference = by_budget[cfg.reference_budget]
    tables = {
        "buffer_frontier": rows,
        "buffer_allocation": evaluate.allocation(program, reference[evaluate.LP], propagated, marginal).toPandas(),
        "buffer_schedule_metrics": evaluate.schedule(test, reference, tau, beta),
        "buffer_sensitivity": evaluate.sensitivity(test, reference, tau, beta, cfg),
    }
    if study:
        tables["buffer_scenario_sizes"] = evaluate.size_study(train, test, tau, beta, cfg, reference[evaluate.LP] if cfg.scenarios is None else None)
    at = rows[rows["budget"] == cfg.reference_budget].set_index("policy")
    base = C.delay_by_day(C.replay(test, None, tau, beta)).toPandas()
    summary = {
        "carrier": cfg.carrier, "tau": tau, "beta": beta, "b_max": cfg.b_max, "scenario_days": program.days, "test_days": len(base), "test_weeks": (base["day"].max() - base["day"].min()).days // BLOCK_DAYS + 1,
        "cells": len(program.keys), "turns_per_day_train": float(program.nbar.sum()), "baseline_delay_per_day_test": float(base["delay"].mean()), "reference_budget": cfg.reference_budget,
        "uniform_at_lp_spend": evaluate.at_spend(rows, at.loc[evaluate.LP, "buffer_test"]), "reference": at.drop(columns="budget").to_dict("index"),
    }
    return tables, {"buffer": summary}


def run(w: Warehouse, cfg: Config | None = None) -> tuple[Results, dict]:
    """All result tables by name, and the summary."""
    cfg = cfg or Config()
    months = descriptive.months_of(w.turns)
    train, test = split_months(months, cfg.test_months)
    tables, summary = describe(w)
    more, part, fits = propagate(w.turns, train, test, cfg)
    tables, summary = tables | more, summary | part
    for more, part in (spread(w, months, cfg), _buffers(w, train, test, fits, cfg)):
        tables, summary = tables | more, summary | part
    return tables, {"config": cfg.__dict__} | summary


def _buffers(w: Warehouse, train: list[str], test: list[str], fits: pd.DataFrame, cfg: Config) -> tuple[Results, dict]:
    own = fits.set_index("group").loc[cfg.carrier]
    days = lambda m: C.scenario_legs(w.legs, cfg.carrier, C.scenario_days(w.legs, cfg.carrier, m))
    return place_buffers(days(train), days(test), float(own["tau"]), float(own["beta"]), cfg)
