"""Small results as files and text: CSV, JSON, Markdown tables, headlines, chart data and a page."""

from __future__ import annotations

import json
import math
from pathlib import Path
from string import Template

import numpy as np
import pandas as pd

from ..functions.columns import CARRIERS

#: Carriers of the short table, the largest networks first.
SHORT_LIST = ("WN", "DL", "OO", "AA", "UA", "YX")


def tidy(value, digits: int = 6):
    """Nested containers with floats rounded and NumPy numbers as Python's; NaN is null."""
    if isinstance(value, dict):
        return {str(k): tidy(v, digits) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [tidy(v, digits) for v in value]
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, digits)
    return value


def write(tables: dict[str, pd.DataFrame], summary: dict, folder: str | Path, decimals: int = 4) -> None:
    """Each table as CSV, rounded, and summary.json."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for name, df in tables.items():
        df.round(decimals).to_csv(out / f"{name}.csv", index=False)
    (out / "summary.json").write_text(json.dumps(tidy(summary), indent=2, default=str) + "\n")


def read(folder: str | Path) -> tuple[dict[str, pd.DataFrame], dict]:
    out = Path(folder)
    return {p.stem: pd.read_csv(p) for p in sorted(out.glob("*.csv"))}, json.loads((out / "summary.json").read_text())


def name_of(code: str) -> str:
    return CARRIERS.get(code, code)


def month_name(month: str) -> str:
    return pd.Timestamp(f"{month}-01").strftime("%b %Y")


def percent(x: float) -> str:
    return f"{100 * x:.1f}%"


def extremes(values: pd.Series, pattern: str) -> str:
    """The smallest and the largest value, each with everyone who has it."""
    ends = [(v, ", ".join(sorted(map(str, values.index[values == v])))) for v in (values.min(), values.max())]
    return " to ".join(f"{pattern.format(v)} ({who})" for v, who in ends)


def markdown(header: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(header), "|" + "---|" * len(header), *map(line, rows)])


def with_interval(row, name: str, pattern: str) -> str:
    return f"{pattern.format(row[name])} [{pattern.format(row[name + '_lo'])}, {pattern.format(row[name + '_hi'])}]"


def carrier_table(hinge: pd.DataFrame, carriers: tuple[str, ...] = SHORT_LIST) -> str:
    models = [c for c in ("constant", "linear", "linear_slack", "gbm", "hinge") if f"mae_{c}" in hinge]
    by = hinge.set_index("group")
    rows = [[name_of(c), with_interval(by.loc[c], "tau", "{:.0f}"), with_interval(by.loc[c], "beta", "{:.2f}"), " / ".join(f"{by.loc[c, f'mae_{m}']:.1f}" for m in models)] for c in carriers if c in by.index]
    return markdown(["Carrier", "tau (min)", "beta", "Held-out MAE: " + " / ".join(models)], rows)


def policy_table(frontier: pd.DataFrame, budget: float) -> str:
    at = frontier[frontier["budget"] == budget]
    rows = [[r["policy"], with_interval(r, "avoided_test", "{:.0f}"), f"{r['buffer_test']:.0f}", f"{r['avoided_per_buffer_min']:.2f}"] for _, r in at.iterrows()]
    return markdown(["Policy", "Avoided (min/day)", "Buffer (min/day)", "Avoided per buffer minute"], rows)


def robustness_table(rows: pd.DataFrame) -> str:
    both = [[r["variant"], f"{int(r['n_events']):,}", with_interval(r, "multiplier", "{:.2f}"), f"{r['small_slip_multiplier']:.2f}"] for _, r in rows.iterrows()]
    return markdown(["Design", "Events", "Multiplier", "1-14 min slips"], both)


def sensitivity_table(rows: pd.DataFrame) -> str:
    wide = rows.pivot_table(index=["tau_eval", "beta_eval"], columns="policy", values="per_min_vs_uniform", sort=False)
    return markdown(["tau", "beta", *wide.columns], [[f"{t:.0f}", f"{b:.2f}", *(f"{x:.2f}" for x in r)] for (t, b), r in zip(wide.index, wide.to_numpy(), strict=True)])


#: Hours in which enough flights leave for a peak or a trend to mean something.
DAY_HOURS, TREND_HOURS = (5, 23), (5, 21)


def listed(names: list[str]) -> str:
    return " and ".join(filter(None, [", ".join(names[:-1]), names[-1]])) if names else "none"


def whole(x: float) -> str:
    return f"{x:,.0f}"


def span(first: str, last: str) -> str:
    return f"{month_name(first)} - {month_name(last)}"


def best_of(df: pd.DataFrame, column: str, hours: tuple[int, int]) -> tuple[int, float]:
    """(hour, value) of the largest value between two hours, the earlier one on ties."""
    rows = df[df["dep_hour_local"].between(*hours)].dropna(subset=[column])
    if rows.empty:
        return hours[0], float("nan")
    top = rows.sort_values([column, "dep_hour_local"], ascending=[False, True]).iloc[0]
    return int(top["dep_hour_local"]), float(top[column])


def at_hour(df: pd.DataFrame, column: str, hour: int) -> float:
    return float(df.loc[df["dep_hour_local"] == hour, column].mean())


def describe_headlines(tables: dict[str, pd.DataFrame], net: dict, carrier: str | None) -> dict[str, str]:
    hours = tables["reactionary_by_hour"]
    peak, high = best_of(hours, "reactionary_per_flight", DAY_HOURS)
    out = {
        "flights": whole(net["flights"]), "flights_millions": f"{net['flights'] / 1e6:.2f} million", "turns": whole(net["turns"]), "turns_millions": f"{net['turns'] / 1e6:.2f} million",
        "chains": whole(net["chains_with_turns"]), "period": span(net["first_month"], net["last_month"]), "reactionary_share": percent(net["reactionary_share"]),
        "peak_hour": f"{peak:02d}:00", "reactionary_at_peak": f"{high:.1f}", "reactionary_at_six": f"{at_hour(hours, 'reactionary_per_flight', 6):.1f}",
        "share_range": extremes(tables["cause_shares_by_carrier"].set_index("name")["reactionary_share"], "{:.0%}"),
    }
    if "carrier_rotations" in tables:
        r = tables["carrier_rotations"].set_index("carrier")
        turn = r["median_sched_turn_min"]
        out["shortest_median_turn"] = f"{turn.min():.0f} min ({listed(sorted(map(name_of, turn.index[turn == turn.min()])))})"
        if carrier in r.index:
            rank = int((r["legs_per_aircraft_day"] > r.loc[carrier, "legs_per_aircraft_day"]).sum()) + 1
            out |= {"carrier_legs_per_day": f"{r.loc[carrier, 'legs_per_aircraft_day']:.1f}", "carrier_legs_rank": str(rank), "carrier_median_turn": f"{turn[carrier]:.0f}"}
    return out


def hinge_headlines(tables: dict[str, pd.DataFrame], p: dict, carrier: str | None) -> dict[str, str]:
    h, mae = tables["hinge_carriers"].set_index("group"), p["mae"]
    out = {"tau_range": extremes(h["tau"], "{:.0f}"), "beta_range": extremes(h["beta"], "{:.2f}"), "carriers_table": carrier_table(tables["hinge_carriers"])}
    out |= {f"mae_{m}": f"{v:.2f}" for m, v in mae.items()}
    if "train_months" in p:
        out |= {"train_period": span(p["train_months"][0], p["train_months"][-1]), "test_period": span(p["test_months"][0], p["test_months"][-1])}
        out |= {"carriers_tested": str(p["n_carriers"]), "carriers_without_test": listed([name_of(c) for c in p["carriers_without_test"]]), "excluded_by_window": percent(p["test_filter_excluded_share"])}
    if {"gbm", "linear_slack"} <= set(mae) and "carriers_hinge_beats_gbm_mae" in p:
        out["trees_win"] = f"{p['n_carriers'] - p['carriers_hinge_beats_gbm_mae']} of {p['n_carriers']}"
        out["hinge_share_of_trees"] = f"{(mae['linear_slack'] - mae['hinge']) / (mae['linear_slack'] - mae['gbm']):.0%}"
    if "hinge_airports" in tables:
        out |= {"hub_tau_range": extremes(tables["hinge_airports"].set_index("group")["tau"], "{:.0f}"), "hubs": str(len(tables["hinge_airports"]))}
    if carrier in h.index:
        out |= {"carrier_name": name_of(carrier), "carrier_tau": f"{h.loc[carrier, 'tau']:.0f}", "carrier_beta": f"{h.loc[carrier, 'beta']:.2f}"}
    return out


def contagion_headlines(tables: dict[str, pd.DataFrame], c: dict, carrier: str | None) -> dict[str, str]:
    designs, coded = tables["contagion_robustness"], c["late_aircraft_coded"]
    out = {
        "multiplier": with_interval(c["overall"], "multiplier", "{:.2f}"), "matched_events": whole(c["matched_events"]), "late_events": whole(c["overall"].get("n_events", 0)),
        "coded_share_events": percent(coded["share_events"]), "coded_share_minutes": percent(coded["share_primary_min"]), "robustness_table": robustness_table(designs),
    }
    for name, row in zip(("headline", "with_origin", "exact_legs", "uncoded"), designs.to_dict("records"), strict=False):
        out |= {f"multiplier_{name}": f"{row['multiplier']:.2f}", f"events_{name}": whole(row["n_events"]), f"small_slips_{name}": f"{row['small_slip_multiplier']:.2f}"}
    if "contagion_by_hour" in tables:
        t = tables["contagion_by_hour"]
        peak, high = best_of(t, "multiplier", TREND_HOURS)
        out |= {"multiplier_peak_hour": f"{peak:02d}:00", "multiplier_at_peak": f"{high:.2f}"} | {f"multiplier_at_{h}": f"{at_hour(t, 'multiplier', h):.2f}" for h in TREND_HOURS}
    if "contagion_by_carrier" in tables:
        by = tables["contagion_by_carrier"].set_index("carrier")["multiplier"]
        out["multiplier_by_carrier_range"] = extremes(by.rename(index=name_of), "{:.2f}")
        if carrier in by.index:
            out["carrier_multiplier"] = f"{by[carrier]:.2f}"
    worst = tables.get("superspreaders")
    if worst is not None and len(worst) > 1:
        top, raw = worst.head(3), worst.sort_values("multiplier", ascending=False).iloc[0]
        apart = worst["excess_over_mix_lo"].iloc[0] > worst["excess_over_mix_hi"].iloc[1]
        label = lambda r: f"{r['origin']} ({r['city']})"
        out |= {
            "worst_airports": listed([label(r) for _, r in top.iterrows()]), "worst_airports_range": f"{top['excess_over_mix'].min():+.2f} to {top['excess_over_mix'].max():+.2f}",
            "worst_airport_stands_out": "yes" if apart else "no", "highest_raw_airport": label(raw), "highest_raw_multiplier": f"{raw['multiplier']:.2f}", "highest_raw_mix": f"{raw['carrier_mix']:.2f}",
        }
    return out


#: How a policy's row is quoted: part of the name, and the policies' names in results.
QUOTED = {"lp": "LP-optimised", "lp_steps": "LP, 5-min steps", "marginal": "Marginal greedy", "greedy": "Greedy", "uniform": "Uniform", "uniform_steps": "Uniform, 5-min steps"}


def buffer_headlines(tables: dict[str, pd.DataFrame], b: dict) -> dict[str, str]:
    out = {"policy_table": policy_table(tables["buffer_frontier"], b["reference_budget"]), "sensitivity_table": sensitivity_table(tables["buffer_sensitivity"]), "uniform_at_lp_spend": whole(b["uniform_at_lp_spend"])}
    out |= {k: whole(b[k]) for k in ("reference_budget", "turns_per_day_train", "cells", "scenario_days", "test_days", "test_weeks", "baseline_delay_per_day_test") if k in b}
    if b.get("turns_per_day_train"):
        out["uniform_seconds"] = f"{60 * b['reference_budget'] / b['turns_per_day_train']:.0f}"
    got = b.get("reference", {})
    for short, policy in QUOTED.items():
        if policy in got:
            r = got[policy]
            out |= {f"{short}_avoided": with_interval(r, "avoided_test", "{:,.0f}"), f"{short}_gain": with_interval(r, "gain_vs_uniform", "{:+,.0f}"), f"{short}_spend": whole(r["buffer_test"]), f"{short}_per_minute": f"{r['avoided_per_buffer_min']:.2f}"}
    if {"LP-optimised", "Uniform", "Marginal greedy"} <= set(got):
        per = {k: got[k]["avoided_per_buffer_min"] for k in got}
        out |= {"lp_times_uniform": f"{per['LP-optimised'] / per['Uniform']:.1f}", "lp_over_marginal": f"{per['LP-optimised'] / per['Marginal greedy'] - 1:.0%}", "lp_cells": whole(got["LP-optimised"]["cells_padded"])}
        out["lp_share_of_delay"] = percent(got["LP-optimised"]["avoided_test"] / b["baseline_delay_per_day_test"])
    s = tables["buffer_sensitivity"]
    own = s[s["policy"] == "LP-optimised"]
    if len(own):
        out |= {"lp_times_uniform_range": f"{own['per_min_vs_uniform'].min():.1f} to {own['per_min_vs_uniform'].max():.1f}", "lp_avoided_range": f"{own['avoided_test'].min():,.0f} to {own['avoided_test'].max():,.0f}"}
    if "buffer_schedule_metrics" in tables:
        for r in tables["buffer_schedule_metrics"].to_dict("records"):
            short = next((k for k, v in QUOTED.items() if v == r["policy"]), "none")
            out |= {f"{short}_on_time": percent(r["ontime15"]), f"{short}_clock_change": f"{r['clock_late_change_per_day']:+,.0f}"}
    if "buffer_scenario_sizes" in tables:
        gains = tables["buffer_scenario_sizes"].groupby("scenario_days")[["gain_train", "gain_test"]].mean()
        out["size_gains"] = "; ".join(f"{n} days {percent(r.gain_train)} / {percent(r.gain_test)}" for n, r in gains.iterrows())
    return out


def headlines(tables: dict[str, pd.DataFrame], summary: dict) -> dict[str, str]:
    """The strings that reports quote, all from the results; those whose results are absent are left out."""
    carrier = summary.get("buffer", {}).get("carrier")
    out = describe_headlines(tables, summary["network"], carrier)
    if "hinge_carriers" in tables:
        out |= hinge_headlines(tables, summary["propagation"], carrier)
    if summary.get("contagion"):
        out |= contagion_headlines(tables, summary["contagion"], carrier)
    if "buffer_frontier" in tables:
        out |= buffer_headlines(tables, summary["buffer"])
    return out


def chart_data(tables: dict[str, pd.DataFrame]) -> dict[str, str]:
    """JSON traces by chart: x, y and, where there is one, the interval."""

    def trace(df: pd.DataFrame, x: str, y: str, name: str | None = None) -> dict:
        t = {"x": df[x].tolist(), "y": df[y].tolist(), "name": name or y}
        return t | ({"lo": df[f"{y}_lo"].tolist(), "hi": df[f"{y}_hi"].tolist()} if f"{y}_lo" in df else {})

    plans = {
        "causes": ("reactionary_by_hour", "dep_hour_local", ("primary_per_flight", "reactionary_per_flight")),
        "shares": ("cause_shares_by_carrier", "name", ("reactionary_share",)),
        "curve": ("contagion_curve", "x_bin", ("multiplier",)),
        "hours": ("contagion_by_hour", "dep_hour_local", ("multiplier",)),
        "airports": ("superspreaders", "origin", ("excess_over_mix",)),
    }
    out = {k: [trace(tables[t], x, y) for y in ys] for k, (t, x, ys) in plans.items() if t in tables}
    for key, table, group, x, y in (("hinge", "hinge_binned_test", "carrier", "ground_left", "mean_out"), ("frontier", "buffer_frontier", "policy", "buffer_test", "avoided_test")):
        if table in tables:
            out[key] = [trace(g, x, y, str(name)) for name, g in tables[table].groupby(group, sort=False)]
    return {k: json.dumps(tidy(v)) for k, v in out.items()}


def html_table(df: pd.DataFrame, decimals: int = 2) -> str:
    return df.round(decimals).to_html(index=False, border=0, na_rep="")


#: The template of a page on the descriptive results; others are given by the caller.
PAGE = Path(__file__).with_name("page.html")


def page(template: str, tables: dict[str, pd.DataFrame], summary: dict) -> str:
    """A page from a ``$name`` template; a name that nothing fills is an error."""
    filled = headlines(tables, summary) | {f"chart_{k}": v for k, v in chart_data(tables).items()} | {f"table_{k}": html_table(v) for k, v in tables.items()}
    return Template(template).substitute(filled)
