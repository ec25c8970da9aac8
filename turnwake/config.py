"""What a run can be told, with the defaults of a full year."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    test_months: int = 3
    hubs: int = 15
    carrier: str = "WN"
    scenarios: int | None = None  # a random sample of that many training days; None: all
    sizes: tuple[int, ...] = (10, 30, 60, 90, 150, 210)
    replicates: int = 3
    b_max: float = 20.0
    step: float = 5.0
    budgets: tuple[float, ...] = (0, 150, 300, 600, 900, 1200, 1800, 2400)
    reference_budget: float = 600.0
    tau_offsets: tuple[float, ...] = (-10, -5, 5, 10)
    other_beta: float = 0.8
    least_airport_events: int = 1500
    least_hour_events: int = 500
    n_boot: int = 300
    policy_boot: int = 2000
    tolerance: float = 1e-4  # relative gap at which the buffer program counts as solved
    seed: int = 2026
