"""Derived columns that several plans share."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of delay causes, as (result column, source column).
CAUSES = (
    ("carrier_min", "carrier_delay"),
    ("weather_min", "weather_delay"),
    ("nas_min", "nas_delay"),
    ("security_min", "security_delay"),
    ("late_aircraft_min", "late_aircraft_delay"),
)
#: Names of carriers by code.
CARRIERS = {
    "AA": "American", "AS": "Alaska", "B6": "JetBlue", "DL": "Delta", "F9": "Frontier", "G4": "Allegiant", "HA": "Hawaiian",
    "MQ": "Envoy", "NK": "Spirit", "OH": "PSA", "OO": "SkyWest", "UA": "United", "WN": "Southwest", "YX": "Republic",
    "9E": "Endeavor", "QX": "Horizon", "ZW": "Air Wisconsin", "PT": "Piedmont", "C5": "CommutAir",
}
#: Edges of the primary-delay bins, right-open.
DELAY_EDGES = (1, 15, 30, 60, 120, 240, 601)


def day_period(hour: Column) -> Column:
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def delay_bin(x: Column, edges: tuple[int, ...] = DELAY_EDGES) -> Column:
    """``lo-hi`` (last minute included) of the bin, null outside all."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(pairwise(edges))):
        out = F.when((x >= lo) & (x < hi), F.lit(f"{lo}-{hi - 1}")).otherwise(out)
    return out


def carrier_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in CARRIERS.items() for x in kv))
    return F.coalesce(F.try_element_at(names, code), code)


def unabsorbed(inbound: Column, scheduled: Column, tau: Column | float) -> Column:
    """Inbound minutes left when all ground time but ``tau`` is used up."""
    return F.greatest(F.lit(0.0), inbound - (scheduled - tau))


def ground_left(scheduled: Column, inbound: Column, step: int = 5, low: int = -120, high: int = 180) -> Column:
    """Ground time left after the inbound's delay, to the nearest step and clamped."""
    return F.least(F.greatest(F.round((scheduled - inbound) / step) * step, F.lit(float(low))), F.lit(float(high)))


def in_window(inbound: str = "inbound_arr_delay", outbound: str = "outbound_dep_delay") -> Column:
    """The delays the models are fitted to: no data errors, no tail beyond ten hours."""
    return F.col(inbound).between(-90, 600) & F.col(outbound).between(-60, 600)


def cause_sums() -> list[Column]:
    return [F.sum(F.coalesce(F.col(source), F.lit(0.0))).alias(name) for name, source in CAUSES]
