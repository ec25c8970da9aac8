"""How many downstream minutes a primary delay minute makes, against matched controls.

An event is a clean start (the aircraft was ready) that leaves x minutes late; its
downstream delay s is the positive arrival delay on the later legs of its chain. Controls
are clean starts that leave on time, with the same match keys. The baseline of a key is an
aggregate joined back, so a key that holds many starts is summed before it is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import DELAY_EDGES, delay_bin
from .bootstrap import ratio_by_day

MATCH = ("carrier", "flight_date", "dep_period", "rem")
MIN_CONTROLS = 5
LATE_MIN = 15


def clean_starts(legs: DataFrame, rem_cap: int | None = 4, drop_coded: bool = False) -> DataFrame:
    """Starts with x, s and the match columns. ``legs`` is already limited to its months: later
    legs outside them do not count downstream."""
    later = Window.partitionBy("chain_id").orderBy("leg_seq").rowsBetween(1, Window.unboundedFollowing)
    down = F.sum(F.greatest(F.coalesce("arr_delay", F.lit(0.0)), F.lit(0.0))).over(later)
    ready = (F.col("leg_seq") == 1) | (F.col("inbound_arr_delay") <= 0)
    out = legs.withColumn("s", down).filter((F.col("legs_remaining") >= 1) & ready & F.col("dep_delay").between(-60, 600))
    if drop_coded:
        out = out.filter(F.coalesce("late_aircraft_delay", F.lit(0.0)) == 0)
    rem = F.col("legs_remaining") if rem_cap is None else F.least("legs_remaining", F.lit(rem_cap).cast("long"))
    return out.select("flight_id", "carrier", "origin", "flight_date", "dep_hour_local", "dep_period", rem.alias("rem"), F.col("dep_delay").alias("x"), "s", "late_aircraft_delay")


def matched(starts: DataFrame, match: tuple[str, ...] = MATCH, min_controls: int = MIN_CONTROLS) -> DataFrame:
    """Starts (controls too) with baseline, n_ctrl and excess, where a key has enough controls."""
    base = starts.filter("x <= 0").groupBy(*match).agg(F.avg("s").alias("baseline"), F.count("*").alias("n_ctrl")).filter(F.col("n_ctrl") >= min_controls)
    return starts.join(base, list(match)).select(*starts.columns, "baseline", "n_ctrl", (F.col("s") - F.col("baseline")).alias("excess"))


def events(legs: DataFrame, match: tuple[str, ...] = MATCH, rem_cap: int | None = 4, drop_coded: bool = False) -> DataFrame:
    return matched(clean_starts(legs, rem_cap, drop_coded), match)


def _point(df: DataFrame, key: Column, name: str, *more: Column) -> DataFrame:
    t = df.groupBy(key.alias(name)).agg(F.count("*").alias("n_events"), F.sum("x").alias("primary_min"), F.sum("excess").alias("excess_min"), *more)
    return t.withColumn("multiplier", F.try_divide("excess_min", "primary_min"))


def _daily(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name), "flight_date").agg(F.sum("excess").alias("excess"), F.sum("x").alias("x"), F.count("*").alias("n"))


def curve(ev: DataFrame) -> DataFrame:
    """Multiplier and means by bin of the primary delay."""
    late = ev.filter(F.col("x") >= DELAY_EDGES[0])
    means = (F.avg(c).alias(n) for c, n in (("x", "mean_x"), ("excess", "mean_excess"), ("s", "mean_downstream"), ("baseline", "mean_baseline")))
    return _point(late, delay_bin(F.col("x")), "x_bin", *means)


def curve_intervals(ev: DataFrame, seed: int = 0) -> pd.DataFrame:
    late = ev.filter(F.col("x") >= DELAY_EDGES[0])
    out = ratio_by_day(_daily(late, delay_bin(F.col("x")), "x_bin"), "x_bin", seed=seed)
    return out.merge(curve(ev).select("x_bin", "mean_x", "mean_excess", "mean_downstream", "mean_baseline").toPandas(), on="x_bin").sort_values("mean_x", ignore_index=True)


def by(ev: DataFrame, key: str, least: int = 0) -> DataFrame:
    """Multiplier of late departures by a column."""
    return _point(ev.filter(F.col("x") >= LATE_MIN), F.col(key), key).filter(F.col("n_events") >= least)


def by_intervals(ev: DataFrame, key: str, least: int = 0, seed: int = 0) -> pd.DataFrame:
    out = ratio_by_day(_daily(ev.filter(F.col("x") >= LATE_MIN), F.col(key), key), key, seed=seed)
    return out[out["n_events"] >= least].reset_index(drop=True)


def overall(ev: DataFrame, seed: int = 0) -> pd.DataFrame:
    return ratio_by_day(_daily(ev.filter(F.col("x") >= LATE_MIN), F.lit("all"), "k"), "k", seed=seed)


def _over_mix(ev: DataFrame, multipliers: DataFrame) -> DataFrame:
    m = multipliers.select("carrier", F.col("multiplier").alias("m"))
    return ev.filter(F.col("x") >= LATE_MIN).join(m, "carrier").withColumn("mix", F.col("m") * F.col("x")).withColumn("excess", F.col("excess") - F.col("mix"))


def over_carrier_mix(ev: DataFrame, key: str, multipliers: DataFrame, least: int = 0) -> DataFrame:
    """Multiplier of a key beyond what its carriers' own multipliers explain, and the part they do."""
    t = _over_mix(ev, multipliers).groupBy(key).agg(F.count("*").alias("n_events"), F.sum("x").alias("primary_min"), F.sum("excess").alias("over"), F.sum("mix").alias("mix"))
    t = t.filter(F.col("n_events") >= least)
    return t.select(key, "n_events", "primary_min", F.try_divide("over", "primary_min").alias("excess_over_mix"), F.try_divide("mix", "primary_min").alias("carrier_mix"))


def over_carrier_mix_intervals(ev: DataFrame, key: str, multipliers: DataFrame, least: int = 0, seed: int = 0) -> pd.DataFrame:
    out = ratio_by_day(_daily(_over_mix(ev, multipliers), F.col(key), key), key, seed=seed).drop(columns="excess_min")
    out = out.rename(columns={f"multiplier{x}": f"excess_over_mix{x}" for x in ("", "_lo", "_hi")})
    mix = over_carrier_mix(ev, key, multipliers).select(key, "carrier_mix").toPandas()
    return out.merge(mix, on=key)[lambda d: d["n_events"] >= least].reset_index(drop=True)


def superspreaders(ev: DataFrame, airports: DataFrame, least: int = 0) -> DataFrame:
    """Multipliers by airport with what is over the carrier mix, and where it lies; the worst first.

    Events are summed by airport and carrier once; both multipliers come from those sums.
    """
    pair = ev.filter(F.col("x") >= LATE_MIN).groupBy("origin", "carrier").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("excess").alias("excess"))
    own = F.try_divide("excess_min", "primary_min").alias("m")
    carriers = pair.groupBy("carrier").agg(F.sum("x").alias("primary_min"), F.sum("excess").alias("excess_min")).select("carrier", own)
    mixed = pair.join(carriers, "carrier").groupBy("origin").agg(
        F.sum("n").alias("n_events"), F.sum("x").alias("primary_min"), F.sum("excess").alias("excess_min"), F.sum(F.col("m") * F.col("x")).alias("mix")
    )
    place = airports.select(F.col("iata").alias("origin"), "name", "city", "state", "lat", "lon")
    share = lambda c, n: F.try_divide(c, F.col("primary_min")).alias(n)
    out = mixed.filter(F.col("n_events") >= least).select(
        "origin", "n_events", "primary_min", "excess_min", share(F.col("excess_min"), "multiplier"), share(F.col("mix"), "carrier_mix"), share(F.col("excess_min") - F.col("mix"), "excess_over_mix")
    )
    return out.join(place, "origin", "left").orderBy(F.col("excess_over_mix").desc_nulls_last(), "origin")


def coded_late(ev: DataFrame) -> DataFrame:
    """How many events of late departures carry a late-aircraft code all the same, and their weight."""
    coded = F.coalesce("late_aircraft_delay", F.lit(0.0)) > 0
    late = ev.filter(F.col("x") >= LATE_MIN)
    return late.agg(F.count("*").alias("events"), F.avg(coded.cast("int")).alias("share_events"), F.try_divide(F.sum(F.when(coded, F.col("x"))), F.sum("x")).alias("share_primary_min"))


#: Alternative designs: name, and what differs from the headline's.
DESIGNS = (
    ("Headline: carrier x day x part of day x legs left (4+)", {}),
    ("+ origin airport in the match", {"more": ("origin",)}),
    ("Exact legs left (no 4+ cap)", {"rem_cap": None}),
    ("Without legs that carry a late-aircraft code", {"drop_coded": True}),
)


def robustness(legs: DataFrame, match: tuple[str, ...] = MATCH, seed: int = 0) -> pd.DataFrame:
    """Headline and small-slip (1 to 14 minutes) multipliers under every design, each a plan of its own."""
    rows = []
    for name, how in DESIGNS:
        options = dict(how)
        ev = events(legs, (*match, *options.pop("more", ())), **options).persist()
        late = overall(ev, seed)
        small = ratio_by_day(_daily(ev.filter((F.col("x") >= 1) & (F.col("x") < LATE_MIN)), F.lit("small"), "k"), "k", seed=seed)
        ev.unpersist()
        row = {"variant": name}
        for part, prefix, renamed in ((late, "multiplier", "multiplier"), (small, "multiplier", "small_slip")):
            got = part.iloc[0] if len(part) else None
            if renamed == "multiplier":
                row["n_events"] = 0 if got is None else int(got["n_events"])
            for end in ("", "_lo", "_hi"):
                row["small_slip_multiplier" if renamed == "small_slip" and not end else renamed + end] = None if got is None else float(got[prefix + end])
        rows.append(row)
    return pd.DataFrame(rows)


def to_spark(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """A small result table as a DataFrame."""
    return spark.createDataFrame(frame)
