"""A small fixture out of raw flights: whole aircraft on chosen days, the same on every run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def whole_tails(raw: DataFrame, days: list[dt.date | str], per_carrier: int = 25) -> DataFrame:
    """All flights on ``days`` of the first tails of each carrier in the order of their MD5."""
    some = raw.filter(F.col("FlightDate").isin(*(dt.date.fromisoformat(str(d)) for d in days)))
    keys = ["Reporting_Airline", "Tail_Number"]
    tails = some.filter("Tail_Number IS NOT NULL").select(*keys).distinct()
    place = F.row_number().over(Window.partitionBy("Reporting_Airline").orderBy(F.md5("Tail_Number"), "Tail_Number"))
    chosen = tails.withColumn("place", place).filter(F.col("place") <= per_carrier).drop("place")
    return some.join(chosen, keys, "left_semi").select(*raw.columns).orderBy(*keys, "FlightDate", "CRSDepTime")


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, in order; for samples and result tables, which are small by what they hold."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
