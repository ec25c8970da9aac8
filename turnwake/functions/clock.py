"""Column functions on published clock times. All timestamps are in a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_minutes(hhmm: Column) -> Column:
    """Minutes after midnight of a clock string; ``2400`` is 1440, what is no clock time is null."""
    padded = F.lpad(hhmm.cast("string"), 4, "0")
    hours, minutes = (F.substring(padded, at, 2).try_cast("int") for at in (1, 3))
    return hours * 60 + minutes


def plus_minutes(ts: Column, minutes: Column) -> Column:
    """A timestamp moved by a number of minutes, rounded half to even as a cast to integer would in SQL engines."""
    return F.timestamp_add("MINUTE", F.bround(minutes).cast("int"), ts)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from start to end, counted on the minutes of both clocks."""
    floor = lambda c: F.floor(F.unix_timestamp(c) / 60)
    return (floor(end) - floor(start)).cast("long")


def at_midnight(day: Column) -> Column:
    return day.cast("timestamp")


def local_to_utc(ts: Column, zone: Column) -> Column:
    """A wall-clock time read in an IANA zone: the first of two occurrences on a fall-back
    night, the offset before the change for times that a spring-forward night skips."""
    return F.to_utc_timestamp(ts, zone)


def utc_to_local(ts: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(ts, zone)
