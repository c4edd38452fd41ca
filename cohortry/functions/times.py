"""Time arithmetic on timestamps without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.hashing import as_col

MICROS = {"minutes": 60_000_000, "hours": 3_600_000_000, "days": 86_400_000_000}


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01, independent of the session zone."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", epoch, as_col(ts).cast("timestamp_ntz"))


def plus(ts: Column | str, *, days: float = 0, hours: float = 0, minutes: float = 0) -> Column:
    """``ts`` shifted by a fixed span."""
    seconds = days * 86400 + hours * 3600 + minutes * 60
    return as_col(ts) + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def span_micros(*, days: float = 0, hours: float = 0, minutes: float = 0) -> int:
    return int(days * MICROS["days"] + hours * MICROS["hours"] + minutes * MICROS["minutes"])


def elapsed_hhmm(ts: Column | str, start: Column | str) -> Column:
    """Whole minutes since ``start``, never negative, as ``HH:MM``; hours may pass 99."""
    minutes = F.floor(F.greatest(F.lit(0), micros(ts) - micros(start)) / F.lit(MICROS["minutes"])).cast("long")
    hours = F.floor(minutes / F.lit(60)).cast("long")
    pad_hours = F.when(hours < 10, F.concat(F.lit("0"), hours.cast("string"))).otherwise(hours.cast("string"))
    return F.concat(pad_hours, F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def length_of_stay(start: Column | str, end: Column | str, unit: str = "days") -> Column:
    """``end - start`` as a double in ``days``, ``hours`` or ``minutes``."""
    if unit not in MICROS:
        raise ValueError(f"unit must be one of {sorted(MICROS)}, got {unit!r}")
    return (micros(end) - micros(start)) / F.lit(float(MICROS[unit]))


def age_at(age: Column | str, year: Column | str, ts: Column | str) -> Column:
    """Age at ``ts`` from an age known for a given year."""
    return as_col(age) + (F.year(as_col(ts)) - as_col(year))
