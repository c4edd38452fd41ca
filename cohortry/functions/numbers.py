"""Numeric cleaning expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.hashing import as_col

# Unit factors and closed plausibility ranges.
UNIT_FACTORS = {"inch": 2.54, "lbs": 0.453592}
PLAUSIBLE = {
    "height_cm": (45.0, 230.0),
    "weight_kg": (2.0, 500.0),
    "bmi": (5.0, 100.0),
    "chart_height_cm": (50.0, 250.0),
}
AGE_BOUNDS = [18, 30, 45, 65, 75, 200]
AGE_LABELS = ["18-29", "30-44", "45-64", "65-74", "75+"]
SEX_CODES = {"M": 1.0, "F": 0.0}


def to_number(c: Column | str) -> Column:
    """Lenient parse: text that is no number gives NULL, and so does NaN."""
    parsed = as_col(c).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def convert_unit(value: Column | str, unit: Column | str, factors: Mapping[str, float]) -> Column:
    """Multiply by the factor of the unit; other units are left alone."""
    out = as_col(value)
    for name, factor in factors.items():
        out = F.when(as_col(unit) == name, as_col(value) * F.lit(float(factor))).otherwise(out)
    return out


def plausible(c: Column | str, lo: float, hi: float) -> Column:
    """NULL outside the closed range."""
    return F.when(as_col(c).between(lo, hi), as_col(c))


def name_contains(c: Column | str, part: str) -> Column:
    return F.lower(as_col(c)).contains(part.lower())


def prefer(*cols: Column | str) -> Column:
    return F.coalesce(*[as_col(c) for c in cols])


def encode(c: Column | str, mapping: Mapping[str, float]) -> Column:
    """Value code; anything unmapped gives NULL."""
    out = F.lit(None).cast("double")
    for value, code in mapping.items():
        out = F.when(as_col(c) == value, F.lit(float(code))).otherwise(out)
    return out


def bin_left(c: Column | str, bounds: Sequence[float], labels: Sequence[str], outside: str = "nan") -> Column:
    """Left-closed bins ``[b0, b1), [b1, b2), ...``; outside and NULL give ``outside``."""
    if len(bounds) != len(labels) + 1:
        raise ValueError("need one more bound than labels")
    value = as_col(c)
    out = F.lit(outside)
    for lo, hi, label in zip(bounds, bounds[1:], labels):
        out = F.when((value >= lo) & (value < hi), F.lit(label)).otherwise(out)
    return out


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def derive_bmi(height_cm: Column | str, weight_kg: Column | str, bmi: Column | str) -> Column:
    """Given BMI, else weight / (height in m) squared from the clipped inputs; clipped at the end."""
    height = clip(as_col(height_cm), *PLAUSIBLE["height_cm"])
    weight = clip(as_col(weight_kg), *PLAUSIBLE["weight_kg"])
    return clip(F.coalesce(as_col(bmi), weight / F.pow(height / F.lit(100.0), F.lit(2.0))), *PLAUSIBLE["bmi"])


def assemble_vector(*cols: Column | str) -> Column:
    return F.array(*[as_col(c).cast("double") for c in cols])


def clamp_int(c: Column | str, lo: int, hi: int, default: int) -> Column:
    """Integer inside [lo, hi], else the default (also for text that is no integer)."""
    number = as_col(c).try_cast("int")
    return F.when(number.between(lo, hi), number).otherwise(F.lit(default))


def fmt_g(c: Column | str) -> Column:
    """Six significant digits, no trailing zeros, exponent form below 1e-4 and from 1e6.

    Rounding is that of the exact binary value, half to even: where the scaled value looks like a tie,
    the part its product lost tells on which side of the tie it lies.  (Subnormal numbers have the few
    digits the JVM prints for them.)
    """
    value = as_col(c).cast("double")
    size = F.abs(value)
    scale = F.pow(F.lit(10.0), F.lit(5.0) - F.floor(F.log10(size)))
    scaled = size * scale
    # what the product lost to rounding, from its two exactly representable halves
    split = size * F.lit(134217729.0)
    upper = split - (split - size)
    lost = (size - upper) * scale - (scaled - upper * scale)
    nudge = F.when(scaled - F.floor(scaled) == 0.5, F.signum(lost) * F.lit(0.25)).otherwise(F.lit(0.0))
    rounded = F.rint(scaled + nudge) / scale * F.signum(value)
    # from 1e6 on the power divides: quotient and remainder are exact up to 2**53
    unit = F.pow(F.lit(10.0), F.floor(F.log10(size)) - F.lit(5.0))
    whole = F.floor(size / unit).cast("double")
    twice = (size - whole * unit) * 2
    up = (twice > unit) | ((twice == unit) & (whole % 2 == 1))
    tens = (whole + F.when(up, 1.0).otherwise(0.0)) * unit * F.signum(value)
    large = F.when((size >= 999999.5) & (size < 9007199254740992.0), tens).otherwise(value)
    # a shortest form of up to six digits (and the point) is what six digits give, too
    short = size.cast("string")
    plain = F.when(short.endswith(".0"), F.left(value.cast("string"), F.length(value.cast("string")) - 2)).otherwise(value.cast("string"))
    return (
        F.when((size >= 1e-3) & (size < 999999.5) & (F.length(short) <= 7), plain)
        .when((size >= 1e-3) & (size < 999999.5), F.regexp_replace(rounded.cast("string"), r"\.0$", ""))
        .when(size == 0, F.lit("0"))
        .when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size >= 9.9999995e-5) & (size < 1e-3), F.regexp_replace(F.format_string("%.9f", value), "0+$", ""))
        .when(value.isNotNull(), F.regexp_replace(F.format_string("%.5e", large), r"\.?0+e", "e"))
    )
