"""One row or one value per group.

All picks are aggregations (``min_by`` / ``max_by`` over an order struct), so Spark combines them
before the shuffle and a group of any size costs one row per task.  Rows without a value are left
out first, and every pick takes a tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.times import micros
from cohortry.operators.skew import nearest


def _names(c: str | Sequence[str]) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


def nulls_last(*cols: str) -> Column:
    """An order in which a missing value of a column comes after all others."""
    return F.struct(*(x for c in cols for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))))


def _row_pick(df: DataFrame, keys: Sequence[str], order: Column, smallest: bool = True) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if smallest else F.max_by
    got = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("__row"))
    return got.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])


def closest_to_anchor(
    st: DataFrame, obs: DataFrame, by: str, visit: str, start: str, ts: str, value: str, tie: str, prefer: str = "before"
) -> DataFrame:
    """Per visit the value nearest by date: on or before the anchor day first, only then after it."""
    if prefer not in ("before", "after"):
        raise ValueError("prefer must be 'before' or 'after'")
    # observations of a subject on one day compete by the tie-break only, so fold them first
    folded = (
        obs.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
        .groupBy(by, F.col(ts).cast("date").alias("__day"))
        .agg(F.min_by(value, tie).alias("__value"))
    )
    visits = st.withColumn("__anchor", F.col(start).cast("date")).where(F.col("__anchor").isNotNull())
    near = nearest(visits, folded, by, "__anchor", "__day", "__value", backward=True)
    sides = ["prev_key", "next_key"] if prefer == "before" else ["next_key", "prev_key"]
    return (
        visits.join(near, [by, "__anchor"])
        .select(by, visit, F.coalesce(*sides).alias(value))
        .where(F.col(value).isNotNull())
    )


def closest_abs(
    st: DataFrame, obs: DataFrame, by: str, visit: str, keys: Sequence[str], start: str, ts: str, value: str, tie: str
) -> DataFrame:
    """Per visit and key the value nearest in absolute time; at equal distance the earlier observation."""
    keys = list(keys)
    seen = (
        obs.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
        .groupBy(by, *keys, ts)
        .agg(F.min_by(value, tie).alias("__value"))
        .withColumn("__line", F.struct(by, *keys))
    )
    wanted = st.select(by, visit, start).join(seen.select(by, *keys, "__line").distinct(), by)
    near = nearest(wanted, seen, "__line", start, ts, "__value", backward=True, strict=True)
    gap_prev, gap_next = micros(start) - micros("prev_start"), micros("next_start") - micros(start)
    take_next = F.col("prev_start").isNull() | F.coalesce(gap_next < gap_prev, F.lit(False))
    best = F.when(take_next, F.col("next_key")).otherwise(F.col("prev_key"))
    return wanted.join(near, ["__line", start]).select(by, visit, *keys, best.alias(value))


def earliest(df: DataFrame, keys: str | Sequence[str], value: str, ts: str, tie: str) -> DataFrame:
    """First value in time; undated rows come last, and count where a group has no others."""
    return df.where(F.col(value).isNotNull()).groupBy(*_names(keys)).agg(F.min_by(value, nulls_last(ts, tie)).alias(value))


def by_priority_then_time(
    df: DataFrame, keys: str | Sequence[str], value: str, rank: Column, ts: str, tie: str
) -> DataFrame:
    """Lowest rank first, then the earliest time, undated rows last; rows without a rank are left out."""
    return (
        df.withColumn("__rank", rank)
        .where(F.col(value).isNotNull() & F.col("__rank").isNotNull())
        .groupBy(*_names(keys))
        .agg(F.min_by(value, nulls_last("__rank", ts, tie)).alias(value))
    )


def latest(df: DataFrame, keys: str | Sequence[str], value: str, ts: str, tie: str, nulls_last: bool = True) -> DataFrame:
    """Last value in time; with ``nulls_last`` a row without a time counts as the latest."""
    no_time = F.col(ts).isNull() if nulls_last else F.col(ts).isNotNull()
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*_names(keys))
        .agg(F.max_by(value, F.struct(no_time, F.col(ts), F.col(tie))).alias(value))
    )


def latest_row(df: DataFrame, keys: str | Sequence[str], ts: str, tie: str) -> DataFrame:
    """The whole row with the greatest time per group."""
    return _row_pick(df, _names(keys), F.struct(ts, tie), smallest=False)


def dedup(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The first row per key in the declared order; missing order values come last."""
    return _row_pick(df, _names(keys), nulls_last(*_names(order)))


def sample_per_key(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """One example row per key: the first in the declared order."""
    return dedup(df, key, order)


def distinct_catalogue(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)


def first_value_text(
    cohort: DataFrame, df: DataFrame, keys: str | Sequence[str], value: str, order: str | Sequence[str], default: str = ""
) -> DataFrame:
    """First non-null text per cohort key, or the default; missing order values come last."""
    keys = _names(keys)
    first = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, nulls_last(*_names(order))).alias(value))
    return cohort.select(*keys).join(first, keys, "left").select(*keys, F.coalesce(value, F.lit(default)).alias(value))
