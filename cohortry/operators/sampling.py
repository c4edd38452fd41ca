"""Splits, labels, sampling and class balancing.

Ranks are by hash of the row key, so every draw is the same on any partitioning and a class or
stratum of any size is ranked in even pieces (see ``hash_rank``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.hashing import hash_hex, normal
from cohortry.operators.ranks import top_n
from cohortry.operators.skew import hash_rank, with_row
from cohortry.operators.windows import returns_within

SPLITS = ("train", "dev", "test")


def outcome_rate(df: DataFrame, by: str, y: str) -> DataFrame:
    """Mean outcome per subject and the 0/1 stratum ``ever`` (mean above 0)."""
    return df.groupBy(by).agg(F.avg(y).cast("double").alias("rate")).withColumn("ever", (F.col("rate") > 0).cast("int"))


def stratified_split(
    df: DataFrame, key: str, stratum: str, fractions: Sequence[float] = (0.7, 0.15, 0.15), seed: str | int = 42
) -> DataFrame:
    """Whole subjects to train / dev / test with the given shares in every stratum: ``key, stratum, split``."""
    if len(fractions) != 3 or abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError(f"three fractions that sum to 1 are needed, got {fractions!r}")
    ranked = hash_rank(df.select(key, stratum), [stratum], [key], seed, "__r")
    first = F.round(F.col("__r_of") * F.lit(fractions[0]))
    second = F.round(F.col("__r_of") * F.lit(fractions[0] + fractions[1]))
    split = F.when(F.col("__r") <= first, "train").when(F.col("__r") <= second, "dev").otherwise("test")
    return ranked.select(key, stratum, split.alias("split"))


def attach_split(df: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    return df.join(splits.select(key, "split"), key, "left")


def outcome_labels(
    st: DataFrame, by: str, visit: str, start: str, end: str, flag: str, days: int = 30, null_end: str = "zero"
) -> DataFrame:
    """``y1`` = outcome flag; ``y2`` = return within ``days`` as 1.0 / 0.0, NULL where y1 = 1.

    A visit without an end has no return (``null_end="zero"``) or no label (``null_end="null"``).
    """
    if null_end not in ("zero", "null"):
        raise ValueError("null_end must be 'zero' or 'null'")
    back = returns_within(st, by, visit, start, end, days).select(by, visit, "returned")
    y2 = F.when(F.col(flag) == 1, F.lit(None).cast("double"))
    if null_end == "null":
        y2 = y2.when(F.col(end).isNull(), F.lit(None).cast("double"))
    return st.join(back, [by, visit]).select(
        by, visit, F.col(flag).cast("int").alias("y1"), y2.otherwise(F.col("returned").cast("double")).alias("y2")
    )


def reward_table(st: DataFrame, people: DataFrame, ev: DataFrame, by: str, visit: str, reward: Column) -> DataFrame:
    """Visits with their person and their events (inner joins) and a 0/1 reward per event."""
    return st.join(people, by).join(ev, visit).withColumn("reward", reward.cast("int"))


COPY_CHUNK = 1000


def balance_oversample(df: DataFrame, y: str, key: str | Sequence[str], seed: str | int = 0) -> DataFrame:
    """Copies of the smaller classes until every class is as large as the largest.

    Every row is copied equally often and the remainder goes to the lowest hashes; ``copy`` is 0 for originals.
    Copies are made in chunks, so that the copies of one row of a very small class are made by many tasks.
    """
    key = [key] if isinstance(key, str) else list(key)
    sizes = df.groupBy(y).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n").alias("__max"), F.min("__n").alias("__min"))
    ranked = with_row(hash_rank(df, [y], key, seed, "__r"), sizes)
    size, rank = F.col("__r_of"), F.col("__r")
    extra = F.col("__max") - size
    last = (F.floor(extra / size) + F.when(rank <= extra % size, 1).otherwise(0)).cast("long")
    rows = ranked.select(*df.columns, last.alias("__last"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("__last"), F.lit(COPY_CHUNK).cast("long"))
    rows = rows.select("*", F.explode(starts).alias("__from")).repartition(*key, "__from")
    upto = F.least(F.col("__last"), F.col("__from") + F.lit(COPY_CHUNK - 1))
    return rows.select(*df.columns, F.explode(F.sequence("__from", F.greatest(upto, F.col("__from")))).alias("copy"))


def balance_with_noise(
    df: DataFrame, y: str, key: str | Sequence[str], vec: str, std: float = 0.01, seed: str | int = 0
) -> DataFrame:
    """As ``balance_oversample``, copies get N(0, std) noise on every vector entry."""
    key = [key] if isinstance(key, str) else list(key)
    balanced = balance_oversample(df, y, key, seed)
    noisy = F.transform(vec, lambda x, i: x + F.lit(std) * normal(seed, *key, F.col("copy"), i))
    return balanced.withColumn(vec, F.when(F.col("copy") > 0, noisy).otherwise(F.col(vec)))


def balance_groups(df: DataFrame, group: str, y: str, seed: str | int = 0) -> DataFrame:
    """Oversample whole groups (one label per group); ``copy`` tells the copies of a group apart."""
    groups = df.groupBy(group).agg(F.min(y).alias("__y"))
    drawn = balance_oversample(groups, "__y", group, seed).select(group, "copy")
    return df.join(drawn, group)


def stratified_subsample(df: DataFrame, y: str, key: str, n: int, seed: str | int = 0) -> DataFrame:
    """``n`` rows without replacement: positives up to ``n / 2``, the rest negatives."""
    ranked = hash_rank(df.where(F.col(y).isin(0, 1)), [y], [key], seed, "__r")
    positives = df.agg(F.count_if(F.col(y) == 1).alias("__pos"))
    room = with_row(ranked, positives)
    taken = F.least(F.col("__pos"), F.lit(n // 2))
    return room.where(F.col("__r") <= F.when(F.col(y) == 1, taken).otherwise(F.lit(n) - taken)).select(*df.columns)


def pos_weights(df: DataFrame, ys: Sequence[str], split: str = "split", train: str = "train") -> DataFrame:
    """Per target, on train rows with a label: negatives, positives, weight neg/pos and its square root."""
    rows = df.where(F.col(split) == train)
    parts = F.array(*[F.struct(F.lit(y).alias("target"), F.col(y).cast("double").alias("v")) for y in ys])
    counts = rows.select(F.explode(parts).alias("p")).groupBy("p.target").agg(
        F.count_if(F.col("p.v") == 0).alias("negatives"), F.count_if(F.col("p.v") == 1).alias("positives")
    )
    both = (F.col("negatives") > 0) & (F.col("positives") > 0)
    weight = F.when(both, F.col("negatives") / F.col("positives"))
    return counts.select("*", weight.alias("weight"), F.sqrt(weight).alias("train_weight"))


def series_per_patient(df: DataFrame, key: str, order: str | Sequence[str], cols: Sequence[str], y: str) -> DataFrame:
    """Per subject the rows in order as an array of structs, and the label of its first row."""
    order = [order] if isinstance(order, str) else list(order)
    place = F.struct(*order)
    rows = F.array_sort(F.collect_list(F.struct(place.alias("at"), F.struct(*cols).alias("row"))))
    return df.groupBy(key).agg(F.transform(rows, lambda e: e["row"]).alias("series"), F.min_by(y, place).alias("label"))


def union_splits(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def random_sample(df: DataFrame, key: str | Sequence[str], n: int, seed: str | int = 0) -> DataFrame:
    """``n`` rows drawn by hash of the key."""
    key = [key] if isinstance(key, str) else list(key)
    drawn = top_n(df.withColumn("__draw", hash_hex(seed, *key)), n, ["__draw", *key])
    return drawn.drop("__draw")
