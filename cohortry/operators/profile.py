"""Profiling and exploratory aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.text import first_rule, is_blank, strip
from cohortry.operators.panels import levels_of
from cohortry.operators.ranks import column_quantiles
from cohortry.operators.skew import exact_quantiles, with_row

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls; for numbers also mean, deviation, min, quartiles, max.

    One aggregate for all columns, and histograms for the quartiles of all numbers at once.
    """
    kinds = dict(df.dtypes)
    numbers = [c for c in df.columns if kinds[c] in NUMERIC or kinds[c].startswith("decimal")]
    nothing = F.lit(None).cast("double")
    stats = []
    for c in df.columns:
        v = F.col(c).cast("double") if c in numbers else nothing
        stats.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count(F.lit(1)).alias("rows"),
                F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"), F.max(v).alias("max"),
            ).alias(c)
        )
    table = df.agg(*stats).select(F.explode(F.array(*[F.col(c) for c in df.columns])).alias("s")).select("s.*")
    if not numbers:
        return table.select("*", nothing.alias("p25"), nothing.alias("p50"), nothing.alias("p75"))
    quartiles = column_quantiles(df, numbers, [0.25, 0.5, 0.75]).groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    )
    return table.join(quartiles, "column", "left")


def top_values(df: DataFrame, c: str, n: int) -> DataFrame:
    """Most frequent values with count and share of all rows (NULL counts as a value)."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    shares = with_row(counts, df.agg(F.count(F.lit(1)).alias("__all")))
    return shares.select(c, "n", (F.col("n") / F.col("__all")).alias("share")).orderBy(F.desc("n"), c).limit(n)


def group_size_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row about rows per group: groups, min, mean, deviation, quartiles, max."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    row = sizes.agg(
        F.count(F.lit(1)).alias("groups"), F.min("size").alias("min"), F.avg("size").alias("mean"),
        F.stddev_samp("size").alias("std"), F.max("size").alias("max"),
    )
    marks = column_quantiles(sizes, ["size"], [0.25, 0.5, 0.75]).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    )
    return with_row(row, marks)


def rate_by(df: DataFrame, by: str | Sequence[str], y: str) -> DataFrame:
    """Outcome mean, positives and rows per category, highest rate first."""
    by = [by] if isinstance(by, str) else list(by)
    rates = df.groupBy(*by).agg(F.avg(y).alias("rate"), F.sum(y).alias("positives"), F.count(F.lit(1)).alias("n"))
    return rates.orderBy(F.desc("rate"), *by)


def top_items(df: DataFrame, item: str, dictionary: DataFrame, label: str, n: int) -> DataFrame:
    """Most frequent items with their dictionary label, else ``Unknown (id)``."""
    top = df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), item).limit(n)
    unknown = F.concat(F.lit("Unknown ("), F.col(item).cast("string"), F.lit(")"))
    # the n rows left are the broadcast side, so the dictionary is scanned in place
    named = dictionary.select(F.col(item).alias("__i"), label).join(F.broadcast(top), F.col("__i") == F.col(item), "right")
    return named.select(item, F.coalesce(label, unknown).alias("label"), "n")


def repetition_stats(df: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Per item, over the visits that have it: visits, mean, median and largest number of repeats."""
    counts = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("__n"))
    row = counts.groupBy(item).agg(
        F.count(F.lit(1)).alias("visits"), F.avg("__n").alias("mean"), F.max("__n").alias("max")
    )
    median = exact_quantiles(counts, [item], "__n", [0.5]).select(item, F.col("quantile").alias("median"))
    return row.join(median, item)


def crosstab(df: DataFrame, r: str, c: str, top_n: int = 20) -> DataFrame:
    """Row values x column values counts; columns are those among the top ``top_n`` of any row."""
    counts = df.groupBy(r, c).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(r).orderBy(F.desc("n"), c)
    kept = counts.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= top_n)
    names = levels_of(kept, c)
    wide = counts.groupBy(r).agg(
        F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col(c) == v, F.col("n"))), F.lit(0)).alias(str(v)) for v in names]
    )
    return wide.orderBy(F.desc("total"), r)


def panel_summary(df: DataFrame, panel: str, visit: str, hit: Column, combo: Column, total_visits: DataFrame) -> DataFrame:
    """Per panel: events, visits, coverage percent, positive percent, distinct combinations.

    ``total_visits`` is a one-row table with the column ``visits_total``.
    """
    # distinct counts by two-level grouping: no set per panel is held in one task
    events = df.groupBy(panel).agg(F.count(F.lit(1)).alias("events"), F.avg(hit.cast("double")).alias("__hit"))
    visits = df.select(panel, visit).distinct().groupBy(panel).agg(F.count(visit).alias("visits"))
    combos = df.select(panel, combo.alias("__combo")).distinct().groupBy(panel).agg(F.count("__combo").alias("combos"))
    row = with_row(events.join(visits, panel).join(combos, panel), total_visits)
    return row.select(
        panel, "events", "visits", (F.col("visits") * 100.0 / F.col("visits_total")).alias("coverage_pct"),
        (F.col("__hit") * 100.0).alias("positive_pct"), "combos",
    )


def yield_rate(df: DataFrame, hit: str, negatives: Sequence[str], drug: str, visit: str, total_visits: DataFrame) -> DataFrame:
    """One row: events, positives (a finding that is no negative keyword), shares, visit coverage."""
    text = F.upper(F.col(hit))
    negative = F.lit(False)
    for word in negatives:
        negative = negative | text.contains(word.upper())
    positive = F.col(hit).isNotNull() & ~F.coalesce(negative, F.lit(False))
    row = df.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(positive).alias("positives"),
        (F.avg(positive.cast("double")) * 100).alias("positive_pct"),
        (F.avg(F.col(drug).isNotNull().cast("double")) * 100).alias("susceptibility_pct"),
    )
    visits = df.where(F.col(visit).isNotNull()).select(visit).distinct().agg(F.count(visit).alias("visits"))
    out = with_row(with_row(row, visits), total_visits)
    return out.withColumn("coverage_pct", F.col("visits") * 100.0 / F.col("visits_total")).drop("visits_total")


def top_per_group(df: DataFrame, by: str, c: str, n: int, groups: DataFrame | None = None) -> DataFrame:
    """The n most frequent values per group; ``groups`` restricts the groups (e.g. by coverage)."""
    kept = df if groups is None else df.join(groups.select(by), by, "left_semi")
    counts = kept.where(F.col(c).isNotNull()).groupBy(by, c).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), c)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def share_profile(df: DataFrame, by: str, c: str, levels: Sequence[str], min_n: int = 100, top_n: int | None = 25) -> DataFrame:
    """Percent of each level per group with at least ``min_n`` rows, by the first level's percent."""
    rows = df.where(F.col(by).isNotNull() & F.col(c).isNotNull())
    shares = [(F.avg((F.col(c) == v).cast("double")) * 100).alias(f"pct_{v}") for v in levels]
    table = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *shares).where(F.col("n") >= min_n)
    ordered = table.orderBy(F.desc(f"pct_{levels[0]}"), by)
    return ordered if top_n is None else ordered.limit(top_n)


def _top(df: DataFrame, c: str, n: int) -> DataFrame:
    """The n most frequent values: at most n rows, so fit to broadcast."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
    return counts.orderBy(F.desc("__n"), c).limit(n).select(c)


def rate_matrix(df: DataFrame, r: str, c: str, hit: Column, top_n: int = 15, min_n: int = 10) -> DataFrame:
    """Long form of the (top rows x top columns) matrix: ``r, c, n, pct``; ``pct`` NULL below ``min_n``."""
    kept = df.join(F.broadcast(_top(df, r, top_n)), r, "left_semi").join(F.broadcast(_top(df, c, top_n)), c, "left_semi")
    cells = kept.groupBy(r, c).agg(F.count(F.lit(1)).alias("n"), (F.avg(hit.cast("double")) * 100).alias("__pct"))
    return cells.select(r, c, "n", F.when(F.col("n") >= min_n, F.col("__pct")).alias("pct"))


def to_matrix(cells: DataFrame, r: str, c: str, value: str, columns: Sequence) -> DataFrame:
    """Wide form of a small matrix with given columns."""
    return cells.groupBy(r).agg(*[F.max(F.when(F.col(c) == v, F.col(value))).alias(str(v)) for v in columns])


def cooccurrence(df: DataFrame, unit: str, item: str, top_n: int = 15) -> DataFrame:
    """Units that have both items, for each pair among the ``top_n`` items: ``a, b, units`` (a < b).

    A unit holds at most ``top_n`` distinct items after the semi join, so its pairs are made inside its row.
    """
    kept = df.where(F.col(item).isNotNull()).join(F.broadcast(_top(df, item, top_n)), item, "left_semi")
    held = kept.groupBy(unit).agg(F.sort_array(F.collect_set(item)).alias("__items"))
    pair = F.transform(
        F.col("__items"),
        lambda a, i: F.transform(F.slice("__items", i + 2, F.size("__items")), lambda b: F.struct(a.alias("a"), b.alias("b"))),
    )
    return held.select(F.explode(F.flatten(pair)).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("units"))


def items_per_unit(df: DataFrame, unit: str, item: str) -> DataFrame:
    """How many units have 1, 2, ... distinct items."""
    sizes = df.select(unit, item).distinct().groupBy(unit).agg(F.count(item).alias("items"))
    return sizes.groupBy("items").agg(F.count(F.lit(1)).alias("units"))


def signal_tier(coverage: str, positive: str) -> Column:
    """HIGH, MEDIUM or LOW from coverage and positivity percent."""
    cov, pos = F.col(coverage), F.col(positive)
    return first_rule([((cov > 5) & (pos > 20), "HIGH"), ((cov > 2) | (pos > 10), "MEDIUM")], "LOW")


def presence_kind(c: str) -> Column:
    """``null``, ``blank``, ``placeholder`` (only ``_`` or only ``-``) or ``meaningful``."""
    text = strip(F.col(c))
    return first_rule(
        [(F.col(c).isNull(), "null"), (is_blank(c), "blank"), (text.rlike(r"^(_+|-+)$"), "placeholder")], "meaningful"
    )


def presence(df: DataFrame, c: str, by: str | None = None) -> DataFrame:
    """Rows and share of each kind, per group if asked."""
    kinds = df.select(*([by] if by else []), presence_kind(c).alias("kind"))
    if by is None:
        counts = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
        return with_row(counts, counts.agg(F.sum("n").alias("__all"))).select(
            "kind", "n", (F.col("n") * 100.0 / F.col("__all")).alias("percent")
        )
    return kinds.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("kind") == "meaningful").alias("meaningful"),
        (F.avg((F.col("kind") == "meaningful").cast("double")) * 100).alias("percent"),
    )


def top_meaningful(df: DataFrame, c: str, n: int, by: str | None = None, groups: int = 10) -> DataFrame:
    """The n most frequent meaningful values, trimmed; with ``by`` those of the groups with the highest share of meaningful rows."""
    named = df.where(presence_kind(c) == "meaningful").withColumn("__value", strip(F.col(c)))
    if by is None:
        return named.groupBy(F.col("__value").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)
    best = presence(df, c, by).where(F.col(by).isNotNull()).orderBy(F.desc("percent"), by).limit(groups)
    return top_per_group(named, by, "__value", n, best).select(by, F.col("__value").alias("value"), "n", "rank")


def tested_share(df: DataFrame, panel: str, visit: str, hit: Column, tested: Column) -> DataFrame:
    """Per panel: visits with a hit, visits with a test of it, and the second as a percentage of the first (of one at least)."""
    flags = df.where(F.col(visit).isNotNull()).groupBy(panel, visit).agg(
        F.bool_or(F.coalesce(hit, F.lit(False))).alias("__hit"), F.bool_or(F.coalesce(tested, F.lit(False))).alias("__tested")
    )
    counts = flags.groupBy(panel).agg(F.count_if("__hit").alias("positive_visits"), F.count_if("__tested").alias("tested_visits"))
    return counts.withColumn("tested_pct", F.col("tested_visits") * 100.0 / F.greatest(F.col("positive_visits"), F.lit(1)))


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys in a, in b, common, only one side, keys repeated per side."""
    both = a.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(
        b.select(key, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    )
    per_key = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("__a").alias("na"), F.sum("__b").alias("nb"))
    in_a, in_b = F.col("na") > 0, F.col("nb") > 0
    return per_key.agg(
        F.count_if(in_a).alias("keys_a"), F.count_if(in_b).alias("keys_b"), F.count_if(in_a & in_b).alias("common"),
        F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(in_b & ~in_a).alias("only_b"),
        F.count_if(F.col("na") > 1).alias("repeated_a"), F.count_if(F.col("nb") > 1).alias("repeated_b"),
    )


def dedup_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows before and after dropping repeated keys."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    after = F.count(F.lit(1))
    return sizes.agg(
        F.sum("__n").alias("rows_before"), after.alias("rows_after"), (F.sum("__n") - after).alias("dropped")
    )


def null_audit(df: DataFrame, c: str, by: Sequence[str]) -> DataFrame:
    """Rows and NULLs of a column per group."""
    missing = F.col(c).isNull()
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("nulls"), F.avg(missing.cast("double")).alias("null_share")
    )


def histogram(df: DataFrame, c: str, bounds: Sequence[float]) -> DataFrame:
    """Counts per left-closed bin, the last bin closed; values outside and NULL are left out."""
    v, bin_ = F.col(c), F.lit(None).cast("int")
    last = len(bounds) - 2
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        inside = (v >= lo) & ((v <= hi) if i == last else (v < hi))
        bin_ = F.when(inside, F.lit(i)).otherwise(bin_)
    counts = df.select(bin_.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    low = F.array(*[F.lit(float(b)) for b in bounds])
    return counts.select("bin", F.get(low, F.col("bin")).alias("low"), F.get(low, F.col("bin") + 1).alias("high"), "n")


def pivot_flags(df: DataFrame, key: str, c: str, values: Sequence, flag: Column) -> DataFrame:
    """Per key one 0/1 column per item: whether it has a row with the flag."""
    hit = lambda v: F.coalesce(F.max(F.when((F.col(c) == v) & flag, 1)), F.lit(0))
    return df.groupBy(key).agg(*[hit(v).alias(str(v)) for v in values])


def pivot_first(df: DataFrame, key: str, c: str, v: str, values: Sequence, order: str) -> DataFrame:
    """Per key the first value (in order) of each category as a column."""
    pick = lambda x: F.min_by(v, F.when((F.col(c) == x) & F.col(v).isNotNull(), F.col(order)))
    return df.groupBy(key).agg(*[pick(x).alias(str(x)) for x in values])
