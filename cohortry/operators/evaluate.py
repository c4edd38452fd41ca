"""Metrics, calibration and importance.

Ranking metrics first fold rows to one row per distinct score, then run two-level prefix sums, so no
task ever sees all scores and ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortry.functions.hashing import as_col
from cohortry.operators.ranks import column_quantiles
from cohortry.operators.skew import LINE, add_piece, prefix_sums, with_row


def _score_table(df: DataFrame, y: str, score: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score (highest first): positives and negatives of that score and above it, group totals."""
    labelled = df.where(F.col(y).isin(0, 1) & F.col(score).isNotNull())
    counts = labelled.groupBy(*by, (-F.col(score).cast("double")).alias("__down")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    return prefix_sums(
        counts, by, "__down", {"pos_above": "pos", "neg_above": "neg"}, {"P": "pos", "N": "neg"}
    )


def auroc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group (ties count half); NULL with one class only."""
    table = _score_table(df, y, score, list(by))
    wins = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0))
    area = F.when((F.max("P") > 0) & (F.max("N") > 0), wins / (F.max("P") * F.max("N").cast("double")))
    return table.groupBy(*by).agg(area.alias("auroc"))


def auprc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision per group (step form); NULL with one class only."""
    table = _score_table(df, y, score, list(by))
    upto = F.col("pos_above") + F.col("pos")
    precision = upto / (upto + F.col("neg_above") + F.col("neg")).cast("double")
    area = F.when((F.max("P") > 0) & (F.max("N") > 0), F.sum(F.col("pos") * precision) / F.max("P"))
    return table.groupBy(*by).agg(area.alias("auprc"))


def auprc_trapezoid(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall curve by the trapezoid rule (starts at precision 1, recall 0)."""
    table = _score_table(df, y, score, list(by))
    upto = F.col("pos_above") + F.col("pos")
    here = upto / (upto + F.col("neg_above") + F.col("neg")).cast("double")
    seen = F.col("pos_above") + F.col("neg_above")
    before = F.when(seen > 0, F.col("pos_above") / seen.cast("double")).otherwise(F.lit(1.0))
    area = F.when((F.max("P") > 0) & (F.max("N") > 0), F.sum(F.col("pos") * (here + before) / 2.0) / F.max("P"))
    return table.groupBy(*by).agg(area.alias("pr_area"))


def _edges_up_to(edges: str, value: str, most: int, limit: Column | None = None) -> Column:
    """How many entries of a short sorted array lie at or below the value (only the first ``limit`` count)."""
    total = F.lit(0)
    for i in range(most):
        hit = F.get(edges, F.lit(i)) <= F.col(value)
        if limit is not None:
            hit = hit & (F.lit(i) < limit)
        total = total + F.when(hit, 1).otherwise(0)
    return total


def ece_bins(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Equal-mass calibration bins: ``bin, n, confidence, accuracy``.

    Edges are exact percentiles of the scores, the ends set to 0 and 1, repeats dropped.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(
        F.col(y).cast("double").alias("__y"), F.col(score).cast("double").alias("__p")
    )
    inner = column_quantiles(rows, ["__p"], [i / bins for i in range(1, bins)])
    edges = inner.agg(
        F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.collect_list("quantile")))).alias("__edges")
    )
    placed = with_row(rows, edges)
    # right-side search over all edges but the last
    at = _edges_up_to("__edges", "__p", bins + 1, F.size("__edges") - 1) - 1
    return (
        placed.withColumn("bin", F.greatest(at, F.lit(0)))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("__p").alias("confidence"), F.avg("__y").alias("accuracy"))
    )


def ece(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: share-weighted gap of confidence and accuracy over the bins."""
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return ece_bins(df, y, score, bins).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(c)))


def calibrated(logit: Column | str, temperature: float | Column) -> Column:
    """Probability of a logit after temperature scaling."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return sigmoid(as_col(logit) / t)


def bce(y: Column | str, logit: Column | str, pos_weight: float = 1.0) -> Column:
    """Stable weighted binary cross-entropy of one row."""
    y, z = as_col(y).cast("double"), as_col(logit)
    softplus = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    return (1 - y) * z + (F.lit(1.0) + F.lit(pos_weight - 1.0) * y) * softplus


def fit_temperature(df: DataFrame, y: str, logit: str, steps: int = 50, tolerance: float = 1e-9) -> float:
    """Temperature that minimises the cross-entropy of ``logit / T``; never below 1e-8.

    Newton over log T: each step is one aggregate of two derivatives, rows stay on the executors.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(logit).isNotNull()).select(
        F.col(y).cast("double").alias("y"), F.col(logit).cast("double").alias("z")
    ).persist()
    try:
        def loss(u: float) -> tuple[float, float, float]:
            s = F.col("z") * F.lit(exp(-u))
            p = sigmoid(s)
            row = rows.agg(
                F.avg(bce("y", s)), F.avg(-(p - F.col("y")) * s), F.avg(p * (1 - p) * s * s + (p - F.col("y")) * s)
            ).first()
            return row[0], row[1], row[2]

        u = 0.0
        value, slope, bend = loss(u)
        if value is None:
            raise ValueError("no labelled rows")
        for _ in range(steps):
            step = -slope / bend if bend > 0 else (-0.5 if slope > 0 else 0.5)
            step = max(-2.0, min(2.0, step))
            moved = loss(u + step)
            while moved[0] > value and abs(step) > tolerance:
                step /= 2
                moved = loss(u + step)
            u, (value, slope, bend) = u + step, moved
            if abs(step) < tolerance or abs(slope) < tolerance:
                break
        return max(exp(u), 1e-8)
    finally:
        rows.unpersist()


def weighted_bce(
    df: DataFrame, ys: Sequence[str], logits: Sequence[str], pos_w: Sequence[float], weights: Sequence[float]
) -> DataFrame:
    """Mean weighted cross-entropy per target over labelled rows, and their weighted sum ``total``."""
    means = [F.avg(bce(y, z, p)).alias(f"loss_{y}") for y, z, p in zip(ys, logits, pos_w)]
    total = sum((F.lit(float(w)) * F.coalesce(F.col(f"loss_{y}"), F.lit(0.0)) for w, y in zip(weights, ys)), F.lit(0.0))
    return df.agg(*means).withColumn("total", total)


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: tn, fp, fn, tp, accuracy."""
    a, p = F.col(y), F.col(pred)
    return df.where(a.isNotNull() & p.isNotNull()).agg(
        F.count_if((a == 0) & (p == 0)).alias("tn"),
        F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 1) & (p == 0)).alias("fn"),
        F.count_if((a == 1) & (p == 1)).alias("tp"),
        F.avg((a == p).cast("double")).alias("accuracy"),
    )


def _joint_counts(df: DataFrame, feats: Sequence[str], edges: Sequence[np.ndarray], y: str) -> DataFrame:
    """``feature, bin, y, n``: a task sends one row for each feature, bin and class it saw, not one for each row and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            classes, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, edge in enumerate(edges):
                column = batch.column(i + 1)
                held = pc.is_valid(column).to_numpy(zero_copy_only=False)
                place = np.searchsorted(edge, pc.drop_null(column).to_numpy(zero_copy_only=False), "right")
                found = np.bincount(code[held] * (len(edge) + 1) + place, minlength=len(classes) * (len(edge) + 1)).reshape(len(classes), -1)
                for j, c in enumerate(classes):
                    counts[i, c] = counts.get((i, c), 0) + found[j]
        rows = [(feats[i], b, c, int(n)) for (i, c), found in counts.items() for b, n in enumerate(found) if n]
        kinds = [pa.string(), pa.int32(), kind_of_y, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["feature", "bin", y, "n"])

    values = df.select(F.col(y), *[F.col(f).cast("double").alias(f"__{i}") for i, f in enumerate(feats)])
    kind_of_y = to_arrow_type(values.schema[y].dataType)
    counted = values.mapInArrow(run, f"feature string, bin int, `{y}` {values.dtypes[0][1]}, n long")
    return counted.groupBy("feature", "bin", y).agg(F.sum("n").alias("n"))


def mutual_information(df: DataFrame, feats: Sequence[str], y: str, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each feature, cut at its quantiles, with the label: ``feature, mi``."""
    labelled = df.where(F.col(y).isNotNull())
    edges: dict[str, set[float]] = {f: set() for f in feats}
    for row in column_quantiles(labelled, feats, [i / bins for i in range(1, bins)]).collect():
        edges[row["column"]].add(row["quantile"])
    joint = _joint_counts(labelled, feats, [np.array(sorted(edges[f])) for f in feats], y)
    per_bin = joint.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    per_y = joint.groupBy("feature", y).agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("nt"))
    cell = joint.join(per_bin, ["feature", "bin"]).join(per_y, ["feature", y]).join(total, "feature")
    share = F.col("n") / F.col("nt")
    term = share * F.log(F.col("n") * F.col("nt").cast("double") / (F.col("nb") * F.col("ny").cast("double")))
    return cell.groupBy("feature").agg(F.sum(term).alias("mi"))


def _digamma(n: Column) -> Column:
    """Digamma of a whole number of at least 1: shifted up by ten, then the asymptotic series (error below 1e-12)."""
    y = n.cast("double") + 10.0
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    return series - sum((1 / (n.cast("double") + i) for i in range(10)), F.lit(0.0))


def _reach(v: np.ndarray, r: np.ndarray, up: bool) -> np.ndarray:
    """The outermost number x on one side of v with ``|x - v| < r`` as doubles subtract: found by halving the range of doubles."""
    sign = 1.0 if up else -1.0
    order = lambda x: np.where(x.view(np.int64) < 0, np.int64(-(2**63)) - x.view(np.int64), x.view(np.int64))
    back = lambda i: np.where(i < 0, np.int64(-(2**63)) - i, i).view(np.float64)
    inside, outside = order(v + 0.0), order(v + sign * 2 * r + 0.0)
    for _ in range(65):
        middle = (inside & outside) + ((inside ^ outside) >> 1)
        held = np.abs(back(middle) - v) < r
        inside, outside = np.where(held, middle, inside), np.where(held, outside, middle)
    return back(inside)


def mutual_information_knn(df: DataFrame, feats: Sequence[str], y: str, k: int = 3, piece_rows: int | None = None) -> DataFrame:
    """Mutual information (nats) of each continuous feature with a class label by nearest neighbours (Ross, 2014): ``feature, mi``.

    For each row the distance to its k-th neighbour of the same class, then the number of rows of any class that are nearer than
    that; classes of one row are left out.  Rows fold to one for each feature, class and value, neighbours are looked up along sorted
    pieces, and the numbers of rows within a distance are differences of running counts: no pair of rows is ever built.
    """
    values = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f).cast("double") + 0.0).alias("x")) for f in feats])
    long = df.where(F.col(y).isNotNull()).select(F.col(y).alias("y"), F.explode(values).alias("e")).select("y", "e.*").where(F.col("x").isNotNull())
    cells = long.groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("c"))
    sizes = cells.groupBy("feature", "y").agg(F.sum("c").alias("size")).where("size > 1")
    cells = cells.join(sizes, ["feature", "y"]).withColumn("k", F.least(F.lit(k), F.col("size") - 1).cast("int"))

    line = add_piece(cells, ["feature", "y"], "x", piece_rows)
    entry = F.array_repeat("x", F.least(F.col("c"), F.lit(k)).cast("int"))
    inside = Window.partitionBy(*LINE).orderBy("x")
    around = [F.flatten(F.collect_list(entry).over(inside.rowsBetween(*span))) for span in ((-k, -1), (1, k))]
    # the outer values of each piece serve the pieces beside it
    ends = line.where("__cut").select(*LINE, "x", entry.alias("__e"), F.row_number().over(inside).alias("__up"), F.row_number().over(Window.partitionBy(*LINE).orderBy(F.desc("x"))).alias("__down"))
    ends = ends.where((F.col("__up") <= k) | (F.col("__down") <= k)).groupBy(*LINE).agg(F.flatten(F.collect_list("__e")).alias("__ends"))
    beside = Window.partitionBy("__line").orderBy("__piece")
    carry = ends.select(*LINE, *[F.flatten(F.collect_list("__ends").over(beside.rowsBetween(*span))).alias(n) for n, span in (("__before", (-k, -1)), ("__after", (1, k)))])
    none = F.array().cast("array<double>")
    near = line.select("*", F.concat(*around).alias("__near")).join(carry, LINE, "left")
    near = near.withColumn("__near", F.concat("__near", F.coalesce("__before", none), F.coalesce("__after", none)))
    gaps = F.array_sort(F.concat(F.array_repeat(F.lit(0.0), F.least(F.col("c") - 1, F.lit(k)).cast("int")), F.transform("__near", lambda v: F.abs(v - F.col("x")))))
    ranged = near.select("feature", "y", "x", "c", "size", "k", F.element_at(gaps, F.col("k")).alias("r"))

    @F.pandas_udf("lo double, hi double")
    def reach(x: pd.Series, r: pd.Series) -> pd.DataFrame:
        v, d = x.to_numpy(float), r.to_numpy(float)
        return pd.DataFrame({"lo": np.where(d > 0, _reach(v, d, False), v) + 0.0, "hi": np.where(d > 0, _reach(v, d, True), v) + 0.0})

    ranged = ranged.withColumn("e", reach("x", "r")).select("feature", "x", "c", "size", "k", "e.*")
    places = [cells.select("feature", "x", F.col("c").alias("n")), *[ranged.select("feature", F.col(e).alias("x"), F.lit(0).cast("long").alias("n")) for e in ("lo", "hi")]]
    counts = reduce(DataFrame.union, places).groupBy("feature", "x").agg(F.sum("n").alias("n"))
    running = prefix_sums(counts, ["feature"], "x", {"below": "n"}, piece_rows=piece_rows)
    low = running.select("feature", F.col("x").alias("lo"), F.col("below").alias("__lo"))
    high = running.select("feature", F.col("x").alias("hi"), (F.col("below") + F.col("n")).alias("__hi"))
    m = F.col("__hi") - F.col("__lo")
    rows = ranged.join(low, ["feature", "lo"]).join(high, ["feature", "hi"])
    terms = F.col("c") * (_digamma(F.col("k")) - _digamma(F.col("size")) - _digamma(m))
    sums = rows.groupBy("feature").agg(F.sum(terms).alias("s"), F.sum("c").alias("n"))
    return sums.select("feature", F.greatest(F.lit(0.0), _digamma(F.col("n")) + F.col("s") / F.col("n")).alias("mi"))


def _weighted_rank(pairs: DataFrame, c: str, name: str) -> DataFrame:
    counts = pairs.groupBy(c).agg(F.sum("__w").alias("__n"))
    ranked = prefix_sums(counts, [], c, {"__before": "__n"})
    return ranked.select(c, (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(name))


def average_rank(df: DataFrame, c: str, name: str) -> DataFrame:
    """Rank of each distinct value, equal values sharing the mean rank: ``c, name``."""
    return _weighted_rank(df.where(F.col(c).isNotNull()).withColumn("__w", F.lit(1)), c, name)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns.

    Equal pairs are folded first, so a value that most rows share costs one row per partner value.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("__w"))
    ranked = pairs.join(_weighted_rank(pairs, a, "__ra"), a).join(_weighted_rank(pairs, b, "__rb"), b)
    w, x, y = F.col("__w"), F.col("__ra"), F.col("__rb")
    sums = ranked.agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"),
        F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy"),
    )
    covariance = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    spread = (F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n"))
    return sums.select("n", F.when(spread > 0, covariance / F.sqrt(spread)).alias("spearman"))


def surrogate_importance(df: DataFrame, feats: Sequence[str], y: str, trees: int = 20, depth: int = 5, seed: int = 0) -> DataFrame:
    """Random-forest importance per feature, highest first."""
    rows = df.where(F.col(y).isNotNull()).select(
        F.col(y).cast("double").alias("label"),
        array_to_vector(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats])).alias("features"),
    )
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)
    pairs = [(f, float(v)) for f, v in zip(feats, model.featureImportances.toArray())]
    table = df.sparkSession.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def group_importance(df: DataFrame, vec: str, slots: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Mean absolute value per named slice of a vector; slices of one name are added up.

    Vectors of one length are summed as vectors, so that a task sends one; rows without a vector are left out.
    """
    names: list[str] = []
    for name, start, width in slots:
        names += [""] * (start - len(names)) + [name] * width
    owner = F.array(*[F.lit(n) for n in names])
    sizes = F.transform(F.col(vec).cast("array<double>"), F.abs)
    mean = df.where(F.col(vec).isNotNull()).agg(Summarizer.mean(array_to_vector(sizes)).alias("__mean"))
    entries = mean.where(F.col("__mean").isNotNull()).select(F.posexplode(vector_to_array("__mean")).alias("pos", "mean_abs"))
    named = entries.withColumn("feature", F.coalesce(F.get(owner, F.col("pos")), F.lit(""))).where(F.col("feature") != "")
    return named.groupBy("feature").agg(F.avg("mean_abs").alias("importance"))


def regroup_importance(df: DataFrame, feature: str, cols: Sequence[str], group: Column) -> DataFrame:
    """Rename features to groups and add their importances up."""
    return df.groupBy(group.alias(feature)).agg(*[F.sum(c).alias(c) for c in cols])


def baseline_model(df: DataFrame, vec: str, ys: Sequence[str], key: str, split: str = "split", iterations: int = 20) -> DataFrame:
    """Class-weighted logistic regression per target, fitted on train rows: ``key, split, logit_<y>``."""
    features = df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))
    out = features
    for y in ys:
        train = features.where((F.col(split) == "train") & F.col(y).isNotNull())
        counts = train.groupBy(F.col(y).cast("int")).count().collect()
        sizes = {r[0]: r[1] for r in counts}
        if not sizes.get(0) or not sizes.get(1):
            raise ValueError(f"train rows of {y} need both classes")
        weight = F.when(F.col(y) == 1, F.lit((sizes[0] / sizes[1]) ** 0.5)).otherwise(F.lit(1.0))
        model = LogisticRegression(
            featuresCol="features", labelCol="__y", weightCol="__w", maxIter=iterations, regParam=0.01,
            predictionCol="__pred", probabilityCol="__prob", rawPredictionCol="__raw",
        ).fit(train.select("features", F.col(y).cast("double").alias("__y"), weight.alias("__w")))
        out = model.transform(out).withColumn(f"logit_{y}", vector_to_array("__raw")[1]).drop("__pred", "__prob", "__raw")
    return out.select(key, split, *ys, *[f"logit_{y}" for y in ys])


def auroc_margin(df: DataFrame, y: str, by: Sequence[str] = (), errors: float = 2.0) -> DataFrame:
    """Per group ``positives, negatives, margin``: so many standard errors of the area that scores without any order would have."""
    p, n = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    counts = df.groupBy(*by).agg(p.alias("positives"), n.alias("negatives"))
    both = (F.col("positives") * F.col("negatives")).cast("double")
    error = F.sqrt((F.col("positives") + F.col("negatives") + 1) / (12 * both))
    return counts.withColumn("margin", F.when(both > 0, errors * error))
