"""Attributions of a forest's predictions to features, from its table of nodes.

A tree gives a feature the average, over all orders in which features become known, of what knowing it changes; a split
on an unknown feature sends a row both ways, weighted by the training rows that went there (path-dependent attributions).
The attributions of a row add up to its prediction less the mean prediction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.session import scratch_path


@dataclass
class Leaf:
    """A leaf: its value, and for each feature on its path the share of rows that go this way and the half-open range it asks for."""

    value: float
    features: list[int]
    shares: list[float]
    bounds: list[tuple[float, float]]


def forest_leaves(model: RandomForestClassificationModel) -> list[list[Leaf]]:
    """The leaves of each tree, values being chances of class 1; read from the model's saved table of nodes (bounded by its size).

    Splits are on numbers: a row goes left where its value is at most the threshold.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "forest")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    return [_leaves(nodes) for _, nodes in sorted(trees.items())]


def _leaves(nodes: dict) -> list[Leaf]:
    out: list[Leaf] = []
    cover = {i: float(sum(r["impurityStats"])) for i, r in nodes.items()}

    def walk(i: int, path: dict[int, tuple[float, float, float]]) -> None:
        node = nodes[i]
        if node["leftChild"] < 0:
            stats = node["impurityStats"]
            out.append(Leaf(float(stats[1]) / cover[i], list(path), [p[0] for p in path.values()], [p[1:] for p in path.values()]))
            return
        f, threshold = node["split"]["featureIndex"], float(node["split"]["leftCategoriesOrThreshold"][0])
        share, lo, hi = path.get(f, (1.0, -np.inf, np.inf))
        for child, low, high in ((node["leftChild"], lo, min(hi, threshold)), (node["rightChild"], max(lo, threshold), hi)):
            walk(child, {**path, f: (share * cover[child] / cover[i], low, high)})

    walk(0, {})
    return out


def attributions(x: np.ndarray, trees: Sequence[Sequence[Leaf]]) -> tuple[np.ndarray, float]:
    """(rows x features) attributions of the mean over trees, and the mean prediction that they add up from."""
    out, base = np.zeros(x.shape), 0.0
    for leaves in trees:
        for leaf in leaves:
            d, z = len(leaf.features), np.array(leaf.shares)
            base += leaf.value * z.prod()
            if not len(x):
                continue
            # whether a row's value of each feature on the path goes this way
            ones = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, (lo, hi) in zip(leaf.features, leaf.bounds)]
            weights = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
            for i, f in enumerate(leaf.features):
                # by number of known features among the others: the sum over their sets of the share of rows that reach the leaf
                sums = np.zeros((len(x), d))
                sums[:, 0] = 1.0
                for j in range(d):
                    if j != i:
                        more = np.zeros_like(sums)
                        more[:, 1:] = sums[:, :-1] * ones[j][:, None]
                        sums = sums * z[j] + more
                out[:, f] += (ones[i] - z[i]) * leaf.value * (sums @ weights)
    return out / len(trees), base / len(trees)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


def attributed(df: DataFrame, vec: str, model: RandomForestClassificationModel) -> DataFrame:
    """``df`` with ``attributions`` (one for each entry of the vector, NULL without one) and ``base``: rows are attributed in batches where they are."""
    trees = forest_leaves(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = part.column(vec)
                found, base = attributions(_matrix(x.drop_null()), trees)
                held = iter(found.tolist())
                rows = [next(held) if ok else None for ok in x.is_valid().to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(rows, pa.list_(pa.float64())), pa.array(np.full(part.num_rows, base))], [*part.schema.names, "attributions", "base"]
                )

    kinds = ", ".join(f"`{c}` {k}" for c, k in df.withColumn(vec, F.col(vec).cast("array<double>")).dtypes)
    return df.withColumn(vec, F.col(vec).cast("array<double>")).mapInArrow(run, f"{kinds}, attributions array<double>, base double")


def fit_forest(df: DataFrame, vec: Column, y: str, trees: int = 20, depth: int = 5, seed: int = 0) -> RandomForestClassificationModel:
    rows = df.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("label"), array_to_vector(vec).alias("features"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def attributed_importance(df: DataFrame, feats: Sequence[str], y: str, trees: int = 20, depth: int = 5, seed: int = 0) -> DataFrame:
    """Mean absolute attribution of each feature over the labelled rows, highest first, by a forest fitted on them: ``feature, importance``.

    A task sends one sum for each feature.
    """
    vec = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats])
    labelled = df.where(F.col(y).isNotNull()).select(F.col(y), vec.alias("x"))
    leaves = forest_leaves(fit_forest(labelled, F.col("x"), y, trees, depth, seed))
    names = list(feats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(names)), 0
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), 2048):
                total += np.abs(attributions(x[at : at + 2048], leaves)[0]).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array(np.full(len(names), n, np.int64))], ["feature", "total", "n"])

    sums = labelled.select("x").mapInArrow(run, "feature string, total double, n long").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select("feature", (F.col("total") / F.col("n")).alias("importance")).orderBy(F.desc("importance"), "feature")
