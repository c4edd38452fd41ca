"""Mutual information by neighbours, tree attributions, moments of many columns, batches of an encoder."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortry.operators import attribution, evaluate, skew, vectors


def digamma(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute_mi(x, y, k=3):
    sizes = {c: y.count(c) for c in set(y)}
    rows = [(a, b) for a, b in zip(x, y) if sizes[b] > 1]
    out = 0.0
    for i, (v, c) in enumerate(rows):
        kk = min(k, sizes[c] - 1)
        r = sorted(abs(w - v) for j, (w, d) in enumerate(rows) if j != i and d == c)[kk - 1]
        m = sum(abs(w - v) < r or (r == 0 and w == v) for w, _ in rows)
        out += digamma(kk) - digamma(sizes[c]) - digamma(m)
    return max(0.0, digamma(len(rows)) + out / len(rows))


@pytest.mark.parametrize("floor", [10**6, 4])
def test_mutual_information_knn_brute_force(spark, floor, monkeypatch):
    monkeypatch.setattr(skew, "PIECE_ROWS", floor)
    rng = np.random.default_rng(6)
    n = 240
    y = [int(c) for c in rng.integers(0, 3, n)]
    y[0] = 9  # a class of one row
    y[1], y[2] = 8, 8
    cols = {
        "told": [v + c * 2.0 for v, c in zip(rng.normal(size=n), y)], "noise": rng.normal(size=n).tolist(), "ties": np.round(rng.normal(size=n), 1).tolist(),
        "same": [1.0] * n, "scales": (10.0 ** rng.integers(-12, 12, n) * rng.choice([-1, 1], n)).tolist(), "zero": rng.choice([-0.0, 0.0, 1e-320], n).tolist(),
    }
    df = spark.createDataFrame([(c, *(float(col[i]) for col in cols.values())) for i, c in enumerate(y)], "y int, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    got = {r["feature"]: r["mi"] for r in evaluate.mutual_information_knn(df, list(cols), "y", 3, floor).collect()}
    assert got.keys() == cols.keys()
    for c, x in cols.items():
        assert got[c] == pytest.approx(brute_mi(x, y), abs=1e-9)
    assert got["told"] > 0.3 > got["noise"]


def brute_attribution(row, nodes, n):
    """Average over orders, by the definition, with both ways taken at splits on unknown features."""
    cover = {i: sum(r["impurityStats"]) for i, r in nodes.items()}

    def value(i, known):
        r = nodes[i]
        if r["leftChild"] < 0:
            return r["impurityStats"][1] / cover[i]
        f, at = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return value(r["leftChild"] if row[f] <= at else r["rightChild"], known)
        return sum(cover[c] / cover[i] * value(c, known) for c in (r["leftChild"], r["rightChild"]))

    out = []
    for f in range(n):
        others = [g for g in range(n) if g != f]
        out.append(sum(
            factorial(s) * factorial(n - 1 - s) / factorial(n) * (value(0, {*c, f}) - value(0, set(c))) for s in range(n) for c in combinations(others, s)
        ))
    return out


def test_tree_attributions_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 6)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "i int, y int, x array<double>")
    model = attribution.fit_forest(df, F.col("x"), "y", trees=3, depth=5, seed=2)
    holes = df.unionByName(spark.createDataFrame([(-1, 0, None)], df.schema))
    got = {r["i"]: r for r in attribution.attributed(holes, "x", model).collect()}
    assert got[-1]["attributions"] is None and got[0]["y"] == y[0]
    prob = {r["i"]: r["p"] for r in model.transform(df.withColumn("features", array_to_vector("x"))).select("i", vector_to_array("probability")[1].alias("p")).collect()}
    model.write().overwrite().save(f"{tmp_path}/m")
    trees = {}
    for r in spark.read.parquet(f"{tmp_path}/m/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    for i in range(300):
        assert got[i]["base"] + sum(got[i]["attributions"]) == pytest.approx(prob[i], abs=1e-9)
    for i in range(0, 300, 30):
        want = np.mean([brute_attribution(x[i], nodes, 6) for nodes in trees.values()], axis=0)
        assert got[i]["attributions"] == pytest.approx(want.tolist(), abs=1e-9)
    named = df.select("y", *[F.col("x")[i].alias(f"f{i}") for i in range(6)])
    found = attribution.attributed_importance(named, [f"f{i}" for i in range(6)], "y", trees=3, depth=5, seed=2)
    mean = {f"f{j}": np.mean([abs(got[i]["attributions"][j]) for i in range(300)]) for j in range(6)}
    assert {r["feature"]: r["importance"] for r in found.collect()} == pytest.approx(mean, abs=1e-9)
    assert found.first()["feature"] == "f0"


@pytest.mark.parametrize("method", ["svd", "pca"])
def test_all_columns_are_fitted_in_one_job(spark, method):
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=(80, 9)) @ rng.normal(size=(9, 9)) + 3, "b": rng.normal(size=(80, 130)), "c": np.zeros((80, 4))}
    data["a"][5] = 0
    rows = [("train" if i < 60 else "test", *[None if n == "b" and i == 7 else v[i].tolist() for n, v in data.items()]) for i in range(80)]
    df = spark.createDataFrame(rows, "split string, a array<double>, b array<double>, c array<double>").repartition(3)
    tracker, group = spark.sparkContext.statusTracker(), f"fit-{method}"
    spark.sparkContext.setJobGroup(group, group)
    reduced, stats = vectors.reduce_table(df, ["a", "b", "c"], k=6, method=method)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6  # adaptive execution counts each stage of the one query
    found = {r["vector"]: r for r in stats.collect()}
    assert (found["c"]["rows"], found["c"]["components"]) == (0, 0) and found["a"]["rows"] == 59 and found["b"]["rows"] == 59
    for name in ("a", "b"):
        train = np.array([r[1 + list(data).index(name)] for r in rows[:60] if r[1 + list(data).index(name)] is not None and any(r[1 + list(data).index(name)])])
        centred = train - train.mean(axis=0)
        base = centred if method == "pca" else train
        parts = np.linalg.svd(base, full_matrices=False)[2][:6]
        kept = (centred @ parts.T).var(axis=0).sum() / centred.var(axis=0).sum()
        assert found[name]["variance"] == pytest.approx(kept, abs=1e-8)
        energy = sorted(np.linalg.norm(np.array([r[name] for r in reduced.where("split = 'train'").collect() if r[name] is not None and any(r[name])]), axis=0))
        assert energy == pytest.approx(sorted(np.linalg.norm(base @ parts.T, axis=0)), rel=1e-5)


def test_batches_by_tokens(spark):
    assert list(vectors.token_batches([1, 1, 1, 9, 9, 100, 2], 3, 20)) == [(0, 3), (3, 5), (5, 6), (6, 7)]
    assert list(vectors.token_batches([], 3, 20)) == []
    rng = np.random.default_rng(4)
    texts = ["x" * int(n) for n in np.exp(rng.normal(6, 1.2, 1500))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "  ")], "k long, t string").repartition(3)

    def make():
        # the number of texts and the longest text of the batch, besides the text itself
        return lambda batch: np.array([[len(t), len(batch), max(len(x) for x in batch)] for t in batch], np.float32)

    got = {r["k"]: r["embedding"] for r in vectors.embed_with_model(df, "k", "t", make, 3, batch_size=64, token_budget=4096).collect()}
    assert got[-1] == got[-2] == [0.0, 0.0, 0.0] and all(got[i][0] == len(t) for i, t in enumerate(texts))
    assert all(n <= 64 and (n == 1 or n * np.ceil(longest / 4) <= 4096) for _, n, longest in (got[i] for i in range(len(texts))))
    padded = sum(v[2] for i, v in got.items() if i >= 0)
    at_random = sum(max(len(t) for t in texts[i : i + 64]) * len(texts[i : i + 64]) for i in range(0, len(texts), 64))
    assert sum(map(len, texts)) > 0.8 * padded > 0.8 * sum(map(len, texts)) and padded < 0.5 * at_random
