"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cohortry.llm import queries, vector_dedup


def brute(rows, cosine=0.93):
    """``vec_id: (n_links, component)`` from all pairs; rows are (id, vector, label) with ids that don't repeat."""
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = (label, x / np.linalg.norm(x))
    root, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(good)
    for label in {good[i][0] for i in ids}:
        for size in {len(good[i][1]) for i in ids}:
            own = [i for i in ids if good[i][0] == label and len(good[i][1]) == size]
            if not own:
                continue
            x = np.stack([good[i][1] for i in own])
            for p, q in np.argwhere(np.triu(x @ x.T >= cosine, 1)):
                a, b = own[p], own[q]
                links[a] += 1
                links[b] += 1
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) for i in root}


def rows_of(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def made(seed, n, dim=64, copies=12, groups=20, noise=0.02):
    """Random directions, groups of near copies around some of them, and exact copies."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    near = [x[g] + noise * np.linalg.norm(x[g]) / np.sqrt(dim) * rng.normal(size=dim) * rng.uniform(0.2, 6) for g in range(groups) for _ in range(copies)]
    x = np.concatenate([x, near, np.repeat(x[-5:], 9, axis=0)]).astype(np.float32)
    return [(i, v.tolist(), int(i % 11 == 0)) for i, v in enumerate(x[rng.permutation(len(x))])]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows_of(queries.op12_vectors(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_cells(spark, kind, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TARGET", 60)
    rows = made(3, 900)
    got, want = rows_of(vector_dedup.near_vectors(table(spark, rows, kind))), brute(rows)
    assert got == want and max(n for n, _ in want.values()) > 8


def test_blocks_and_cores(spark, monkeypatch):
    """A group of near copies that is most of a label, compared in small blocks; some of its vectors lie outside the core."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=32)
    centre /= np.linalg.norm(centre)
    group = [centre + rng.uniform(0, 0.5) * (z := rng.normal(size=32)) / np.linalg.norm(z) for _ in range(500)]
    rows = [(i, v.astype(np.float32).tolist(), 1) for i, v in enumerate([*group, *rng.normal(size=(300, 32)), *([group[0]] * 100)])]
    monkeypatch.setattr(vector_dedup, "TARGET", 50)
    monkeypatch.setattr(vector_dedup, "BLOCK", 64)
    # six centroids at most are left of the group; every vector looks at all
    monkeypatch.setattr(vector_dedup, "PROBES", 64)
    assert rows_of(vector_dedup.near_vectors(table(spark, rows))) == brute(rows)


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs at a cosine of just above 0.93 in random directions, many cells: recall as the docstring states."""
    monkeypatch.setattr(vector_dedup, "TARGET", 64)
    rng = np.random.default_rng(4)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x = unit(rng.normal(size=(2000, 64)))
    z = rng.normal(size=x.shape)
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.9305 * x + np.sqrt(1 - 0.9305**2) * z
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, y]))]
    got, want = rows_of(vector_dedup.near_vectors(table(spark, rows, "double"))), brute(rows)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_kmeans_keeps_one_centroid_of_a_tight_group():
    rng = np.random.default_rng(2)
    x = rng.normal(size=16) + 0.01 * rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(vector_dedup.spherical_kmeans(x, 8)) == 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
            (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [1e38, 1e30], 1), (13, [1e-38, 0.0], 1), (14, [-0.0, 0.0], 1), (15, [-1.0, 0.0], 1), (16, [1.0, -0.0], 1)]
    clashing = table(spark, rows).selectExpr("*", "'a' as id", "'b' as v", "'c' as grp", "'d' as fp", "1 as n")
    assert rows_of(vector_dedup.near_vectors(clashing)) == brute(rows)
    assert vector_dedup.drop_near_vectors(clashing).columns == clashing.columns
    assert {r.vec_id for r in vector_dedup.drop_near_vectors(clashing).collect()} == {i for i, (_, c) in brute(rows).items() if i == c}
    again = table(spark, [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (4, [0.0, 1.0], 1)])
    got = sorted((tuple(r) for r in vector_dedup.near_vectors(again).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (None, 0, None, True), (5, 1, 5, True), (5, 1, 5, True), (4, 0, 4, True)], key=str)
    assert vector_dedup.near_vectors(table(spark, [])).count() == 0
