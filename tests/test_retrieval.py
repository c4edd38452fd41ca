"""The pivot index against a comparison with every document."""

from __future__ import annotations

import numpy as np
import pytest

from cohortry.operators import retrieval


def frame(spark, x, name="d", first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], f"{name} long, v array<double>")


def brute(asked, docs, k):
    out = {}
    for i, q in enumerate(asked):
        order = sorted(range(len(docs)), key=lambda j: (((docs[j] - q) ** 2).sum(), j))[:k]
        out[i] = [(j, float(((docs[j] - q) ** 2).sum())) for j in order]
    return out


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["q"], r["rank"])):
        out.setdefault(r["q"], []).append((r["d"], r["distance"]))
    return out


def clustered(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim)) * 10
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dim))
    x[n // 3 : n // 3 + 200] = x[0]  # copies: ties by id
    return x


@pytest.mark.parametrize(("block", "chunk", "pivots"), [(64, 5, 40), (4096, 1024, 12), (30, 1024, 1)])
def test_search_is_exact_and_skips(spark, tmp_path, monkeypatch, block, chunk, pivots):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "CHUNK", chunk)
    docs = clustered(1, 1500)
    asked = np.concatenate([clustered(1, 1500)[::40], np.random.default_rng(2).normal(size=(5, 12)) * 30])
    path = retrieval.build_index(frame(spark, docs).repartition(5), "d", "v", f"{tmp_path}/index", pivots)
    hits, report = retrieval.search_index(frame(spark, asked, "q"), "q", "v", path, 4, "d")
    assert found(hits) == brute(asked, docs, 4)
    rows = report.collect()
    assert len(rows) == len(asked) and all(r["docs"] == 1500 and r["docs_met"] <= 1500 for r in rows)
    if pivots > 1:
        assert sum(r["cells_met"] for r in rows) < 0.5 * sum(r["cells"] for r in rows)
        assert sum(r["docs_met"] for r in rows) < 0.5 * 1500 * len(rows)


def test_more_hits_than_documents(spark, tmp_path):
    docs = clustered(3, 700)[:7]
    path = retrieval.build_index(frame(spark, docs), "d", "v", f"{tmp_path}/index", 3)
    hits, _ = retrieval.search_index(frame(spark, docs[:2], "q"), "q", "v", path, 50, "d")
    assert found(hits) == brute(docs[:2], docs, 50)


def test_extended_index(spark, tmp_path, monkeypatch):
    """New documents, also far from all pivots, are found; those the index holds are not added again."""
    monkeypatch.setattr(retrieval, "BLOCK", 50)
    docs = clustered(5, 900)
    docs[600:] += 40
    path = retrieval.build_index(frame(spark, docs[:600]), "d", "v", f"{tmp_path}/index", 9)
    retrieval.extend_index(frame(spark, docs), "d", "v", path)
    assert spark.read.parquet(f"{path}/blocks").agg({"n": "sum"}).first()[0] == 900
    asked = docs[::50]
    assert found(retrieval.search_index(frame(spark, asked, "q"), "q", "v", path, 3, "d")[0]) == brute(asked, docs, 3)


def test_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, [1.0, 2.0])], "d long, v array<double>")
    none = spark.createDataFrame([(1, None)], "q long, v array<double>")
    assert retrieval.top_k_similar(none, docs, "q", "d", "v", 3).count() == 0
    assert retrieval.top_k_similar(frame(spark, np.zeros((1, 2)), "q"), docs.where("d = 1"), "q", "d", "v", 3).count() == 0
    assert [tuple(r) for r in retrieval.top_k_similar(frame(spark, np.zeros((1, 2)), "q"), docs, "q", "d", "v", 3).collect()] == [(0, 2, 5.0, 1)]


def test_plan_has_no_cross_join(spark, tmp_path, capsys):
    docs = frame(spark, clustered(7, 300))
    path = retrieval.build_index(docs, "d", "v", f"{tmp_path}/index", 4)
    retrieval.search_index(docs.withColumnRenamed("d", "q"), "q", "v", path, 3, "d")[0].explain()
    plan = capsys.readouterr().out
    assert "Cartesian" not in plan and "NestedLoop" not in plan
