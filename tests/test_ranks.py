"""Ranks by histograms, thresholds of an order, and the operators that use them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import ranks


@pytest.mark.parametrize("few", [10**6, 0])
def test_column_quantiles_like_numpy(spark, few, monkeypatch):
    """With no final count of distinct values every bit of a value is found by histograms."""
    monkeypatch.setattr(ranks, "FEW", few)
    rng = np.random.default_rng(3)
    cols = {
        "wide": rng.normal(size=900) * 10.0 ** rng.integers(-300, 300, 900), "ties": np.round(rng.normal(size=900), 1), "whole": rng.integers(-5, 5, 900).astype(float),
        "zeros": np.where(rng.random(900) < 0.5, -0.0, 0.0), "one": np.full(900, 7.25),
    }
    rows = [tuple(float(x) for x in r) + (None, i if i else None) for i, r in enumerate(zip(*cols.values()))]
    df = spark.createDataFrame(rows, "wide double, ties double, whole double, zeros double, one double, none double, some long").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = {(r["column"], r["prob"]): r["quantile"] for r in ranks.column_quantiles(df, df.columns, probs).collect()}
    cols["some"] = np.arange(1, 900)
    assert set(got) == {(c, p) for c in cols for p in probs}
    for (c, p), q in got.items():
        lo, hi = (np.quantile(cols[c], p, method=m) for m in ("lower", "higher"))
        part = p * (len(cols[c]) - 1) % 1
        assert q == lo + (hi - lo) * part or (c != "wide" and q == pytest.approx(np.quantile(cols[c], p), abs=1e-12))


def test_quantiles_send_no_rows(spark):
    """What a task sends is bounded by buckets, not by rows."""
    df = spark.range(0, 400_000, 1, 3).select((F.col("id") * 7919 % 400_000).cast("double").alias("x"))
    got = ranks.values_at(df, lambda total, nulls: [0, total // 2, total - 1, total])[0]
    assert got == {0: (0.0, 0, 1), 200_000: (200_000.0, 200_000, 1), 399_999: (399_999.0, 399_999, 1)}


@pytest.mark.parametrize("n", [0, 333, 999, 5000])
@pytest.mark.parametrize(("names", "few"), [(["s", ("x", "desc"), "id"], 3), ([("b", "desc"), ("s", "desc"), "d", ("id", "desc")], 3), (["x", "t", "id"], 50), (["id"], 3)])
def test_top_n(spark, monkeypatch, n, names, few):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "SMALL", 0)
    rng = random.Random(5)
    prefix = "a common beginning of many"
    rows = [
        (i, rng.choice([None, prefix, prefix + "é", prefix + " words", "", "b"]), rng.choice([None, -1.5, 0.0, 2.0, 1e300]), rng.choice([None, True, False]),
         rng.choice([None, *range(-3, 3)]), rng.choice([None, 1, 2]))
        for i in range(1000)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, s string, x double, b boolean, d int, t int")
    df = df.withColumns({"d": F.date_add(F.lit("1970-01-01").cast("date"), F.col("d")), "t": F.timestamp_seconds("t").cast("timestamp_ntz")})
    order = [F.col(c).asc() if isinstance(c, str) else F.col(c[0]).desc() for c in names]
    want = sorted(r["id"] for r in df.orderBy(*order).limit(n).collect())
    assert sorted(r["id"] for r in ranks.top_n(df, n, names).collect()) == want


def test_top_n_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 3)
    monkeypatch.setattr(ranks, "SMALL", 0)
    df = spark.createDataFrame([(1, "x")] * 50 + [(2, "y")] * 50, "k long, v string")
    assert sorted(tuple(r) for r in ranks.top_n(df, 70, "k").collect()) == [(1, "x")] * 50 + [(2, "y")] * 20
