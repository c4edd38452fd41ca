"""Hot keys: results must not depend on how a timeline is cut, nor on the number of partitions."""

from __future__ import annotations

import bisect
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortry.operators import evaluate, linkage, panels, pick, sampling, skew, windows
from cohortry.plans import oracle_sql, queries
from tools.check_queries import compare

ORDERED = [
    "link_window_open", "link_asof_forward", "link_next_after", "linkage_stats_open", "prior_visits", "returns_within",
    "next_visit", "first_event_lag", "closest_to_anchor", "closest_to_anchor_after", "closest_abs", "impute_median",
    "history_block", "notes_block", "category_codes", "action_index", "auroc", "auroc_by_group", "auprc", "ece_bins",
    "mutual_information", "spearman", "profile_columns", "repetition_stats", "group_size_stats", "text_length_stats",
]
DAY = datetime(2020, 1, 1)


@pytest.mark.parametrize("name", ORDERED)
def test_all_keys_hot(spark, sf_dir, duck, monkeypatch, name):
    monkeypatch.setattr(skew, "PIECE_ROWS", 2)
    df = queries()[name](spark, sf_dir)
    cursor = duck.execute(oracle_sql()[name])
    want = ([d[0] for d in cursor.description], cursor.fetchall())
    assert compare((df.columns, [tuple(r) for r in df.collect()]), want) == ""


@pytest.fixture(scope="module")
def skewed(spark):
    """Subject 1 holds a third of all visits and events; times repeat."""
    rng = random.Random(5)
    subject = lambda: 1 if rng.random() < 0.34 else rng.randrange(2, 40)
    visits = [(subject(), 1000 + i, DAY + timedelta(hours=rng.randrange(4000))) for i in range(900)]
    visits = [(s, v, a, a + timedelta(hours=rng.randrange(0, 200))) for s, v, a in visits]
    events = [(subject(), i, DAY + timedelta(hours=rng.randrange(4000)), None) for i in range(2500)]
    st = spark.createDataFrame(visits, "s long, v long, a timestamp_ntz, e timestamp_ntz")
    ev = spark.createDataFrame(events, "s long, i long, t timestamp_ntz, v long")
    return visits, events, st.repartition(5), ev.repartition(7)


@pytest.mark.parametrize("floor", [10**6, 50, 2])
def test_nearest_brute_force(skewed, floor):
    visits, events, st, ev = skewed
    got = skew.nearest(ev, st, "s", "t", "a", "v", backward=True, strict=True, piece_rows=floor).collect()
    want = {}
    for s, _, t, _ in events:
        own = [(a, v) for s2, v, a, _ in visits if s2 == s]
        before = max((a for a, _ in own if a <= t), default=None)
        after = min((a for a, _ in own if a > t), default=None)
        key = lambda at: min((v for a, v in own if a == at), default=None)
        want[(s, t)] = (after, key(after), before, key(before))
    assert {(r["s"], r["t"]): (r["next_start"], r["next_key"], r["prev_start"], r["prev_key"]) for r in got} == want
    assert len(got) == len(want)


def test_link_by_window_brute_force(skewed):
    visits, events, st, ev = skewed
    got = {r["i"]: r["v"] for r in linkage.link_by_window(ev, st, "s", "v", "t", "a", "e", 3).collect()}
    tol, want = timedelta(hours=3), {}
    for s, i, t, _ in events:
        hits = [(abs(a - t), a, v) for s2, v, a, e in visits if s2 == s and a - tol <= t <= e + tol]
        if hits:
            want[i] = min(hits)[2]
    assert got == want


@pytest.mark.parametrize("floor", [10**6, 2])
def test_next_visit_brute_force(skewed, floor, monkeypatch):
    monkeypatch.setattr(skew, "PIECE_ROWS", floor)
    visits, _, st, _ = skewed
    got = {r["v"]: r["next_visit"] for r in windows.next_visit(st, "s", "v", "a", "e").collect()}
    want = {}
    for s in {x[0] for x in visits}:
        own = sorted((a, v) for s2, v, a, _ in visits if s2 == s)
        want.update({v: (own[i + 1][1] if i + 1 < len(own) else None) for i, (_, v) in enumerate(own)})
    assert got == want


@pytest.mark.parametrize("floor", [10**6, 2])
def test_running_list_brute_force(skewed, floor):
    visits, _, st, _ = skewed
    got = {r["v"]: r["prior"] for r in skew.running_list(st, "s", "a", F.col("v"), "prior", floor).collect()}
    for s, v, a, _ in visits:
        assert got[v] == [v2 for _, v2 in sorted((a2, v2) for s2, v2, a2, _ in visits if s2 == s and a2 < a)]


@pytest.mark.parametrize("floor", [10**6, 5])
def test_exact_quantiles_like_numpy(spark, floor):
    rng = np.random.default_rng(3)
    groups = {g: np.round(rng.normal(size=n), 1 if g == "ties" else 9) for g, n in (("big", 900), ("ties", 300), ("one", 1))}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("big", None)], "g string, x double")
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in skew.exact_quantiles(df, ["g"], "x", probs, floor).collect()}
    for g, xs in groups.items():
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(xs, p), abs=1e-12)


def test_hash_rank_is_a_permutation_on_any_partitioning(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, "rare").otherwise("common").alias("g"))
    results = [
        sorted(tuple(r) for r in skew.hash_rank(df.repartition(n), ["g"], ["id"], 3).collect()) for n in (1, 4, 200)
    ]
    assert results[0] == results[1] == results[2]
    assert sorted(r[2] for r in results[0] if r[1] == "common") == list(range(1, 4901))
    assert {r[3] for r in results[0] if r[1] == "rare"} == {100}


def largest_piece(df):
    return df.groupBy("__line", "__piece").count().agg(F.max("count")).first()[0]


def test_pieces_have_an_absolute_size(spark):
    """A key of 0.3 %, a NULL key with a third of the rows, and the rest in keys of one row."""
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 300 == 1, F.lit(-1)).otherwise(F.col("id"))
    cut = skew.add_piece(spark.range(200_000).select(key.alias("k"), "id"), ["k"], "id", 100).cache()
    for hot, rows in ((F.col("k").isNull(), 66_667), (F.col("k") == -1, 667)):
        own = cut.where(hot)
        assert own.count() == rows
        assert largest_piece(own) < 2500
    assert cut.where("k is null").agg(F.count_distinct("__piece")).first()[0] > 500
    falls = Window.partitionBy("k").orderBy("id")
    assert cut.withColumn("d", F.col("__piece") - F.lag("__piece").over(falls)).where("d < 0 or d > 1").count() == 0
    cut.unpersist()


def test_strings_with_one_common_start_are_cut(spark):
    names = spark.range(50_000).select(F.format_string("Customer#%09d", "id").alias("v"), "id")
    assert largest_piece(skew.add_piece(names, [], "v", 100)) < 2500
    codes = panels.category_codes(names, "v")
    assert codes.where("code <> id").count() == 0


@pytest.mark.parametrize("rows", [10**6, 20])
def test_null_subject_is_matched_like_any_other(spark, rows):
    st = spark.range(300).select(F.lit(None).cast("long").alias("s"), (F.col("id") * 10).alias("v"), F.timestamp_seconds(F.col("id") * 10).cast("timestamp_ntz").alias("a"))
    ev = spark.range(2990).select(F.lit(None).cast("long").alias("s"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), "id")
    got = skew.nearest(ev, st, "s", "t", "a", "v", piece_rows=rows).select("next_key").collect()
    assert sorted(r[0] for r in got) == [-(-i // 10) * 10 for i in range(2990)]


def test_tiny_class_is_copied_in_chunks(spark):
    df = spark.range(5001).select("id", (F.col("id") == 17).cast("int").alias("y"))
    out = sampling.balance_oversample(df, "y", "id", 1)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 5000, 1: 5000}
    assert out.where("y = 1").select("copy").distinct().count() == 5000


def test_auroc_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 1500)
    score = np.where(rng.random(1500) < 0.4, 0.5, rng.random(1500))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y int, p double")
    pos, neg = np.sort(score[y == 1]), np.sort(score[y == 0])
    wins = sum((bisect.bisect_left(neg, s) + bisect.bisect_right(neg, s)) / 2 for s in pos)
    assert evaluate.auroc(df, "y", "p").first()[0] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


def test_closest_to_anchor_prefers_the_past(spark):
    st = spark.createDataFrame([(1, 10, datetime(2020, 1, 10)), (2, 20, datetime(2020, 1, 10))], "s int, v int, a timestamp_ntz")
    obs = spark.createDataFrame(
        [(1, datetime(2020, 1, 1), 5.0, 1), (1, datetime(2020, 1, 11), 6.0, 2), (1, datetime(2020, 1, 1), None, 0),
         (2, datetime(2020, 1, 20), 7.0, 3), (2, datetime(2020, 1, 20), 8.0, 1)],
        "s int, t timestamp_ntz, x double, tie int",
    )
    got = {r["v"]: r["x"] for r in pick.closest_to_anchor(st, obs, "s", "v", "a", "t", "x", "tie").collect()}
    assert got == {10: 5.0, 20: 8.0}


def test_closed_windows_of_any_length(spark):
    """Against all pairs: windows up to the year 9999, reversed ones, thousands that overlap, tolerances of weeks."""
    rng = np.random.default_rng(5)
    base = datetime(2020, 1, 1)
    hours = lambda x: base + timedelta(hours=float(x))
    stays = [(1, i, hours(a), hours(a + rng.choice([-30, 0, 5, 40, 3000, 90000]))) for i, a in enumerate(rng.integers(0, 2000, 400) / 2)]
    stays += [(2, 1000 + i, hours(i % 50), datetime(9999, 12, 31)) for i in range(2000)]
    stays += [(None, 5000, hours(0), hours(9)), (1, 5001, None, hours(9)), (1, 5002, hours(9), None)]
    points = [(1, None, hours(h)) for h in rng.integers(-200, 3000, 300) / 2] + [(2, None, hours(h)) for h in (-3, 10, 30000, 800000)]
    points += [(None, None, hours(1)), (1, None, None)]
    st = spark.createDataFrame(stays, "sid long, vid long, s timestamp_ntz, e timestamp_ntz")
    ev = spark.createDataFrame(points, "sid long, vid long, ts timestamp_ntz")
    for tol in (0.0, 1.0, 500.0):
        gap = timedelta(hours=tol)
        want, many = set(), 0
        for sid, _, ts in points:
            fits = [(abs(s - ts), s, v) for i, v, s, e in stays if None not in (sid, ts, i, s, e) and i == sid and s - gap <= ts and ts - e <= gap]
            if fits:
                want.add((sid, min(fits)[2], ts))
                many += len(fits) > 1
        got = linkage.link_by_window(ev, st, "sid", "vid", "ts", "s", "e", tol)
        assert {tuple(r) for r in got.collect()} == want
        assert linkage.linkage_stats(ev, st, "sid", "vid", "ts", "s", "e", tol).first()["ambiguous_resolved"] == many
    assert linkage._pieces(st.where("sid = 2"), "sid", "vid", "s", "e", 0).count() < 10_000
