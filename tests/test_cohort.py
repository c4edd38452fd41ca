"""Linkage, windows, labels and splits on small fixtures."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortry.functions.times import age_at, elapsed_hhmm, length_of_stay
from cohortry.operators import linkage, pick, sampling, text, windows


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


@pytest.fixture
def admissions(spark):
    flags = [1, 0, 0, 1, 0] * 4
    return spark.createDataFrame([(i, 100 + i, f) for i, f in enumerate(flags)], "subject_id long, hadm_id long, died int")


def test_split_covers_everyone(spark, admissions):
    people = sampling.outcome_rate(admissions, "subject_id", "died")
    splits = sampling.stratified_split(people, "subject_id", "ever")
    out = sampling.attach_split(admissions, splits, "subject_id").collect()
    assert len(out) == 20 and {r["split"] for r in out} == {"train", "dev", "test"}
    assert sum(r["split"] == "train" for r in out) == 14


def test_split_is_the_same_on_any_partitioning(spark, admissions, rows):
    people = sampling.outcome_rate(admissions, "subject_id", "died")
    split = lambda n: rows(sampling.stratified_split(people.repartition(n), "subject_id", "ever"))
    assert split(1) == split(4) == split(200)


def test_split_fractions_must_sum_to_one(admissions):
    with pytest.raises(ValueError):
        sampling.stratified_split(admissions, "subject_id", "died", (0.6, 0.15, 0.15))


@pytest.fixture
def stays(spark):
    data = [
        (1, 10, ts("2020-01-01"), ts("2020-01-05"), 1),
        (2, 20, ts("2020-01-01"), ts("2020-01-10"), 0),
        (2, 21, ts("2020-01-20"), ts("2020-01-25"), 0),
        (3, 30, ts("2020-01-01"), None, 0),
    ]
    return spark.createDataFrame(data, "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, died int")


@pytest.mark.parametrize(("null_end", "open_label"), [("zero", 0.0), ("null", None)])
def test_labels(stays, null_end, open_label):
    labels = sampling.outcome_labels(stays, "subject_id", "hadm_id", "admittime", "dischtime", "died", null_end=null_end)
    got = {r["hadm_id"]: (r["y1"], r["y2"]) for r in labels.collect()}
    assert got == {10: (1, None), 20: (0, 1.0), 21: (0, 0.0), 30: (0, open_label)}


def test_return_exactly_at_the_bound(spark):
    day = ts("2020-01-01")
    data = [(1, 1, day, day + timedelta(days=1)), (1, 2, day + timedelta(days=31), day + timedelta(days=32)),
            (1, 3, day + timedelta(days=32), day + timedelta(days=33))]
    st = spark.createDataFrame(data, "s long, v long, a timestamp_ntz, e timestamp_ntz")
    got = {r["v"]: r["returned"] for r in windows.returns_within(st, "s", "v", "a", "e").collect()}
    # 30 days after the end counts; a start at the very moment of the end does not
    assert got == {1: True, 2: False, 3: False}
    nxt = {r["v"]: r["readmitted"] for r in windows.next_visit(st, "s", "v", "a", "e").collect()}
    assert nxt == {1: True, 2: True, 3: False}


@pytest.fixture
def timeline(spark):
    data = [(1, 10, ts("2018-03-12")), (1, 20, ts("2019-07-24")), (1, 30, ts("2020-01-01")), (2, 40, ts("2020-01-01"))]
    return spark.createDataFrame(data, "subject_id long, hadm_id long, admittime timestamp_ntz")


def test_diagnosis_history(spark, timeline):
    facts = spark.createDataFrame(
        [(10, 1, "Chronic kidney disease"), (10, 2, "Hypertension"), (10, 3, ""), (20, 1, "Kidney failure")],
        "hadm_id long, seq int, title string",
    )
    block = text.history_block(timeline, facts, "subject_id", "hadm_id", "admittime", "title", "seq")
    got = {r["hadm_id"]: r["history"] for r in block.collect()}
    assert got[10] == "" and got[40] == ""
    assert got[30] == (
        "Past Diagnoses:\n\nVisit (2018-03-12):\nChronic kidney disease\nHypertension\n\nVisit (2019-07-24):\nKidney failure"
    )
    assert "2019" not in got[20]


def test_history_keeps_the_header_of_a_visit_without_titles(spark, timeline):
    facts = spark.createDataFrame([(10, 1, "")], "hadm_id long, seq int, title string")
    block = text.history_block(timeline, facts, "subject_id", "hadm_id", "admittime", "title", "seq")
    assert {r["hadm_id"]: r["history"] for r in block.collect()}[20] == "Past Diagnoses:\n\nVisit (2018-03-12):"


def test_note_history(spark, timeline):
    notes = spark.createDataFrame([(10, 1, "Allergies: none"), (20, 2, "Allergies: nuts"), (20, 3, " ")], "hadm_id long, n int, text string")
    block = text.notes_block(timeline, notes, "subject_id", "hadm_id", "admittime", "text", "n")
    got = {r["hadm_id"]: r["notes"] for r in block.collect()}
    assert got[10] == ""
    assert got[30] == (
        "Prior Discharge Summary (2018-03-12):\nAllergies: none\n\nPrior Discharge Summary (2019-07-24):\nAllergies: nuts"
    )


def test_triage_linkage(spark):
    st = spark.createDataFrame(
        [(1, 100, ts("2020-01-01 10:00:00")), (2, 200, ts("2020-01-01")), (3, 300, ts("2020-02-01"))],
        "subject_id long, hadm_id long, admittime timestamp_ntz",
    )
    ed = spark.createDataFrame(
        [(1, 11, 100, ts("2020-01-01 08:00:00")), (2, 12, None, ts("2020-01-05")), (3, 13, None, ts("2020-01-20"))],
        "subject_id long, stay_id long, hadm_id long, intime timestamp_ntz",
    )
    triage = spark.createDataFrame([(1, 11), (2, 12), (3, 13)], "subject_id long, stay_id long")
    bridged = linkage.link_via_bridge(triage, ed.drop("subject_id"), "stay_id", "hadm_id")
    linked = linkage.link_next_after(bridged, st, "subject_id", "hadm_id", "intime", "admittime")
    assert {r["subject_id"]: r["hadm_id"] for r in linked.collect()} == {1: 100, 3: 300}


@pytest.fixture
def lab_visit(spark):
    st = spark.createDataFrame([(1, 10, ts("2020-01-01"), ts("2020-01-05"))], "s long, v long, a timestamp_ntz, e timestamp_ntz")
    start = ts("2020-01-01")
    ev = spark.createDataFrame([(1, 10, start + timedelta(hours=h)) for h in (6, 24, 25)] + [(1, 10, None)], "s long, v long, t timestamp_ntz")
    return ev, st


@pytest.mark.parametrize(("window", "n"), [(24, 2), ("full", 3), (6, 1)])
def test_lab_window(lab_visit, window, n):
    ev, st = lab_visit
    assert windows.anchor_window(ev, st, ["s", "v"], "t", "a", window, end="e").count() == n


@pytest.mark.parametrize("window", [0, -3, "soon", 1.5, True])
def test_lab_window_option_is_checked(lab_visit, window):
    ev, st = lab_visit
    with pytest.raises(ValueError):
        windows.anchor_window(ev, st, ["s", "v"], "t", "a", window, end="e")


def test_within_stay_keeps_undated(lab_visit):
    ev, st = lab_visit
    assert windows.within_stay(ev, st, ["s", "v"], "t", "a", "e").count() == 4
    assert windows.within_stay(ev, st, ["s", "v"], "t", "a", "e", null_ts_ok=False).count() == 3


def test_asof_at_the_exact_tolerance(spark):
    st = spark.createDataFrame([(1, 10, ts("2020-01-01 12:00:00"))], "s long, v long, a timestamp_ntz")
    ev = spark.createDataFrame(
        [(1, 1, None, ts("2020-01-01 10:00:00")), (1, 2, None, ts("2020-01-01 09:59:59")), (1, 3, None, ts("2020-01-01 12:00:01")),
         (1, 4, 99, ts("2020-01-01"))],
        "s long, i int, v long, t timestamp_ntz",
    )
    got = {r["i"]: r["v"] for r in linkage.link_asof_forward(ev, st, "s", "v", "t", "a", 2).collect()}
    assert got == {1: 10, 4: 99}


def test_linkage_counters(spark):
    st = spark.createDataFrame(
        [(1, 10, ts("2020-01-01"), ts("2020-01-03")), (1, 11, ts("2020-01-02"), ts("2020-01-04"))],
        "s long, v long, a timestamp_ntz, e timestamp_ntz",
    )
    ev = spark.createDataFrame(
        [(1, None, ts("2020-01-02 12:00:00")), (1, None, ts("2020-01-01 01:00:00")), (1, None, ts("2021-01-01")), (1, 10, ts("2020-01-01")),
         (1, None, None)],
        "s long, v long, t timestamp_ntz",
    )
    row = linkage.linkage_stats(ev, st, "s", "v", "t", "a", "e", 1).first().asDict()
    assert row == {"total": 5, "total_null": 4, "linked": 2, "ambiguous_resolved": 1, "unresolvable": 2}
    assert linkage.drop_stats(ev, "v").first().asDict() == {
        "total": 5, "total_null": 4, "dropped": 4, "linked": 0, "ambiguous_resolved": 0, "unresolvable": 0,
    }


def test_time_expressions(spark):
    df = spark.createDataFrame(
        [(ts("2020-01-01"), ts("2020-01-01 02:14:59")), (ts("2020-01-01"), ts("2019-12-31")), (ts("2020-01-01"), ts("2020-01-06 05:06:00"))],
        "a timestamp_ntz, t timestamp_ntz",
    )
    got = df.select(elapsed_hhmm("t", "a"), length_of_stay("a", "t", "hours"), age_at(F.lit(50), F.lit(2018), "a")).collect()
    assert [r[0] for r in got] == ["02:14", "00:00", "125:06"]
    assert got[1][1] == -24.0 and got[0][2] == 52


def test_latest_takes_the_undated(spark):
    df = spark.createDataFrame([(1, ts("2020-01-01"), "old", 1), (1, None, "undated", 2), (2, ts("2020-01-01"), None, 1)],
                               "k long, t timestamp_ntz, x string, tie int")
    assert [tuple(r) for r in pick.latest(df, "k", "x", "t", "tie").collect()] == [(1, "undated")]
    assert [tuple(r) for r in pick.latest(df, "k", "x", "t", "tie", nulls_last=False).collect()] == [(1, "old")]


def test_balancing(spark):
    df = spark.createDataFrame([(i, [float(i)], 0 if i < 12 else (1 if i < 17 else 2)) for i in range(20)], "id long, x array<double>, y int")
    out = sampling.balance_oversample(df, "y", "id")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 12, 1: 12, 2: 12}
    assert out.where("copy = 0").count() == 20
    assert out.join(df.withColumnRenamed("x", "x0"), "id").where("x <> x0").count() == 0
    noisy = sampling.balance_with_noise(df, "y", "id", "x", 0.01)
    off = noisy.join(df.select("id", F.col("x").alias("x0")), "id").select("copy", F.abs(F.col("x")[0] - F.col("x0")[0]).alias("d"))
    assert off.where("copy = 0 and d > 0").count() == 0
    assert 0 < off.where("copy > 0").agg(F.max("d")).first()[0] < 0.06
    assert sampling.balance_oversample(out.drop("copy"), "y", "id").count() == 36
