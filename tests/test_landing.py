"""Scratch tables of the hospital queries: what stays on the disks, and that results are those of SQL."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortry import session
from cohortry.plans import oracle_sql, queries
from tools.check_queries import TABLES, compare, duck

T0 = datetime(1995, 1, 1)
KINDS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Six subjects with five visits each; lines, notes, pages and events for them."""
    root = str(tmp_path_factory.mktemp("tables"))
    at = lambda days: T0 + timedelta(days=days)
    tables = {
        "customer": ([(c, c % 3) for c in range(6)], "c_custkey long, c_nationkey int"),
        "part": ([(p, f"{'hot red big'.split()[p % 3]} bolt", f"Brand#{p % 25 + 1}", KINDS[p % 6], p % 50) for p in range(60)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "orders": ([(o, o % 6, "FO"[o % 2], at(o * 37 % 400), f"{o % 5}-LOW") for o in range(30)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(o, (o * 7 + n * 11) % 60, n, float(n + o % 9), "RNA"[(o + n) % 3], at(o * 37 % 400 + n * 13 - 20)) for o in range(30) for n in range(1, 8)],
                     "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"),
        "events": ([(e, at(e), e % 4, ["view", "error"][e % 2]) for e in range(20)], "event_id long, ts timestamp_ntz, user_id long, event_type string"),
        "documents": ([(d, f"Name: x\nAllergies: none {d}") for d in range(0, 30, 2)], "doc_id long, text string"),
        "pages": ([(p, f"<p>report {p}</p>") for p in range(60)], "page_id long, html string"),
    }
    for name in TABLES:
        rows, schema = tables.get(name, ([(0,)], "x int"))
        spark.createDataFrame(rows, schema).coalesce(1).toPandas().to_parquet(f"{root}/{name}.parquet", coerce_timestamps="us")
    return root


@pytest.fixture
def scratch(monkeypatch, tmp_path):
    """Scratch tables of a test go to one folder."""
    monkeypatch.setattr(session, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    return lambda: sorted(os.listdir(tmp_path))


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        name = files.next().getName()
        if name.startswith("shuffle_"):
            found.add(name)
    return found


@pytest.mark.parametrize("before", [None, "false"])
def test_landed_tables_leave_no_shuffle_files(spark, scratch, before):
    if before is not None:
        spark.conf.set(session.CLEANUP, before)
    try:
        held = shuffle_files(spark)
        out = session.landed(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
        assert not shuffle_files(spark) - held and out.count() == 7 and scratch() == ["counts"]
        assert spark.conf.get(session.CLEANUP, None) == before
        with pytest.raises(Exception, match="no"):
            session.landed(spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("x")), "broken")
        assert spark.conf.get(session.CLEANUP, None) == before
        session.discard(out)
        assert "counts" not in scratch()
    finally:
        spark.conf.unset(session.CLEANUP)


def agrees(spark, folder, name, df):
    con = duck(folder)
    cursor = con.execute(oracle_sql()[name])
    want = ([d[0] for d in cursor.description], cursor.fetchall())
    assert want[1] and compare((df.columns, [tuple(r) for r in df.collect()]), want) == ""


def test_feature_texts_are_shuffled_one_kind_at_a_time(spark, folder, scratch):
    held = shuffle_files(spark)
    df = queries()["feature_texts"](spark, folder)
    # only texts remain, and nothing is left to shuffle
    assert scratch() == ["cultures", "discharge", "emergency", "history", "labs", "radiology"]
    assert not shuffle_files(spark) - held
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    agrees(spark, folder, "feature_texts", df)


def test_training_table_keeps_three_scratch_tables(spark, folder, scratch):
    held = shuffle_files(spark)
    df = queries()["training_table"](spark, folder)
    assert scratch() == ["demographics", "embeddings", "splits"]
    assert not shuffle_files(spark) - held
    agrees(spark, folder, "training_table", df)
