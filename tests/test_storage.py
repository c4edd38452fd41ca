"""Snapshots, the registry of sources, and CSV with line breaks in cells."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators import contracts
from cohortry.sources import quoted, snapshots
from cohortry.sources import tables as src


def values(df):
    return sorted(r[0] for r in df.collect())


def test_snapshots_replace_a_table_as_a_whole(spark, tmp_path):
    path = f"{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path)
    snapshots.write_snapshot(spark.range(3), path)
    reader = snapshots.read_snapshot(spark, path)
    # a writer that fails midway: some of its tasks have written their files
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        snapshots.write_snapshot(broken, path)
    assert values(snapshots.read_snapshot(spark, path)) == [0, 1, 2]
    # a table may be made from itself, and an open reader stays on its version
    snapshots.write_snapshot(snapshots.read_snapshot(spark, path).select((F.col("id") + 10).alias("id")), path)
    assert values(snapshots.read_snapshot(spark, path)) == [10, 11, 12] and values(reader) == [0, 1, 2]


def test_a_pointer_that_is_not_whole_does_not_count(spark, tmp_path):
    path = f"{tmp_path}/table"
    version = snapshots.write_snapshot(spark.range(2), path)
    (tmp_path / "table" / "pointers" / "000000000007").write_text(version[:9])
    assert values(snapshots.read_snapshot(spark, path)) == [0, 1]
    snapshots.write_snapshot(spark.range(1), path)
    assert values(snapshots.read_snapshot(spark, path)) == [0]


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/table"
    snapshots.write_snapshot(spark.range(1), path)
    # both have seen the same pointers
    monkeypatch.setattr(snapshots, "_names", lambda *a: [])
    assert [snapshots.publish(spark, path, v) for v in ("b", "c")] == [2, 3]
    monkeypatch.undo()
    assert snapshots.current_version(spark, path) == "c"


def test_old_versions_are_removed_later(spark, tmp_path):
    path = f"{tmp_path}/table"
    names = [snapshots.write_snapshot(spark.range(n), path) for n in range(1, 5)]
    assert snapshots.collect_versions(spark, path) == []
    assert snapshots.collect_versions(spark, path, keep=2, spare_seconds=-5) == names[:2]
    assert values(snapshots.read_snapshot(spark, path)) == [0, 1, 2, 3]
    assert snapshots.collect_versions(spark, path, keep=2, spare_seconds=-5) == []


def test_fingerprints(spark):
    rows = [(1, "a", None, [1.5], b"\x00"), (2, "", "b", None, None), (2, None, "b", [], b""), (1, "a", None, [1.5], b"\x00")]
    make = lambda rows: spark.createDataFrame(rows, "i int, s string, t string, x array<double>, b binary")
    mark = lambda df: contracts.fingerprints(df).first()["fingerprint"]
    whole = mark(make(rows))
    assert mark(make(rows[::-1]).repartition(3)) == whole
    assert len({whole, mark(make(rows[:3])), mark(make([*rows, rows[0], rows[0]])), mark(make([*rows[:2], (2, "b", None, [], b""), rows[3]])), mark(make(rows).withColumnRenamed("i", "j"))}) == 5
    # two pairs of equal rows cancel out in an exclusive or, not in the sum
    assert mark(make([rows[0]] * 2 + [rows[1]] * 2)) != mark(make([rows[2]] * 2 + [rows[1]] * 2))


def test_a_file_is_hashed_by_several_tasks(spark, tmp_path):
    spark.range(200_000).coalesce(1).write.option("parquet.block.size", 100_000).parquet(f"{tmp_path}/t.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        assert spark.read.parquet(f"{tmp_path}/t.parquet").rdd.getNumPartitions() > 3
        found = contracts.source_manifest(spark, f"{tmp_path}/t.parquet").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = contracts.fingerprints(spark.range(200_000)).first()
    assert [(r["rows"], r["fingerprint"]) for r in found] == [(200_000, whole["fingerprint"])]


def test_registry(spark, tmp_path):
    source, registry, output = tmp_path / "in", f"{tmp_path}/registry", tmp_path / "out"
    source.mkdir()
    (source / "a.csv").write_text("x\n1\n"), (source / "empty.csv").write_text("")
    now = lambda: contracts.source_manifest(spark, str(source))
    ask = lambda **more: contracts.unchanged(registry, "step", now(), [str(output)], **more)
    assert {r["file"].rsplit("/", 1)[1]: r["rows"] for r in now().collect()} == {"a.csv": 2, "empty.csv": 0}
    output.write_text("done")
    assert not ask()  # never recorded
    contracts.record(registry, "other", now())
    contracts.record(registry, "step", now())
    assert ask() and not ask(force=True)
    output.unlink()
    assert not ask()  # the output is missing
    output.write_text("done")
    (source / "a.csv").write_text("x\n2\n")
    assert not ask() and {r["state"] for r in contracts.changed(now(), contracts.registered(spark, registry, "step")).collect()} == {"changed"}
    contracts.record(registry, "step", now())
    assert ask()
    (source / "b.csv").write_text("x\n")
    assert not ask()
    (source / "b.csv").unlink(), (source / "a.csv").unlink()
    assert not ask()
    assert contracts.registered(spark, registry).groupBy("step").count().count() == 2


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("more", T.StringType())])


@pytest.mark.parametrize("split", ["200", "3k", "64m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_like_one_reader(spark, tmp_path, split, end):
    rng = random.Random(3)
    folder = tmp_path / "csv"
    folder.mkdir()
    for part in range(2):
        with open(folder / f"{part}.csv", "w", newline="") as file:
            writer = csv.writer(file, lineterminator=end)
            writer.writerow(["id", "text", "more"])
            for i in range(300):
                cell = "".join(rng.choice(["word ", "\n", '"', ",", '""', "é", "\n\n", "x" * 40]) for _ in range(rng.randrange(25)))
                writer.writerow([i, cell if rng.random() < 0.9 else "", rng.choice(["plain", "a,b", '"', "\n"])])
            writer.writerow([999, "long\n" * 3000, "end"])
    one = spark.read.schema(SCHEMA).option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(folder))
    want = sorted((tuple(r) for r in one.collect()), key=str)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = quoted.read_quoted_csv(spark, str(folder), SCHEMA)
        assert sorted((tuple(r) for r in df.collect()), key=str) == want
        if split == "3k":
            assert df.rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_notes_are_read_in_ranges(spark, tmp_path):
    with open(tmp_path / "discharge.csv", "w", newline="") as file:
        writer = csv.writer(file, lineterminator="\n")
        writer.writerow(["note_id", "subject_id", "hadm_id", "charttime", "text"])
        writer.writerows([f"n{i}", i, "", "2020-01-01 00:00:00", f"line one\n\nline \"two\" of {i}"] for i in range(3000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        df = src.read_table(spark, "discharge", str(tmp_path), src.SCHEMAS["discharge"], ["subject_id", "hadm_id", "text"])
        assert df.rdd.getNumPartitions() > 5
        rows = {r["subject_id"]: (r["hadm_id"], r["text"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {i: (None, f'line one\n\nline "two" of {i}') for i in range(3000)}


def test_quoted_csv_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text,more\n")
    (tmp_path / "b.csv").write_text("")
    assert quoted.read_quoted_csv(spark, str(tmp_path / "a.csv"), SCHEMA).count() == 0
    assert quoted.read_quoted_csv(spark, str(tmp_path / "b.csv"), SCHEMA).count() == 0
