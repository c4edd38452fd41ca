"""Data contracts, output audits, source manifests and the registry of what steps have read."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.hashing import hex_number
from cohortry.sources.snapshots import current_version, read_snapshot, write_snapshot
from cohortry.sources.tables import path_exists

REPORT = "check string, status string, detail string"


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that names what is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df


def _kind(t: T.DataType) -> str:
    return t.simpleString()


def check_contract(
    df: DataFrame,
    columns: Sequence[str],
    types: Mapping[str, Sequence[str]] | None = None,
    not_null: Sequence[str] = (),
    dims: Mapping[str, int] | None = None,
) -> DataFrame:
    """Report of PASS / FAIL / SKIP rows: column order, types, NULLs, vector lengths.

    The schema is compared on the driver, all data checks share one aggregate.
    """
    types, dims = dict(types or {}), dict(dims or {})
    have = df.columns
    rows: list[tuple[str, str, str]] = []
    rows.append(("columns in order", "PASS" if list(columns) == have else "FAIL", f"{len(have)} of {len(columns)}"))
    for c, allowed in types.items():
        kind = _kind(df.schema[c].dataType) if c in have else None
        status = "SKIP" if kind is None else ("PASS" if kind in allowed else "FAIL")
        rows.append((f"type of {c}", status, kind or "absent"))
    static = df.sparkSession.createDataFrame(rows, REPORT)
    counted = [(f"nulls in {c}", F.count_if(F.col(c).isNull())) for c in not_null if c in have]
    counted += [
        (f"length of {c}", F.count_if(F.coalesce(F.size(c) != n, F.lit(True)))) for c, n in dims.items() if c in have
    ]
    absent = [(f"nulls in {c}", "SKIP", "absent") for c in not_null if c not in have]
    absent += [(f"length of {c}", "SKIP", "absent") for c in dims if c not in have]
    if absent:
        static = static.unionByName(df.sparkSession.createDataFrame(absent, REPORT))
    if not counted:
        return static
    one = df.agg(*[expr.alias(f"c{i}") for i, (_, expr) in enumerate(counted)])
    parts = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("bad")) for i, (name, _) in enumerate(counted)])
    data = one.select(F.explode(parts).alias("p")).select(
        "p.check", F.when(F.col("p.bad") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.concat(F.col("p.bad").cast("string"), F.lit(" bad rows")).alias("detail"),
    )
    return static.unionByName(data)


def check_labels(df: DataFrame, y1: str, y2: str, split: str, splits: Sequence[str] = ("train", "dev", "test")) -> DataFrame:
    """Report: y2 NULL for every positive y1, present for every other row, and only known splits."""
    checks = [
        ("y2 empty where y1 = 1", F.count_if((F.col(y1) == 1) & F.col(y2).isNotNull())),
        ("y2 present where y1 = 0", F.count_if((F.col(y1) == 0) & F.col(y2).isNull())),
        ("known splits only", F.count_if(~F.coalesce(F.col(split).isin(list(splits)), F.lit(False)))),
    ]
    one = df.agg(*[expr.alias(f"c{i}") for i, (_, expr) in enumerate(checks)])
    parts = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("bad")) for i, (n, _) in enumerate(checks)])
    return one.select(F.explode(parts).alias("p")).select(
        "p.check", F.when(F.col("p.bad") == 0, "PASS").otherwise("FAIL").alias("status"),
        F.concat(F.col("p.bad").cast("string"), F.lit(" bad rows")).alias("detail"),
    )


def audit_outputs(outputs: Mapping[str, DataFrame | None], cohort: DataFrame, key: str, column: str) -> DataFrame:
    """Per expected output: ``complete``, ``partial`` (rows or values lacking) or ``missing``.

    An output is given as a frame, or None where it does not exist.
    """
    spark = cohort.sparkSession
    want = cohort.select(key).distinct().agg(F.count(F.lit(1)).alias("expected"))
    report = None
    for name, df in outputs.items():
        if df is None or column not in df.columns:
            row = spark.createDataFrame([(name, 0, 0)], "output string, rows long, nulls long")
        else:
            row = df.agg(
                F.lit(name).alias("output"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column).isNull()).alias("nulls")
            ).select("output", "rows", "nulls")
        report = row if report is None else report.unionByName(row)
    full = report.join(F.broadcast(want), F.lit(True))
    complete = (F.col("rows") == F.col("expected")) & (F.col("nulls") == 0)
    status = F.when(F.col("rows") == 0, "missing").when(complete, "complete").otherwise("partial")
    return full.select("output", "rows", "nulls", "expected", status.alias("status"))


#: Formats by the end of a name; others are read as lines of text.
FORMATS = {".parquet": "parquet", ".orc": "orc"}


def row_digest(df: DataFrame) -> Column:
    """md5 of a row: each column as text with its length in front, so that NULL, empty text and shifted columns differ."""
    def part(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        text = F.hex(c) if isinstance(f.dataType, T.BinaryType) else c.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat(*[part(f) for f in df.schema.fields])) if df.columns else F.md5(F.lit(""))


def fingerprints(df: DataFrame, by: Column | None = None) -> DataFrame:
    """``file, rows, fingerprint`` of the rows in each group (of all rows without one), whatever their order.

    A multiset hash: the sum of one half of each row's digest, the exclusive or of the other, and the number of rows are combined
    before the shuffle, so that a file of any size is hashed by all tasks that read a part of it.  Copies of a row count.
    """
    names = F.lit(",".join(df.columns))
    hashed = df.select((F.lit("") if by is None else by).alias("file"), row_digest(df).alias("__d"))
    halves = hashed.select("file", hex_number(F.col("__d"), 1, 15).alias("a"), hex_number(F.col("__d"), 16, 15).alias("b"))
    found = halves.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.bit_xor("b").alias("b"))
    return found.select("file", "rows", F.md5(F.concat_ws("|", names, F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))).alias("fingerprint"))


def _entries(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(target).isFile() or any(path.rstrip("/").endswith(end) for end in FORMATS):
        return [path]
    names = sorted(s.getPath().getName() for s in fs.listStatus(target))
    return [f"{path.rstrip('/')}/{n}" for n in names if not n.startswith((".", "_"))]


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Address and length of each file under a path, also of empty ones, which scans leave out; nothing is read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = target.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(target, True), []
    while found.hasNext():
        status = found.next()
        if not status.getPath().getName().startswith((".", "_")):
            out.append((re.sub("^file:/+", "file:///", status.getPath().toUri().toString()), status.getLen()))
    return out


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per source file under ``path`` (a file, a table's folder, or a folder of those): ``file, length, rows, fingerprint``.

    Tables are read as such, other files as lines of text; a fingerprint depends on the rows only, not on their order or on how the
    file was written.  A file without rows has the fingerprint of an empty one.
    """
    files = spark.createDataFrame(_listed(spark, path), "file string, length long")
    parts = []
    for entry in _entries(spark, path):
        kind = next((k for end, k in FORMATS.items() if entry.endswith(end)), "text")
        df = spark.read.format(kind).option("recursiveFileLookup", "true").load(entry)
        parts.append(fingerprints(df, F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///")))
    if not parts:
        return spark.createDataFrame([], "file string, length long, rows long, fingerprint string")
    found = reduce(DataFrame.unionByName, parts)
    return files.join(found, "file", "left").select("file", "length", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("fingerprint", F.md5(F.lit(""))).alias("fingerprint"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new, gone or different."""
    old = before.select("file", F.col("fingerprint").alias("__old"))
    both = now.select("file", "fingerprint").join(old, "file", "full_outer")
    state = (
        F.when(F.col("__old").isNull(), "new")
        .when(F.col("fingerprint").isNull(), "gone")
        .when(F.col("fingerprint") != F.col("__old"), "changed")
    )
    return both.select("file", state.alias("state")).where(F.col("state").isNotNull())


REGISTRY = "step string, file string, rows long, fingerprint string"


def registered(spark: SparkSession, registry: str, step: str | None = None) -> DataFrame:
    """What the registry at ``registry`` holds (of one step): ``step, file, rows, fingerprint``; empty where nothing was recorded."""
    held = spark.createDataFrame([], REGISTRY) if current_version(spark, registry) is None else read_snapshot(spark, registry)
    return held if step is None else held.where(F.col("step") == step)


def record(registry: str, step: str, manifest: DataFrame) -> None:
    """Store the sources of a step after it ran; other steps stay.  The registry is replaced as a whole, so readers see the old or the new one."""
    spark = manifest.sparkSession
    others = registered(spark, registry).where(F.col("step") != step)
    write_snapshot(others.unionByName(manifest.select(F.lit(step).alias("step"), "file", "rows", "fingerprint")), registry)


def unchanged(registry: str, step: str, manifest: DataFrame, outputs: Sequence[str] = (), force: bool = False) -> bool:
    """Whether a step may be skipped: all its outputs exist, and its sources are those that were recorded, none new, gone or different.

    False with ``force``, and for a step that was never recorded.
    """
    spark = manifest.sparkSession
    if force or not all(path_exists(spark, p) for p in outputs):
        return False
    before = registered(spark, registry, step)
    return not before.isEmpty() and changed(manifest, before).isEmpty()
