"""Typed scans and sinks.  Every schema is declared; nothing is inferred from the data."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators.ranks import Order, top_n
from cohortry.sources.quoted import read_quoted_csv

# The columns each clinical source table is read with.
SCHEMAS: dict[str, str] = {
    "admissions": "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz, admission_type string, hospital_expire_flag int",
    "patients": "subject_id bigint, gender string, anchor_age int, anchor_year int",
    "omr": "subject_id bigint, chartdate date, seq_num int, result_name string, result_value string",
    "chartevents": "subject_id bigint, hadm_id bigint, itemid bigint, charttime timestamp_ntz, value string, valuenum double",
    "labevents": "labevent_id bigint, subject_id bigint, hadm_id bigint, itemid bigint, charttime timestamp_ntz, value string, valuenum double, valueuom string, ref_range_lower double, ref_range_upper double, flag string, priority string",
    "d_labitems": "itemid bigint, label string, fluid string, category string",
    "microbiologyevents": "microevent_id bigint, subject_id bigint, hadm_id bigint, charttime timestamp_ntz, spec_type_desc string, test_name string, org_name string, ab_name string, interpretation string, comments string",
    "diagnoses_icd": "subject_id bigint, hadm_id bigint, seq_num int, icd_code string, icd_version int",
    "d_icd_diagnoses": "icd_code string, icd_version int, long_title string",
    "discharge": "note_id string, subject_id bigint, hadm_id bigint, charttime timestamp_ntz, text string",
    "radiology": "note_id string, subject_id bigint, hadm_id bigint, charttime timestamp_ntz, text string",
    "triage": "subject_id bigint, stay_id bigint, temperature string, heartrate string, resprate string, o2sat string, sbp string, dbp string, pain string, acuity int, chiefcomplaint string",
    "edstays": "subject_id bigint, hadm_id bigint, stay_id bigint, intime timestamp_ntz, outtime timestamp_ntz",
}


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system Spark reads it from."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def find_source(spark: SparkSession, name: str, roots: Sequence[str]) -> str | None:
    """First of ``<root>/<name>.csv.gz`` and ``<root>/<name>.csv`` over the roots in order."""
    for root in roots:
        for suffix in (".csv.gz", ".csv"):
            path = os.path.join(root, name + suffix)
            if path_exists(spark, path):
                return path
    return None


#: Tables whose texts hold line breaks.
NOTE_TABLES = ("discharge", "radiology")


def read_table(
    spark: SparkSession,
    name: str,
    roots: str | Sequence[str],
    schema: str | T.StructType,
    cols: Sequence[str] | None = None,
    optional: bool = False,
    multi_line: bool | None = None,
) -> DataFrame:
    """Typed scan of a CSV table; columns are matched by header name.

    With ``multi_line`` quoted cells may span lines; by default that holds for tables of notes only.  Such files are
    read in byte ranges, too (``read_quoted_csv``).

    A ``.gz`` file is one split: land big ones once as parquet.  An optional table that does not exist
    gives an empty typed frame.
    """
    wanted = _schema(schema)
    path = find_source(spark, name, [roots] if isinstance(roots, str) else list(roots))
    if path is None:
        if optional:
            return empty_table(spark, wanted).select(*(cols or wanted.fieldNames()))
        raise FileNotFoundError(f"no {name}.csv.gz or {name}.csv under {roots}")
    spans = str(name in NOTE_TABLES if multi_line is None else multi_line).lower()
    header = spark.read.option("header", "true").option("multiLine", spans).option("escape", '"').csv(path).columns
    types = {f.name: f.dataType for f in wanted.fields}
    on_file = T.StructType([T.StructField(h, types.get(h, T.StringType()), True) for h in header])
    lacking = [n for n in (cols or wanted.fieldNames()) if n not in header]
    if lacking:
        raise ValueError(f"{path} lacks the columns {lacking}")
    if spans == "true" and not path.endswith(".gz"):
        return read_quoted_csv(spark, path, on_file).select(*(cols or wanted.fieldNames()))
    scan = spark.read.schema(on_file).option("header", "true").option("multiLine", spans).option("escape", '"')
    return scan.csv(path).select(*(cols or wanted.fieldNames()))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with few splits (a ``.gz`` file, one large row group) over all cores.

    Meant for a scan that CPU-heavy expressions follow.  A scan with enough splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_events(df: DataFrame, item: str, ids: Iterable) -> DataFrame:
    """Event rows of the wanted items: on parquet the filter reaches the scan."""
    return df.where(F.col(item).isin(list(ids)))


def empty_table(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], _schema(schema))


def read_columns(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Parquet scan of some columns."""
    return spark.read.parquet(path).select(*cols)


def vector_column(spark: SparkSession, path: str, suffix: str = "embedding") -> str:
    """Name of the one array column whose name ends with the suffix (schema only, no data read)."""
    schema = spark.read.parquet(path).schema
    names = [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType) and f.name.endswith(suffix)]
    if len(names) != 1:
        raise ValueError(f"{path} has {len(names)} array columns ending in {suffix!r}")
    return names[0]


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet for a folder that nobody reads yet: overwriting removes the old table first.  ``write_snapshot`` replaces a table that is in use."""
    df.write.mode(mode).parquet(path)
    return path


def write_by(df: DataFrame, path: str, part: str, mode: str = "overwrite") -> str:
    """One folder per value.  Rebalancing splits a value that holds most rows over several writers."""
    df.hint("rebalance", part).write.mode(mode).partitionBy(part).parquet(path)
    return path


def write_text(df: DataFrame, path: str, fmt: str, mode: str = "overwrite") -> str:
    """CSV (with header) or JSON lines."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"format must be csv or json, got {fmt!r}")
    writer = df.write.mode(mode)
    (writer.option("header", "true").option("escape", '"') if fmt == "csv" else writer).format(fmt).save(path)
    return path


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(_schema(schema)).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV with a header; ``multi_line`` where quoted cells span lines."""
    if multi_line:
        return read_quoted_csv(spark, path, _schema(schema))
    scan = spark.read.schema(_schema(schema)).option("header", "true")
    return scan.option("escape", '"').csv(path)


def read_sql(
    spark: SparkSession, query: str, url: str | None = None, partition: Mapping[str, str] | None = None, **options: str
) -> DataFrame:
    """A query over session views, or over a JDBC source (``partition`` gives the split column and bounds)."""
    if url is None:
        return spark.sql(query)
    reader = spark.read.format("jdbc").option("url", url)
    if partition:
        reader = reader.option("dbtable", f"({query}) AS q").options(**partition)
    else:
        reader = reader.option("query", query)
    return reader.options(**options).load()


def head_sample(df: DataFrame, n: int, order: Order | Sequence[Order]) -> DataFrame:
    """First n rows in a declared order (names, or ``(name, "desc")``); any n, no task holds them all."""
    return top_n(df, n, order)


def cap_rows(df: DataFrame, n: int, order: Order | Sequence[Order]) -> DataFrame:
    """At most n rows, first in order (the row-cap option of a source)."""
    return head_sample(df, n, order)


def lookup_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Small table from configuration."""
    return spark.createDataFrame(list(rows), _schema(schema))


def panel_table(spark: SparkSession, config: Mapping[str, Sequence[Sequence[str]]]) -> DataFrame:
    """Panel configuration ``{panel: [(test, specimen), ...]}`` as a lookup table, names trimmed."""
    rows = sorted({(t.strip(), s.strip(), p) for p, pairs in config.items() for t, s in pairs})
    return lookup_table(spark, rows, "test_name string, spec_type_desc string, panel string")
