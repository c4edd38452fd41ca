"""Registry of queries and the column roles the given tables play.

``visit`` = an order of a customer, ``lab`` = a line item of that order, ``person`` = a customer,
``item`` = a part, ``note`` = a document, ``chart event`` = a row of events.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.hashing import as_col

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_FAMILIES = [
    "sources", "linking", "timing", "picking", "numbers", "texts", "panels", "sampling", "vectors", "evaluation",
    "profiling", "contracts", "hospital",
]


class Tables:
    """The given parquet tables by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(self.path(name))
        return self._read[name]


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name, with its SQL where SQL can say it."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            _ORACLES[name] = sql
        return build

    return add


def _load() -> None:
    for family in _FAMILIES:
        import_module(f"cohortry.plans.{family}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def ts_text(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd HH:mm:ss")


def ts_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(as_col(c).cast("double"), digits)


def big(c: Column | str) -> Column:
    return as_col(c).cast("long")


def visits(t: Tables) -> DataFrame:
    """Orders as visits of 0 to 9 days; the outcome is order status F."""
    return t.orders.select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("visit_id"),
        F.col("o_orderdate").alias("start_ts"),
        (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 10).cast("int"))).alias("end_ts"),
        (F.col("o_orderstatus") == "F").cast("int").alias("died"),
        F.col("o_orderpriority").alias("priority"),
    )


VISITS = """visits AS (
  SELECT o_custkey AS subject_id, o_orderkey AS visit_id, o_orderdate AS start_ts,
         o_orderdate + to_days((o_orderkey % 10)::INTEGER) AS end_ts,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS died, o_orderpriority AS priority
  FROM orders)"""


def labs(t: Tables) -> DataFrame:
    """Line items as measurements of a subject; every third line has lost its visit key."""
    people = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id"))
    return t.lineitem.join(people, "l_orderkey").select(
        "subject_id",
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_orderkey")).alias("visit_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_partkey").alias("item"),
        F.col("l_quantity").alias("value"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").cast("long").alias("line"),
    )


LABS = """labs AS (
  SELECT o_custkey AS subject_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_orderkey END AS visit_id, l_shipdate AS ts,
         l_partkey AS item, l_quantity AS value, l_returnflag AS flag, l_linenumber::BIGINT AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def visit_labs(t: Tables) -> DataFrame:
    """Line items as measurements with their visit key."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("visit_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_partkey").alias("item"),
        F.col("l_quantity").alias("value"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").cast("long").alias("line"),
    )


VISIT_LABS = """visit_labs AS (
  SELECT l_orderkey AS visit_id, l_shipdate AS ts, l_partkey AS item, l_quantity AS value, l_returnflag AS flag,
         l_linenumber::BIGINT AS line
  FROM lineitem)"""

SUBJECT_SPLIT = f"""{VISITS},
people AS (SELECT subject_id, avg(died) AS rate, CASE WHEN avg(died) > 0 THEN 1 ELSE 0 END AS ever FROM visits GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ever ORDER BY md5(concat_ws('|', subject_id, '42')), subject_id) AS r,
                  count(*) OVER (PARTITION BY ever) AS n FROM people),
splits AS (SELECT subject_id, rate, ever,
                  CASE WHEN r <= round(n * 0.7) THEN 'train' WHEN r <= round(n * 0.85) THEN 'dev' ELSE 'test' END AS split
           FROM ranked)"""
