"""Queries of record linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import linkage
from cohortry.plans.registry import LABS, VISITS, Tables, big, labs, query, ts_sql, ts_text, visits

_OUT = f"subject_id, visit_id, {ts_sql('ts')} AS ts, item, line"


def _out(df: DataFrame) -> DataFrame:
    return df.select("subject_id", "visit_id", ts_text("ts").alias("ts"), "item", "line")


@query(
    "drop_null_key",
    f"WITH {LABS} SELECT count(*)::BIGINT AS rows, count(DISTINCT visit_id)::BIGINT AS visits FROM labs WHERE visit_id IS NOT NULL",
)
def _(t: Tables) -> DataFrame:
    kept = linkage.drop_null_key(labs(t), "visit_id")
    per_visit = kept.groupBy("visit_id").agg(F.count(F.lit(1)).alias("n"))
    return per_visit.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("visits"))


@query(
    "null_key_counts",
    f"""WITH {LABS} SELECT count(*)::BIGINT AS total, count(*) FILTER (visit_id IS NULL)::BIGINT AS total_null,
        count(visit_id)::BIGINT AS kept FROM labs""",
)
def _(t: Tables) -> DataFrame:
    return linkage.null_key_counts(labs(t), "visit_id")


_MATCH = """hits AS (
  SELECT p.subject_id, p.ts, v.visit_id, v.start_ts,
         row_number() OVER (PARTITION BY p.subject_id, p.ts
                            ORDER BY abs(epoch_us(v.start_ts) - epoch_us(p.ts)), v.start_ts, v.visit_id) AS r,
         count(*) OVER (PARTITION BY p.subject_id, p.ts) AS matches
  FROM points p JOIN visits v ON v.subject_id = p.subject_id AND {cond}),
found AS (SELECT * FROM hits WHERE r = 1)"""
_POINTS = "points AS (SELECT DISTINCT subject_id, ts FROM labs WHERE visit_id IS NULL AND ts IS NOT NULL)"
_FILLED = f"""SELECT {_OUT} FROM (
  SELECT subject_id, visit_id, ts, item, line FROM labs WHERE visit_id IS NOT NULL
  UNION ALL
  SELECT l.subject_id, f.visit_id, l.ts, l.item, l.line FROM labs l
  JOIN found f ON f.subject_id = l.subject_id AND f.ts = l.ts WHERE l.visit_id IS NULL)"""
_CLOSED = "p.ts >= v.start_ts - INTERVAL 48 HOUR AND p.ts <= v.end_ts + INTERVAL 48 HOUR"
_OPEN = "p.ts >= v.start_ts - INTERVAL 48 HOUR"
_ASOF = "v.start_ts >= p.ts AND v.start_ts <= p.ts + INTERVAL 1440 HOUR"
_NEXT = "v.start_ts >= p.ts"


def _sql(cond: str) -> str:
    return f"WITH {VISITS}, {LABS}, {_POINTS}, {_MATCH.format(cond=cond)} {_FILLED}"


@query("link_window", _sql(_CLOSED))
def _(t: Tables) -> DataFrame:
    return _out(linkage.link_by_window(labs(t), visits(t), "subject_id", "visit_id", "ts", "start_ts", "end_ts", 48))


@query("link_window_open", _sql(_OPEN))
def _(t: Tables) -> DataFrame:
    return _out(linkage.link_by_window(labs(t), visits(t), "subject_id", "visit_id", "ts", "start_ts", None, 48))


@query("link_asof_forward", _sql(_ASOF))
def _(t: Tables) -> DataFrame:
    return _out(linkage.link_asof_forward(labs(t), visits(t), "subject_id", "visit_id", "ts", "start_ts", 1440))


@query("link_next_after", _sql(_NEXT))
def _(t: Tables) -> DataFrame:
    return _out(linkage.link_next_after(labs(t), visits(t), "subject_id", "visit_id", "ts", "start_ts"))


def _stats_sql(cond: str) -> str:
    return f"""WITH {VISITS}, {LABS}, {_POINTS}, {_MATCH.format(cond=cond)},
m AS (SELECT l.visit_id IS NULL AS is_null, f.matches FROM labs l
      LEFT JOIN found f ON l.visit_id IS NULL AND f.subject_id = l.subject_id AND f.ts = l.ts)
SELECT count(*)::BIGINT AS total, count(*) FILTER (is_null)::BIGINT AS total_null,
       count(*) FILTER (is_null AND matches >= 1)::BIGINT AS linked,
       count(*) FILTER (is_null AND matches > 1)::BIGINT AS ambiguous_resolved,
       count(*) FILTER (is_null AND matches IS NULL)::BIGINT AS unresolvable FROM m"""


@query("linkage_stats", _stats_sql(_CLOSED))
def _(t: Tables) -> DataFrame:
    return linkage.linkage_stats(labs(t), visits(t), "subject_id", "visit_id", "ts", "start_ts", "end_ts", 48)


@query("linkage_stats_open", _stats_sql(_OPEN))
def _(t: Tables) -> DataFrame:
    return linkage.linkage_stats(labs(t), visits(t), "subject_id", "visit_id", "ts", "start_ts", None, 48)


@query(
    "linkage_report",
    f"""SELECT 'labs' AS module, 'window' AS table, *, 0::BIGINT AS dropped FROM ({_stats_sql(_CLOSED)})
UNION ALL SELECT 'labs', 'drop', count(*), count(*) FILTER (visit_id IS NULL), 0, 0, 0, count(*) FILTER (visit_id IS NULL)
FROM (WITH {VISITS}, {LABS} SELECT visit_id FROM labs)""",
)
def _(t: Tables) -> DataFrame:
    """Counters of two strategies on one table."""
    window = linkage.linkage_stats(labs(t), visits(t), "subject_id", "visit_id", "ts", "start_ts", "end_ts", 48)
    return linkage.stats_report({("labs", "window"): window, ("labs", "drop"): linkage.drop_stats(labs(t), "visit_id")})


@query(
    "link_via_bridge",
    f"""SELECT l_orderkey AS stay_id, l_linenumber::BIGINT AS line, l_partkey AS item,
        coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_custkey END, l_suppkey) AS visit_id,
        {ts_sql('o_orderdate')} AS intime FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""",
)
def _(t: Tables) -> DataFrame:
    stays = t.lineitem.select(
        F.col("l_orderkey").alias("stay_id"), big("l_linenumber").alias("line"), F.col("l_partkey").alias("item"),
        F.col("l_suppkey").alias("visit_id"),
    )
    bridge = t.orders.select(
        F.col("o_orderkey").alias("stay_id"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("visit_id"),
        ts_text("o_orderdate").alias("intime"),
    )
    return linkage.link_via_bridge(stays, bridge, "stay_id", "visit_id")
