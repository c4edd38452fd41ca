"""Queries that pick one value or row per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import pick
from cohortry.plans.registry import LABS, VISIT_LABS, VISITS, Tables, big, labs, query, ts_sql, ts_text, visit_labs, visits


def _tied(df: DataFrame) -> DataFrame:
    return df.withColumn("tie", F.struct("item", "line", "value"))


def _closest_sql(side: str) -> str:
    return f"""WITH {VISITS}, {LABS},
o AS (SELECT subject_id, ts::DATE AS d, value FROM labs
      QUALIFY row_number() OVER (PARTITION BY subject_id, ts::DATE ORDER BY item, line, value) = 1)
SELECT visit_id, value FROM visits v JOIN o USING (subject_id)
QUALIFY row_number() OVER (PARTITION BY visit_id ORDER BY {side}, abs(date_diff('day', start_ts::DATE, d))) = 1"""


@query("closest_to_anchor", _closest_sql("d > start_ts::DATE"))
def _(t: Tables) -> DataFrame:
    got = pick.closest_to_anchor(visits(t), _tied(labs(t)), "subject_id", "visit_id", "start_ts", "ts", "value", "tie")
    return got.select("visit_id", "value")


@query("closest_to_anchor_after", _closest_sql("d < start_ts::DATE"))
def _(t: Tables) -> DataFrame:
    got = pick.closest_to_anchor(
        visits(t), _tied(labs(t)), "subject_id", "visit_id", "start_ts", "ts", "value", "tie", prefer="after"
    )
    return got.select("visit_id", "value")


@query(
    "closest_abs",
    f"""WITH {VISITS}, {LABS},
o AS (SELECT subject_id, flag, ts, value FROM labs
      QUALIFY row_number() OVER (PARTITION BY subject_id, flag, ts ORDER BY item, line, value) = 1)
SELECT visit_id, flag, value FROM visits JOIN o USING (subject_id)
QUALIFY row_number() OVER (PARTITION BY visit_id, flag ORDER BY abs(epoch_us(ts) - epoch_us(start_ts)), ts) = 1""",
)
def _(t: Tables) -> DataFrame:
    got = pick.closest_abs(visits(t), _tied(labs(t)), "subject_id", "visit_id", ["flag"], "start_ts", "ts", "value", "tie")
    return got.select("visit_id", "flag", "value")


@query(
    "earliest_value",
    f"""WITH {VISIT_LABS} SELECT visit_id, value FROM visit_labs
QUALIFY row_number() OVER (PARTITION BY visit_id ORDER BY ts, item, line, value) = 1""",
)
def _(t: Tables) -> DataFrame:
    return pick.earliest(_tied(visit_labs(t)), "visit_id", "value", "ts", "tie")


@query(
    "priority_pick",
    f"""WITH {VISIT_LABS} SELECT visit_id, value FROM visit_labs WHERE flag IN ('R', 'A')
QUALIFY row_number() OVER (PARTITION BY visit_id ORDER BY CASE flag WHEN 'R' THEN 0 ELSE 1 END, ts, item, line, value) = 1""",
)
def _(t: Tables) -> DataFrame:
    rank = F.when(F.col("flag") == "R", 0).when(F.col("flag") == "A", 1)
    return pick.by_priority_then_time(_tied(visit_labs(t)), "visit_id", "value", rank, "ts", "tie")


@query(
    "latest_value",
    f"""WITH {VISIT_LABS}, u AS (SELECT *, CASE WHEN flag <> 'R' THEN ts END AS t FROM visit_labs)
SELECT visit_id, value FROM u
QUALIFY row_number() OVER (PARTITION BY visit_id ORDER BY t IS NULL DESC, t DESC, item DESC, line DESC, value DESC) = 1""",
)
def _(t: Tables) -> DataFrame:
    undated = visit_labs(t).withColumn("ts", F.when(F.col("flag") != "R", F.col("ts")))
    return pick.latest(_tied(undated), "visit_id", "value", "ts", "tie")


@query(
    "latest_row",
    f"""WITH {VISITS} SELECT subject_id, visit_id, {ts_sql('start_ts')} AS start_ts, priority FROM visits
QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY start_ts DESC, visit_id DESC) = 1""",
)
def _(t: Tables) -> DataFrame:
    rows = visits(t).select("subject_id", "visit_id", "start_ts", "priority")
    return pick.latest_row(rows, "subject_id", "start_ts", "visit_id").withColumn("start_ts", ts_text("start_ts"))


@query(
    "dedup_first",
    f"""WITH {VISIT_LABS} SELECT visit_id, line, {ts_sql('ts')} AS ts, item, value FROM visit_labs
QUALIFY row_number() OVER (PARTITION BY visit_id, line ORDER BY visit_labs.ts, item, value) = 1""",
)
def _(t: Tables) -> DataFrame:
    rows = visit_labs(t).select("visit_id", "line", "ts", "item", "value")
    return pick.dedup(rows, ["visit_id", "line"], ["ts", "item", "value"]).withColumn("ts", ts_text("ts"))


@query(
    "sample_per_key",
    f"""WITH {VISIT_LABS} SELECT item, visit_id, line, {ts_sql('ts')} AS ts, value FROM visit_labs
QUALIFY row_number() OVER (PARTITION BY item ORDER BY visit_labs.ts, visit_id, line, value) = 1""",
)
def _(t: Tables) -> DataFrame:
    rows = visit_labs(t).select("item", "visit_id", "line", "ts", "value")
    return pick.sample_per_key(rows, "item", ["ts", "visit_id", "line", "value"]).withColumn("ts", ts_text("ts"))


@query("distinct_catalogue", "SELECT DISTINCT p_brand, p_type, p_size::BIGINT AS size FROM part")
def _(t: Tables) -> DataFrame:
    return pick.distinct_catalogue(t.part.select("p_brand", "p_type", big("p_size").alias("size")), ["p_brand", "p_type", "size"])


@query(
    "first_value_text",
    f"""WITH {VISITS}, f AS (SELECT subject_id, priority AS complaint FROM visits WHERE died = 1
      QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY start_ts, visit_id) = 1)
SELECT c_custkey AS subject_id, coalesce(complaint, '') AS complaint FROM customer LEFT JOIN f ON c_custkey = subject_id""",
)
def _(t: Tables) -> DataFrame:
    told = visits(t).withColumn("complaint", F.when(F.col("died") == 1, F.col("priority")))
    cohort = t.customer.select(F.col("c_custkey").alias("subject_id"))
    return pick.first_value_text(cohort, told, "subject_id", "complaint", ["start_ts", "visit_id"])


_UNDATED = "SELECT *, CASE WHEN flag <> 'R' THEN ts END AS t FROM visit_labs"


def _undated(t: Tables) -> DataFrame:
    """Measurements of which those flagged R have lost their time."""
    return visit_labs(t).withColumn("ts", F.when(F.col("flag") != "R", F.col("ts")))


@query(
    "earliest_undated",
    f"""WITH {VISIT_LABS}, u AS ({_UNDATED}) SELECT visit_id, value FROM u
QUALIFY row_number() OVER (PARTITION BY visit_id ORDER BY t NULLS LAST, item, line, value) = 1""",
)
def _(t: Tables) -> DataFrame:
    return pick.earliest(_tied(_undated(t)), "visit_id", "value", "ts", "tie")


@query(
    "priority_pick_undated",
    f"""WITH {VISIT_LABS}, u AS ({_UNDATED}) SELECT visit_id, value FROM u
QUALIFY row_number() OVER (PARTITION BY visit_id ORDER BY line % 2, t NULLS LAST, item, line, value) = 1""",
)
def _(t: Tables) -> DataFrame:
    return pick.by_priority_then_time(_tied(_undated(t)), "visit_id", "value", F.col("line") % 2, "ts", "tie")


@query(
    "dedup_undated",
    f"""WITH {VISIT_LABS}, u AS ({_UNDATED}) SELECT visit_id, {ts_sql('t')} AS ts, item, line, value FROM u
QUALIFY row_number() OVER (PARTITION BY visit_id ORDER BY t NULLS LAST, item, line, value) = 1""",
)
def _(t: Tables) -> DataFrame:
    rows = _undated(t).select("visit_id", "ts", "item", "line", "value")
    return pick.dedup(rows, "visit_id", ["ts", "item", "line", "value"]).withColumn("ts", ts_text("ts"))


@query(
    "first_value_undated",
    f"""WITH {VISIT_LABS}, u AS ({_UNDATED}), f AS (SELECT visit_id, flag FROM u
      QUALIFY row_number() OVER (PARTITION BY visit_id ORDER BY t NULLS LAST, item, line, value) = 1)
SELECT o_orderkey AS visit_id, coalesce(flag, '') AS flag FROM orders LEFT JOIN f ON o_orderkey = visit_id""",
)
def _(t: Tables) -> DataFrame:
    cohort = t.orders.select(F.col("o_orderkey").alias("visit_id"))
    return pick.first_value_text(cohort, _undated(t), "visit_id", "flag", ["ts", "item", "line", "value"])
