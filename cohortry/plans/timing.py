"""Queries of anchor-relative windows and temporal joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.times import elapsed_hhmm, length_of_stay
from cohortry.operators import windows
from cohortry.plans.registry import (
    VISIT_LABS, VISITS, Tables, query, rnd, ts_sql, ts_text, visit_labs, visits,
)

_ROWS = f"visit_id, {ts_sql('ts')} AS ts, item, line"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("visit_id", ts_text("ts").alias("ts"), "item", "line")


@query(
    "anchor_window",
    f"""WITH {VISITS}, {VISIT_LABS} SELECT {_ROWS} FROM visit_labs JOIN visits USING (visit_id)
        WHERE ts BETWEEN start_ts - INTERVAL 240 HOUR AND start_ts + INTERVAL 4800 HOUR""",
)
def _(t: Tables) -> DataFrame:
    return _rows(windows.anchor_window(visit_labs(t), visits(t), ["visit_id"], "ts", "start_ts", 4800, lookback_hours=240))


@query(
    "anchor_window_full",
    f"""WITH {VISITS}, {VISIT_LABS} SELECT {_ROWS} FROM visit_labs JOIN visits USING (visit_id)
        WHERE ts BETWEEN start_ts - INTERVAL 2400 HOUR AND end_ts""",
)
def _(t: Tables) -> DataFrame:
    return _rows(
        windows.anchor_window(visit_labs(t), visits(t), ["visit_id"], "ts", "start_ts", "full", "end_ts", lookback_hours=2400)
    )


@query(
    "within_stay",
    f"""WITH {VISITS}, l AS (SELECT l_orderkey AS visit_id, CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS ts,
             l_partkey AS item, l_linenumber::BIGINT AS line FROM lineitem)
        SELECT visit_id, {ts_sql('ts')} AS ts, item, line FROM l JOIN visits USING (visit_id)
        WHERE ts IS NULL OR ts BETWEEN start_ts AND end_ts""",
)
def _(t: Tables) -> DataFrame:
    undated = visit_labs(t).withColumn("ts", F.when(F.col("flag") != "R", F.col("ts")))
    return _rows(windows.within_stay(undated, visits(t), ["visit_id"], "ts", "start_ts", "end_ts"))


@query(
    "prior_visits",
    f"""WITH {VISITS}, {VISIT_LABS},
facts AS (SELECT visit_id, count(*) AS n, string_agg(item::VARCHAR, ',' ORDER BY line, item) AS items FROM visit_labs GROUP BY 1)
SELECT v.visit_id, count(p.visit_id)::BIGINT AS prior_visits, coalesce(sum(f.n), 0)::BIGINT AS prior_facts,
       coalesce(string_agg(f.items, ';' ORDER BY p.start_ts, p.visit_id), '') AS items
FROM visits v LEFT JOIN (SELECT * FROM visits SEMI JOIN facts USING (visit_id)) p
     ON p.subject_id = v.subject_id AND p.start_ts < v.start_ts
LEFT JOIN facts f ON f.visit_id = p.visit_id GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    fact = F.struct("line", "item")
    prior = windows.prior_visits(visits(t), visit_labs(t), "subject_id", "visit_id", "start_ts", fact)
    sizes = F.transform("prior", lambda p: F.size(p["facts"]))
    per_visit = F.transform("prior", lambda p: F.array_join(F.transform(p["facts"], lambda f: f["item"].cast("string")), ","))
    return prior.select(
        "visit_id",
        F.size("prior").cast("long").alias("prior_visits"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("prior_facts"),
        F.array_join(per_visit, ";").alias("items"),
    )


@query(
    "returns_within",
    f"""WITH {VISITS} SELECT visit_id, EXISTS (SELECT 1 FROM visits n WHERE n.subject_id = v.subject_id
          AND n.start_ts > v.end_ts AND n.start_ts <= v.end_ts + INTERVAL 30 DAY) AS returned FROM visits v""",
)
def _(t: Tables) -> DataFrame:
    return windows.returns_within(visits(t), "subject_id", "visit_id", "start_ts", "end_ts", 30).select("visit_id", "returned")


@query(
    "next_visit",
    f"""WITH {VISITS}, n AS (SELECT *, lead(visit_id) OVER w AS next_visit, lead(start_ts) OVER w AS next_start FROM visits
          WINDOW w AS (PARTITION BY subject_id ORDER BY start_ts, visit_id))
SELECT visit_id, next_visit, {ts_sql('next_start')} AS next_start,
       round((epoch_us(next_start) - epoch_us(end_ts)) / 86400000000.0, 6) AS days_to_next,
       coalesce((epoch_us(next_start) - epoch_us(end_ts)) / 86400000000.0 BETWEEN 0 AND 30, false) AS readmitted FROM n""",
)
def _(t: Tables) -> DataFrame:
    nxt = windows.next_visit(visits(t), "subject_id", "visit_id", "start_ts", "end_ts")
    return nxt.select(
        "visit_id", "next_visit", ts_text("next_start").alias("next_start"), rnd("days_to_next").alias("days_to_next"), "readmitted"
    )


@query(
    "elapsed_hhmm",
    f"""WITH {VISITS}, {VISIT_LABS}, m AS (SELECT visit_id, item, line, greatest(0, epoch_us(ts) - epoch_us(start_ts)) // 60000000 AS mins
          FROM visit_labs JOIN visits USING (visit_id))
SELECT visit_id, item, line, CASE WHEN mins // 60 < 10 THEN '0' ELSE '' END || (mins // 60) || ':' || lpad((mins % 60)::VARCHAR, 2, '0') AS elapsed
FROM m""",
)
def _(t: Tables) -> DataFrame:
    joined = visit_labs(t).join(visits(t).select("visit_id", "start_ts"), "visit_id")
    return joined.select("visit_id", "item", "line", elapsed_hhmm("ts", "start_ts").alias("elapsed"))


@query(
    "first_event_lag",
    f"""WITH {VISITS}, {VISIT_LABS}, f AS (SELECT visit_id, min(ts) AS ts FROM visit_labs GROUP BY 1),
lag AS (SELECT (epoch_us(f.ts) - epoch_us(start_ts)) / 3600000000.0 AS h FROM f JOIN visits USING (visit_id))
SELECT count(*)::BIGINT AS visits, round(avg(CASE WHEN h <= 24 THEN 1.0 ELSE 0.0 END), 6) AS share_24h,
       round(avg(CASE WHEN h <= 48 THEN 1.0 ELSE 0.0 END), 6) AS share_48h, round(median(h), 6) AS median_hours
FROM lag WHERE h BETWEEN -4800 AND 4800""",
)
def _(t: Tables) -> DataFrame:
    lag = windows.first_event_lag(visit_labs(t), visits(t), "visit_id", "ts", "start_ts", -4800, 4800)
    return lag.select(
        "visits", rnd("share_24h").alias("share_24h"), rnd("share_48h").alias("share_48h"), rnd("median_hours").alias("median_hours")
    )


@query(
    "length_of_stay",
    f"""WITH {VISITS} SELECT visit_id, round((epoch_us(end_ts) - epoch_us(start_ts)) / 86400000000.0, 6) AS days,
        round((epoch_us(end_ts) - epoch_us(start_ts)) / 3600000000.0, 6) AS hours FROM visits""",
)
def _(t: Tables) -> DataFrame:
    return visits(t).select(
        "visit_id",
        rnd(length_of_stay("start_ts", "end_ts")).alias("days"),
        rnd(length_of_stay("start_ts", "end_ts", "hours")).alias("hours"),
    )
