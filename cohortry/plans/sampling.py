"""Queries of splits, labels, sampling and balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import sampling
from cohortry.operators.profile import rate_by
from cohortry.plans.registry import (
    SUBJECT_SPLIT, VISIT_LABS, VISITS, Tables, big, query, rnd, visit_labs, visits,
)


@query("outcome_rate", f"WITH {VISITS} SELECT subject_id, round(avg(died), 6) AS rate, (avg(died) > 0)::BIGINT AS ever FROM visits GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rates = sampling.outcome_rate(visits(t), "subject_id", "died")
    return rates.select("subject_id", rnd("rate").alias("rate"), big("ever").alias("ever"))


def subject_splits(t: Tables) -> DataFrame:
    people = sampling.outcome_rate(visits(t), "subject_id", "died")
    return sampling.stratified_split(people, "subject_id", "ever")


@query("split_stratified", f"WITH {SUBJECT_SPLIT} SELECT subject_id, ever::BIGINT AS ever, split FROM splits")
def _(t: Tables) -> DataFrame:
    return subject_splits(t).select("subject_id", big("ever").alias("ever"), "split")


def visit_splits(t: Tables) -> DataFrame:
    return sampling.attach_split(visits(t), subject_splits(t), "subject_id")


@query("attach_split", f"WITH {SUBJECT_SPLIT} SELECT visit_id, subject_id, split FROM visits LEFT JOIN splits USING (subject_id)")
def _(t: Tables) -> DataFrame:
    return visit_splits(t).select("visit_id", "subject_id", "split")


def _labels_sql(null_end: str) -> str:
    missing = "WHEN end_ts IS NULL THEN NULL " if null_end == "null" else ""
    return f"""WITH {VISITS.replace('visits AS', 'dated AS')}, visits AS (SELECT subject_id, visit_id, start_ts, died, priority,
  CASE WHEN priority <> '5-LOW' THEN end_ts END AS end_ts FROM dated)
SELECT visit_id, died::BIGINT AS y1, CASE WHEN died = 1 THEN NULL {missing}WHEN EXISTS (SELECT 1 FROM visits n WHERE n.subject_id = v.subject_id
   AND n.start_ts > v.end_ts AND n.start_ts <= v.end_ts + INTERVAL 30 DAY) THEN 1.0 ELSE 0.0 END::DOUBLE AS y2 FROM visits v"""


def _labels(t: Tables, null_end: str) -> DataFrame:
    open_ended = visits(t).withColumn("end_ts", F.when(F.col("priority") != "5-LOW", F.col("end_ts")))
    labels = sampling.outcome_labels(open_ended, "subject_id", "visit_id", "start_ts", "end_ts", "died", 30, null_end)
    return labels.select("visit_id", big("y1").alias("y1"), "y2")


@query("outcome_labels", _labels_sql("zero"))
def _(t: Tables) -> DataFrame:
    return _labels(t, "zero")


@query("outcome_labels_null_end", _labels_sql("null"))
def _(t: Tables) -> DataFrame:
    return _labels(t, "null")


def return_rates(t: Tables) -> DataFrame:
    """30-day return label per visit with a subject-level split, as a rate per split and priority."""
    st = visits(t)
    labels = sampling.outcome_labels(st, "subject_id", "visit_id", "start_ts", "end_ts", "died")
    table = visit_splits(t).join(labels.select("visit_id", "y1", "y2"), "visit_id").where(F.col("y2").isNotNull())
    rates = rate_by(table, ["split", "priority"], "y2")
    return rates.select("split", "priority", rnd("rate").alias("rate"), big("positives").alias("positives"), "n")


@query(
    "return_rates",
    f"""WITH {SUBJECT_SPLIT}, y AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM visits n WHERE n.subject_id = v.subject_id
   AND n.start_ts > v.end_ts AND n.start_ts <= v.end_ts + INTERVAL 30 DAY) THEN 1.0 ELSE 0.0 END AS y2 FROM visits v WHERE died = 0)
SELECT split, priority, round(avg(y2), 6) AS rate, sum(y2)::BIGINT AS positives, count(*)::BIGINT AS n FROM y JOIN splits USING (subject_id) GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return return_rates(t)


@query(
    "reward_table",
    f"""WITH {VISITS}, {VISIT_LABS} SELECT visit_id, subject_id, c_mktsegment AS segment, item, line, (flag = 'R')::BIGINT AS reward
        FROM visits JOIN customer ON c_custkey = subject_id JOIN visit_labs USING (visit_id)""",
)
def _(t: Tables) -> DataFrame:
    people = t.customer.select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"))
    table = sampling.reward_table(visits(t), people, visit_labs(t), "subject_id", "visit_id", F.col("flag") == "R")
    return table.select("visit_id", "subject_id", "segment", "item", "line", big("reward").alias("reward"))


def _balance_sql(cls: str, table: str, key: str, seed: int) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {cls} ORDER BY md5(concat_ws('|', {key}, '{seed}')), {key}) AS r,
         count(*) OVER (PARTITION BY {cls}) AS n FROM {table}),
x AS (SELECT *, (SELECT max(n) FROM r) - n AS extra FROM r),
b AS (SELECT * EXCLUDE (r, n, extra), unnest(range(0, 1 + (extra // n + CASE WHEN r <= extra % n THEN 1 ELSE 0 END)::BIGINT)) AS copy FROM x)"""


@query(
    "balance_oversample",
    f"WITH {_balance_sql('quality', 'labels', 'doc_id', 0)} SELECT doc_id, quality::BIGINT AS quality, copy::BIGINT AS copy FROM b",
)
def _(t: Tables) -> DataFrame:
    balanced = sampling.balance_oversample(t.labels, "quality", "doc_id", 0)
    return balanced.select("doc_id", big("quality").alias("quality"), big("copy").alias("copy"))


@query(
    "balance_multiclass",
    f"WITH e AS (SELECT event_id, event_type FROM events), {_balance_sql('event_type', 'e', 'event_id', 3)} SELECT event_id, event_type, copy::BIGINT AS copy FROM b",
)
def _(t: Tables) -> DataFrame:
    balanced = sampling.balance_oversample(t.events.select("event_id", "event_type"), "event_type", "event_id", 3)
    return balanced.select("event_id", "event_type", big("copy").alias("copy"))


def _noise_sql(i: int) -> str:
    digest = f"md5(concat_ws('|', vec_id, copy, {i}, '5'))"
    u1, u2 = (f"((('0x' || substr({digest}, {at}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)" for at in (1, 9))
    draw = f"sqrt(-2.0::DOUBLE * ln({u1})) * cos(2.0::DOUBLE * pi() * {u2})"
    return f"round(embedding[{i + 1}] + CASE WHEN copy > 0 THEN 0.01::DOUBLE * ({draw}) ELSE 0 END, 5) AS x{i}"


@query(
    "balance_with_noise",
    f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings), {_balance_sql('label', 'e', 'vec_id', 5)}
SELECT vec_id, label::BIGINT AS label, copy::BIGINT AS copy, {', '.join(_noise_sql(i) for i in range(64))} FROM b""",
)
def _(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    noisy = sampling.balance_with_noise(rows, "label", "vec_id", "embedding", 0.01, 5)
    entry = lambda i: rnd(F.get("embedding", F.lit(i)), 5).alias(f"x{i}")
    return noisy.select("vec_id", big("label").alias("label"), big("copy").alias("copy"), *[entry(i) for i in range(64)])


@query(
    "balance_groups",
    f"""WITH g AS (SELECT conv_id, CASE WHEN count(*) > 5 THEN 1 ELSE 0 END AS y FROM conversations GROUP BY 1), {_balance_sql('y', 'g', 'conv_id', 2)}
SELECT conv_id, turn, copy::BIGINT AS copy, y::BIGINT AS y FROM conversations JOIN b USING (conv_id)""",
)
def _(t: Tables) -> DataFrame:
    sizes = t.conversations.groupBy("conv_id").agg((F.count(F.lit(1)) > 5).cast("long").alias("y"))
    rows = t.conversations.select("conv_id", "turn").join(sizes, "conv_id")
    return sampling.balance_groups(rows, "conv_id", "y", 2).select("conv_id", "turn", big("copy").alias("copy"), "y")


@query(
    "stratified_subsample",
    f"""WITH {VISITS}, r AS (SELECT visit_id, died, row_number() OVER (PARTITION BY died ORDER BY md5(concat_ws('|', visit_id, '1')), visit_id) AS r FROM visits),
k AS (SELECT least(count(*) FILTER (died = 1), 500) AS pos FROM visits)
SELECT visit_id, died::BIGINT AS died FROM r CROSS JOIN k WHERE r <= CASE WHEN died = 1 THEN pos ELSE 1000 - pos END""",
)
def _(t: Tables) -> DataFrame:
    drawn = sampling.stratified_subsample(visits(t).select("visit_id", "died"), "died", "visit_id", 1000, 1)
    return drawn.select("visit_id", big("died").alias("died"))


@query(
    "pos_weights",
    f"""WITH {SUBJECT_SPLIT}, y AS (SELECT split, died AS y1, CASE WHEN died = 0 THEN CASE WHEN priority = '5-LOW' THEN 1 ELSE 0 END END AS y2 FROM visits JOIN splits USING (subject_id)),
l AS (SELECT 'y1' AS target, y1 AS v FROM y WHERE split = 'train' UNION ALL SELECT 'y2', y2 FROM y WHERE split = 'train'),
c AS (SELECT target, count(*) FILTER (v = 0)::BIGINT AS negatives, count(*) FILTER (v = 1)::BIGINT AS positives FROM l GROUP BY 1)
SELECT target, negatives, positives, round(negatives / positives::DOUBLE, 6) AS weight, round(sqrt(negatives / positives::DOUBLE), 6) AS train_weight FROM c""",
)
def _(t: Tables) -> DataFrame:
    rows = visit_splits(t).select(
        "split", F.col("died").alias("y1"), F.when(F.col("died") == 0, (F.col("priority") == "5-LOW").cast("int")).alias("y2")
    )
    weights = sampling.pos_weights(rows, ["y1", "y2"])
    return weights.select("target", "negatives", "positives", rnd("weight").alias("weight"), rnd("train_weight").alias("train_weight"))


@query(
    "series_per_subject",
    f"""WITH {VISITS} SELECT subject_id, string_agg(visit_id || ':' || priority, ',' ORDER BY start_ts, visit_id) AS series,
        arg_min(died, epoch_us(start_ts)::HUGEINT * 10000000 + visit_id)::BIGINT AS label FROM visits GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    series = sampling.series_per_patient(visits(t), "subject_id", ["start_ts", "visit_id"], ["visit_id", "priority"], "died")
    text = F.array_join(F.transform("series", lambda r: F.concat_ws(":", r["visit_id"].cast("string"), r["priority"])), ",")
    return series.select("subject_id", text.alias("series"), big("label").alias("label"))


@query(
    "union_splits_balanced",
    f"""WITH {SUBJECT_SPLIT}, s AS (SELECT visit_id, split, died FROM visits JOIN splits USING (subject_id)), {_balance_sql('died', 's', 'visit_id', 9)}
SELECT died::BIGINT AS died, split, count(*)::BIGINT AS n, sum(copy)::BIGINT AS copies FROM b GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    rows = visit_splits(t).select("visit_id", "split", "died")
    stacked = sampling.union_splits(*[rows.where(F.col("split") == s) for s in sampling.SPLITS])
    balanced = sampling.balance_oversample(stacked, "died", "visit_id", 9)
    return balanced.groupBy(big("died").alias("died"), "split").agg(F.count(F.lit(1)).alias("n"), F.sum("copy").alias("copies"))


@query(
    "random_sample",
    "SELECT doc_id, text FROM documents ORDER BY md5(concat_ws('|', doc_id, '4')), doc_id LIMIT 30",
)
def _(t: Tables) -> DataFrame:
    return sampling.random_sample(t.documents.select("doc_id", "text"), "doc_id", 30, 4)
