"""Queries of metrics, calibration and importance."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.text import first_rule
from cohortry.operators import attribution as att
from cohortry.operators import evaluate as ev
from cohortry.plans.registry import SUBJECT_SPLIT, Tables, big, query, rnd
from cohortry.plans.sampling import visit_splits
from cohortry.session import scratch_path
from cohortry.sources.tables import write_table


def scored(t: Tables) -> DataFrame:
    """Orders with an outcome (NULL for status P), a score with many ties and a fine one."""
    price = F.col("o_totalprice")
    y = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    coarse = (F.floor(price) % 90 + F.when(F.col("o_orderstatus") == "F", 10).otherwise(0)) / F.lit(100.0)
    return t.orders.select(
        "o_orderkey", "o_orderpriority", y.alias("y"), coarse.alias("coarse"), (price % 1000 / 1000).alias("fine"),
        ((price % 700 - 350) / 100 + F.coalesce(y, F.lit(0)) * 0.8).alias("logit"),
        (price % 900 - 450).alias("z2"), F.when(F.col("o_orderkey") % 4 != 0, y).alias("y2"),
    )


def _land(t: Tables, df: DataFrame, name: str) -> DataFrame:
    return t.spark.read.parquet(write_table(df, scratch_path(t.spark, name)))


SCORED = """scored AS (SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS y,
  (floor(o_totalprice)::BIGINT % 90 + CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 0 END) / 100.0::DOUBLE AS coarse, o_totalprice % 1000 / 1000 AS fine,
  (o_totalprice % 700 - 350) / 100 + CASE WHEN o_orderstatus = 'F' THEN 0.8 ELSE 0 END::DOUBLE AS logit, o_totalprice % 900 - 450 AS z2,
  CASE WHEN o_orderkey % 4 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END END AS y2 FROM orders)"""


def _auroc_sql(score: str, by: str = "") -> str:
    keep, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH {SCORED}, s AS (SELECT {keep}y, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {keep}{score}) - 1) / 2.0 AS r
   FROM scored WHERE y IS NOT NULL)
SELECT {keep}round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
   / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE, 6) AS auroc FROM s {group}"""


@query("auroc", _auroc_sql("fine"))
def _(t: Tables) -> DataFrame:
    return ev.auroc(scored(t), "y", "fine").select(rnd("auroc").alias("auroc"))


@query("auroc_by_group", _auroc_sql("coarse", "o_orderpriority"))
def _(t: Tables) -> DataFrame:
    return ev.auroc(scored(t), "y", "coarse", ["o_orderpriority"]).select("o_orderpriority", rnd("auroc").alias("auroc"))


_CURVE = """d AS (SELECT coarse, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM scored WHERE y IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER () AS p FROM d WINDOW w AS (ORDER BY coarse DESC))"""


@query("auprc", f"WITH {SCORED}, {_CURVE} SELECT round(sum(pos * (cp / cn::DOUBLE)) / any_value(p), 6) AS auprc FROM c")
def _(t: Tables) -> DataFrame:
    return ev.auprc(scored(t), "y", "coarse").select(rnd("auprc").alias("auprc"))


@query(
    "auprc_trapezoid",
    f"""WITH {SCORED}, {_CURVE} SELECT round(sum(pos * (cp / cn::DOUBLE + CASE WHEN cn - n > 0 THEN (cp - pos) / (cn - n)::DOUBLE ELSE 1 END) / 2) / any_value(p), 6) AS pr_area FROM c""",
)
def _(t: Tables) -> DataFrame:
    return ev.auprc_trapezoid(scored(t), "y", "coarse").select(rnd("pr_area").alias("pr_area"))


def _bins_sql(score: str, bins: int) -> str:
    inner = ", ".join(f"quantile_cont({score}, {i / bins!r})" for i in range(1, bins))
    return f"""{SCORED}, e AS (SELECT list_sort(list_distinct([0.0::DOUBLE, 1.0::DOUBLE, {inner}])) AS edges FROM scored WHERE y IS NOT NULL),
b AS (SELECT greatest(len(list_filter(edges[1:len(edges) - 1], lambda x: x <= {score})) - 1, 0) AS bin, {score} AS p, y FROM scored CROSS JOIN e WHERE y IS NOT NULL),
g AS (SELECT bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy FROM b GROUP BY 1)"""


@query("ece_bins", f"WITH {_bins_sql('fine', 10)} SELECT bin::BIGINT AS bin, n::BIGINT AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM g")
def _(t: Tables) -> DataFrame:
    bins = ev.ece_bins(scored(t), "y", "fine")
    return bins.select(big("bin").alias("bin"), "n", rnd("confidence").alias("confidence"), rnd("accuracy").alias("accuracy"))


@query("ece", f"WITH {_bins_sql('coarse', 10)} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM g")
def _(t: Tables) -> DataFrame:
    return ev.ece(scored(t), "y", "coarse").select(rnd("ece").alias("ece"))


@query("calibrated", f"WITH {SCORED} SELECT o_orderkey, round(1 / (1 + exp(-(logit / 1.7::DOUBLE))), 6) AS probability FROM scored")
def _(t: Tables) -> DataFrame:
    return scored(t).select("o_orderkey", rnd(ev.calibrated("logit", 1.7)).alias("probability"))


def _stage_sql(stage: str) -> str:
    bins = _bins_sql("p", 10).split(", e AS", 1)[1].replace("FROM scored", f"FROM {stage}")
    return f"""SELECT '{stage}' AS stage, (SELECT round(any_value(t), 3) FROM {stage}) AS temperature,
  (WITH e AS{bins} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 3) FROM g) AS ece"""


#: Bisection for the zero of the loss's slope over log T.
_FITTED = """half(i, lo, hi) AS (SELECT 0, -5.0::DOUBLE, 5.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN slope > 0 THEN lo ELSE m END, CASE WHEN slope > 0 THEN m ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS m, sum((y - 1 / (1 + exp(-logit * exp(-(lo + hi) / 2)))) * logit * exp(-(lo + hi) / 2)) AS slope
    FROM half, scored WHERE y IS NOT NULL AND i < 45 GROUP BY ALL) u),
fitted AS (SELECT exp((lo + hi) / 2) AS t FROM half ORDER BY i DESC LIMIT 1)"""


@query(
    "fit_temperature",
    f"""WITH RECURSIVE {SCORED}, {_FITTED}, before AS (SELECT y, 1.0::DOUBLE AS t, 1 / (1 + exp(-logit)) AS p FROM scored),
after AS (SELECT y, t, 1 / (1 + exp(-logit / t)) AS p FROM scored, fitted)
{_stage_sql('before')} UNION ALL {_stage_sql('after')}""",
)
def _(t: Tables) -> DataFrame:
    """Fitted temperature with the calibration error before and after."""
    rows = scored(t)
    temperature = ev.fit_temperature(rows, "y", "logit")
    errors = [
        ev.ece(rows.withColumn("p", ev.calibrated("logit", T)), "y", "p").select(F.lit(name).alias("stage"), rnd(F.lit(T), 3).alias("temperature"), rnd("ece", 3).alias("ece"))
        for name, T in (("before", 1.0), ("after", temperature))
    ]
    return errors[0].unionByName(errors[1])


_BCE = "(1 - {y}) * {z} + (1 + ({w} - 1) * {y}) * (ln(1 + exp(-abs({z}))) + greatest(-({z}), 0))"


@query(
    "weighted_bce",
    f"""WITH {SCORED}, l AS (SELECT avg({_BCE.format(y='y', z='logit', w='1.5::DOUBLE')}) AS loss_y, avg({_BCE.format(y='y2', z='z2', w='0.5::DOUBLE')}) AS loss_y2 FROM scored)
SELECT round(loss_y, 6) AS loss_y, round(loss_y2, 6) AS loss_y2, round(0.7::DOUBLE * loss_y + 0.3::DOUBLE * loss_y2, 6) AS total FROM l""",
)
def _(t: Tables) -> DataFrame:
    loss = ev.weighted_bce(scored(t), ["y", "y2"], ["logit", "z2"], [1.5, 0.5], [0.7, 0.3])
    return loss.select(*[rnd(c).alias(c) for c in loss.columns])


@query(
    "confusion",
    f"""WITH {SCORED}, p AS (SELECT y, CASE WHEN coarse >= 0.5 THEN 1 ELSE 0 END AS p FROM scored WHERE y IS NOT NULL)
SELECT count(*) FILTER (y = 0 AND p = 0)::BIGINT AS tn, count(*) FILTER (y = 0 AND p = 1)::BIGINT AS fp, count(*) FILTER (y = 1 AND p = 0)::BIGINT AS fn,
       count(*) FILTER (y = 1 AND p = 1)::BIGINT AS tp, round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p""",
)
def _(t: Tables) -> DataFrame:
    rows = scored(t).withColumn("pred", (F.col("coarse") >= 0.5).cast("int"))
    return ev.confusion(rows, "y", "pred").withColumn("accuracy", rnd("accuracy"))


def _mi_sql(feats: list[str], bins: int) -> str:
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS value, y FROM scored WHERE y IS NOT NULL" for f in feats)
    inner = ", ".join(f"quantile_cont(value, {i / bins!r})" for i in range(1, bins))
    return f"""WITH {SCORED}, l AS ({long}), e AS (SELECT feature, list_distinct([{inner}]) AS edges FROM l GROUP BY 1),
b AS (SELECT feature, y, len(list_filter(edges, lambda x: x <= value)) AS bin FROM l JOIN e USING (feature)),
j AS (SELECT feature, bin, y, count(*) AS n FROM b GROUP BY 1, 2, 3),
m AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS nt FROM j)
SELECT feature, round(sum(n / nt::DOUBLE * ln(n * nt::DOUBLE / (nb * ny::DOUBLE))), 6) AS mi FROM m GROUP BY 1"""


@query("mutual_information", _mi_sql(["coarse", "fine", "logit"], 10))
def _(t: Tables) -> DataFrame:
    return ev.mutual_information(scored(t), ["coarse", "fine", "logit"], "y").select("feature", rnd("mi").alias("mi"))


_KNN_FEATS = list(range(6))


@query(
    "mutual_information_knn",
    f"""WITH p AS (SELECT vec_id, label, f, embedding[f + 1]::DOUBLE AS x FROM embeddings, unnest({_KNN_FEATS}) AS u(f)),
s AS (SELECT label, f, count(*) AS size FROM p GROUP BY ALL), q AS (SELECT p.*, size FROM p JOIN s USING (label, f) WHERE size > 1),
d AS (SELECT a.vec_id, a.f, a.x, any_value(a.size) AS size, least(3, any_value(a.size) - 1) AS k, list_sort(list(abs(b.x - a.x))) AS gaps
      FROM q a JOIN q b ON a.f = b.f AND a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id, a.f, a.x),
m AS (SELECT d.f, d.vec_id, any_value(d.size) AS size, any_value(d.k) AS k, count(*) FILTER (abs(q.x - d.x) < gaps[k] OR gaps[k] = 0 AND q.x = d.x) AS m
      FROM d JOIN q ON q.f = d.f GROUP BY d.f, d.vec_id),
h AS (SELECT f, count(*) AS n, avg(list_sum([1.0::DOUBLE / i FOR i IN range(1, k)])) AS hk, avg(list_sum([1.0::DOUBLE / i FOR i IN range(1, size)])) AS hs,
      avg(coalesce(list_sum([1.0::DOUBLE / i FOR i IN range(1, m)]), 0)) AS hm FROM m GROUP BY f)
SELECT 'x' || f AS feature, round(greatest(0, list_sum([1.0::DOUBLE / i FOR i IN range(1, n)]) + coalesce(hk, 0) - hs - hm), 6) AS mi FROM h""",
)
def _(t: Tables) -> DataFrame:
    table = t.embeddings.select("label", *[F.get("embedding", F.lit(i)).alias(f"x{i}") for i in _KNN_FEATS])
    return ev.mutual_information_knn(table, [f"x{i}" for i in _KNN_FEATS], "label").select("feature", rnd("mi").alias("mi"))


@query("tree_attributions", f"WITH {SCORED} SELECT o_orderkey, true AS adds_up, true AS in_bounds FROM scored WHERE y IS NOT NULL")
def _(t: Tables) -> DataFrame:
    """For each labelled row, whether a forest's attributions and its mean prediction add up to the forest's own prediction of the row."""
    rows = scored(t).where("y is not null").select("o_orderkey", "y", F.array("coarse", "fine", "logit", "z2").cast("array<double>").alias("x"))
    model = att.fit_forest(rows, F.col("x"), "y", trees=5, depth=4)
    found = model.transform(att.attributed(rows, "x", model).withColumn("features", array_to_vector("x")))
    total = F.col("base") + F.aggregate("attributions", F.lit(0.0), lambda a, v: a + v)
    return found.select(
        "o_orderkey", (F.abs(total - vector_to_array("probability")[1]) < 1e-9).alias("adds_up"), F.forall("attributions", lambda v: F.abs(v) <= 1).alias("in_bounds")
    )


@query(
    "attributed_importance",
    """SELECT feature, true AS in_bounds, true AS informed FROM (VALUES ('coarse'), ('fine'), ('logit'), ('z2')) v(feature)
WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus <> 'P')""",
)
def _(t: Tables) -> DataFrame:
    """Mean absolute attributions: the two features that the outcome moves have more than the others."""
    found = att.attributed_importance(scored(t), ["coarse", "fine", "logit", "z2"], "y", trees=10, depth=4)
    moved = F.col("feature").isin("coarse", "logit")
    sides = found.agg(F.min(F.when(moved, F.col("importance"))).alias("least"), F.max(F.when(~moved, F.col("importance"))).alias("most"))
    return found.join(F.broadcast(sides), F.lit(True)).select("feature", F.col("importance").between(0, 1).alias("in_bounds"), (F.col("least") > F.col("most")).alias("informed"))


@query(
    "spearman",
    f"""WITH {SCORED}, r AS (SELECT rank() OVER (ORDER BY coarse) + (count(*) OVER (PARTITION BY coarse) - 1) / 2.0 AS a,
      rank() OVER (ORDER BY logit) + (count(*) OVER (PARTITION BY logit) - 1) / 2.0 AS b FROM scored)
SELECT count(*)::BIGINT AS n, round(corr(a, b), 6) AS spearman FROM r""",
)
def _(t: Tables) -> DataFrame:
    return ev.spearman(scored(t), "coarse", "logit").select("n", rnd("spearman").alias("spearman"))


@query(
    "surrogate_importance",
    """SELECT feature, true AS in_bounds, 1.0::DOUBLE AS total, true AS informed
FROM (VALUES ('coarse'), ('fine'), ('logit'), ('z2')) v(feature)""",
)
def _(t: Tables) -> DataFrame:
    """What holds for any forest: shares of one whole, most of it with the two features that the outcome moves."""
    found = ev.surrogate_importance(scored(t), ["coarse", "fine", "logit", "z2"], "y", trees=10, depth=4)
    whole = found.agg(F.sum("importance").alias("total"), F.sum(F.when(F.col("feature").isin("coarse", "logit"), F.col("importance"))).alias("moved"))
    return found.join(F.broadcast(whole), F.lit(True)).select(
        "feature", F.col("importance").between(0, 1).alias("in_bounds"), rnd("total").alias("total"), (F.col("moved") > 0.5).alias("informed")
    )


_GROUPS = [("head", 0, 16), ("body", 16, 32), ("head", 48, 16)]


@query(
    "group_importance",
    """WITH v AS (SELECT generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT CASE WHEN i < 16 OR i >= 48 THEN 'head' ELSE 'body' END AS feature, round(avg(abs(x)), 6) AS importance FROM v GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return ev.group_importance(t.embeddings, "embedding", _GROUPS).select("feature", rnd("importance").alias("importance"))


@query(
    "regroup_importance",
    """WITH v AS (SELECT generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT i, avg(abs(x)) AS importance FROM v GROUP BY 1)
SELECT CASE WHEN i < 8 THEN 'demographics' ELSE 'slot' || i END AS feature, round(sum(importance), 6) AS importance FROM s GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    slots = [(f"slot{i}", i, 1) for i in range(64)]
    table = ev.group_importance(t.embeddings, "embedding", slots)
    group = first_rule([(F.col("feature").isin([f"slot{i}" for i in range(8)]), "demographics")], F.col("feature"))
    return ev.regroup_importance(table, "feature", ["importance"], group).withColumn("importance", rnd("importance"))


@query(
    "baseline_model",
    f"""WITH {SUBJECT_SPLIT}, {SCORED}, s AS (SELECT split, y, y2 FROM scored JOIN orders USING (o_orderkey) JOIN splits ON o_custkey = subject_id)
SELECT split, 'y' AS target, count(y)::BIGINT AS n, true AS better_than_chance FROM s GROUP BY ALL
UNION ALL SELECT split, 'y2', count(y2)::BIGINT, true FROM s GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    """Train on one split; per split and target the labelled rows, and whether their order beats chance: the area of all the target's rows
    lies above a half, and the split's own is not below that by more than the error that its numbers of both classes allow.

    The joined rows and the logits are landed, as each fit and each area reads them again.
    """
    table = scored(t).join(visit_splits(t).select(F.col("visit_id").alias("o_orderkey"), "split"), "o_orderkey")
    table = table.withColumn("x", F.array("coarse", "fine", "logit"))
    table = _land(t, table.select("o_orderkey", "split", "x", "y", "y2"), "scored")
    logits = _land(t, ev.baseline_model(table, "x", ["y", "y2"], "o_orderkey"), "logits")
    above = (F.col("whole") > 0.5) & (F.col("auroc") >= 0.5 - F.col("margin"))
    parts = [
        ev.auroc(logits, y, f"logit_{y}", ["split"])
        .join(ev.auroc_margin(logits, y, ["split"]), "split")
        .join(F.broadcast(ev.auroc(logits, y, f"logit_{y}").select(F.col("auroc").alias("whole"))), F.lit(True))
        .select("split", F.lit(y).alias("target"), (F.col("positives") + F.col("negatives")).alias("n"), above.alias("better_than_chance"))
        for y in ("y", "y2")
    ]
    return parts[0].unionByName(parts[1])
