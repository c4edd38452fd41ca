"""Queries of numeric cleaning, statistics and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions import numbers as num
from cohortry.functions.times import age_at
from cohortry.operators import numeric, sampling, vectors
from cohortry.plans.registry import SUBJECT_SPLIT, Tables, big, query, rnd, visits


def vitals(t: Tables) -> DataFrame:
    """Per visit age, sex, and height / weight with gaps."""
    people = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return t.orders.join(people, "o_custkey").select(
        F.col("o_custkey").alias("subject_id"),
        key.alias("visit_id"),
        (F.lit(18) + F.col("o_custkey") % 70).alias("age"),
        F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("sex"),
        F.when(key % 3 != 0, F.lit(150.0) + price % 50).alias("height_cm"),
        F.when(key % 4 != 0, F.lit(50.0) + price % 37).alias("weight_kg"),
        F.when(key % 5 == 0, F.lit(15.0) + price % 20).alias("bmi"),
    )


VITALS = """vitals AS (
  SELECT o_custkey AS subject_id, o_orderkey AS visit_id, 18 + o_custkey % 70 AS age,
         CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
         CASE WHEN o_orderkey % 3 <> 0 THEN 150.0::DOUBLE + o_totalprice % 50 END AS height_cm,
         CASE WHEN o_orderkey % 4 <> 0 THEN 50.0::DOUBLE + o_totalprice % 37 END AS weight_kg,
         CASE WHEN o_orderkey % 5 = 0 THEN 15.0::DOUBLE + o_totalprice % 20 END AS bmi
  FROM orders JOIN customer ON c_custkey = o_custkey)"""

_BIN_SQL = """CASE WHEN age >= 18 AND age < 30 THEN '18-29' WHEN age >= 30 AND age < 45 THEN '30-44'
  WHEN age >= 45 AND age < 65 THEN '45-64' WHEN age >= 65 AND age < 75 THEN '65-74' WHEN age >= 75 AND age < 200 THEN '75+' ELSE 'nan' END"""


@query(
    "to_number",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN event_type ELSE json_extract_string(props, '$.k') END AS DOUBLE)
       AS number FROM events""",
)
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", num.to_number(text).alias("number"))


@query(
    "convert_unit",
    """SELECT p_partkey, round(p_retailprice * CASE p_type WHEN 'LARGE' THEN 2.54 WHEN 'SMALL' THEN 0.453592 ELSE 1 END::DOUBLE, 6) AS value
       FROM part""",
)
def _(t: Tables) -> DataFrame:
    rules = {"LARGE": num.UNIT_FACTORS["inch"], "SMALL": num.UNIT_FACTORS["lbs"]}
    return numeric.convert_unit(t.part.withColumn("value", F.col("p_retailprice")), "value", "p_type", rules).select(
        "p_partkey", rnd("value").alias("value")
    )


@query(
    "plausible",
    "SELECT l_orderkey, l_partkey, CASE WHEN l_quantity BETWEEN 5.0 AND 45.0 THEN l_quantity END AS quantity FROM lineitem",
)
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey", num.plausible("l_quantity", 5.0, 45.0).alias("quantity"))


@query("name_contains", "SELECT count(*) FILTER (contains(lower(p_name), 'ring'))::BIGINT AS hits, count(*)::BIGINT AS n FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.agg(F.count_if(num.name_contains("p_name", "RING")).alias("hits"), F.count(F.lit(1)).alias("n"))


@query("prefer", f"WITH {VITALS} SELECT visit_id, round(coalesce(height_cm, weight_kg), 6) AS value FROM vitals")
def _(t: Tables) -> DataFrame:
    return vitals(t).select("visit_id", rnd(num.prefer("height_cm", "weight_kg")).alias("value"))


@query(
    "missing_flags",
    f"""WITH {VITALS} SELECT visit_id, CASE WHEN height_cm IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS height_cm_missing,
        CASE WHEN weight_kg IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS weight_kg_missing FROM vitals""",
)
def _(t: Tables) -> DataFrame:
    flagged = numeric.missing_flags(vitals(t), ["height_cm", "weight_kg"])
    return flagged.select("visit_id", "height_cm_missing", "weight_kg_missing")


@query("age_at", "SELECT o_orderkey, o_custkey % 80 + (year(o_orderdate) - 1995) AS age FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", big(age_at(F.col("o_custkey") % 80, F.lit(1995), "o_orderdate")).alias("age"))


@query(
    "encode_values",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END::DOUBLE AS code FROM orders",
)
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", num.encode("o_orderstatus", {"F": 1.0, "O": 0.0}).alias("code"))


@query("age_bins", f"WITH {VITALS} SELECT {_BIN_SQL} AS bin, count(*)::BIGINT AS n FROM vitals GROUP BY 1")
def _(t: Tables) -> DataFrame:
    binned = vitals(t).select(num.bin_left("age", num.AGE_BOUNDS, num.AGE_LABELS).alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def _with_stratum(t: Tables) -> DataFrame:
    sex = num.encode("sex", num.SEX_CODES)
    return vitals(t).withColumn("stratum", numeric.stratum_of(num.bin_left("age", num.AGE_BOUNDS, num.AGE_LABELS), sex))


def _visit_splits(t: Tables) -> DataFrame:
    people = sampling.outcome_rate(visits(t), "subject_id", "died")
    splits = sampling.stratified_split(people, "subject_id", "ever")
    return sampling.attach_split(visits(t), splits, "subject_id").select("visit_id", "split")


def _stats(t: Tables) -> DataFrame:
    return numeric.fit_strata_stats(_with_stratum(t), _visit_splits(t), "visit_id", "stratum", ["height_cm", "weight_kg"])


_STRATA = f"""{SUBJECT_SPLIT}, {VITALS},
s AS (SELECT *, {_BIN_SQL} || '_' || CASE sex WHEN 'M' THEN '1.0' ELSE '0.0' END AS stratum FROM vitals),
train AS (SELECT s.* FROM s JOIN splits USING (subject_id) WHERE split = 'train'),
stats AS (SELECT coalesce(stratum, '__global__') AS stratum, avg(height_cm) AS hm, stddev_samp(height_cm) AS hs,
                 avg(weight_kg) AS wm, stddev_samp(weight_kg) AS ws FROM train GROUP BY ROLLUP (stratum))"""


@query(
    "strata_stats",
    f"""WITH {_STRATA} SELECT stratum, round(hm, 6) AS height_cm_mean, round(hs, 6) AS height_cm_std,
        round(wm, 6) AS weight_kg_mean, round(ws, 6) AS weight_kg_std FROM stats""",
)
def _(t: Tables) -> DataFrame:
    stats = _stats(t)
    return stats.select("stratum", *[rnd(c).alias(c) for c in stats.columns if c != "stratum"])


def _normal_sql(col: str) -> str:
    digest = f"md5(concat_ws('|', visit_id, '{col}', '7'))"
    u1, u2 = (f"((('0x' || substr({digest}, {at}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)" for at in (1, 9))
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos(2.0::DOUBLE * pi() * {u2}))"


_IMPUTED = f"""{_STRATA},
filled AS (SELECT visit_id, age, sex, stratum, s.height_cm AS h0, s.weight_kg AS w0, bmi,
  coalesce(s.height_cm, CASE WHEN coalesce(CASE WHEN k.stratum IS NOT NULL THEN k.hs ELSE g.hs END, 0) = 0
     THEN CASE WHEN k.stratum IS NOT NULL THEN k.hm ELSE g.hm END
     ELSE CASE WHEN k.stratum IS NOT NULL THEN k.hm ELSE g.hm END + CASE WHEN k.stratum IS NOT NULL THEN k.hs ELSE g.hs END * {_normal_sql('height_cm')} END) AS height_cm,
  coalesce(s.weight_kg, CASE WHEN coalesce(CASE WHEN k.stratum IS NOT NULL THEN k.ws ELSE g.ws END, 0) = 0
     THEN CASE WHEN k.stratum IS NOT NULL THEN k.wm ELSE g.wm END
     ELSE CASE WHEN k.stratum IS NOT NULL THEN k.wm ELSE g.wm END + CASE WHEN k.stratum IS NOT NULL THEN k.ws ELSE g.ws END * {_normal_sql('weight_kg')} END) AS weight_kg
  FROM s LEFT JOIN (SELECT * FROM stats WHERE stratum <> '__global__') k USING (stratum)
  CROSS JOIN (SELECT * FROM stats WHERE stratum = '__global__') g)"""


def _imputed(t: Tables, flags: bool = False) -> DataFrame:
    rows = _with_stratum(t)
    if flags:
        rows = numeric.missing_flags(rows, ["height_cm", "weight_kg", "bmi"])
    return numeric.impute_normal(rows, _stats(t), "stratum", ["height_cm", "weight_kg"], "visit_id", 7)


@query(
    "impute_normal",
    f"WITH {_IMPUTED} SELECT visit_id, round(height_cm, 4) AS height_cm, round(weight_kg, 4) AS weight_kg FROM filled",
)
def _(t: Tables) -> DataFrame:
    return _imputed(t).select("visit_id", rnd("height_cm", 4).alias("height_cm"), rnd("weight_kg", 4).alias("weight_kg"))


_BMI_SQL = """greatest(5.0, least(100.0, coalesce(bmi, greatest(2.0, least(500.0, weight_kg))
  / pow(greatest(45.0, least(230.0, height_cm)) / 100.0, 2))))"""


@query("derive_bmi", f"WITH {_IMPUTED} SELECT visit_id, round({_BMI_SQL}, 4) AS bmi FROM filled")
def _(t: Tables) -> DataFrame:
    return _imputed(t).select("visit_id", rnd(num.derive_bmi("height_cm", "weight_kg", "bmi"), 4).alias("bmi"))


_VEC = ["age", "sex", "height", "weight", "bmi_value", "height_missing", "weight_missing", "bmi_missing"]


@query(
    "demographic_vector",
    f"""WITH {_IMPUTED} SELECT visit_id, age::DOUBLE AS age, CASE sex WHEN 'M' THEN 1.0 ELSE 0.0 END::DOUBLE AS sex,
        round(height_cm, 4) AS height, round(weight_kg, 4) AS weight, round({_BMI_SQL}, 4) AS bmi_value,
        CASE WHEN h0 IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS height_missing,
        CASE WHEN w0 IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS weight_missing,
        CASE WHEN bmi IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS bmi_missing FROM filled""",
)
def _(t: Tables) -> DataFrame:
    rows = _imputed(t, flags=True)
    vec = num.assemble_vector(
        "age", num.encode("sex", num.SEX_CODES), rnd("height_cm", 4), rnd("weight_kg", 4),
        rnd(num.derive_bmi("height_cm", "weight_kg", "bmi"), 4), "height_cm_missing", "weight_kg_missing", "bmi_missing",
    )
    return vectors.explode_vector(rows.select("visit_id", vec.alias("vec")), "vec", _VEC)


@query(
    "impute_median",
    f"""WITH {VITALS}, m AS (SELECT median(height_cm) AS h, median(weight_kg) AS w FROM vitals)
        SELECT visit_id, round(coalesce(height_cm, h), 2) AS height_cm, round(coalesce(weight_kg, w), 2) AS weight_kg,
        round(coalesce(bmi, 0), 2) AS bmi FROM vitals CROSS JOIN m""",
)
def _(t: Tables) -> DataFrame:
    rows = vitals(t).select("visit_id", "height_cm", "weight_kg", "bmi")
    return numeric.impute_median(rows, ["height_cm", "weight_kg"], ["bmi"])


@query(
    "standardize",
    f"""WITH {SUBJECT_SPLIT}, {VITALS},
m AS (SELECT avg(height_cm) AS hm, avg(weight_kg) AS wm FROM vitals JOIN splits USING (subject_id) WHERE split = 'train'),
d AS (SELECT any_value(hm) AS hm, any_value(wm) AS wm, stddev_pop(coalesce(height_cm, hm)) AS hs, stddev_pop(coalesce(weight_kg, wm)) AS ws
      FROM vitals JOIN splits USING (subject_id) CROSS JOIN m WHERE split = 'train')
SELECT visit_id, round((coalesce(height_cm, hm) - hm) / hs, 6) AS height_cm, round((coalesce(weight_kg, wm) - wm) / ws, 6) AS weight_kg
FROM vitals CROSS JOIN d""",
)
def _(t: Tables) -> DataFrame:
    rows = vitals(t).join(_visit_splits(t), "visit_id")
    scaled = numeric.standardize(rows.where(F.col("split") == "train"), rows, ["height_cm", "weight_kg"])
    return scaled.select("visit_id", rnd("height_cm").alias("height_cm"), rnd("weight_kg").alias("weight_kg"))


@query(
    "drop_sparse_columns",
    f"WITH {VITALS} SELECT visit_id, subject_id, age::BIGINT AS age, sex, round(height_cm, 6) AS height_cm, round(weight_kg, 6) AS weight_kg FROM vitals",
)
def _(t: Tables) -> DataFrame:
    rows = vitals(t).select(
        "visit_id", "subject_id", big("age").alias("age"), "sex", rnd("height_cm").alias("height_cm"),
        rnd("weight_kg").alias("weight_kg"), F.when(F.col("age") > 85, F.col("bmi")).alias("bmi"),
    )
    return numeric.drop_sparse_columns(rows, 0.2)


@query(
    "source_coverage",
    f"""WITH {VITALS}, c AS (SELECT CASE WHEN height_cm IS NOT NULL AND weight_kg IS NOT NULL THEN 'both'
             WHEN height_cm IS NOT NULL THEN 'first_only' WHEN weight_kg IS NOT NULL THEN 'second_only' ELSE 'neither' END AS source FROM vitals)
SELECT source, count(*)::BIGINT AS rows, round(count(*) * 100.0 / (SELECT count(*) FROM c), 6) AS percent FROM c GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return numeric.source_coverage(vitals(t), "height_cm", "weight_kg").select("source", "rows", rnd("percent").alias("percent"))


@query(
    "drop_missing",
    f"""WITH {VITALS} SELECT visit_id, round(weight_kg, 6) AS weight_kg, round(height_cm, 6) AS height_cm FROM vitals
        WHERE height_cm IS NOT NULL AND weight_kg IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    rows = vitals(t).select("visit_id", rnd("height_cm").alias("height_cm"), rnd("weight_kg").alias("weight_kg"))
    return numeric.drop_missing(rows, ["height_cm", "weight_kg"], label="height_cm")


@query("format_general", "SELECT l_orderkey, l_linenumber::BIGINT AS line, format('{:g}', l_extendedprice) AS price, format('{:g}', l_discount * l_tax) AS small FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", big("l_linenumber").alias("line"), num.fmt_g("l_extendedprice").alias("price"),
        num.fmt_g(F.col("l_discount") * F.col("l_tax")).alias("small"),
    )
