"""Queries of categories, panels and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import panels as pan
from cohortry.plans.registry import Tables, big, query, ts_sql, ts_text
from cohortry.sources.tables import lookup_table, panel_table

# part types and brands in the place of fluids and categories
_FLUIDS = {"ECONOMY": "Blood", "LARGE": "Urine", "MEDIUM": "Cerebrospinal Fluid", "PROMO": "Other Body Fluid", "SMALL": "I", "STANDARD": " Stool "}
_CATEGORIES = {0: "Chemistry", 1: "Hematology", 2: "Blood Gas", 3: "Other Tests"}


def dictionary(t: Tables) -> DataFrame:
    """Parts as an item dictionary."""
    fluid = F.col("p_type")
    for kind, name in _FLUIDS.items():
        fluid = F.when(F.col("p_type") == kind, F.lit(name)).otherwise(fluid)
    category = F.lit("")
    for rest, name in _CATEGORIES.items():
        category = F.when(F.col("p_size") % 4 == rest, F.lit(name)).otherwise(category)
    return t.part.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("label"), fluid.alias("fluid"), category.alias("category"))


_CASE_FLUID = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FLUIDS.items()) + " END"
_CASE_CAT = "CASE p_size % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CATEGORIES.items()) + " END"
DICTIONARY = f"dictionary AS (SELECT p_partkey AS item, p_name AS label, {_CASE_FLUID} AS fluid, {_CASE_CAT} AS category FROM part)"


@query(
    "lab_groups",
    f"""WITH {DICTIONARY}, g AS (SELECT item, CASE
   WHEN trim(fluid) = 'Cerebrospinal Fluid' THEN 'csf' WHEN trim(fluid) = 'Stool' THEN 'stool'
   WHEN fluid = 'Blood' AND category = 'Blood Gas' THEN 'blood_gas' WHEN fluid = 'Urine' AND category = 'Blood Gas' THEN 'urine_hematology'
   WHEN fluid = 'Other Body Fluid' AND category = 'Blood Gas' THEN 'other_body_fluid_hematology'
   ELSE replace(lower(fluid || '_' || category), ' ', '_') END AS lab_group FROM dictionary WHERE fluid <> 'I')
SELECT lab_group, string_agg(DISTINCT item::VARCHAR, ',' ORDER BY item::VARCHAR) AS items, count(*)::BIGINT AS n FROM g GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    groups = pan.lab_groups(dictionary(t), "item", "fluid", "category")
    text = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return groups.select("lab_group", text.alias("items"), big(F.size("items")).alias("n"))


_PANELS = {
    "first_panel": [("ECONOMY", "Brand#1"), ("ECONOMY", "Brand#2"), ("LARGE", "Brand#1")],
    "second_panel": [("SMALL", "Brand#3"), ("PROMO ", "Brand#4"), ("PROMO", "Brand#5")],
}
_PANEL_SQL = "panels(test_name, spec_type_desc, panel) AS (VALUES " + ", ".join(
    f"('{a.strip()}', '{b}', '{p}')" for p, pairs in _PANELS.items() for a, b in pairs
) + ")"
_TESTS_SQL = """tests AS (SELECT l_orderkey AS visit_id, l_linenumber::BIGINT AS line, l_partkey AS item, ' ' || p_type || ' ' AS test_name, p_brand AS spec_type_desc
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def tests(t: Tables) -> DataFrame:
    parts = t.part.withColumnRenamed("p_partkey", "l_partkey")
    return t.lineitem.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("visit_id"), big("l_linenumber").alias("line"), F.col("l_partkey").alias("item"),
        F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("test_name"), F.col("p_brand").alias("spec_type_desc"),
    )


@query(
    "assign_panel",
    f"""WITH {_TESTS_SQL}, {_PANEL_SQL} SELECT visit_id, line, item, panel FROM tests t JOIN panels p
        ON trim(t.test_name) = p.test_name AND trim(t.spec_type_desc) = p.spec_type_desc""",
)
def _(t: Tables) -> DataFrame:
    assigned = pan.assign_panel(tests(t), panel_table(t.spark, _PANELS), ["test_name", "spec_type_desc"])
    return assigned.select("visit_id", "line", "item", "panel")


@query(
    "unassigned_pairs",
    f"""WITH {_TESTS_SQL}, {_PANEL_SQL} SELECT trim(test_name) AS test_name, trim(spec_type_desc) AS spec_type_desc, count(*)::BIGINT AS n
        FROM tests WHERE (trim(test_name), trim(spec_type_desc)) NOT IN (SELECT (test_name, spec_type_desc) FROM panels) GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return pan.unassigned(tests(t), panel_table(t.spark, _PANELS), ["test_name", "spec_type_desc"])


@query(
    "exclude_values",
    f"""WITH {_TESTS_SQL} SELECT visit_id, line, item FROM tests
        WHERE test_name NOT IN (' PROMO ', 'SMALL') AND spec_type_desc NOT IN ('Brand#7', 'Brand#8')""",
)
def _(t: Tables) -> DataFrame:
    rules = {"test_name": [" PROMO ", "SMALL"], "spec_type_desc": ["Brand#7", "Brand#8"]}
    return pan.exclude(tests(t), rules).select("visit_id", "line", "item")


def _group_case() -> str:
    out = "CASE"
    for kind, groups in (("chemistry", pan.BLOOD_CHEMISTRY_GROUPS), ("hematology", pan.BLOOD_HEMATOLOGY_GROUPS)):
        for name, words in groups:
            hit = " OR ".join(f"contains(l, '{w}')" for w in words)
            out += f" WHEN f = 'blood' AND c = '{kind}' AND ({hit}) THEN '{name}'"
    title = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    return out + f" ELSE {title.format('f')} || ' - ' || {title.format('c')} END"


@query(
    "clinical_group",
    f"""WITH {DICTIONARY}, d AS (SELECT item, lower(label) AS l, lower(fluid) AS f, lower(category) AS c FROM dictionary)
        SELECT item, {_group_case()} AS clinical_group FROM d""",
)
def _(t: Tables) -> DataFrame:
    return dictionary(t).select("item", pan.clinical_group("label", "fluid", "category").alias("clinical_group"))


@query(
    "map_values",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH' WHEN '5-LOW' THEN 'LOW' ELSE o_orderpriority END AS o_orderpriority
       FROM orders""",
)
def _(t: Tables) -> DataFrame:
    mapping = lookup_table(t.spark, [("1-URGENT", "HIGH"), ("2-HIGH", "HIGH"), ("5-LOW", "LOW")], "raw string, class string")
    return pan.map_values(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", mapping, "raw", "class")


@query(
    "fold_rare",
    """WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1)
       SELECT p_partkey, CASE WHEN n >= 25 THEN p_name ELSE 'Other' END AS p_name FROM part JOIN c USING (p_name)""",
)
def _(t: Tables) -> DataFrame:
    return pan.fold_rare(t.part.select("p_partkey", "p_name"), "p_name", 25)


@query(
    "one_hot",
    """SELECT o_orderkey, (o_orderstatus = 'F')::BIGINT AS status_F, (o_orderstatus = 'O')::BIGINT AS status_O, (o_orderstatus = 'P')::BIGINT AS status_P
       FROM orders""",
)
def _(t: Tables) -> DataFrame:
    hot = pan.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", prefix="status")
    return hot.select("o_orderkey", *[big(c).alias(c) for c in hot.columns[1:]])


@query(
    "category_codes",
    """WITH d AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_size > 3))
       SELECT p_partkey, coalesce(code, -1)::BIGINT AS code FROM (SELECT p_partkey, CASE WHEN p_size > 3 THEN p_name END AS p_name FROM part) LEFT JOIN d USING (p_name)""",
)
def _(t: Tables) -> DataFrame:
    named = t.part.select("p_partkey", F.when(F.col("p_size") > 3, F.col("p_name")).alias("p_name"))
    return pan.category_codes(named, "p_name").select("p_partkey", "code")


@query(
    "customer_codes",
    """SELECT c_custkey, (row_number() OVER (ORDER BY c_name) - 1)::BIGINT AS code FROM customer""",
)
def _(t: Tables) -> DataFrame:
    return pan.category_codes(t.customer.select("c_custkey", "c_name"), "c_name").select("c_custkey", "code")


@query(
    "dictionary_lookup",
    """SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, coalesce(title, '') AS title FROM lineitem
       LEFT JOIN (SELECT p_partkey, p_name AS title FROM part WHERE p_type <> 'PROMO') ON p_partkey = l_partkey""",
)
def _(t: Tables) -> DataFrame:
    titles = t.part.where(F.col("p_type") != "PROMO").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    facts = t.lineitem.select("l_orderkey", big("l_linenumber").alias("line"), "l_partkey")
    return pan.lookup(facts, titles, ["l_partkey"])


@query(
    "dictionary_lookup_inner",
    """SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, p_name AS title FROM lineitem
       JOIN part ON p_partkey = l_partkey WHERE p_type <> 'PROMO'""",
)
def _(t: Tables) -> DataFrame:
    titles = t.part.where(F.col("p_type") != "PROMO").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    facts = t.lineitem.select("l_orderkey", big("l_linenumber").alias("line"), "l_partkey")
    return pan.lookup(facts, titles, ["l_partkey"], how="inner")


@query("valid_dictionary", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def _(t: Tables) -> DataFrame:
    facts = t.lineitem.select(F.col("l_partkey").alias("p_partkey"))
    return pan.valid_dictionary(t.part.select("p_partkey", "p_name"), facts, ["p_partkey"])


@query("enrich_catalogue", "SELECT DISTINCT l_partkey AS item, p_name, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(t: Tables) -> DataFrame:
    facts = t.lineitem.select(F.col("l_partkey").alias("item"))
    return pan.enrich_catalogue(facts, t.part.withColumnRenamed("p_partkey", "item"), ["item"], ["p_name", "p_brand"])


@query(
    "drop_empty_results",
    """SELECT l_orderkey, l_linenumber::BIGINT AS line, CASE WHEN l_returnflag = 'R' THEN l_quantity END AS number, CASE WHEN l_linestatus = 'F' THEN l_linestatus END AS text
       FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'F'""",
)
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", big("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("number"),
        F.when(F.col("l_linestatus") == "F", F.col("l_linestatus")).alias("text"),
    )
    return pan.drop_empty(rows, ["number", "text"])


@query(
    "action_index",
    """WITH f AS (SELECT l_partkey, min(l_orderkey) AS first_seen FROM lineitem GROUP BY 1)
       SELECT l_partkey, first_seen, (row_number() OVER (ORDER BY first_seen, l_partkey) - 1)::BIGINT AS action FROM f""",
)
def _(t: Tables) -> DataFrame:
    return pan.action_index(t.lineitem, "l_partkey", "l_orderkey").withColumn("action", big("action"))


@query(
    "action_index_dates",
    f"""WITH f AS (SELECT l_partkey, min(l_shipdate) AS t FROM lineitem GROUP BY 1)
       SELECT l_partkey, {ts_sql('t')} AS first_seen, (row_number() OVER (ORDER BY t, l_partkey) - 1)::BIGINT AS action FROM f""",
)
def _(t: Tables) -> DataFrame:
    ranked = pan.action_index(t.lineitem, "l_partkey", "l_shipdate")
    return ranked.select("l_partkey", ts_text("first_seen").alias("first_seen"), big("action").alias("action"))
