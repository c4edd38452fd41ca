"""Queries of profiling and exploratory aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.text import combined_label
from cohortry.operators import profile as pf
from cohortry.plans.registry import VISITS, Tables, big, query, rnd, visits
from cohortry.plans.texts import CULTURES, cultures

_PROFILE_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _profile_sql() -> str:
    parts = []
    for c in _PROFILE_COLS:
        number = c in ("o_orderkey", "o_custkey", "o_totalprice")
        kind = "double" if c == "o_totalprice" else ("bigint" if number else "string")
        stats = (
            f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
            + ", ".join(f"round(quantile_cont({c}::DOUBLE, {p}), 4) AS {n}" for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
            if number
            else ", ".join(f"NULL::DOUBLE AS {n}" for n in ("mean", "std", "min", "max", "p25", "p50", "p75"))
        )
        parts.append(f"SELECT '{c}' AS column, '{kind}' AS type, count(*)::BIGINT AS rows, count(*) FILTER ({c} IS NULL)::BIGINT AS nulls, {stats} FROM o")
    return (
        "WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders) "
        + " UNION ALL ".join(parts)
    )


@query("profile_columns", _profile_sql())
def _(t: Tables) -> DataFrame:
    rows = t.orders.select(*_PROFILE_COLS).withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    p = pf.profile(rows)
    rounded = [rnd(c, 4).alias(c) for c in ("mean", "std", "p25", "p50", "p75")]
    return p.select("column", "type", "rows", "nulls", "min", "max", *rounded)


@query(
    "top_values",
    "SELECT l_partkey, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 8) AS share FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 25",
)
def _(t: Tables) -> DataFrame:
    return pf.top_values(t.lineitem, "l_partkey", 25).withColumn("share", rnd("share", 8))


@query(
    "group_size_stats",
    """WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey)
SELECT count(*)::BIGINT AS groups, min(size)::BIGINT AS min, round(avg(size), 6) AS mean, round(stddev_samp(size), 6) AS std, max(size)::BIGINT AS max,
       quantile_cont(size::DOUBLE, 0.25) AS p25, quantile_cont(size::DOUBLE, 0.5) AS p50, quantile_cont(size::DOUBLE, 0.75) AS p75 FROM s""",
)
def _(t: Tables) -> DataFrame:
    stats = pf.group_size_stats(t.lineitem, ["l_orderkey"])
    return stats.withColumn("mean", rnd("mean")).withColumn("std", rnd("std"))


@query("rate_by", f"WITH {VISITS} SELECT priority, round(avg(died), 6) AS rate, sum(died)::BIGINT AS positives, count(*)::BIGINT AS n FROM visits GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return pf.rate_by(visits(t), "priority", "died").withColumn("rate", rnd("rate"))


@query(
    "top_items",
    """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20)
SELECT l_partkey, coalesce(p_name, 'Unknown (' || l_partkey || ')') AS label, n::BIGINT AS n FROM c LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey""",
)
def _(t: Tables) -> DataFrame:
    names = t.part.where(F.col("p_size") > 10).select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return pf.top_items(t.lineitem, "l_partkey", names, "p_name", 20)


@query(
    "repetition_stats",
    """WITH c AS (SELECT l_suppkey, l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT l_suppkey, count(*)::BIGINT AS visits, round(avg(n), 6) AS mean, max(n)::BIGINT AS max, median(n)::DOUBLE AS median FROM c GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return pf.repetition_stats(t.lineitem, ["l_returnflag", "l_partkey"], "l_suppkey").withColumn("mean", rnd("mean"))


@query(
    "crosstab",
    """SELECT o_orderpriority, count(*)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS O,
       count(*) FILTER (o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return pf.crosstab(t.orders, "o_orderpriority", "o_orderstatus", 20)


@query(
    "panel_summary",
    f"""WITH {CULTURES}, v AS (SELECT count(DISTINCT o_orderkey) AS n FROM orders)
SELECT test, count(*)::BIGINT AS events, count(DISTINCT visit_id)::BIGINT AS visits, round(count(DISTINCT visit_id) * 100.0 / any_value(v.n), 6) AS coverage_pct,
       round(avg(CASE WHEN organism IS NOT NULL THEN 100.0 ELSE 0.0 END), 6) AS positive_pct, count(DISTINCT specimen)::BIGINT AS combos
FROM cultures CROSS JOIN v GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    total = t.orders.agg(F.count("o_orderkey").alias("visits_total"))
    summary = pf.panel_summary(cultures(t), "test", "visit_id", F.col("organism").isNotNull(), F.col("specimen"), total)
    return summary.withColumn("coverage_pct", rnd("coverage_pct")).withColumn("positive_pct", rnd("positive_pct"))


@query(
    "yield_rate",
    f"""WITH {CULTURES}, p AS (SELECT *, organism IS NOT NULL AND NOT contains(upper(organism), 'RING') AND NOT contains(upper(organism), 'BOLT') AS pos FROM cultures)
SELECT count(*)::BIGINT AS events, count(*) FILTER (pos)::BIGINT AS positives, round(avg(CASE WHEN pos THEN 100.0 ELSE 0.0 END), 6) AS positive_pct,
       round(avg(CASE WHEN drug IS NOT NULL THEN 100.0 ELSE 0.0 END), 6) AS susceptibility_pct, count(DISTINCT visit_id)::BIGINT AS visits,
       round(count(DISTINCT visit_id) * 100.0 / (SELECT count(*) FROM orders), 6) AS coverage_pct FROM p""",
)
def _(t: Tables) -> DataFrame:
    total = t.orders.agg(F.count("o_orderkey").alias("visits_total"))
    y = pf.yield_rate(cultures(t), "organism", ["ring", "bolt"], "drug", "visit_id", total)
    return y.select("events", "positives", "visits", *[rnd(c).alias(c) for c in ("positive_pct", "susceptibility_pct", "coverage_pct")])


@query(
    "top_per_group",
    f"""WITH {CULTURES}, g AS (SELECT specimen FROM cultures GROUP BY 1 HAVING count(*) >= 10),
c AS (SELECT specimen, organism, count(*) AS n FROM cultures WHERE organism IS NOT NULL AND specimen IN (SELECT specimen FROM g) GROUP BY 1, 2)
SELECT specimen, organism, n::BIGINT AS n, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY specimen ORDER BY n DESC, organism) AS rank FROM c) WHERE rank <= 3""",
)
def _(t: Tables) -> DataFrame:
    rows = cultures(t)
    covered = rows.groupBy("specimen").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 10)
    return pf.top_per_group(rows, "specimen", "organism", 3, covered).withColumn("rank", big("rank"))


@query(
    "resistance_profile",
    f"""WITH {CULTURES}, p AS (SELECT drug, count(*) AS n, avg(CASE WHEN grade = 'R' THEN 100.0 ELSE 0 END) AS r, avg(CASE WHEN grade = 'I' THEN 100.0 ELSE 0 END) AS i,
   avg(CASE WHEN grade = 'S' THEN 100.0 ELSE 0 END) AS s FROM cultures WHERE drug IS NOT NULL AND grade IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)
SELECT drug, n::BIGINT AS n, round(r, 6) AS "pct_R", round(i, 6) AS "pct_I", round(s, 6) AS "pct_S" FROM p ORDER BY r DESC, drug LIMIT 25""",
)
def _(t: Tables) -> DataFrame:
    shares = pf.share_profile(cultures(t), "drug", "grade", ["R", "I", "S"], 50, 25)
    return shares.select("drug", "n", *[rnd(f"pct_{g}").alias(f"pct_{g}") for g in "RIS"])


@query(
    "resistance_matrix",
    f"""WITH {CULTURES}, c AS (SELECT * FROM cultures WHERE grade IS NOT NULL),
o AS (SELECT organism FROM c WHERE organism IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, organism LIMIT 5),
d AS (SELECT drug FROM c WHERE drug IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, drug LIMIT 5)
SELECT organism, drug, count(*)::BIGINT AS n, CASE WHEN count(*) >= 10 THEN round(avg(CASE WHEN grade = 'R' THEN 100.0 ELSE 0 END), 6) END AS pct
FROM c WHERE organism IN (SELECT organism FROM o) AND drug IN (SELECT drug FROM d) GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    graded = cultures(t).where(F.col("grade").isNotNull())
    return pf.rate_matrix(graded, "organism", "drug", F.col("grade") == "R", 5, 10).withColumn("pct", rnd("pct"))


@query(
    "cooccurrence",
    f"""WITH {CULTURES}, top AS (SELECT specimen FROM cultures GROUP BY 1 ORDER BY count(*) DESC, specimen LIMIT 15),
h AS (SELECT DISTINCT visit_id, specimen FROM cultures WHERE specimen IN (SELECT specimen FROM top))
SELECT x.specimen AS a, y.specimen AS b, count(*)::BIGINT AS units FROM h x JOIN h y ON x.visit_id = y.visit_id AND x.specimen < y.specimen GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return pf.cooccurrence(cultures(t), "visit_id", "specimen", 15)


@query("items_per_unit", f"WITH {CULTURES}, s AS (SELECT count(DISTINCT specimen) AS items FROM cultures GROUP BY visit_id) SELECT items::BIGINT AS items, count(*)::BIGINT AS units FROM s GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return pf.items_per_unit(cultures(t), "visit_id", "specimen")


@query(
    "signal_tier",
    f"""WITH {CULTURES}, s AS (SELECT specimen, count(DISTINCT visit_id) * 100.0 / (SELECT count(*) FROM orders) AS cov, avg(CASE WHEN organism = 'ring' THEN 100.0 ELSE 0 END) AS pos FROM cultures GROUP BY 1)
SELECT specimen, CASE WHEN cov > 5 AND pos > 20 THEN 'HIGH' WHEN cov > 2 OR pos > 10 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM s""",
)
def _(t: Tables) -> DataFrame:
    total = t.orders.agg(F.count("o_orderkey").alias("visits_total"))
    hit = F.coalesce(F.col("organism") == "ring", F.lit(False))
    summary = pf.panel_summary(cultures(t), "specimen", "visit_id", hit, F.col("test"), total)
    return summary.select("specimen", pf.signal_tier("coverage_pct", "positive_pct").alias("tier"))


_COMMENTS = """c AS (SELECT l_shipmonth AS grp, comments FROM (SELECT month(l_shipdate)::BIGINT AS l_shipmonth,
  CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '  ' WHEN 3 THEN '___' WHEN 4 THEN ' --- ' ELSE 'line ' || l_partkey % 30 END AS comments FROM lineitem))"""
_KIND = "CASE WHEN comments IS NULL THEN 'null' WHEN trim(comments) = '' THEN 'blank' WHEN regexp_full_match(trim(comments), '_+|-+') THEN 'placeholder' ELSE 'meaningful' END"


def _comments(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    text = F.when(n == 2, "  ").when(n == 3, "___").when(n == 4, " --- ").when(n != 1, F.concat(F.lit("line "), (F.col("l_partkey") % 30).cast("string")))
    return t.lineitem.select(big(F.month("l_shipdate")).alias("grp"), text.alias("comments"))


@query("comment_presence", f"WITH {_COMMENTS} SELECT {_KIND} AS kind, count(*)::BIGINT AS n, round(count(*) * 100.0 / (SELECT count(*) FROM c), 6) AS percent FROM c GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return pf.presence(_comments(t), "comments").withColumn("percent", rnd("percent"))


@query(
    "comment_presence_by_group",
    f"""WITH {_COMMENTS}, k AS (SELECT grp, {_KIND} AS kind FROM c) SELECT grp, count(*)::BIGINT AS n, count(*) FILTER (kind = 'meaningful')::BIGINT AS meaningful,
        round(avg(CASE WHEN kind = 'meaningful' THEN 100.0 ELSE 0 END), 6) AS percent FROM k GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return pf.presence(_comments(t), "comments", "grp").withColumn("percent", rnd("percent"))


_MEANINGFUL = f"m AS (SELECT grp, trim(comments) AS value, count(*)::BIGINT AS n FROM c WHERE {_KIND} = 'meaningful' GROUP BY ALL)"


@query("top_comments", f"WITH {_COMMENTS}, {_MEANINGFUL} SELECT value, sum(n)::BIGINT AS n FROM m GROUP BY 1 ORDER BY n DESC, value LIMIT 80")
def _(t: Tables) -> DataFrame:
    return pf.top_meaningful(_comments(t), "comments", 80)


@query(
    "top_comments_by_group",
    f"""WITH {_COMMENTS}, {_MEANINGFUL}, best AS (SELECT grp FROM c GROUP BY 1 ORDER BY avg(CASE WHEN {_KIND} = 'meaningful' THEN 1.0 ELSE 0 END) DESC, grp LIMIT 10)
SELECT grp, value, n, row_number() OVER (PARTITION BY grp ORDER BY n DESC, value)::BIGINT AS rank FROM m SEMI JOIN best USING (grp)
QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, value) <= 10""",
)
def _(t: Tables) -> DataFrame:
    return pf.top_meaningful(_comments(t), "comments", 10, "grp").withColumn("rank", big("rank"))


@query(
    "tested_share",
    f"""WITH {CULTURES}, v AS (SELECT specimen, visit_id, bool_or(organism IS NOT NULL) AS hit, bool_or(drug IS NOT NULL) AS tested FROM cultures GROUP BY ALL)
SELECT specimen, count(*) FILTER (hit)::BIGINT AS positive_visits, count(*) FILTER (tested)::BIGINT AS tested_visits,
       round(count(*) FILTER (tested) * 100.0 / greatest(count(*) FILTER (hit), 1), 6) AS tested_pct FROM v GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    share = pf.tested_share(cultures(t), "specimen", "visit_id", F.col("organism").isNotNull(), F.col("drug").isNotNull())
    return share.withColumn("tested_pct", rnd("tested_pct"))


@query(
    "key_overlap",
    """WITH k AS (SELECT key, sum(a) AS na, sum(b) AS nb FROM (SELECT o_custkey AS key, 1 AS a, 0 AS b FROM orders
      UNION ALL SELECT user_id, 0, 1 FROM events) GROUP BY 1)
SELECT count(*) FILTER (na > 0)::BIGINT AS keys_a, count(*) FILTER (nb > 0)::BIGINT AS keys_b, count(*) FILTER (na > 0 AND nb > 0)::BIGINT AS common,
       count(*) FILTER (na > 0 AND nb = 0)::BIGINT AS only_a, count(*) FILTER (nb > 0 AND na = 0)::BIGINT AS only_b,
       count(*) FILTER (na > 1)::BIGINT AS repeated_a, count(*) FILTER (nb > 1)::BIGINT AS repeated_b FROM k""",
)
def _(t: Tables) -> DataFrame:
    return pf.key_overlap(t.orders.select(F.col("o_custkey").alias("key")), t.events.select(F.col("user_id").alias("key")), "key")


@query(
    "dedup_report",
    """WITH s AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
       SELECT sum(n)::BIGINT AS rows_before, count(*)::BIGINT AS rows_after, (sum(n) - count(*))::BIGINT AS dropped FROM s""",
)
def _(t: Tables) -> DataFrame:
    return pf.dedup_report(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "null_audit",
    f"""WITH {VISITS} SELECT died::BIGINT AS died, priority, count(*)::BIGINT AS n, count(*) FILTER (visit_id % 10 = 3)::BIGINT AS nulls,
        round(avg(CASE WHEN visit_id % 10 = 3 THEN 1.0 ELSE 0 END), 6) AS null_share FROM visits GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    open_ended = visits(t).withColumn("end_ts", F.when(F.col("visit_id") % 10 != 3, F.col("end_ts"))).withColumn("died", big("died"))
    return pf.null_audit(open_ended, "end_ts", ["died", "priority"]).withColumn("null_share", rnd("null_share"))


@query(
    "histogram",
    """SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 35 THEN 2 ELSE 3 END::BIGINT AS bin,
       CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN 10 WHEN l_quantity < 35 THEN 20 ELSE 35 END::DOUBLE AS low,
       CASE WHEN l_quantity < 10 THEN 10 WHEN l_quantity < 20 THEN 20 WHEN l_quantity < 35 THEN 35 ELSE 50 END::DOUBLE AS high, count(*)::BIGINT AS n
       FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1, 2, 3""",
)
def _(t: Tables) -> DataFrame:
    return pf.histogram(t.lineitem, "l_quantity", [1, 10, 20, 35, 50]).withColumn("bin", big("bin"))


_ITEMS = [1, 2, 3, 5, 8]


@query(
    "pivot_flags",
    "SELECT l_suppkey, " + ", ".join(f"max(CASE WHEN l_partkey = {i} AND l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS \"{i}\"" for i in _ITEMS)
    + " FROM lineitem GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    wide = pf.pivot_flags(t.lineitem, "l_suppkey", "l_partkey", _ITEMS, F.col("l_returnflag") == "R")
    return wide.select("l_suppkey", *[big(str(i)).alias(str(i)) for i in _ITEMS])


@query(
    "pivot_first_text",
    "SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS user, arg_min(text, turn) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    return pf.pivot_first(t.conversations, "conv_id", "role", "text", ["user", "assistant"], "turn")


@query(
    "combined_label",
    "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'Unknown' WHEN p_size < 10 THEN p_type ELSE p_type || ' - ' || p_brand END AS label FROM part",
)
def _(t: Tables) -> DataFrame:
    a, b = F.when(F.col("p_type") != "PROMO", F.col("p_type")), F.when(F.col("p_size") >= 10, F.col("p_brand"))
    return t.part.select("p_partkey", combined_label(a, b).alias("label"))
