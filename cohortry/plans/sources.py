"""Queries of scans and sinks: what is written is read back whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.plans.registry import Tables, big, query, rnd, ts_sql, ts_text
from cohortry.session import scratch_path
from cohortry.sources import snapshots as snap
from cohortry.sources import tables as src


@query(
    "csv_round_trip",
    f"""SELECT doc_id, lang, length(text)::BIGINT AS chars, md5(text) AS digest FROM documents""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "text")
    path = src.write_text(rows, scratch_path(t.spark, "csv"), "csv")
    back = src.read_csv(t.spark, path, "doc_id bigint, lang string, text string", multi_line=True)
    return back.select("doc_id", "lang", big(F.length("text")).alias("chars"), F.md5("text").alias("digest"))


@query("typed_csv_table", f"SELECT o_orderkey, o_totalprice, {ts_sql('o_orderdate')} AS o_orderdate FROM orders")
def _(t: Tables) -> DataFrame:
    """Orders landed as a CSV table, found in the second of two places and read with a declared schema."""
    root = scratch_path(t.spark, "landing")
    src.write_text(t.orders, f"{root}/orders.csv", "csv")
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz"
    back = src.read_table(t.spark, "orders", [f"{root}/absent", root], schema, ["o_orderkey", "o_totalprice", "o_orderdate"])
    return back.withColumn("o_orderdate", ts_text("o_orderdate"))


@query("json_round_trip", f"SELECT event_id, event_type, value, {ts_sql('ts')} AS ts FROM events")
def _(t: Tables) -> DataFrame:
    path = src.write_text(t.events.select("event_id", "event_type", "value", "ts"), scratch_path(t.spark, "json"), "json")
    back = src.read_json_lines(t.spark, path, "event_id bigint, event_type string, value double, ts timestamp_ntz")
    return back.select("event_id", "event_type", "value", ts_text("ts").alias("ts"))


@query("parquet_round_trip", "SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS line, l_quantity FROM lineitem")
def _(t: Tables) -> DataFrame:
    path = src.write_table(t.lineitem, scratch_path(t.spark, "table"))
    back = src.read_columns(t.spark, path, ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])
    return back.select("l_orderkey", "l_partkey", big("l_linenumber").alias("line"), "l_quantity")


@query(
    "snapshot_replace",
    """SELECT stage, l_returnflag, n, quantity FROM (SELECT 'before' AS stage, l_returnflag, count(*)::BIGINT AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 2
UNION ALL SELECT 'failed', l_returnflag, count(*)::BIGINT, sum(l_quantity) FROM lineitem GROUP BY 2
UNION ALL SELECT 'open', l_returnflag, count(*)::BIGINT, sum(l_quantity) FROM lineitem GROUP BY 2
UNION ALL SELECT 'after', l_returnflag, count(*)::BIGINT, sum(l_quantity) FROM lineitem WHERE l_quantity > 10 GROUP BY 2)""",
)
def _(t: Tables) -> DataFrame:
    """A table that is replaced: as written first, after a writer that failed midway, of a reader that was open meanwhile, and afterwards."""
    path = scratch_path(t.spark, "snapshots")
    snap.write_snapshot(t.lineitem.select("l_returnflag", "l_quantity"), path)
    first = snap.read_snapshot(t.spark, path)
    broken = first.withColumn("l_quantity", F.when(F.col("l_quantity") == 50, F.raise_error(F.lit("broken row")).cast("double")).otherwise(F.col("l_quantity")))
    try:
        snap.write_snapshot(broken, path)
    except Exception as error:  # noqa: BLE001
        if "broken row" not in str(error):
            raise
    failed = snap.read_snapshot(t.spark, path)
    snap.write_snapshot(first.where("l_quantity > 10"), path)
    stages = {"before": t.lineitem, "failed": failed, "open": first, "after": snap.read_snapshot(t.spark, path)}
    rows = [df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")).withColumn("stage", F.lit(name)) for name, df in stages.items()]
    return reduce(DataFrame.unionByName, rows).select("stage", "l_returnflag", "n", "quantity")


@query(
    "partitioned_sink",
    "SELECT p_type AS panel, count(*)::BIGINT AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    kinds = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("panel"))
    path = src.write_by(t.lineitem.join(kinds, "l_partkey"), scratch_path(t.spark, "panels"), "panel")
    back = t.spark.read.parquet(path)
    return back.groupBy("panel").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("scan_events", f"SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def _(t: Tables) -> DataFrame:
    return src.scan_events(t.events, "event_type", ["click", "view"]).select("event_id", "event_type", "value")


@query("scan_columns", "SELECT l_partkey, round(l_extendedprice, 2) AS price FROM lineitem")
def _(t: Tables) -> DataFrame:
    return src.read_columns(t.spark, t.path("lineitem"), ["l_partkey", "l_extendedprice"]).select("l_partkey", rnd("l_extendedprice", 2).alias("price"))


@query("vector_column", "SELECT 'embedding' AS name, count(*)::BIGINT AS n FROM embeddings")
def _(t: Tables) -> DataFrame:
    name = src.vector_column(t.spark, t.path("embeddings"))
    return src.read_columns(t.spark, t.path("embeddings"), ["vec_id", name]).agg(F.lit(name).alias("name"), F.count(name).alias("n"))


@query("optional_source", "SELECT o_orderkey, NULL::DOUBLE AS result FROM orders")
def _(t: Tables) -> DataFrame:
    """A table that does not exist gives an empty typed frame, so the join leaves NULLs."""
    omr = src.read_table(t.spark, "omr", t.folder, src.SCHEMAS["omr"], optional=True)
    side = omr.select(F.col("subject_id").alias("o_orderkey"), F.col("result_value").cast("double").alias("result"))
    return t.orders.select("o_orderkey").join(side, "o_orderkey", "left")


@query(
    "sql_source",
    "SELECT l_suppkey, count(*)::BIGINT AS abnormal FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25 GROUP BY 1",
)
def _(t: Tables) -> DataFrame:
    t.lineitem.createOrReplaceTempView("cohortry_events")
    return src.read_sql(
        t.spark,
        "SELECT l_suppkey, count(*) AS abnormal FROM cohortry_events WHERE l_returnflag = 'R' AND l_quantity > 25 GROUP BY l_suppkey",
    )


@query("head_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 2000")
def _(t: Tables) -> DataFrame:
    return src.head_sample(t.orders, 2000, "o_orderkey").select("o_orderkey", "o_custkey")


@query("row_cap", f"SELECT event_id, {ts_sql('ts')} AS ts FROM (SELECT * FROM events ORDER BY events.ts DESC, event_id LIMIT 500)")
def _(t: Tables) -> DataFrame:
    return src.cap_rows(t.events, 500, [("ts", "desc"), "event_id"]).select("event_id", ts_text("ts").alias("ts"))


@query("half_sample", "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_quantity FROM lineitem ORDER BY l_returnflag DESC, l_quantity, l_orderkey, l_linenumber LIMIT (SELECT count(*) // 2 FROM lineitem)")
def _(t: Tables) -> DataFrame:
    """Half of a table in an order whose first columns tie in most rows: found by thresholds, without a task that holds it."""
    half = src.head_sample(t.lineitem, t.lineitem.count() // 2, [("l_returnflag", "desc"), "l_quantity", "l_orderkey", "l_linenumber"])
    return half.select("l_orderkey", big("l_linenumber").alias("line"), "l_quantity")


@query(
    "lookup_config",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS meaning FROM orders WHERE o_orderstatus IN ('F', 'O')""",
)
def _(t: Tables) -> DataFrame:
    config = src.lookup_table(t.spark, [("F", "finished"), ("O", "open")], "o_orderstatus string, meaning string")
    return t.orders.join(F.broadcast(config), "o_orderstatus").select("o_orderkey", "meaning")
