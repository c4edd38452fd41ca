"""CSV whose quoted cells hold line breaks, read in byte ranges.

Spark cuts a file at line breaks; a range may begin inside a quoted cell.  The number of quotes in a range is odd or even,
and the parities of all ranges before it say whether it begins inside a cell.  Then each range puts the lines of its records
together by itself; what a range's edge cuts is joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces of records at the edges of a range: the end of one that began before, the beginning of one, lines inside of one.
END, BEGIN, INSIDE = 1, 2, 3
_OUT = "record string, file string, begin long, kind int"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records (kind 0) and pieces of those that an edge cuts, from the lines of ranges in their order."""
    at: tuple | None = None
    odd, from_before, held = False, False, []

    def left() -> list[tuple]:
        if not held or at is None:
            return []
        return [("\n".join(held), *at, INSIDE if from_before else BEGIN)]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["record", "file", "begin", "kind"])

    for batch in batches:
        rows: list[tuple] = []
        files, begins, inside = (batch.column(c).to_pylist() for c in ("file", "begin", "inside"))
        lines, quotes = batch.column("value").to_pylist(), batch.column("quotes").to_numpy()
        edges = [0, *(i for i in range(1, len(lines)) if begins[i] != begins[i - 1] or files[i] != files[i - 1]), len(lines)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if (files[a], begins[a]) != at:
                rows += left()
                at, odd, from_before, held = (files[a], begins[a]), bool(inside[a]), bool(inside[a]), []
            state = (np.cumsum(quotes[a:b]) + odd) % 2
            first = a
            for end in (np.flatnonzero(state == 0) + a).tolist():
                if first == end and not held:
                    rows.append((lines[end], *at, END if from_before else 0))
                else:
                    rows.append(("\n".join([*held, *lines[first : end + 1]]), *at, END if from_before else 0))
                    held = []
                first, from_before = end + 1, False
            held += lines[first:b]
            odd = bool(state[-1])
        yield table(rows)
    yield table(left())


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``record, file, begin``: each CSV record of the files at ``path`` as text, with the place of the range it was put together in.

    A quote in a cell is written twice, as CSV asks; so quotes outside of cells come in pairs.  A file that ends inside a cell gives its
    rest as a record.  Of each range one row (its place and parity) is sent to all tasks.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    lines = scan.select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("begin"), "value",
        (F.length("value") - F.length(F.translate("value", '"', ""))).alias("quotes"),
    )
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("file", "begin").agg((F.sum("quotes") % 2).alias("odd"))
    ranges = ranges.select("file", "begin", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # the broadcast join keeps the order of the lines
    placed = lines.join(F.broadcast(ranges), ["file", "begin"]).select("file", "begin", "inside", "value", "quotes")
    found = placed.mapInArrow(_records, _OUT)
    cut = found.where("kind > 0")
    order = Window.partitionBy("file").orderBy("begin", "kind").rowsBetween(Window.unboundedPreceding, 0)
    chained = cut.withColumn("chain", F.last(F.when(F.col("kind") == BEGIN, F.col("begin")), ignorenulls=True).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("begin", "kind", "record")))
    joined = chained.groupBy("file", "chain").agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"))
    return found.where("kind = 0").select("record", "file", "begin").unionByName(joined.select("record", "file", F.col("chain").alias("begin")))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed scan of CSV files with a header, in byte ranges; ``schema`` names the columns as they stand in the file.

    Rows are those of Spark's own reader with ``multiLine``.  Headers are the first records of files and are left out.
    """
    records = quoted_records(spark, path).withColumn("record", F.regexp_replace("record", "\r$", ""))
    header = spark.read.option("lineSep", "\n").text(path).limit(1).first()
    head = header[0].removesuffix("\r") if header is not None else ""
    kept = records.where((F.trim("record") != "") & ~((F.col("begin") == 0) & (F.col("record") == F.lit(head))))
    options = {"escape": '"', "multiLine": "true"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return kept.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
