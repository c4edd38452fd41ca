"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import WORD_RE, written

#: Groups, and pieces of large groups, are placed in so many bundles by their hash.
BUNDLES = 1 << 14
#: A piece holds at most this share of a shard.
PIECE = 1 / 64
#: So many sets of shards are filled at once; more shards take several levels.
FAN = 64
#: Rows of a shard are numbered in so many parts, whose sizes give each part's first number.
PARTS = 512


def place(vectors: np.ndarray, shards: int | np.ndarray) -> np.ndarray:
    """The shard of each item: largest items first, each where the dot product with the residual capacity is highest.

    ``shards`` is their number, or the capacity of each in shards.
    """
    room = np.ones(shards) if isinstance(shards, int) else shards.astype(float)
    total = np.maximum(vectors.sum(axis=0), 1)
    need = vectors / total * room.sum()
    left = np.repeat(room[:, None], vectors.shape[1], axis=1)
    chosen = np.zeros(len(need), np.int64)
    # bytes come first among equals, as shards are read by bytes
    weight = np.array([8.0] + [1.0] * (vectors.shape[1] - 1))
    for i in np.argsort(-(need * weight).max(axis=1), kind="stable"):
        best = int(np.argmax(left @ (need[i] * weight)))
        chosen[i] = best
        left[best] -= need[i]
    return chosen


def _children(first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """First shards and numbers of shards of at most FAN sets that ``count`` shards from ``first`` on are dealt in."""
    fan = min(FAN, count)
    counts = count // fan + (np.arange(fan) < count % fan)
    return first + np.cumsum(counts) - counts, counts


def _placed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Bundles of a set of shards to its parts."""
    first, counts = _children(*key)
    pdf = pdf.sort_values("bundle")
    chosen = place(pdf[["size", "tokens", "n"]].to_numpy(float), counts)
    return pd.DataFrame({"first": key[0], "count": key[1], "bundle": pdf["bundle"], "to_first": first[chosen], "to_count": counts[chosen]})


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, tokens, text_crc32, shard, slot`` for each row of ``docs``.

    Size: UTF-8 bytes of the text plus one, null as empty. Equal texts are a group, which goes to one shard unless it holds more than
    a 64th of a shard: such a group is cut by the hash of its ids in pieces of that size. Groups and pieces are gathered by hash in a
    fixed number of bundles, which a task places by vectors of bytes, tokens and rows. More than 64 shards are filled in levels: sets of
    shards first, then each set on its own, so that no task and not the driver places more than the bundles of one set. Slots number the
    rows of a shard from 0, by part of the shard, then id, crc and size, so that no task orders a whole shard; equal rows are
    interchangeable. Null ids count as one id. Empty in, empty out.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.regexp_count(whole, F.lit(WORD_RE)).cast("long").alias("tokens"),
        F.crc32(whole.cast("binary")).alias("crc"), F.unhex(F.md5(whole)).alias("grp"),
    )
    rows = written(rows, "rows")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
    groups = written(rows.groupBy("grp").agg(*sums), "groups")
    total = groups.agg(F.sum("size"), F.sum("tokens"), F.sum("n")).first()
    share = F.greatest(*(F.col(c) / F.lit(float(max(t or 0, 1))) for c, t in zip(("size", "tokens", "n"), total)))
    # a group above the share of a piece: at most 3 * shards / PIECE of them
    pieces = F.least(F.ceil(share * (shards / PIECE)), F.col("n")).cast("int")
    large = share * (shards / PIECE) > 1
    rows = rows.join(groups.where(large).select("grp", pieces.alias("pieces")), "grp", "left")
    rows = rows.withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id", F.lit(3)), F.col("pieces")), F.lit(0)).cast("int"))
    cut = rows.where("pieces is not null").groupBy("grp", "piece").agg(*sums)
    units = written(groups.where(~large).select("grp", F.lit(0).alias("piece"), "size", "tokens", "n").unionByName(cut), "units")

    begin = {"first": F.lit(0).cast("long"), "count": F.lit(shards).cast("long")}
    rows, units, most, level = rows.withColumns(begin), units.withColumns(begin), shards, 0
    while most > 1:
        bundle = F.pmod(F.xxhash64("grp", "piece", F.lit(level)), F.lit(BUNDLES))
        units, rows = units.withColumn("bundle", bundle), rows.withColumn("bundle", bundle)
        placed = units.groupBy("first", "count", "bundle").agg(*(F.sum(c).alias(c) for c in ("size", "tokens", "n")))
        placed = placed.groupBy("first", "count").applyInPandas(_placed, "first long, count long, bundle long, to_first long, to_count long")
        placed = written(placed, "placed")
        # as many rows as bundles for each set of shards; Spark sends them to all tasks where they are few
        moved = {"first": F.col("to_first"), "count": F.col("to_count")}
        units, rows = (x.join(placed, ["first", "count", "bundle"]).withColumns(moved).drop("to_first", "to_count", "bundle") for x in (units, rows))
        most, level = -(-most // FAN), level + 1
    rows = rows.withColumn("shard", F.col("first").cast("int")).drop("first", "count")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "crc", F.lit(5)), F.lit(PARTS)))
    return numbered(rows).select(F.col("id").alias(doc_id), "size", "tokens", F.col("crc").alias("text_crc32"), "shard", "slot")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... in each shard, part by part."""
    from pyspark.sql import Window

    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "size")))
    # one row for each shard and part
    joined = ranked.join(F.broadcast(first), ["shard", "part"])
    return joined.withColumn("slot", (F.col("first") + F.col("rank") - 1).cast("long"))
