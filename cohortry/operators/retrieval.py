"""Exact nearest neighbours through an index of pivots.

Documents are dealt to their nearest pivot and stored in blocks of one cell, in order of their distance to the
pivot.  A query looks in the cells around it first; the distance of its k-th hit there then bounds what any other
cell or block can hold, by the triangle inequality, and the rest is skipped.  Nothing is estimated: hits are those of
a comparison with every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.session import scratch_path

#: Documents in a block, queries that meet a block together, pivots at most, and sampled documents for each pivot.
BLOCK, CHUNK, MOST_PIVOTS, SAMPLED = 4096, 1024, 1024, 32
#: Bytes of the sample that pivots are fitted on, and of the pivots.
MOST_BYTES = 64 << 20


def _fit(sample: np.ndarray, m: int, rounds: int = 5) -> np.ndarray:
    """At most m centres of the sample, equal ones once."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(0).permutation(len(centres))[:m]]
    for _ in range(rounds):
        home = _to_pivots(sample, centres).argmin(axis=1)
        for i in range(len(centres)):
            own = sample[home == i]
            if len(own):
                centres[i] = own.mean(axis=0)
    return np.unique(centres, axis=0)


def _to_pivots(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2.0 * x @ centres.T
    return np.sqrt(np.maximum(squares, 0.0))


def build_index(docs: DataFrame, doc_id: str, vec: str, path: str, pivots: int | None = None) -> str:
    """Index ``docs`` (rows without a vector are left out) in the folder ``path``.

    ``pivots`` defaults to one for each block of documents.  They are fitted on a sample by hash, of SAMPLED rows for each pivot and MOST_BYTES
    at most; every document is indexed.
    """
    rows = docs.where(F.col(vec).isNotNull()).select(F.col(doc_id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    total, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    m = min(pivots or total // BLOCK, MOST_PIVOTS, MOST_BYTES // (8 * dim * SAMPLED))
    spark = docs.sparkSession
    if m > 1:
        draw = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, m * SAMPLED / total) * (1 << 30))
        held = rows.where(draw).select("v").limit(2 * m * SAMPLED).toPandas()["v"].tolist()
        centres = _fit(np.array(held, float), m) if held else np.zeros((1, dim))
    else:
        centres = np.zeros((1, dim))
    table = [(i, c.tobytes()) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "pivot int, centre binary").coalesce(1).write.parquet(f"{path}/pivots")
    _add_blocks(rows, centres, path, total)
    return path


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
    return np.array([np.frombuffer(r["centre"]) for r in rows])


def _add_blocks(rows: DataFrame, centres: np.ndarray, path: str, total: int) -> None:
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at : at + BLOCK]
                x = np.array(part["v"].tolist(), dtype=np.float64)
                far = _to_pivots(x, centres)
                home = far.argmin(axis=1)
                yield pd.DataFrame({"pivot": home.astype(np.int32), "far": far[np.arange(len(x)), home], "id": part["id"].to_numpy(), "x": [r.tobytes() for r in x]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def block(part: pd.DataFrame) -> pd.DataFrame:
            far = part["far"].to_numpy()
            return pd.DataFrame({
                "pivot": [part["pivot"].iloc[0]], "n": [len(part)], "lo": [far.min()], "hi": [far.max()], "ids": [part["id"].tolist()],
                "far": [far.tobytes()], "vecs": [b"".join(part["x"])],
            })

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) and (held["pivot"].iloc[0] != held["pivot"].iloc[-1] or len(held) >= BLOCK):
                n = min(BLOCK, int((held["pivot"] == held["pivot"].iloc[0]).sum()))
                yield block(held.iloc[:n])
                held = held.iloc[n:]
        if held is not None and len(held):
            yield block(held)

    placed = rows.mapInPandas(place, f"pivot int, far double, id {kind}, x binary")
    if total > BLOCK:
        # ranges of pivot and distance: a cell of any size is spread, and its blocks are rings around the pivot
        placed = placed.repartitionByRange("pivot", "far").sortWithinPartitions("pivot", "far")
    else:
        placed = placed.coalesce(1).sortWithinPartitions("pivot", "far")
    placed.mapInPandas(pack, f"pivot int, n int, lo double, hi double, ids array<{kind}>, far binary, vecs binary").write.mode("append").parquet(f"{path}/blocks")


def extend_index(docs: DataFrame, doc_id: str, vec: str, path: str) -> str:
    """Add to the index the documents whose id it lacks; pivots stay as they are."""
    spark = docs.sparkSession
    known = spark.read.parquet(f"{path}/blocks").select(F.explode("ids").alias("id"))
    rows = docs.where(F.col(vec).isNotNull()).select(F.col(doc_id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    _add_blocks(rows.join(known, "id", "left_anti"), _centres(spark, path), path, BLOCK + 1)
    return path


def _rank_in_block(asked: np.ndarray, docs: np.ndarray, ids: Sequence, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, document and squared distance of the k best documents of a block for each query, those beyond ``reach`` left out."""
    norms, squares = (asked**2).sum(axis=1), (docs**2).sum(axis=1)
    rough = norms[:, None] + squares[None, :] - 2.0 * asked @ docs.T
    slack = 1e-9 * (norms.max() + squares.max() + 1.0)
    edge = reach + slack
    if len(docs) > k:
        edge = np.minimum(edge, np.partition(rough, k - 1, axis=1)[:, k - 1] + slack)
    q, d = np.nonzero(rough <= edge[:, None])
    exact = ((docs[d] - asked[q]) ** 2).sum(axis=1)
    order = np.lexsort((np.asarray(ids)[d], exact, q))
    q, d, exact = q[order], d[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    kept = place < k
    return q[kept], d[kept], exact[kept]


def search_index(queries: DataFrame, query_id: str, vec: str, path: str, k: int = 3, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The k documents of an index with the smallest squared distance for each query, ``query_id, doc_id, distance, rank``; equal distances
    go to the smaller id.  And the report ``query_id, cells, cells_met, docs, docs_met``: how much of the index each query looked at.

    First the cells nearest to the query that hold k documents are searched, then all cells and blocks that its k-th distance doesn't
    rule out.  Pairs of cell and query are joined by cell; Spark sends the smaller side or splits large cells.
    """
    spark = queries.sparkSession
    centres, blocks = _centres(spark, path), spark.read.parquet(f"{path}/blocks")
    cells = blocks.groupBy("pivot").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
    n, lo, hi = np.zeros(len(centres), np.int64), np.full(len(centres), np.inf), np.zeros(len(centres))
    at = cells["pivot"].to_numpy(np.int64)
    n[at], lo[at], hi[at] = cells["n"].to_numpy(np.int64), cells["lo"].to_numpy(float), cells["hi"].to_numpy(float)
    apart = _to_pivots(centres, centres)
    asked = queries.where(F.col(vec).isNotNull()).select(F.col(query_id).alias("qid"), F.col(vec).cast("array<double>").alias("v"))
    kind, id_kind = (s.dataType.simpleString() for s in (asked.schema["qid"], blocks.schema["ids"]))
    id_kind = id_kind[len("array<") : -1]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nearest cells that hold k documents."""
        for batch in batches:
            x = np.array(batch["v"].tolist(), dtype=np.float64).reshape(len(batch), -1)
            if not len(x):
                continue
            far = _to_pivots(x, centres)
            far[:, n == 0] = np.inf
            order = np.argsort(far, axis=1, kind="stable")
            need = (np.cumsum(n[order], axis=1) < k).sum(axis=1)
            rows = [(i, order[i, j]) for i in range(len(x)) for j in range(min(need[i] + 1, int((n > 0).sum())))]
            q = np.array([r[0] for r in rows], np.int64)
            yield pd.DataFrame({"qid": batch["qid"].to_numpy()[q], "q": [x[i].tobytes() for i in q], "pivot": np.array([r[1] for r in rows], np.int32), "reach": math.inf})

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells that the first hits don't rule out; a cell is the region nearer to its pivot than to any other, between two spheres."""
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch["v"].tolist(), dtype=np.float64).reshape(len(batch), -1)
            reach = np.sqrt(batch["reach"].to_numpy(float))
            far = _to_pivots(x, centres)
            near = far.argmin(axis=1)
            least = np.maximum(0.0, np.maximum(lo - far, far - hi))
            plane = np.where(apart[near] > 0, (far**2 - far[np.arange(len(x)), near][:, None] ** 2) / (2 * np.maximum(apart[near], 1e-300)), 0.0)
            least = np.maximum(least, plane)
            slack = 1e-7 * (1.0 + far)
            open_ = (n > 0) & (least <= reach[:, None] + slack)
            for i, met in enumerate(batch["met"]):
                open_[i, np.asarray(met, np.int64)] = False
            q, pivot = np.nonzero(open_)
            yield pd.DataFrame({"qid": batch["qid"].to_numpy()[q], "q": [x[i].tobytes() for i in q], "pivot": pivot.astype(np.int32), "reach": batch["reach"].to_numpy(float)[q]})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pivot, part in batch.groupby("pivot", sort=True):
                for begin in range(0, len(part), CHUNK):
                    own = part.iloc[begin : begin + CHUNK]
                    yield pd.DataFrame({"pivot": [pivot], "qids": [own["qid"].tolist()], "qs": [b"".join(own["q"])], "reach": [own["reach"].to_numpy(float).tobytes()]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                reach, x = np.frombuffer(row.reach), np.frombuffer(row.qs).reshape(len(row.qids), -1)
                far = _to_pivots(x, centres[row.pivot][None, :])[:, 0]
                held = np.maximum(row.lo - far, far - row.hi) <= np.sqrt(reach) + 1e-7 * (1.0 + far)
                if held.any():
                    docs = np.frombuffer(row.vecs).reshape(len(row.ids), -1)
                    q, d, distance = _rank_in_block(x[held], docs, row.ids, k, reach[held])
                    yield pd.DataFrame({"qid": np.asarray(row.qids)[held][q], "id": np.asarray(row.ids)[d], "distance": distance, "met": 0})
                yield pd.DataFrame({"qid": np.asarray(row.qids)[held], "id": [None] * int(held.sum()), "distance": np.nan, "met": row.n})

    pair = f"qid {kind}, q binary, pivot int, reach double"

    def searched(pairs: DataFrame) -> DataFrame:
        packed = pairs.mapInPandas(chunks, f"pivot int, qids array<{kind}>, qs binary, reach binary")
        return blocks.join(packed, "pivot").mapInPandas(meet, f"qid {kind}, id {id_kind}, distance double, met int")

    begin = asked.mapInPandas(first, pair)
    found = searched(begin)
    visited = begin.groupBy("qid").agg(F.collect_set("pivot").alias("met"))
    cells_met = visited.select("qid", F.size("met").alias("cells_met"))
    if len(cells) > 1:
        found = spark.read.parquet(_written(found, "first"))
        order = Window.partitionBy("qid").orderBy("distance", "id")
        ranked = found.where("id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
        bound = ranked.select("qid", F.col("distance").alias("reach"))
        bounded = asked.join(visited, "qid").join(bound, "qid", "left").withColumn("reach", F.coalesce("reach", F.lit(math.inf)))
        more = spark.read.parquet(_written(bounded.mapInPandas(others, pair), "pairs"))
        found = found.unionByName(searched(more))
        later = more.groupBy("qid").agg(F.count(F.lit(1)).alias("more"))
        cells_met = cells_met.join(later, "qid", "left").select("qid", (F.col("cells_met") + F.coalesce("more", F.lit(0))).alias("cells_met"))
    order = Window.partitionBy("qid").orderBy("distance", "id")
    hits = found.where("id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    hits = hits.select(F.col("qid").alias(query_id), F.col("id").alias(doc_id), "distance", "rank")
    docs_met = found.where("id is null").groupBy("qid").agg(F.sum("met").alias("docs_met"))
    report = cells_met.join(docs_met, "qid", "left").select(
        F.col("qid").alias(query_id), F.lit(len(cells)).alias("cells"), "cells_met", F.lit(int(n.sum())).cast("long").alias("docs"), F.coalesce("docs_met", F.lit(0)).cast("long").alias("docs_met")
    )
    return hits, report


def _written(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def top_k_similar(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, vec: str, k: int = 3) -> DataFrame:
    """The k documents with the smallest squared distance per query: ``query_id, doc_id, distance, rank``.

    Through an index of ``docs`` in the shared scratch folder; keep one with ``build_index`` where documents are searched again.
    Rows without a vector are left out.
    """
    path = build_index(docs, doc_id, vec, scratch_path(docs.sparkSession, "index"))
    return search_index(queries, query_id, vec, path, k, doc_id)[0]


def retrieved_context(hits: DataFrame, docs: DataFrame, query_id: str, doc_id: str, text: str) -> DataFrame:
    """Texts of the hits in rank order, joined by a blank line: ``context``."""
    held = hits.join(docs.select(doc_id, text), doc_id)
    items = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    return held.groupBy(query_id).agg(F.array_join(F.transform(items, lambda e: e["t"]), "\n\n").alias("context"))
