"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one vector kept of each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import in_blocks, written
from cohortry.llm.components import connected_components

COSINE = 0.93
#: A vector is a member of the cells of its PROBES nearest centroids; two vectors are compared if they share a cell.
PROBES = 4
#: Vectors for each centroid (more where the bounds below ask for it), the most centroids of all labels and of one label, and the most
#: bytes of centroids and of the sample that one label's centroids are fitted on.
TARGET, MOST_CELLS, MOST_OF_LABEL, MOST_BYTES = 512, 1 << 16, 1 << 12, 64 << 20
#: Vectors that are compared with each other in one task, and sampled vectors for each centroid.
BLOCK, SAMPLED, ROUNDS = 4096, 16, 6


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, cosine: float = COSINE) -> np.ndarray:
    """At most ``k`` unit centroids of unit vectors ``x``, beginning with the first k.

    Of centroids nearer to each other than half the angle of a link only the one with more vectors stays, so that a group of near
    copies has one centroid however large it is.
    """
    centres = x[:k].copy()
    sizes = np.ones(len(centres))
    for _ in range(ROUNDS):
        home = np.concatenate([(x[b : b + 4096] @ centres.T).argmax(axis=1) for b in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        sizes = np.bincount(home, minlength=len(centres)).astype(float)
        length = np.sqrt((sums * sums).sum(axis=1))
        moved = length > 1e-9
        centres[moved] = sums[moved] / length[moved, None]
    order = np.argsort(-sizes, kind="stable")
    centres, near, kept = centres[order], np.cos(np.arccos(cosine) / 2), []
    for i in range(len(centres)):
        if not kept or (centres[kept] @ centres[i]).max() < near:
            kept.append(i)
    return centres[kept]


def _memberships(x: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell, whether the vector is in its core, and member cells (-1 for none) of unit vectors.

    A cell is left out if no vector that near could be at home there: the vector is farther than a link from the plane between both
    centroids. Two vectors of a core are nearer to their centroid than half the angle of a link, hence linked.
    """
    inner = x @ centres.T
    probes = min(PROBES, len(centres))
    cells = np.argsort(-inner, axis=1, kind="stable")[:, :probes]
    home = cells[:, 0]
    at_home = inner[np.arange(len(x)), home]
    gap = at_home[:, None] - np.take_along_axis(inner, cells, axis=1)
    apart = np.linalg.norm(centres[home][:, None, :] - centres[cells], axis=2)
    cells = np.where(gap <= np.sqrt(1 - cosine**2) * apart + 1e-9, cells, -1)
    return home, at_home >= np.cos(np.arccos(cosine) / 2) + 1e-9, cells


def _hang(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of i and j for all pairs; every node points at its root before and after."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root[:] = above


def _compared(cosine: float, kind: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, lo, hi = key[1:4]
        pdf = pdf.sort_values("fp")
        x = _unit(np.frombuffer(b"".join(pdf["x"]), kind).reshape(len(pdf), -1))
        n, core, home, part = (pdf[c].to_numpy() for c in ("n", "core", "home", "part"))
        cells = np.stack(pdf["cells"].to_numpy())
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for begin in range(0, len(left), 512):
            rows = left[begin : begin + 512]
            i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
            i, j = rows[i], right[j]
            own = (i != j) & ~(core[i] & core[j] & (home[i] == home[j]))
            i, j = i[own], j[own]
            # pairs that share a lower cell are counted there
            first = np.ones(len(i), bool)
            for p in range(cells.shape[1]):
                for q in range(cells.shape[1]):
                    first &= ~((cells[i, p] == cells[j, q]) & (cells[i, p] >= 0) & (cells[i, p] < cell))
            i, j = i[first], j[first]
            np.add.at(links, i, n[j])
            if lo != hi:
                np.add.at(links, j, n[i])
            _hang(root, i, j)
        fps = pdf["fp"].to_numpy()
        hit = np.flatnonzero(links)
        return pd.DataFrame({"fp": fps[hit], "links": links[hit], "pivot": fps[root[hit]]})

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row: vectors of one label with a cosine of at least ``cosine`` are linked.

    Equal vectors are one node with a number of copies from the start. Labels with more than TARGET vectors get centroids, fitted on a
    sample of bounded size. Every vector joins the cells of its nearest centroids; within a cell all are compared in double precision,
    in blocks if there are many, each pair in the first cell it shares. The vectors around a centroid that are so near that all of
    them are linked (its core) are counted and hung on one of them instead, so that a group of near copies costs no square. Found links
    are exact. A pair with a cosine of exactly 0.93 shares a cell with a chance of 0.99 or more if its direction is random in 64
    dimensions, nearer ones more often; links of copies and within a core are never missed.

    ``n_links`` counts other rows; ``component_id`` is the least id reachable over links, itself included. Vectors that are null,
    empty or zero, hold null or non-finite components, or have a null label are linked with nothing; vectors of several lengths are
    never linked. Null ids: the row stands alone, component null, kept. Rows with one id count one by one. Other columns are not
    looked at; an empty table gives no rows.
    """
    v = F.col("v")
    good = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v"), F.col(label).cast("string").alias("label"))
    rows = rows.withColumn("grp", F.when(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)), F.concat_ws(":", F.size("v"), "label")))
    rows = rows.withColumn("grp", F.when(F.col("label").isNotNull(), F.col("grp")))
    named = F.concat_ws(":", F.xxhash64("v"), F.xxhash64(F.lit(1), "v"), "grp")
    rows = rows.select("id", "v", "grp", F.when(F.col("grp").isNotNull(), F.unhex(F.md5(named))).alias("fp"))
    known = rows.where("grp is not null")
    kind = "<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8"
    if kind == "<f8":
        known = known.withColumn("v", F.col("v").cast("array<double>"))

    classes = written(_assigned(known, _centroids(known, cosine), kind, cosine), "assigned")
    member = classes.withColumn("cell", F.explode(F.filter("cells", lambda c: c >= 0)))
    # vectors of a core are compared with others only
    inner = F.col("core") & (F.col("home") == F.col("cell"))
    work = in_blocks(member, ["grp", "cell"], inner, F.lit(1.0 / BLOCK), "fp")
    work = work.select("grp", "cell", "lo", "hi", "part", "fp", "n", "core", "home", "cells", "x")
    found = work.groupBy("grp", "cell", "lo", "hi").applyInPandas(_compared(cosine, kind), "fp binary, links long, pivot binary")
    found = written(found, "links")

    cores = classes.where("core").groupBy("grp", "home").agg(F.min("fp").alias("pivot"), F.sum("n").alias("m"))
    hung = classes.where("core").select("grp", "home", "fp", "n").join(cores, ["grp", "home"])
    hung = hung.select("fp", (F.col("m") - F.col("n")).alias("links"), "pivot").where("links > 0")
    every = found.unionByName(hung)
    linked = connected_components(every, "fp", "pivot").join(classes.select("fp", "id"), F.col("node") == F.col("fp"))
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    linked = linked.join(least, "component").select("fp", "least")
    counts = every.groupBy("fp").agg(F.sum("links").alias("links"))
    results = classes.select("fp", "id", "n").join(counts, "fp", "left").join(linked, "fp", "left")
    results = results.select("fp", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "id").alias("least"))
    out = rows.select("id", "fp").join(results, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select(F.col("id").alias(vec_id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _centroids(known: DataFrame, cosine: float) -> dict[str, np.ndarray]:
    """Unit centroids of each label that has more than TARGET vectors. All of them have at most MOST_BYTES."""
    sizes = known.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.max(F.size("v")).alias("dim"))
    total, dim = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    target = max(TARGET, -(-total // min(MOST_CELLS, max(1, MOST_BYTES // (8 * dim)))))
    most = max(8, min(MOST_OF_LABEL, MOST_BYTES // (8 * dim * SAMPLED)))
    wanted = sizes.where(F.col("size") > target).withColumn("k", F.least(F.ceil(F.col("size") / target), F.lit(most)).cast("int"))
    draw = F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) / float(1 << 20) < F.col("k") * SAMPLED / F.col("size")
    sample = known.join(F.broadcast(wanted.select("grp", "k", "size")), "grp").where(draw)
    sample = sample.groupBy("grp", "fp").agg(F.first("k").alias("k"), F.first("v").alias("v"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        centres = spherical_kmeans(_unit(np.stack(pdf["v"].to_numpy())), int(pdf["k"].iloc[0]), cosine)
        return pd.DataFrame({"grp": key[0], "c": [c.tobytes() for c in centres]})

    found: dict[str, list] = {}
    for grp, c in sample.groupBy("grp").applyInPandas(fit, "grp string, c binary").toPandas().itertuples(index=False):
        found.setdefault(grp, []).append(np.frombuffer(c))
    return {grp: np.array(sorted(map(tuple, c))) for grp, c in found.items()}


def _assigned(known: DataFrame, centroids: dict[str, np.ndarray], kind: str, cosine: float) -> DataFrame:
    """One row for each distinct vector of a label: ``fp, id`` (the least), ``n`` copies, ``grp, x, home, core, cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = np.array(batch.column("grp").to_pylist(), object)
            home, core, cells = np.zeros(len(grp), np.int32), np.zeros(len(grp), bool), np.full((len(grp), PROBES), -1, np.int32)
            cells[:, 0] = 0
            packed: list[bytes] = [b""] * len(grp)
            for one in sorted(set(grp)):
                at = np.flatnonzero(grp == one)
                raw = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), -1)
                for i, x in zip(at, raw):
                    packed[i] = x.tobytes()
                if one in centroids:
                    home[at], core[at], found = _memberships(_unit(raw), centroids[one], cosine)
                    cells[at, : found.shape[1]] = found
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(grp) + 1) * PROBES, pa.int32()), pa.array(cells.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp"), batch.column("id"), batch.column("n"), batch.column("grp"), pa.array(packed, pa.binary()), pa.array(home), pa.array(core), lists],
                ["fp", "id", "n", "grp", "x", "home", "core", "cells"],
            )

    folded = known.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("grp").alias("grp"), F.first("v").alias("v"))
    kinds = dict(folded.dtypes)
    return folded.mapInArrow(run, f"fp binary, id {kinds['id']}, n long, grp string, x binary, home int, core boolean, cells array<int>")


def drop_near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``vectors`` with one of each group, all columns. Rows without an id stay; rows of one id count as one."""
    gone = near_vectors(vectors, vec_id, embedding, label, cosine).where(~F.col("kept")).select(F.col(vec_id).alias("__gone")).distinct()
    return vectors.join(gone, vectors[vec_id] == gone["__gone"], "left_anti")
