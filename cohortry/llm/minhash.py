"""Near-duplicate groups: SuperMinHash signatures, bands, exact verification, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import PIECE, Words, bit_filter, constants, discard, in_blocks, mix, passes, slices, utf8, written
from cohortry.llm.components import connected_components

#: Words in a shingle, per cent of similarity that links, bands and registers in a band. Two texts at the threshold of 85 % miss
#: each other in all bands with a chance of (1 - 0.85 ** 4) ** 32 = 6e-11.
WIDTH, PERCENT, BANDS, ROWS = 5, 85, 32, 4
#: A block of texts that are compared in one task has about so many texts and shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1 << 20
#: Of bands with up to so many sets the pairs are compared that no other band has.
FEW = 6


def shingles(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit numbers of its shingles; a shorter text is one shingle, one without words has none."""
    words, factors = Words(data, bounds), constants(7, width)
    n = len(words.hash)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        rolled += words.hash[j : j + len(rolled)] * factors[j]
    rolled, sets = mix(rolled), []
    for begin, end in zip(words.bounds[:-1], words.bounds[1:]):
        if end - begin >= width:
            sets.append(np.unique(rolled[begin : end - width + 1]))
        elif end > begin:
            whole = (words.hash[begin:end] * factors[: end - begin]).sum(dtype=np.uint64)
            sets.append(mix(np.array([whole ^ np.uint64(end - begin)])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def super_minhash(sets: list[np.ndarray], m: int = BANDS * ROWS, chunk: int = 1 << 15) -> np.ndarray:
    """SuperMinHash (Ertl, 2017): each element gets a permutation of the registers and puts j + U(0, 1) into the j-th of them.

    Registers keep the least. An element stops at step j once all registers of its set are at most j, as later values are larger.
    All elements of a chunk take a step together; the order of elements doesn't change the result.
    """
    seeds = constants(11, 2 * m)
    held = np.full((len(sets), m), np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for begin in range(0, len(values), chunk):
        x, who = values[begin : begin + chunk], owner[begin : begin + chunk]
        order = np.tile(np.arange(m, dtype=np.uint16), (len(x), 1))
        for j in range(m):
            own = np.arange(who[0], who[-1] + 1)
            alive = (held[own].max(axis=1) > j)[who - who[0]]
            if not alive.all():
                x, who, order = x[alive], who[alive], order[alive]
                if not len(x):
                    break
            draw = (mix(x ^ seeds[2 * j]) >> np.uint64(11)).astype(np.float64) / 9007199254740992.0
            k = j + ((mix(x ^ seeds[2 * j + 1]) >> np.uint64(32)).astype(np.int64) * (m - j) >> 32)
            line = np.arange(len(x))
            chosen = order[line, k]
            order[line, k] = order[:, j]
            np.minimum.at(held, (who, chosen), draw + j)
    return held


def _fingerprints(sets: list[np.ndarray]) -> pa.Array:
    """128 bits of each set; equal sets have equal ones. Null for an empty set."""
    seeds = constants(13, 2)
    return pa.array([np.array([mix(s ^ c).sum(dtype=np.uint64) for c in seeds]).tobytes() if len(s) else None for s in sets], pa.binary())


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, fp`` (128 bits of the set, null if empty) and ``bands`` (a number for each band, null if empty)."""
    factors, numbers = constants(17, ROWS), constants(19, BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            sets = shingles(*utf8(batch.column("text")))
            held = super_minhash(sets).view(np.uint64).reshape(len(sets), BANDS, ROWS)
            bands = mix((mix(held) * factors).sum(axis=2, dtype=np.uint64) + numbers).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), _fingerprints(sets),
                 pa.array([b if len(s) else None for b, s in zip(bands, sets)], pa.list_(pa.int64()))],
                ["id", "n_shingles", "fp", "bands"],
            )

    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, n_shingles long, fp binary, bands array<long>")


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _of_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between a pivot and the sets around it, by exact counts on whole sets; a pivot comes before the sets around it."""
    pivot, middle = None, np.zeros(0, np.uint64)
    for batch in batches:
        found = []
        for fp, near, raw in zip(*(batch.column(c).to_pylist() for c in ("fp", "pivot", "shingles"))):
            own = np.frombuffer(raw, np.uint64)
            if fp == near:
                pivot, middle = near, own
            elif near == pivot and _similar(middle, own):
                found.append((fp, near))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])


def _verified(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links within one block, or between two, of sets that aren't of one tree yet: a spanning forest of them, by exact counts on whole sets."""
    pdf = pdf.drop_duplicates("fp").sort_values("fp")
    sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
    fps, part, tree = pdf["fp"].tolist(), pdf["part"].to_numpy(), pdf["tree"].to_numpy()
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    both = np.zeros((len(sets), len(sets)))
    step = 4096
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (begin, begin + step))
        has = np.zeros((len(sets), step), np.float32)
        has[owner[a:b], column[a:b] - begin] = 1
        both += has @ has.T
    linked = 100 * both >= PERCENT * (n[:, None] + n[None, :] - both)
    linked &= tree[:, None] != tree[None, :]
    if key[-2] != key[-1]:
        linked &= part[:, None] != part[None, :]
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((fps[i], fps[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Words are split at white space, A-Z counts as a-z; the set of a text is its distinct shingles of five words (all words if fewer).
    Two texts are linked if 100 * intersection >= 85 * union; ``component_id`` is the least id reachable over links, ``kept`` says
    whether that is the row's own. Equal sets are one node from the start, so that copies cost nothing more. Sets that share a band
    (of SuperMinHash registers) are candidates, and only those are compared, exactly and on whole sets: first each with one of its band
    (the pivot), then, in bands whose sets are not all of one tree of links by that, those of different trees: each pair once where a
    band has a few sets, in blocks else (bands of much the same sets together). So a group of near copies takes one comparison a set, and chains of bands are never compared from
    end to end.

    Null or wordless texts: n_shingles 0, linked with nothing. Null id: the row stands alone, component null, kept. Rows with one id
    and the same text are one document; with one id and other texts each text is linked on its own. Other columns are not looked at.
    """
    rows = written(signatures(docs, doc_id, text), "signatures")
    known = rows.where("fp is not null and id is not null")
    # the bands of equal sets are equal
    classes = written(known.groupBy("fp").agg(F.min("id").alias("id"), F.max("n_shingles").alias("n"), F.max("bands").alias("bands")), "classes")
    banded = classes.select("fp", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").drop("sets")
    crowded = written(banded.join(shared, "band"), "crowded")
    pivots = crowded.groupBy("band").agg(F.min("fp").alias("pivot"))
    stars = written(crowded.join(pivots, "band").where("fp <> pivot").select("fp", "pivot", "n").distinct(), "stars")
    sets = _sets(docs, doc_id, text, crowded.select("fp").distinct().join(classes.select("fp", "id"), "fp"))

    trees = connected_components(_linked_to_pivots(stars, sets), "a", "b").withColumnRenamed("component", "tree")

    labelled = crowded.join(trees, F.col("fp") == F.col("node"), "left").select("band", "fp", "n", F.coalesce("tree", "fp").alias("tree"))
    marks = [F.bit_xor(F.xxhash64(F.lit(s), "fp", "tree")).alias(f"x{s}") for s in (0, 1)]
    ends = labelled.groupBy("band").agg(F.count(F.lit(1)).alias("sets"), *marks, F.min(F.xxhash64("tree")).alias("lo"), F.max(F.xxhash64("tree")).alias("hi"))
    # of bands with the same sets one is enough
    mixed = ends.where("lo <> hi").groupBy("sets", "x0", "x1").agg(F.min("band").alias("band")).select("band", "sets")
    mixed = written(labelled.join(mixed, "band"), "mixed")
    # a few sets: each pair once, however many bands it shares
    few = mixed.where(F.col("sets") <= FEW).groupBy("band").agg(F.array_sort(F.collect_list(F.struct("fp", "tree", "n"))).alias("own"))
    pairs = few.select("own", F.explode("own").alias("x")).select("x", F.explode(F.filter("own", lambda y: (y["fp"] < F.col("x.fp")) & (y["tree"] != F.col("x.tree")))).alias("y"))
    pairs = pairs.select("x.fp", F.col("y.fp").alias("pivot"), "x.n").distinct()
    mixed_many = _merged(mixed.where(F.col("sets") > FEW).drop("sets"))
    most = mixed_many.groupBy("band", "tree").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.max_by("tree", F.struct("c", "tree")).alias("main"))
    work = in_blocks(mixed_many.join(most, "band"), ["band"], F.col("tree") == F.col("main"), _load(), "fp").select("band", "lo", "hi", "part", "fp", "tree")
    second = work.join(sets, "fp").groupBy("band", "lo", "hi").applyInPandas(_verified, "a binary, b binary")
    second = second.unionByName(_linked_to_pivots(written(pairs, "pairs"), sets))
    joined = second.join(trees.select(F.col("node").alias("a"), F.col("tree").alias("ta")), "a", "left").join(trees.select(F.col("node").alias("b"), F.col("tree").alias("tb")), "b", "left")
    over = connected_components(joined.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")), "a", "b")
    discard(crowded, stars, sets, mixed)

    linked = classes.select("fp", "id").join(trees, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("tree", "fp").alias("tree"), F.col("tree").isNotNull().alias("linked"))
    linked = linked.join(over, F.col("tree") == F.col("node"), "left").where("linked or node is not null").select("fp", "id", F.coalesce("component", "tree").alias("component"))
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    linked = linked.join(least, "component").select("fp", "least")
    labels = classes.select("fp", "id").join(linked, "fp", "left").select("fp", F.coalesce("least", "id").alias("label"))
    found = rows.select("id", "n_shingles", "fp").join(labels, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "id"))
    return found.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _merged(bands: DataFrame) -> DataFrame:
    """``band, fp, n, tree``: bands with the same least set become one where that gives no more pairs than they have one by one.

    Near copies share most of their bands, so their pairs are compared once rather than once for each band. No pair is lost.
    """
    each = bands.groupBy("band").agg(F.min("fp").alias("pivot"), F.count(F.lit(1)).alias("sets"))
    placed = bands.join(each, "band")
    alone = each.groupBy("pivot").agg(F.sum(F.col("sets") * F.col("sets")).alias("pairs"), F.min("band").alias("into"))
    whole = placed.select("pivot", "fp").distinct().groupBy("pivot").agg(F.count(F.lit(1)).alias("all"))
    chosen = alone.join(whole, "pivot").select("pivot", F.when(F.col("all") * F.col("all") <= F.col("pairs"), F.col("into")).alias("into"))
    return placed.join(chosen, "pivot").select(F.coalesce("into", "band").alias("band"), "fp", "n", "tree").distinct()


def _load() -> Column:
    return F.greatest(F.lit(1.0 / BLOCK_TEXTS), F.col("n") / float(BLOCK_SHINGLES))


def _linked_to_pivots(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: the links among the pairs ``fp, pivot`` (``n`` shingles in the set of fp); a pivot with many sets around it is dealt to several tasks."""
    parts = stars.groupBy("pivot").agg(F.ceil(F.sum(_load())).alias("parts"))
    around = stars.join(parts, "pivot").select("fp", "pivot", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))
    middle = parts.select(F.col("pivot").alias("fp"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    star = around.unionByName(middle).join(sets, "fp").select("fp", "pivot", "part", "shingles")
    star = star.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.col("fp") != F.col("pivot"))
    return star.mapInArrow(_of_stars, "a binary, b binary")


def _sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``fp, shingles`` of the wanted sets (``fp, id``), each from the text of its id; written."""
    bits = bit_filter(wanted.select(F.xxhash64("id").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch.filter(pa.array(passes(bits, batch.column("h").to_numpy().view(np.uint64))))
            for part in slices([chosen], "text", PIECE):
                sets = shingles(*utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("asked"), _fingerprints(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["asked", "made", "shingles"])

    asked = docs.select(F.col(doc_id).alias("asked"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("h"))
    made = asked.mapInArrow(run, f"asked {dict(asked.dtypes)['asked']}, made binary, shingles binary")
    found = wanted.join(made, (F.col("fp") == F.col("made")) & (F.col("id") == F.col("asked")))
    # rows that repeat an id and its text give the set again
    return written(found.groupBy("fp").agg(F.first("shingles").alias("shingles")), "sets")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, all columns. Rows without an id stay; rows of one id count as one document."""
    gone = near_duplicates(docs, doc_id, text).where(~F.col("kept")).select(F.col(doc_id).alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
