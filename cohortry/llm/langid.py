"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import mix, slices

#: Entries of a vector, and letters in an n-gram.
DIM, GRAM = 1024, 3
#: Of four parts of the documents by crc32 of their id, the one that is never learned from.
PARTS, HELD_OUT = 4, 2
UNKNOWN = "und"

class Letters:
    """Which code points are letters; the table is as long as the highest one asked for."""

    def __init__(self) -> None:
        self.table = np.zeros(0, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        top = int(points.max(initial=0)) + 1
        if top > len(self.table):
            self.table = np.array([chr(i).isalpha() for i in range(top)])
        return self.table[points]


def _letter_vectors(points: np.ndarray) -> np.ndarray:
    """A random vector of +1 and -1 for each code point, the same in every task."""
    words = np.arange(1, DIM // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = mix(mix(points.astype(np.uint64) + np.uint64(1))[:, None] ^ words)
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Each n-gram's vector: the product of its letters' vectors, the first rotated twice, the second once."""
    mask, out = np.int64((1 << 21) - 1), None
    for k in range(GRAM):
        points, inverse = np.unique((grams >> np.int64(21 * (GRAM - 1 - k))) & mask, return_inverse=True)
        vectors = np.roll(_letter_vectors(points), GRAM - 1 - k, axis=1)[inverse]
        out = vectors if out is None else out * vectors
    return out


def count_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram's number, count) of all texts, and the distinct grams. Case is ignored; what is not a letter is a space."""
    letter, codes, owner = Letters(), [], []
    for i, text in enumerate(texts):
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points = np.where(letter(points), points, 0x20) if len(points) else points
        points = np.concatenate([[0x20], points, [0x20]])
        points = points[np.append(True, (points[1:] != 0x20) | (points[:-1] != 0x20))]
        if len(points) >= GRAM:
            codes.append((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])
            owner.append(np.full(len(codes[-1]), i, np.int64))
    if not codes:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grams, at = np.unique(np.concatenate(codes), return_inverse=True)
    pairs, counts = np.unique(np.concatenate(owner) * len(grams) + at, return_counts=True)
    return pairs // len(grams), pairs % len(grams), counts, grams


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bundled n-gram vectors of each text, as whole numbers in float32 blocks; and whether it has a letter."""
    text, gram, counts, grams = count_grams(texts)
    out = np.zeros((len(texts), DIM))
    step = 2048
    order = np.argsort(gram, kind="stable")
    text, gram, counts = text[order], gram[order], counts[order]
    for begin in range(0, len(grams), step):
        a, b = np.searchsorted(gram, (begin, begin + step))
        table = np.zeros((len(texts), min(step, len(grams) - begin)), np.float32)
        table[text[a:b], gram[a:b] - begin] = counts[a:b]
        out += table @ gram_vectors(grams[begin : begin + step]).astype(np.float32)
    has = np.zeros(len(texts), bool)
    has[text] = True
    return out, has


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(PARTS)) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes: the sum over all their documents of the documents' bundles, each of length one.

    Each task sums its own; what is shuffled is a vector for each task and language, what reaches the driver one for each language.
    """
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", 1 << 20):
            vectors, has = bundles(batch.column("text").to_pylist())
            # whole numbers, so that sums don't depend on their order
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.rint(vectors / np.maximum(length, 1e-9) * (1 << 20)).astype(np.int64)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for one in set(langs[has]):
                sums[one] = sums.get(one, 0) + unit[has & (langs == one)].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "sums"])

    parts = labelled.mapInArrow(run, "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("at", "x"))
    total = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    found = sorted((row["lang"], np.array([x["x"] for x in row["xs"]], float)) for row in total.collect())
    return [lang for lang, _ in found], np.array([v for _, v in found]).reshape(-1, DIM)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs``: the language whose prototype has the largest cosine, and that cosine.

    What all languages share (the mean prototype) is taken from prototypes and documents before they are compared. Null texts and texts
    without a letter get ``und`` and 0, and so does every text if nothing was learned; a tie goes to the first language by name.
    """
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    mean = unit.mean(axis=0) if len(unit) > 1 else np.zeros(DIM)
    centred = unit - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            vectors, has = bundles(batch.column("text").to_pylist())
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            vectors -= mean
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            cosines = np.round(vectors @ centred.T, 9)
            best = cosines.argmax(axis=1) if len(langs) else np.zeros(len(vectors), int)
            known = has & (len(langs) > 0)
            names = [langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            score = [float(min(1.0, max(0.0, cosines[i, b]))) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", doc_id)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from labelled rows that are not held out, predicted from the text alone.

    A null id is not held out. Rows without a language are predicted, not learned from. Empty in, empty out.
    """
    langs, prototypes = learn(docs.where(~held_out(F.col(doc_id))), text, lang)
    out = predict(docs, langs, prototypes, doc_id, text)
    return out.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "lang_pred", "score")
