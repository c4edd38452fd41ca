"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by concatenating pieces."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import slices

#: The public pattern that splits text before merging; white space is that of Unicode.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Longer words are merged with a heap, as the fold looks at all pairs for each merge.
FOLD_BYTES = 64
#: Distinct words whose ids a task keeps; beyond that it begins anew. And words of a text that are looked up at once.
KEPT_WORDS, STEP = 500_000, 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file, read on the driver: a vocabulary of fixed size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def fold_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word. The state of the fold is the list of pieces, at first its bytes, and the rank of each with its right neighbour;
    each step joins the pair of least rank, of equal ones the first, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > FOLD_BYTES:
        return merge_long(word, ranks)
    none = len(ranks) + 1
    rank = ranks.get
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        joined = pieces[i] + pieces[i + 1]
        pieces[i : i + 2] = [joined]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(joined + pieces[i + 1], none)
        if i:
            pairs[i - 1] = rank(pieces[i - 1] + joined, none)
    return [ranks[p] for p in pieces]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word, in n log n: a heap of pairs by rank and place over a linked list of pieces."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _gathered(values: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[bounds[p] : bounds[p + 1]]`` for each place in order, joined; and the bounds of the runs."""
    length = (bounds[1:] - bounds[:-1])[places]
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[places] - ends + length, length)
    return values[at], np.concatenate([[0], ends])


def _packed(text: str, find, known: dict[str, bytes], ranks: dict[bytes, int]) -> bytes:
    """Ids of a text as little-endian unsigned numbers of 32 bits; ``known`` holds those of words seen before."""
    out, matches = [], find(text)
    while words := [m.group() for m in islice(matches, STEP)]:
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > KEPT_WORDS:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = np.array(fold_merges(w.encode(), ranks), "<u4").tobytes()
        out.append(b"".join([known[w] for w in words]))
    return b"".join(out)


def encode(docs: DataFrame, ranks: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int) for each row: the ids that the ranks give, each match of the pattern on its own.

    A task folds each distinct word once and keeps its ids (of a bounded number of words); the ids of a text are put together in the
    order of its words. Nothing is shuffled. Null and empty texts have no ids; words of any length are encoded (long ones with a
    heap). Repeated rows are encoded each; null ids are kept; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, known = regex.compile(PATTERN).finditer, {}
        for batch in slices(batches, "text"):
            packed = [_packed(t, find, known, ranks) if t else b"" for t in batch.column("text").to_pylist()]
            bounds = np.cumsum([0, *map(len, packed)]) // 4
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), listed], ["id", "ids"])

    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, ids array<int>").withColumnRenamed("id", doc_id)


def decode_digests(encoded: DataFrame, ranks: dict[bytes, int], doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``decoded``, binary, with ``keep_ids`` also ``ids``).

    Decoding joins the pieces of the ids in order; null ids give nulls, no ids an empty text.
    """
    import hashlib

    order = sorted(ranks, key=ranks.get)
    table = np.frombuffer(b"".join(order), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in order])])
    kind = dict(encoded.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                rows = [x.values.to_numpy(zero_copy_only=False) for x in part.column("ids")]
                decoded = [_gathered(table, bounds, x)[0].tobytes() for x in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x) for x in rows], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in rows]),
                     pa.array([hashlib.sha256(x).hexdigest() for x in decoded]), *([part.column("ids")] if keep_ids else [pa.array(decoded, pa.binary())])],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids" if keep_ids else "decoded"],
                )

    last = "ids array<int>" if keep_ids else "decoded binary"
    made = encoded.select(F.col(doc_id).alias("id"), "ids").mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, {last}")
    return made.withColumnRenamed("id", doc_id)
