"""Benchmark decontamination by templates: windows of words whose numbers, names and units are typed placeholders."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import PIECE, Words, bit_filter, constants, mix, passes, slices, utf8, written

#: Tokens in a window, and how many of them must be plain words for a window of that length to say anything.
WIDTH, PLAIN = 8, 3
#: A document repeats an item if it has at least this share of the item's windows and of its slots one consistent value each.
COVERAGE, CONSISTENT = 0.5, 0.8
#: It also repeats an item if it has so many plain words of it in one piece, whatever the item's length.
RUN = 13
#: Items of fewer words than the key also have windows of this width, of which one replaced word breaks less than half.
SHORTER = {14: 4, 23: 5}
#: Documents that repeat an item of fewer words than this are reported, not taken out: such an item stands in clean texts, too.
LEAST_WORDS = 3
#: Windows of an item that stand at most so far from where the others put the item belong to one place.
NEAR = 16
UNITS = (
    "mm cm m km in inch inches ft feet yd yards mi mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres gal s sec "
    "second seconds min minute minutes h hr hour hours day days week weeks month months year years percent pct dollar dollars usd "
    "euro euros eur pound pounds gbp cent cents kmh mph hz khz mhz ghz w kw v a j kj c f k degrees"
).split()

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974))
#: Kinds of windows: names, numbers and units are placeholders; numbers and units are; nothing is.
TYPED, FOLDED, EXACT = 0, 1, 2
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def _cases() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 0x20000 its lower case, where that is as long in UTF-8, and whether it is upper case."""
    size = lambda c: 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    lower, upper = np.arange(0x20000), np.zeros(0x20000, bool)
    for i in range(0x20000):
        c = chr(i)
        upper[i] = c.isupper() or c.istitle()
        low = c.lower()
        if low != c and len(low) == 1 and size(ord(low)) == size(i):
            lower[i] = ord(low)
    lower[0x3C2] = 0x3C3
    return lower, upper


_LOWER, _UPPER = _cases()


def _fold(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case, each at its place, and whether an upper-case character begins at each; ß is ss."""
    upper, out = _UPPER[data] & (data < 0x80), data.copy()
    ascii_upper = np.flatnonzero(upper)
    out[ascii_upper] += np.uint8(32)
    for low, high, more in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3)):
        at = np.flatnonzero((data >= low) & (data <= high))
        at = at[at + more < len(data)]
        code = data[at].astype(np.int64) & (0x3F >> more)
        for j in range(1, more + 1):
            code = code << 6 | data[at + j] & 0x3F
        at, code = at[code < len(_LOWER)], code[code < len(_LOWER)]
        upper[at] = _UPPER[code]
        new = _LOWER[code]
        at, new = at[new != code], new[new != code]
        for j in range(more, 0, -1):
            out[at + j] = 0x80 | new & 0x3F
            new = new >> 6
        out[at] = (0x100 - (0x80 >> more)) & 0xFF | new
        if more == 1:
            sharp = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] == 0x9F))
            out[sharp] = out[sharp + 1] = 0x73
    return out, upper


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.unique(Words(data, np.array([0, len(data)]), letters_only=True).hash)


class _Templates:
    """Words of several texts, and for each kind of window (which holds width and kind) its hash and use at each word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        folded, upper = _fold(data)
        self.words = words = Words(folded, bounds, letters_only=True)
        value, n = words.hash, len(words.hash)
        self.value, self.sizes = value, np.diff(words.bounds)
        self.left = np.repeat(words.bounds[1:], self.sizes) - np.arange(n)
        number, unit, titled = (np.zeros(n, bool) for _ in range(3))
        if n:
            kept, digits = words.sums(words.kept), words.sums(words.kept & _DIGIT[data])
            # where a word's first letter stands: its first kept byte
            first = np.flatnonzero(words.kept)[np.cumsum(kept) - kept]
            titled = upper[first] & (words.sums(words.kept & upper) == 1) & (words.sums(words.kept & (data & 0xC0 != 0x80)) > 1)
            unit = np.isin(value, _unit_hashes())
            number = (digits > 0) & (digits * 2 >= kept)
        self.kinds = {}
        for which in (TYPED, FOLDED, EXACT):
            kind = np.zeros(n, np.uint64)
            if which == TYPED:
                kind[titled] = _NAME
            if which != EXACT:
                kind[unit], kind[number] = _UNIT, _NUMBER
            self.kinds[which] = kind
        self.rolled: dict[tuple[int, int], np.ndarray] = {}

    def slots(self, which: int) -> np.ndarray:
        return np.where(self.kinds[which] > 0, self.value, np.uint64(0))

    def plain(self, which: int) -> np.ndarray:
        """Plain words before each word, and before the end."""
        return np.concatenate([[0], np.cumsum(self.kinds[which] == 0)])

    def usable(self, which: int, width: int) -> np.ndarray:
        """Where windows of this width begin that lie in one text and have enough plain words."""
        at = np.flatnonzero(self.left >= width)
        if which == EXACT:
            return at
        plain = self.plain(which)
        return at[plain[at + width] - plain[at] >= (PLAIN if width == WIDTH else width // 2 + 1)]

    def hashes(self, which: int, width: int) -> np.ndarray:
        """Hash of the window at each word; widths share their sums, so ask for them in ascending order."""
        if (which, width) not in self.rolled:
            known = max((w for k, w in self.rolled if k == which and w < width), default=0)
            total = self.rolled[which, known].copy() if known else np.zeros(len(self.value), np.uint64)
            kind = self.kinds[which]
            token, factors = np.where(kind > 0, mix(kind + np.uint64(1)), self.value), constants(23, WIDTH)
            for j in range(known, min(width, len(token))):
                total[: len(token) - j] += token[j:] * factors[j]
            self.rolled[which, width] = total
        return mix(self.rolled[which, width] + np.uint64(which * 16 + width))

    def values(self, which: int, width: int, at: np.ndarray) -> list[np.ndarray]:
        slot = self.slots(which).view(np.int64)
        return list(slot[at[:, None] + np.arange(width)]) if len(at) else []


def _narrow(size: int) -> int:
    """Width of the narrow windows of an item of so many words, 0 if it has none."""
    return 0 if size < WIDTH else next((w for below, w in sorted(SHORTER.items()) if size < below), 0)


_ITEM = "sig binary, words long, s int, at long, h long, slots array<long>, nth long, total long, before long, behind long"


def item_windows(benchmark: DataFrame, row_id: str, text: str) -> DataFrame:
    """``id, sig, words, s, at, h, slots, nth, total, before, behind``: the windows by which items are found.

    ``sig`` is the digest of the item's words and kinds of words: items of one ``sig`` have the same windows. ``s`` is 16 times the kind and the width; windows of one item and one ``s`` are judged together. ``nth`` counts usable windows,
    ``total`` is what a document's windows are compared with, ``before`` and ``behind`` count plain words before the window and its end.
    """
    chosen = benchmark.select(F.col(row_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            t = _Templates(*utf8(batch.column("text")))
            bounds, sizes, typed = t.words.bounds, t.sizes, t.kinds[TYPED]
            sig = [md5(t.value[a:b].tobytes() + typed[a:b].tobytes()).digest() for a, b in zip(bounds[:-1], bounds[1:])]
            narrow = np.array([_narrow(int(x)) for x in sizes], np.int64)
            found = np.zeros(len(sizes), bool)
            for which, width in [(k, w) for k in (TYPED, FOLDED, EXACT) for w in range(1, WIDTH + 1)]:
                if which == EXACT:
                    rows = (np.minimum(sizes, WIDTH) == width) & ~found
                else:
                    rows = sizes >= WIDTH if width == WIDTH else (narrow == width) | (sizes == width) & (sizes >= 5)
                at = t.usable(which, width)
                row = np.searchsorted(bounds, at, "right") - 1
                count = np.bincount(row, minlength=len(sizes))
                # what a narrow set is compared with are all places, so that a few usable ones don't stand for the item
                total = np.where(width == narrow, sizes - width + 1, count) if which != EXACT else count
                rows &= (count > 0) & (count >= COVERAGE * total)
                found |= rows
                at, row = at[rows[row]], row[rows[row]]
                if not len(at):
                    continue
                plain = t.plain(which)
                nth = np.arange(len(at)) - np.searchsorted(row, row)
                longs = [pa.array(x, pa.int64()) for x in (nth, total[row], plain[at] - plain[bounds[row]], plain[at + width] - plain[bounds[row]])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(row)), pa.array([sig[r] for r in row], pa.binary()), pa.array(sizes[row], pa.int64()),
                        pa.array(np.full(len(at), which * 16 + width), pa.int32()), pa.array(at - bounds[row], pa.int64()),
                        pa.array(t.hashes(which, width)[at].view(np.int64)), pa.array(t.values(which, width, at), pa.list_(pa.int64())), *longs,
                    ],
                    ["id", "sig", "words", "s", "at", "h", "slots", "nth", "total", "before", "behind"],
                )

    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, {_ITEM}")


def document_windows(docs: DataFrame, row_id: str, text: str, sets: list[int], bits: np.ndarray) -> DataFrame:
    """``id, at, h, slots`` for each usable window of the given kinds and widths (``s`` of the items) that passes the filter."""
    chosen = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            t = _Templates(*utf8(batch.column("text")))
            for which, width in (divmod(s, 16) for s in sorted(sets)):
                at, h = t.usable(which, width), t.hashes(which, width)
                at = at[passes(bits, h[at])]
                if len(at):
                    row = np.searchsorted(t.words.bounds, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(row)), pa.array(at - t.words.bounds[row], pa.int64()), pa.array(h[at].view(np.int64)), pa.array(t.values(which, width, at), pa.list_(pa.int64()))],
                        ["id", "at", "h", "slots"],
                    )

    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, at long, h long, slots array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_windows, n_item_windows, consistency, n_item_words`` for each document that repeats an item, also with other values.

    ASCII punctuation is left out and capitals count as small letters (where both are as long in UTF-8; ß as ss). An item has two sets
    of windows: in one, words of digits, words in Title case and units are placeholders, in the other only digits and units are, so that
    a copy in another case is found. A window is eight words, three of them plain. Items under 23 words also have narrow windows of
    five words, under 14 of four; an item of five to seven words is one window, mostly plain. An item without such windows, as one under
    five words or a table of numbers, is found where its exact words stand in a row, be it one word.

    Windows of documents first pass a filter of fixed size and are then joined by hash. A document repeats an item if in one set it holds
    half of its windows (narrow ones: near one place), or consecutive ones in place with thirteen plain words, and the slots are filled
    consistently there: at least 80 % of the item's slots have the most frequent partner of their value, in the whole document or in one
    run of windows that keep their distance to the item's. Other numbers or names in the same places are thus found, also if a document
    asks one question several times with several values; chance fits of templates are not. The row tells of the best of these.

    Rows of one id count as one document, null is an id like any other. Null and empty texts match nothing; with an empty benchmark the
    result is empty. Items of the same words are one until the end, then found each. Other columns are not looked at.
    """
    listed = written(item_windows(benchmark, item_id, item_text), "items")
    members, items = listed.select("sig", "id").distinct(), listed.drop("id").dropDuplicates(["sig", "s", "at"])
    sets = [r.s for r in items.select("s").distinct().collect()]
    found = document_windows(docs, doc_id, text, sets, bit_filter(items.select("h")))
    items = items.withColumnsRenamed({"sig": "item", "at": "item_at", "slots": "item_slots"})
    hits = found.withColumnRenamed("id", "doc").join(items, "h").drop("h").withColumn("run", F.col("at") - F.col("item_at"))
    # places whose windows are judged together: the whole document, a run, two grids of neighbouring runs
    place = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("value"))
    near = [place(k, F.floor((F.col("run") + k * NEAR) / (2 * NEAR))) for k in (0, 1)]
    own, wide = place(3, F.col("run")), F.col("s") % 16 == WIDTH
    places = F.when(F.col("s") >= 16 * EXACT, F.array(own)).when(wide, F.array(place(2, F.lit(0)), own)).otherwise(F.array(*near))
    hits = written(hits.withColumn("places", places), "hits").withColumn("place", F.explode("places"))
    by = ["doc", "item", "s", "place"]
    # one row for each window of an item in a place, then pieces of windows without a gap, then places
    held = hits.select(*by, "item_at", "nth", "total", "before", "behind", "words").distinct()
    pieces = held.withColumn("piece", F.col("nth") - F.row_number().over(Window.partitionBy(*by).orderBy("nth")))
    pieces = pieces.groupBy(*by, "total", "words", "piece").agg(F.count(F.lit(1)).alias("n"), (F.max("behind") - F.min("before")).alias("span"))
    judged = pieces.groupBy(*by, "total", "words").agg(F.sum("n").alias("n"), F.max("span").alias("span"))
    piece = wide & (F.col("s") < 16 * EXACT) & (F.col("place.kind") == 3) & (F.col("span") >= RUN)
    judged = judged.where(F.when(F.col("s") >= 16 * EXACT, F.col("n") == F.col("total")).otherwise((F.col("n") >= COVERAGE * F.col("total")) | piece))
    # a slot counts once for each value it has, however many windows hold it
    filled = hits.select(*by, "item_at", F.posexplode(F.arrays_zip("item_slots", "slots")).alias("k", "p")).where("p.item_slots <> 0")
    filled = filled.select(*by, (F.col("item_at") + F.col("k")).alias("at"), F.col("p.item_slots").alias("want"), F.col("p.slots").alias("has")).distinct()
    # share of the slots in each place whose value has the most frequent partner of the item's value
    slots = filled.groupBy(*by, "want", "has").agg(F.count(F.lit(1)).alias("n")).groupBy(*by, "want").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    slots = slots.groupBy(*by).agg((F.sum("most") / F.sum("n")).alias("consistency")).withColumnsRenamed({c: f"{c}_" for c in by})
    same = [judged[c].eqNullSafe(slots[f"{c}_"]) for c in ("doc", "item")] + [judged[c] == slots[f"{c}_"] for c in ("s", "place")]
    judged = judged.join(slots, same[0] & same[1] & same[2] & same[3], "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") >= CONSISTENT)
    best = F.max(F.struct("consistency", (F.col("n") / F.col("total")).alias("share"), "n", "total", "words")).alias("best")
    judged = judged.groupBy("doc", "item").agg(best).join(members, F.col("item") == F.col("sig"))
    judged = judged.groupBy("doc", "id").agg(F.max("best").alias("best"))
    shown = [F.col("best.n").alias("n_windows"), F.col("best.total").alias("n_item_windows"), "best.consistency", F.col("best.words").alias("n_item_words")]
    return judged.select(F.col("doc").alias(doc_id), F.col("id").alias(item_id), *shown)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that repeat an item of LEAST_WORDS words or more, all columns.

    Shorter items stand in clean texts by chance; ``contaminated`` reports them with their ``n_item_words``.
    """
    found = contaminated(docs, benchmark, doc_id, text, item_id, item_text).where(F.col("n_item_words") >= LEAST_WORDS)
    leaked = found.select(F.col(doc_id).alias("__leaked")).distinct()
    return docs.join(leaked, docs[doc_id].eqNullSafe(leaked["__leaked"]), "left_anti")
