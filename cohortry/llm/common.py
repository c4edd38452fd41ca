"""Helpers that several operators share: tables in the shared folder, words of UTF-8 text as arrays, 64-bit mixing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and a word, as Java regular expressions.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters and digits of ASCII, and every byte of a longer UTF-8 sequence.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of text whose words a task turns into arrays at once: these take up to a hundred bytes for each, and a worker stays as large as it was.
PIECE = 1 << 18
#: log2 of the bits of a filter, 1 MB: for some million values.
FILTER_BITS = 23
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share.

    A temporary folder is taken only where no folder is set and the session runs in one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: later steps don't depend on the executors that made it."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more."""
    for table in tables:
        target = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def in_blocks(rows: DataFrame, by: list[str], inner: Column, load: Column, key: str) -> DataFrame:
    """``rows`` with ``lo, hi, part``: those of a group meet in blocks, of which two at a time (or one with itself) are one task's work.

    ``load`` is what a row weighs; a block weighs about 1. Rows that are ``inner`` are compared with others only, never among
    themselves, so that a group of many inner rows takes work in proportion to them. A group of weight 1 is one block. ``key`` deals rows
    to blocks. Part of a row is the block it is in; ``lo`` and ``hi`` are the two that meet.
    """
    rows = rows.withColumns({"__inner": inner, "__load": load})
    sums = rows.groupBy(*by).agg(*(F.sum(F.when(F.col("__inner") == side, F.col("__load")).otherwise(0.0)).alias(n) for n, side in (("__in", True), ("__out", False))))
    large = sums.where(F.col("__in") + F.col("__out") > 1).select(*by, F.ceil("__out").alias("__bo"), F.ceil("__in").alias("__bi"))
    dealt = rows.join(large, by, "left")
    place = lambda n: F.pmod(F.xxhash64(key), F.greatest(n, F.lit(1)))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    part = F.when(F.col("__bo").isNull(), 0).when(F.col("__inner"), F.col("__bo") + place(F.col("__bi"))).otherwise(place(F.col("__bo")))
    met = F.when(F.col("__bo").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("__inner"), upto(F.col("__bo"))).otherwise(upto(F.col("__bo") + F.col("__bi")))
    dealt = dealt.withColumn("part", part.cast("long")).withColumn("__with", F.explode(met))
    dealt = dealt.withColumns({"lo": F.least("part", "__with"), "hi": F.greatest("part", "__with")})
    return dealt.drop("__inner", "__load", "__bo", "__bi", "__with")


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most_bytes`` of text; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            base = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, base + most_bytes, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and the n + 1 bounds of its rows; null counts as empty."""
    column = pc.fill_null(column, "")
    bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    if bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all else as it is."""
    return np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed only."""
    at = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)
    return mix(at * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def bit_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Two bits for each value of the column ``h`` (64-bit hashes) in a filter of ``2 ** bits`` bits.

    At most ``2 ** bits / 64`` numbers reach the driver, whatever the data; a fuller filter passes more, it never misses a value.
    """
    bit = F.explode(F.array(*(F.shiftrightunsigned("h", s).bitwiseAND((1 << bits) - 1) for s in (0, 27)))).alias("bit")
    mask = F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))"))
    found = hashes.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(mask.alias("mask")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    return out.view(np.uint64)


def passes(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    hit, top = np.ones(len(hashes), bool), np.uint64(len(filled) * 64 - 1)
    for shift in (0, 27):
        at = (hashes >> np.uint64(shift)) & top
        hit &= (filled[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return hit


class Words:
    """The words of several texts: ``hash`` of each, and ``bounds`` of each text's words.

    ``letters_only`` leaves out ASCII punctuation, and words that have nothing else.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, letters_only: bool = False):
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = bounds[:-1][bounds[:-1] < len(data)]
        first[edge] = inside[edge]
        starts = np.flatnonzero(first)
        self.data, self.kept = data, _ALNUM[data] & inside if letters_only else inside
        if letters_only and len(starts):
            starts = starts[np.add.reduceat(self.kept, starts, dtype=np.int64) > 0]
        self.starts = starts
        self.bounds = np.searchsorted(starts, bounds)
        self.hash = np.zeros(0, np.uint64)
        if not len(starts):
            return
        count = np.cumsum(self.kept)
        before = count[starts] - self.kept[starts]
        lengths = np.diff(np.append(starts, len(data)))
        place = np.zeros(len(data), np.int64)
        place[starts[0] :] = count[starts[0] :] - 1 - np.repeat(before, lengths)
        place[~self.kept] = 0
        power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C55, np.uint64))
        parts = (lower_ascii(data).astype(np.uint64) + np.uint64(1)) * power[place]
        parts[~self.kept] = 0
        self.hash = mix(np.add.reduceat(parts, starts) + np.add.reduceat(self.kept, starts, dtype=np.int64).astype(np.uint64))

    def sums(self, flag: np.ndarray) -> np.ndarray:
        """Number of set bytes in each word."""
        return np.add.reduceat(flag, self.starts, dtype=np.int64) if len(self.starts) else np.zeros(0, np.int64)
