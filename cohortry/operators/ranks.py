"""Values at exact ranks by refining histograms, and the first n rows of an order without sorting the table.

Values have ordered 64-bit images.  A pass counts, for all columns at once, how many values fall in each
bucket of leading bits; the bucket that holds a wanted rank is refined by the next pass.  A task sends its
counters, never rows.  Once the buckets hold few rows, their distinct values are counted instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.times import micros

#: Bits that each pass adds; the first twelve are sign and exponent of a double.
DIGITS = (12, 13, 13, 13, 13)
#: Buckets that hold so many rows together are finished by counting their distinct values.
FEW = 100_000
#: Up to so many rows of an order every task may keep that many.
SMALL = 1_000

_SIGN = np.uint64(1 << 63)


def _images(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the values; NaN above all, -0.0 equal to 0.0."""
    if values.dtype == np.int64:
        return values.view(np.uint64) ^ _SIGN
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _value(image: int, double: bool) -> float | int:
    if not double:
        return int((np.array([image], np.uint64) ^ _SIGN).view(np.int64)[0])
    bits = np.array([image], np.uint64)
    return float(np.where(bits & _SIGN, bits ^ _SIGN, ~bits).view(np.float64)[0])


def _column_images(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return _images(pc.drop_null(batch.column(i)).to_numpy(zero_copy_only=False))


def _counted(df: DataFrame, known: list[np.ndarray], used: int, width: int) -> list[dict[int, int]]:
    """Per column ``{place of the prefix in known << width | next bits: rows}``; place -1 counts NULLs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(p) << width, np.int64) for p in known]
        nulls = [0] * len(known)
        for batch in batches:
            for i, prefixes in enumerate(known):
                nulls[i] += batch.column(i).null_count
                if not len(prefixes):
                    continue
                image = _column_images(batch, i)
                place = np.zeros(len(image), np.int64)
                if used:
                    head = image >> np.uint64(64 - used)
                    place = np.minimum(np.searchsorted(prefixes, head), len(prefixes) - 1)
                    held = prefixes[place] == head
                    image, place = image[held], place[held]
                digit = ((image >> np.uint64(64 - used - width)) & np.uint64((1 << width) - 1)).astype(np.int64)
                counts[i] += np.bincount((place << width) | digit, minlength=len(counts[i]))
        for i, n in enumerate(counts):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at) + 1, i, np.int32)), pa.array(np.append(at, -1)), pa.array(np.append(n[at], nulls[i]))], ["c", "at", "n"]
            )

    out: list[dict[int, int]] = [{} for _ in known]
    found = df.mapInArrow(run, "c int, at long, n long").groupBy("c", "at").agg(F.sum("n").alias("n")).toPandas()
    for c, at, n in zip(found["c"].tolist(), found["at"].tolist(), found["n"].tolist()):
        out[c][at] = n
    return out


def _listed(df: DataFrame, known: list[np.ndarray], used: int) -> list[dict[int, int]]:
    """Per column ``{image: rows}`` of the values that begin with a known prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in known]
        for batch in batches:
            for i, prefixes in enumerate(known):
                image = _column_images(batch, i)
                if len(prefixes) and len(image):
                    held[i].append(image[np.isin(image >> np.uint64(64 - used), prefixes)] if used else image)
        for i, parts in enumerate(held):
            image, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(image), i, np.int32)), pa.array(image.view(np.int64)), pa.array(n)], ["c", "at", "n"])

    out: list[dict[int, int]] = [{} for _ in known]
    found = df.mapInArrow(run, "c int, at long, n long").groupBy("c", "at").agg(F.sum("n").alias("n")).toPandas()
    images = found["at"].to_numpy(np.int64).view(np.uint64).tolist()
    for c, at, n in zip(found["c"].tolist(), images, found["n"].tolist()):
        out[c][at] = n
    return out


def values_at(df: DataFrame, wanted: Callable[[int, int], Sequence[int]]) -> list[dict[int, tuple]]:
    """Per column of ``df`` (all double or long) ``{rank: (value, rows below it, rows equal to it)}``.

    ``wanted`` gives the 0-based ranks among a column's non-null values from its number of those and of NULLs; ranks outside are
    left out.  At most six jobs, however many columns and ranks; ``df`` should be cheap to read or persisted.
    """
    doubles = [kind == "double" for _, kind in df.dtypes]
    known: list[np.ndarray] = [np.zeros(1, np.uint64) for _ in doubles]
    # rank -> (prefix, rows below the prefix), and the rows of each prefix
    places: list[dict[int, tuple[int, int]]] = []
    inside: list[dict[int, int]] = []
    used = 0
    for width in DIGITS:
        counts = _counted(df, known, used, width)
        if not used:
            places, inside = [], []
            for c in counts:
                nulls = c.pop(-1, 0)
                total = sum(c.values())
                places.append({r: (0, 0) for r in wanted(total, nulls) if 0 <= r < total})
        fresh: list[dict[int, tuple[int, int]]] = []
        inside = []
        for column, c in enumerate(counts):
            c.pop(-1, None)
            per: dict[int, list[tuple[int, int]]] = {}
            for at, n in sorted(c.items()):
                per.setdefault(at >> width, []).append((at & ((1 << width) - 1), n))
            moved, rows = {}, {}
            for rank, (prefix, below) in places[column].items():
                for digit, n in per[int(np.searchsorted(known[column], np.uint64(prefix)))]:
                    if rank < below + n:
                        moved[rank] = (prefix << width | digit, below)
                        rows[prefix << width | digit] = n
                        break
                    below += n
            fresh.append(moved)
            inside.append(rows)
        places, used = fresh, used + width
        known = [np.array(sorted(rows), np.uint64) for rows in inside]
        if used < 64 and max((sum(rows.values()) for rows in inside), default=0) <= FEW:
            return _finished(places, _listed(df, known, used), used, doubles)
    exact = [{image: n for image, n in rows.items()} for rows in inside]
    return _finished(places, exact, 64, doubles)


def _finished(places: list[dict[int, tuple[int, int]]], listed: list[dict[int, int]], used: int, doubles: list[bool]) -> list[dict[int, tuple]]:
    out = []
    for places_of, counts, double in zip(places, listed, doubles):
        per: dict[int, list[tuple[int, int]]] = {}
        for image, n in sorted(counts.items()):
            per.setdefault(image >> (64 - used), []).append((image, n))
        found = {}
        for rank, (prefix, below) in places_of.items():
            for image, n in per[prefix]:
                if rank < below + n:
                    found[rank] = (_value(image, double), below, n)
                    break
                below += n
        out.append(found)
    return out


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles of several columns: ``column, prob, quantile``; NULLs are left out, a column without values has no row.

    The numbers are those that a sort in one task would give.  Runs when called, on a persisted projection of the columns.
    """
    values = df.select(*[F.col(c).cast("double").alias(f"__q{i}") for i, c in enumerate(cols)]).persist()
    sizes: list[int] = []

    def wanted(total: int, nulls: int) -> list[int]:
        sizes.append(total)
        places = [p * (total - 1) for p in probs] if total else []
        return sorted({int(r) for x in places for r in (np.floor(x), np.ceil(x))})

    try:
        found = values_at(values, wanted)
    finally:
        values.unpersist()
    rows = []
    for c, total, held in zip(cols, sizes, found):
        for p in probs if total else ():
            x = p * (total - 1)
            lo, hi = held[int(np.floor(x))][0], held[int(np.ceil(x))][0]
            rows.append((c, float(p), float(lo + (hi - lo) * (x - np.floor(x)))))
    return df.sparkSession.createDataFrame(rows, "column string, prob double, quantile double")


Order = str | tuple[str, str]


def _order(order: Order | Sequence[Order]) -> list[tuple[str, bool]]:
    items = [order] if isinstance(order, str) or (isinstance(order, tuple) and len(order) == 2 and order[1] in ("asc", "desc")) else list(order)
    return [(o, False) if isinstance(o, str) else (o[0], o[1] == "desc") for o in items]


def _images_of(df: DataFrame, name: str, down: bool, tied: Callable[[], DataFrame]) -> Iterator[Column]:
    """Numbers whose ascending order, one after the other, is the order of the non-null values of ``name``."""
    c, kind = F.col(name), dict(df.dtypes)[name]
    turned = lambda x: F.bitwise_not(x.cast("long")) if down else x.cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        yield turned(c)
    elif kind == "boolean":
        yield turned(c.cast("int"))
    elif kind == "date":
        yield turned(F.unix_date(c))
    elif kind.startswith("timestamp"):
        yield turned(micros(name))
    elif kind in ("float", "double") or kind.startswith("decimal"):
        yield -c.cast("double") if down else c.cast("double")
    else:
        raw, at = (c if kind == "binary" else c.cast("string").cast("binary")), 0
        while not at or not tied().where(F.octet_length(raw) > at).isEmpty():
            yield turned(F.conv(F.rpad(F.hex(F.substring(raw, at + 1, 7)), 14, "0"), 16, 10))
            at += 7


def top_n(df: DataFrame, n: int, order: Order | Sequence[Order]) -> DataFrame:
    """The first n rows in an order (names, or ``(name, "desc")``), as a set of rows; NULLs first, or last with ``desc``.

    A large n is found by a threshold: histograms fix the value of the n-th row in the first column, rows below it are a filter, and
    only rows that tie with it are looked at further, column by column, at last by a hash of the whole row.  So no task holds more
    than FEW rows, whatever n.  Up to SMALL rows each task keeps its own first n.
    """
    keys = _order(order)
    sort = [F.col(c).desc() if down else F.col(c).asc() for c, down in keys]
    if n <= SMALL:
        return df.orderBy(*sort).limit(n)
    ties: list[Column] = []
    below: list[Column] = []
    rest, equal = n, 0

    def tied() -> DataFrame:
        return df.where(reduce(and_, ties)) if ties else df

    def cut(image: Column) -> float | int | None:
        """Sets rows below the threshold of an image apart; its value there, None if there are not enough rows."""
        nonlocal rest, equal
        values = tied().select(image.alias("__v")).persist()
        try:
            found = values_at(values, lambda total, nulls: [rest - 1])[0]
        finally:
            values.unpersist()
        if not found:
            return None
        value, under, equal = found[rest - 1]
        literal = F.lit(value)
        below.append(reduce(and_, [*ties, image < literal]))
        ties.append(image == literal)
        rest -= under
        return value

    def few() -> bool:
        """Cuts until few rows tie, or all that tie are wanted; False if there are not enough rows."""
        for name, down in keys:
            missing = F.when(F.col(name).isNull() != F.lit(down), F.lit(0)).otherwise(F.lit(1)).cast("long")
            found = cut(missing)
            if found is None or equal <= max(FEW, rest):
                return found is not None
            # rows without a value tie in this column
            if (found == 0) != down:
                continue
            for image in _images_of(df, name, down, tied):
                cut(image)
                if equal <= max(FEW, rest):
                    return True
        cut(F.xxhash64(*df.columns))
        return True

    if not few():
        return df
    last = tied() if equal == rest else tied().orderBy(*sort).limit(rest)
    return df.where(reduce(or_, below)).unionByName(last)
