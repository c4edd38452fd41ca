"""Ordered work that survives hot keys.

A window over one key runs in one task.  Where a key holds many rows, its timeline is cut into pieces,
the window runs per (key, piece), and what has to pass from piece to piece is carried over in a table of
one row per piece.

A value of the order column is a cut if its hash (with the key) is 0 modulo ``PIECE_ROWS``.  So a piece
has ``PIECE_ROWS`` values on average, whatever share of the table its key holds; values of any type with
an order can be cut, a NULL key is a key like any other, and the cuts depend on the data alone: tasks
that run again, or branches of a plan, always cut alike.  Cuts are broadcast: one value for each
``PIECE_ROWS`` rows, 16 MB for 10 ** 12 rows of a number or moment.  Results are exact for any cuts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.hashing import as_col, hash_hex, hex_number
from cohortry.functions.times import micros

PIECE_ROWS = 1_000_000
HASH_DIGITS = 4
LINE = ["__line", "__piece"]


def _piece_of(cuts: Column, value: Column) -> Column:
    """How many cuts lie at or below ``value``: a binary search over the sorted array."""
    top = F.ceil(F.log2(F.size(cuts) + 1)).cast("int")
    found = F.aggregate(
        F.sequence(top, F.lit(0), F.lit(-1)),
        F.lit(0),
        lambda acc, e: F.when(
            F.try_element_at(cuts, acc + F.call_function("shiftleft", F.lit(1), e)) <= value, acc + F.call_function("shiftleft", F.lit(1), e)
        ).otherwise(acc),
    )
    return F.when(F.coalesce(F.size(cuts), F.lit(0)) <= 0, F.lit(0)).otherwise(found)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table (a global aggregate) to every row."""
    return df.join(F.broadcast(row), F.lit(True))


def add_piece(df: DataFrame, keys: Sequence[str], order: Column | str, piece_rows: int | None = None) -> DataFrame:
    """Add ``__line`` (the key as a struct, in which NULLs are equal), ``__piece`` (never falls as ``order``
    rises within a key; 0 without an order) and ``__cut`` (whether the key has cuts).

    Without keys the whole table is one timeline.
    """
    size = PIECE_ROWS if piece_rows is None else piece_rows
    lined = df.withColumn("__line", F.struct(*(keys or [F.lit(0).alias("all")])))
    at = as_col(order)
    chosen = lined.where(at.isNotNull() & (F.pmod(F.xxhash64("__line", at), F.lit(size)) == 0))
    cuts = chosen.groupBy("__line").agg(F.sort_array(F.collect_set(at)).alias("__cuts"))
    return (
        lined.join(F.broadcast(cuts), "__line", "left")
        .withColumn("__piece", _piece_of(F.col("__cuts"), at))
        .withColumn("__cut", F.col("__cuts").isNotNull())
        .drop("__cuts")
    )


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    totals: Mapping[str, str] | None = None,
    piece_rows: int | None = None,
) -> DataFrame:
    """Exclusive running sums in ``order`` per key, and sums over the whole key.

    ``sums`` and ``totals`` map a new column to a summed column.  Rows must be unique per (keys, order):
    group by the order value first.
    """
    keys, totals = list(keys), dict(totals or {})
    cut = add_piece(df, keys, order, piece_rows)
    piece = Window.partitionBy(*LINE)
    inside = piece.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__line")
    across = whole.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    summed = sorted({*sums.values(), *totals.values()})
    per_piece = cut.where("__cut").groupBy(*LINE).agg(*[F.sum(c).alias(f"__t_{c}") for c in summed])
    carry = per_piece.select(
        *LINE,
        *[F.sum(f"__t_{c}").over(across).alias(f"__c_{n}") for n, c in sums.items()],
        *[F.sum(f"__t_{c}").over(whole).alias(f"__c_{n}") for n, c in totals.items()],
    )
    walked = cut.select(
        "*",
        *[F.sum(c).over(inside).alias(f"__i_{n}") for n, c in sums.items()],
        *[F.sum(c).over(piece).alias(f"__i_{n}") for n, c in totals.items()],
    )
    zero = F.lit(0)
    return walked.join(carry, LINE, "left").select(
        *df.columns,
        *[(F.coalesce(F.col(f"__i_{n}"), zero) + F.coalesce(F.col(f"__c_{n}"), zero)).alias(n) for n in sums],
        *[F.coalesce(F.col(f"__c_{n}"), F.col(f"__i_{n}")).alias(n) for n in totals],
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], piece_rows: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group, one row per (group, prob): columns ``prob``, ``quantile``.

    Counts per distinct value, running counts, then only the rows that hold a wanted rank: no group is
    ever gathered in one task.  NULL values are left out.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = prefix_sums(counts, by, "__v", {"__before": "__n"}, {"__total": "__n"}, piece_rows)
    before, after = F.col("__before"), F.col("__before") + F.col("__n")
    place = lambda p: p * (F.col("__total") - 1)
    # the ranks next to a place are adjacent: a row matters if its ranks meet them
    meets = lambda p: (before <= F.ceil(place(p))) & (F.floor(place(p)) < after)
    held = ranked.where(reduce(or_, [meets(F.lit(float(p))) for p in probs]))
    listed = F.expr("array(" + ", ".join(f"{float(p)!r}D" for p in probs) + ")")
    rows = held.select("*", F.explode(F.filter(listed, meets)).alias("prob")).withColumn("__place", place(F.col("prob")))
    holds = lambda rank: (before <= rank) & (rank < after)
    found = rows.groupBy(*by, "prob").agg(
        F.max(F.when(holds(F.floor("__place")), F.col("__v"))).cast("double").alias("__lo"),
        F.max(F.when(holds(F.ceil("__place")), F.col("__v"))).cast("double").alias("__hi"),
        F.max("__place").alias("__place"),
    )
    part = F.col("__place") - F.floor("__place")
    return found.select(*by, "prob", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * part).alias("quantile"))


def hash_rank(df: DataFrame, by: Sequence[str], key: Sequence[str], seed: str | int, name: str = "rank") -> DataFrame:
    """1-based rank by the hash of the key within a group, plus the group size as ``<name>_of``.

    The hash is uniform, so its first digits cut every group into equal buckets, however large it is.
    """
    by = list(by)
    hashed = df.withColumn("__h", hash_hex(seed, *key)).withColumn(
        "__piece", hex_number(F.col("__h"), 1, HASH_DIGITS).cast("int")
    )
    group = by or [F.lit(0)]
    across = Window.partitionBy(*group).orderBy("__piece")
    sizes = hashed.groupBy(*by, "__piece").agg(F.count(F.lit(1)).alias("__size"))
    sizes = sizes.select(
        *[F.col(c).alias(f"__b_{c}") for c in by],
        F.col("__piece").alias("__p"),
        F.coalesce(F.sum("__size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__c"),
        F.sum("__size").over(Window.partitionBy(*group)).alias(f"{name}_of"),
    )
    inside = Window.partitionBy(*by, "__piece").orderBy("__h", *key)
    ranked = hashed.withColumn("__r", F.row_number().over(inside))
    same = F.col("__piece") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    return ranked.join(sizes, same).select(
        *df.columns, (F.col("__r") + F.col("__c")).alias(name), F.col(f"{name}_of")
    )


def _timeline(points: DataFrame, targets: DataFrame, by: str, ts: str, start: str, key: str, piece_rows: int | None) -> DataFrame:
    """Points and targets of a subject as one timeline: ``__kind`` 0 is a target, 1 a point."""
    def nothing(frame: DataFrame, c: str) -> Column:
        return F.lit(None).cast(frame.schema[c].dataType)

    p = points.select(by, ts).distinct().select(
        F.col(by).alias("__by"), micros(ts).alias("__t"), F.lit(1).alias("__kind"), F.col(ts).alias("__ts"),
        nothing(targets, start).alias("__start"), nothing(targets, key).alias("__key"),
    )
    t = targets.where(F.col(start).isNotNull()).select(by, start, F.col(key).alias("__k"))
    t = t.groupBy(by, start).agg(F.min("__k").alias("__key")).select(
        F.col(by).alias("__by"), micros(start).alias("__t"), F.lit(0).alias("__kind"),
        nothing(points, ts).alias("__ts"), F.col(start).alias("__start"), "__key",
    )
    return add_piece(p.unionByName(t), ["__by"], "__t", piece_rows)


def nearest(
    points: DataFrame,
    targets: DataFrame,
    by: str,
    ts: str,
    start: str,
    key: str,
    *,
    forward: bool = True,
    backward: bool = False,
    strict: bool = False,
    piece_rows: int | None = None,
) -> DataFrame:
    """As-of match per subject, one row per distinct (subject, ts).

    ``forward`` adds ``next_start, next_key`` of the nearest target at or after ``ts`` (after it, if
    ``strict``); ``backward`` adds ``prev_start, prev_key`` of the nearest one at or before it.  NULL where
    there is none; among equal starts the smallest key wins.  Both sides are merged into one timeline and
    a running "last target seen" answers every point, so no pair of a point and a target is ever built.
    """
    line = _timeline(points, targets, by, ts, start, key, piece_rows)
    target = F.when(F.col("__kind") == 0, F.struct("__start", "__key"))
    at = F.when(F.col("__kind") == 0, F.col("__t"))
    sides = []
    if forward:
        kind = F.col("__kind").desc() if strict else F.col("__kind").asc()
        sides.append(("next", [F.col("__t").desc(), kind], F.col("__piece").desc(), F.min_by(target, at)))
    if backward:
        sides.append(("prev", [F.col("__t").asc(), F.col("__kind").asc()], F.col("__piece").asc(), F.max_by(target, at)))
    edges = line.where("__cut").groupBy(*LINE).agg(*[edge.alias(f"__edge_{n}") for n, _, _, edge in sides])
    seen, carried, out = [], [], []
    for name, order, piece_order, _ in sides:
        walk = Window.partitionBy(*LINE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        back = Window.partitionBy("__line").orderBy(piece_order).rowsBetween(Window.unboundedPreceding, -1)
        seen.append(F.last(target, ignorenulls=True).over(walk).alias(f"__seen_{name}"))
        carried.append(F.last(f"__edge_{name}", ignorenulls=True).over(back).alias(f"__carry_{name}"))
        hit = F.coalesce(f"__seen_{name}", f"__carry_{name}")
        out += [hit["__start"].alias(f"{name}_start"), hit["__key"].alias(f"{name}_key")]
    carry = edges.select(*LINE, *carried)
    walked = line.select(*LINE, "__by", "__kind", "__ts", *seen).where("__kind = 1")
    return walked.join(carry, LINE, "left").select(
        F.col("__by").alias(by), F.col("__ts").alias(ts), *out
    )


def _stored(df: DataFrame, by: str, order: str, entry: Column, size: Column, piece_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows with ``__subject`` and ``__end`` (the sizes of the subject's entries strictly earlier in time, added up), and the sorted entries
    of each subject (``__subject, __store``).

    An entry is NULL where a row has none.  Rows without a time have no entry and nothing before them.
    """
    rows = df.withColumns({"__subject": F.struct(by), "__t": micros(order)}).withColumn("__entry", F.when(F.col("__t").isNotNull(), entry))
    sizes = rows.where(F.col("__t").isNotNull()).groupBy("__subject", "__t").agg(F.sum(F.when(F.col("__entry").isNotNull(), size).otherwise(0)).alias("__n"))
    ends = prefix_sums(sizes, ["__subject"], "__t", {"__end": "__n"}, piece_rows=piece_rows).select("__subject", "__t", "__end")
    store = rows.where(F.col("__entry").isNotNull()).groupBy("__subject").agg(F.array_sort(F.collect_list(F.struct("__t", "__entry"))).alias("__store"))
    placed = rows.drop("__entry").join(ends, ["__subject", "__t"], "left")
    return placed.withColumn("__end", F.coalesce("__end", F.lit(0)).cast("int")), store


def running_list(
    df: DataFrame, by: str, order: str, value: Column | str, name: str, piece_rows: int | None = None
) -> DataFrame:
    """Per row the list of ``value`` of the rows of the same subject **strictly** earlier in time.

    A subject's values are stored once, in order; a row is a place in that store, and its list is cut from the store's front when
    the row is written.  So a subject takes memory for its own values, however many rows refer to them.
    """
    value = as_col(value)
    rows, store = _stored(df, by, order, F.when(value.isNotNull(), F.struct(value.alias("v"))), F.lit(1), piece_rows)
    values = store.select("__subject", F.transform("__store", lambda e: e["__entry"]["v"]).alias("__store"))
    empty = F.array().cast(values.schema["__store"].dataType)
    cut = F.when(F.col("__end") > 0, F.slice("__store", F.lit(1), F.col("__end"))).otherwise(empty)
    return rows.join(values, "__subject", "left").select(*df.columns, cut.alias(name))


def running_text(
    df: DataFrame, by: str, order: str, tie: str, text: Column, sep: str, name: str, piece_rows: int | None = None
) -> DataFrame:
    """Per row the texts of the subject's rows strictly earlier in time, joined by ``sep``; ``""`` where there are none.

    As ``running_list``, with one text per subject as the store: each row's text is the beginning of it.
    """
    entry = F.when(text.isNotNull(), F.struct(F.col(tie).alias("tie"), text.alias("v")))
    rows, store = _stored(df, by, order, entry, F.length(text) + len(sep), piece_rows)
    joined = store.select("__subject", F.array_join(F.transform("__store", lambda e: e["__entry"]["v"]), sep).alias("__store"))
    cut = F.when(F.col("__end") > 0, F.left(F.col("__store"), F.col("__end") - len(sep))).otherwise("")
    return rows.join(joined, "__subject", "left").select(*df.columns, cut.alias(name))
