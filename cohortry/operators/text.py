"""Text built from several rows, and reports about text columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.hashing import hash_hex
from cohortry.functions.text import clean_comment, event_text, is_blank, sentences, word_count
from cohortry.operators.ranks import column_quantiles
from cohortry.operators.skew import running_text

# Susceptibility grades, best first; anything else ranks behind them.
GRADE_RANKS = {"R": 0, "S": 1, "I": 2}


#: Writes a table under a name and gives it back as read.
Land = Callable[[DataFrame, str], DataFrame]


def as_is(df: DataFrame, name: str) -> DataFrame:
    """Lands nothing."""
    return df


def _dated_blocks(
    st: DataFrame, facts: DataFrame, by: str, visit: str, start: str, entry: Column, block: Callable[[Column, Column], Column], sep: str, name: str,
    land: Land,
) -> DataFrame:
    """Per visit the blocks of the subject's earlier visits; ``block`` gives a visit's text from its date and its sorted entries.

    Visits with their own text are read three times.
    """
    folded = facts.groupBy(visit).agg(F.array_sort(F.collect_list(entry)).alias("__facts"))
    line = st.select(by, visit, start).join(folded, visit, "left")
    text = F.when(F.col("__facts").isNotNull(), block(F.date_format(F.col(start), "yyyy-MM-dd"), F.col("__facts")))
    line = land(line.select(by, visit, start, text.alias("__block")), f"{name}_blocks")
    return running_text(line, by, start, visit, F.col("__block"), sep, name).select(by, visit, name)


def history_block(
    st: DataFrame, facts: DataFrame, by: str, visit: str, start: str, line: str, order: str,
    header: str = "Past Diagnoses:", land: Land = as_is,
) -> DataFrame:
    """Per visit a block of the subject's earlier visits in time order, one line per fact.

    A visit whose lines are all empty keeps its date line.  No earlier facts: ``""``.
    """
    entry = F.struct(F.col(order).alias("ord"), F.coalesce(F.col(line), F.lit("")).alias("line"))

    def block(date: Column, held: Column) -> Column:
        lines = F.filter(F.transform(held, lambda f: f["line"]), lambda t: F.length(t) > 0)
        return F.array_join(F.concat(F.array(F.concat(F.lit("\nVisit ("), date, F.lit("):"))), lines), "\n")

    blocks = _dated_blocks(st, facts, by, visit, start, entry, block, "\n", "history", land)
    return blocks.withColumn("history", F.when(F.col("history") != "", F.concat(F.lit(header + "\n"), F.col("history"))).otherwise(""))


def notes_block(
    st: DataFrame, notes: DataFrame, by: str, visit: str, start: str, text: str, order: str,
    header: str = "Prior Discharge Summary", land: Land = as_is,
) -> DataFrame:
    """Per visit the notes of earlier visits, each under a dated header, joined by a blank line."""
    kept = notes.where(~is_blank(text))
    entry = F.struct(F.col(order).alias("ord"), F.col(text).alias("text"))

    def block(date: Column, held: Column) -> Column:
        head = F.concat(F.lit(f"{header} ("), date, F.lit("):\n"))
        return F.array_join(F.transform(held, lambda f: F.concat(head, f["text"])), "\n\n")

    return _dated_blocks(st, kept, by, visit, start, entry, block, "\n\n", "notes", land)


def susceptibility(
    df: DataFrame, keys: Sequence[str], name: str, grade: str, order: str, ranks: Mapping[str, int] = GRADE_RANKS
) -> DataFrame:
    """Per event one grade per antibiotic (the best ranked), antibiotics in first-seen order: ``susceptibility``.

    Two levels: first one row per (event, antibiotic), combined before the shuffle, then the short list.
    """
    rank = F.lit(99)
    for value, r in ranks.items():
        rank = F.when(F.col(grade) == value, F.lit(r)).otherwise(rank)
    best = (
        df.where(~is_blank(name))
        .groupBy(*keys, name)
        .agg(
            F.min_by(F.coalesce(F.col(grade), F.lit("")), F.struct(rank, F.col(order))).alias("__grade"),
            F.min(order).alias("__first"),
        )
    )
    item = F.struct(F.col("__first"), F.concat(F.col(name), F.lit(":"), F.col("__grade")).alias("__text"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda e: e["__text"])
    return best.groupBy(*keys).agg(F.array_join(listed, ", ").alias("susceptibility"))


def ordered_text(
    df: DataFrame, keys: Sequence[str], text: str, order: Sequence[str], sep: str, distinct: bool = False
) -> DataFrame:
    """Texts of a group joined in order; with ``distinct`` every text only at its first place.

    Repeats are folded before the shuffle, so what is gathered per group is just the text it outputs.
    """
    kept = df.where(F.col(text).isNotNull())
    place = F.struct(*order)
    if distinct:
        kept = kept.groupBy(*keys, text).agg(F.min(place).alias("__place"))
    else:
        kept = kept.select(*keys, text, place.alias("__place"))
    items = F.array_sort(F.collect_list(F.struct("__place", F.col(text).alias("__text"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(items, lambda e: e["__text"]), sep).alias(text))


def group_text(
    cohort: DataFrame, lines: DataFrame, keys: Sequence[str], group: str, groups: Sequence[str], text: str,
    order: Sequence[str],
) -> DataFrame:
    """One row per cohort key and group: the lines in time order, ``""`` where there are none.

    Lines meet their cohort key once, and a key's groups are spread out after that.
    """
    kept = lines.where(F.col(text).isNotNull() & F.col(group).isin(list(groups)))
    place = F.struct(F.struct(*order).alias("place"), F.col(text).alias("text"), F.col(group).alias("of"))
    held = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(place)).alias("__held"))

    def told(name: str) -> Column:
        own = F.filter("__held", lambda e: e["of"] == name)
        return F.coalesce(F.array_join(F.transform(own, lambda e: e["text"]), "\n"), F.lit(""))

    texts = F.array(*[F.struct(F.lit(g).alias(group), told(g).alias(text)) for g in groups])
    return cohort.select(*keys).join(held, keys, "left").select(*keys, F.inline(texts))


def panel_text(
    df: DataFrame, keys: Sequence[str], ts: str, test: str, specimen: str, organism: str, drug: str, grade: str,
    comment: str, order: str, rules: Mapping,
) -> DataFrame:
    """Culture rows of a panel to one text per key: events in time order, repeats dropped, joined by `` | ``."""
    event = [*keys, ts, test, specimen, organism]
    rows = df.withColumn("__comment", clean_comment(comment, rules))
    rank = F.lit(99)
    for value, r in GRADE_RANKS.items():
        rank = F.when(F.col(grade) == value, F.lit(r)).otherwise(rank)
    has_drug = ~is_blank(drug)
    # one row per (event, drug): best grade, first place of the drug, first comment, first row
    per_drug = rows.groupBy(*event, F.when(has_drug, F.col(drug)).alias("__drug")).agg(
        F.min_by(F.coalesce(F.col(grade), F.lit("")), F.struct(rank, F.col(order))).alias("__grade"),
        F.min(order).alias("__first"),
        F.min(F.when(F.col("__comment").isNotNull(), F.struct(F.col(order), F.col("__comment")))).alias("__note"),
    )
    item = F.struct("__first", F.concat(F.col("__drug"), F.lit(":"), F.col("__grade")).alias("__text"))
    events = per_drug.groupBy(*event).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("__drug").isNotNull(), item))), lambda e: e["__text"]), ", "
        ).alias("__sus"),
        F.min("__note").alias("__note"),
        F.min("__first").alias("__first"),
    )
    text = events.withColumn("text", event_text(test, specimen, organism, "__sus", F.col("__note.__comment")))
    # rows without a time come last
    return ordered_text(text.withColumn("__no_ts", F.col(ts).isNull()), keys, "text", ["__no_ts", ts, "__first"], " | ", True)


def text_length_stats(df: DataFrame, text: str, limit: int = 512) -> DataFrame:
    """One row: count, mean, max, median and 95th percentile of words; token estimate; share above a limit."""
    counted = df.where(F.col(text).isNotNull()).select(
        word_count(text).cast("double").alias("w"), (F.length(text) / 4.0).alias("t")
    )
    row = counted.agg(
        F.count(F.lit(1)).alias("texts"),
        F.avg("w").alias("mean_words"),
        F.max("w").alias("max_words"),
        F.avg("t").alias("mean_tokens"),
        F.avg((F.col("t") > limit).cast("double")).alias("share_over_limit"),
    )
    marks = column_quantiles(counted, ["w"], [0.5, 0.95]).agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("median_words"),
        F.max(F.when(F.col("prob") == 0.95, F.col("quantile"))).alias("p95_words"),
    )
    return row.join(F.broadcast(marks), F.lit(True))


def marker_rate(df: DataFrame, text: str, marker: str) -> DataFrame:
    """One row: texts, texts with the marker, share."""
    hit = F.coalesce(F.col(text).contains(marker), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(hit).alias("with_marker"), F.avg(hit.cast("double")).alias("share")
    )


def sentence_openers(df: DataFrame, text: str, position: int, words: int = 6) -> DataFrame:
    """How often each opening (first words) occurs in the sentence at a 1-based position."""
    sentence = F.try_element_at(sentences(text), F.lit(position))
    opener = F.array_join(F.slice(F.split(sentence, r"\s+"), 1, words), " ")
    return df.select(opener.alias("opener")).where(F.col("opener").isNotNull()).groupBy("opener").agg(
        F.count(F.lit(1)).alias("n")
    )


def trigger_report(df: DataFrame, text: str, phrases: Sequence[str], key: str, examples: int = 3, seed: str | int = 0) -> DataFrame:
    """Per phrase: texts with it, its most common sentence position, the first example by key, and ``examples`` drawn by hash of the key.

    All rows are counted.  Phrases are tested inside the row, so no row is paired with the whole list
    in a join; ties between positions go to the earlier one.  A task keeps its first ``examples`` of a phrase only.
    """
    def first_position(phrase: str) -> Column:
        hits = F.transform(sentences(text), lambda s: F.lower(s).contains(phrase.lower()))
        return (F.array_position(hits, F.lit(True)) - 1).cast("int")

    found = F.array(*[
        F.when(F.col(text).contains(p), F.struct(F.lit(p).alias("phrase"), first_position(p).alias("pos"))) for p in phrases
    ])
    hits = df.select(key, F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select(key, "f.phrase", "f.pos")
    per_pos = hits.groupBy("phrase", "pos").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("example"))
    placed = F.when(F.col("pos") >= 0, F.struct((-F.col("n")).alias("n"), F.col("pos")))
    found = per_pos.groupBy("phrase").agg(
        F.sum("n").alias("texts"), F.min_by("pos", placed).alias("usual_position"), F.min("example").alias("example")
    )
    return found.join(_drawn(hits, "phrase", key, examples, seed), "phrase")


def _drawn(hits: DataFrame, group: str, key: str, n: int, seed: str | int) -> DataFrame:
    """``group, examples``: the n keys of each group with the least hashes, in the order of these."""
    order = Window.partitionBy(group).orderBy("__draw", key)
    ranked = hits.select(group, key, hash_hex(seed, key).alias("__draw")).withColumn("__rank", F.row_number().over(order))
    picked = ranked.where(F.col("__rank") <= n).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__rank", key))).alias("__picked"))
    return picked.select(group, F.transform("__picked", lambda e: e[key]).alias("examples"))


def before_after(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rows, changed rows, emptied rows, mean length before and after."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("changed"),
        F.count_if(F.col(a).isNotNull() & F.col(b).isNull()).alias("emptied"),
        F.avg(F.length(a)).alias("mean_before"),
        F.avg(F.length(b)).alias("mean_after"),
    )


def length_distribution(df: DataFrame, text: str) -> DataFrame:
    """One row: texts and the least, median, mean, 75th, 90th, 95th percentile and greatest of their lengths; NULL texts left out."""
    lengths = df.where(F.col(text).isNotNull()).select(F.length(text).cast("double").alias("n"))
    row = lengths.agg(F.count(F.lit(1)).alias("texts"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.max("n").alias("greatest"))
    marks = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    found = column_quantiles(lengths, ["n"], list(marks.values()))
    wide = found.agg(*[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for name, p in marks.items()])
    return row.join(F.broadcast(wide), F.lit(True)).select("texts", "least", "median", "mean", "p75", "p90", "p95", "greatest")


def phrase_report(df: DataFrame, text: str, phrases: Sequence[str], key: str, chars: int = 80) -> DataFrame:
    """Per phrase that occurs: texts with it, and the beginning of the first one by key, on one line."""
    held = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.col(text), p))
    shown = F.translate(F.substring(text, 1, chars), "\n", " ")
    hits = df.select(key, shown.alias("__shown"), F.explode(held).alias("phrase"))
    return hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("texts"), F.min_by("__shown", F.struct(key, "__shown")).alias("example"))
