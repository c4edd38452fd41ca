"""Quality rules: counts of a text's own words and lines, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import SPACE_RE, WORD_RE

#: A line is boilerplate of its host if at least so many distinct texts hold it; a line of fewer words than LONG_LINE may repeat by
#: chance and must also be held by this share of the host's texts.
MIN_TEXTS, LONG_LINE, SHARE = 10, 5, 0.005
#: A document is depleted if more than this share of its words stands in boilerplate lines.
DEPLETED = 0.5
#: Rules on the text alone.
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once; a plain column could be computed anew for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _covered(starts: Column) -> Column:
    """Words in windows of three that begin at the given ascending places."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        starts, begin, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
    )["n"]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words which the text holds twice or more.

    Windows are sorted by hash, so that equal ones are neighbours: n log n for a text of any length.
    """

    def of(w: Column) -> Column:
        windows = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )

        def repeats(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.when(F.size(F.array_distinct(s["h"])) == F.size(s), F.lit(0).cast("long")).otherwise(_covered(F.sort_array(F.transform(again, lambda x: x["i"]))))

        return _let(F.sort_array(windows), repeats)

    return _let(words, of)


def _repeated_lines(text: Column) -> Column:
    return _let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_RE)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _line_hash(line: Column) -> Column:
    """128 bits of a line without regard to case and to the amount of white space."""
    return F.unhex(F.md5(F.lower(F.btrim(F.regexp_replace(line, SPACE_RE, " ")))))


def _keyed(docs: DataFrame, host: str, text: str, *more: Column) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*more, F.coalesce(F.col(host), F.lit("")).alias("__host"), F.unhex(F.md5(whole)).alias("__md5"), whole.alias("__text"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``__host, __md5, places, removed_words`` for each distinct text of a host that holds boilerplate lines.

    ``places`` are those of the lines among all lines of the text. Documents are counted by distinct text, so that copies of one text
    don't make its lines boilerplate.
    """
    rows = _keyed(docs, host, text)
    counted = F.transform(
        F.split("__text", "\n", -1),
        lambda x, i: F.when(x.rlike(WORD_RE), F.struct(i.alias("place"), _line_hash(x).alias("line"), F.regexp_count(x, F.lit(WORD_RE)).alias("n"))),
    )
    # the place tells apart the lines of one text, so that rows of equal texts fall together
    lines = rows.select("__host", "__md5", F.explode(F.filter(counted, lambda c: c.isNotNull())).alias("c")).select("__host", "__md5", "c.place", "c.line", "c.n").distinct()
    held = lines.groupBy("__host", "__md5", "line").agg(F.sum("n").alias("n"), F.max("n").alias("words"), F.collect_list("place").alias("places"))
    texts = rows.select("__host", "__md5").distinct().groupBy("__host").agg(F.count(F.lit(1)).alias("texts"))
    counts = held.groupBy("__host", "line").agg(F.count(F.lit(1)).alias("in_texts"), F.max("words").alias("words")).where(F.col("in_texts") >= MIN_TEXTS)
    frequent = counts.join(texts, "__host").where((F.col("words") >= LONG_LINE) | (F.col("in_texts") >= F.col("texts") * SHARE)).select("__host", "line")
    found = held.join(frequent, ["__host", "line"]).groupBy("__host", "__md5")
    return found.agg(F.flatten(F.collect_list("places")).alias("places"), F.sum("n").alias("removed_words"))


def _measures() -> list[Column]:
    text = F.col("__text")
    words = F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0))
    return [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE_RE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        _repeated_lines(text).alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def line_quality(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``doc_id``, measures, ``removed_words, base_failed, kept`` for each row of ``docs``.

    A line that at least ten distinct texts of a host hold is boilerplate there, whatever its case and white space and the size of the
    host; a line under five words only if 0.5 % of the host's texts hold it, too. A document with more than half of its words in such lines is depleted. ``kept``: neither that nor failed by its own text
    (under 50 words, or over half of them in windows of three words that repeat).

    Null text counts as empty and fails; a null host is the host ''. Repeated rows are judged alike and count once. Rows of an empty
    table: none. The line counts are combined before each shuffle; a hot host is spread, as keys hold the text or the line.
    """
    rows = _keyed(docs, host, text, F.col(doc_id).alias("__id"))
    measured = rows.select("__id", "__host", "__md5", *_measures())
    found = boilerplate(docs, host, text).select(F.col("__host").alias("__h"), F.col("__md5").alias("__m"), "removed_words")
    judged = measured.join(found, (F.col("__host") == F.col("__h")) & (F.col("__md5") == F.col("__m")), "left")
    judged = judged.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn("base_failed", base_failed())
    depleted = F.col("removed_words") > DEPLETED * F.col("n_words")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed"]
    return judged.select(F.col("__id").alias(doc_id), *names, (~F.col("base_failed") & ~depleted).alias("kept"))


def apply_quality(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """The documents that are kept, without their boilerplate lines; all columns of any names, other texts as they are.

    Nulls, empty texts, repeated rows and empty tables count as in ``line_quality``; none of the kept has a null text.
    """
    found = boilerplate(docs, host, text)
    # the row travels as one struct: no name of a document's column can meet a name used here
    whole = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("__row")
    words = lambda: F.regexp_extract_all(F.col("__text"), F.lit(WORD_RE), F.lit(0))
    rows = _keyed(docs, host, text, whole).join(found, ["__host", "__md5"], "left")
    rows = rows.withColumns({"n_words": F.size(words()).cast("long"), "n_repeat_words": repeated_words(words())})
    depleted = F.coalesce("removed_words", F.lit(0)) > DEPLETED * F.col("n_words")
    left = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places")), lambda i: F.get(lines, i))
    cleaned = F.when(F.col("places").isNull(), F.col("__text")).otherwise(F.array_join(_let(F.split("__text", "\n", -1), left), "\n"))
    kept = rows.where(~base_failed() & ~depleted)
    return kept.select(*(cleaned.alias(c) if c == text else F.col("__row").getField(c).alias(c) for c in docs.columns))
