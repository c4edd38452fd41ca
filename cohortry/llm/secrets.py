"""Secret scans over a ledger of blobs: each content is scanned once for each version of a rule, findings are joined to all paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import shared_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` of a match must have ``least`` characters, else the match counts as nothing (but is passed over)."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Base kinds in their order. A run of hex digits or of an access key that is too short holds no longer one, so the least length
#: stands in the pattern there.
BASE = [
    Rule("assign", 1, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
]
#: Kinds that the method adds.
ADDED = [
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
]
RULES = BASE + ADDED
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
_LEDGER = f"blob string, scanned array<string>, spans array<struct<rule:string,span:{SPAN}>>"


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches, leftmost and non-overlapping, in code points.

    Splitting at the matches gives the texts between them; their lengths and those of the matches add up to the places. A list that
    grows is copied for each element, so n matches are walked in runs of about the cube root of n, each from its own begin
    (then copies of a run's spans and sums of the runs before it are about as many).
    """
    pattern, empty = F.lit(rule.pattern), F.array().cast(f"array<{SPAN}>")
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    # lengths of what stands between matches, of matches, and of the part that must be long enough
    found = F.struct(*(F.transform(x, F.length).alias(c) for c, x in (("b", F.split(text, rule.pattern, -1)), ("m", matches), ("g", judged))))
    total = lambda numbers: F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["b"]
        end = start + F.coalesce(p["m"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        good = p["m"].isNotNull() & (p["g"] >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def runs(parts: Column) -> Column:
        width = F.ceil(F.cbrt(F.size(parts))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(parts), width), lambda i: F.slice(parts, i, width))

    def joined(cut: Column) -> Column:
        sizes = F.transform(cut, lambda run: F.aggregate(run, F.lit(0), lambda acc, p: acc + p["b"] + F.coalesce(p["m"], F.lit(0))))
        begins = lambda size: F.transform(size, lambda _, k: total(F.slice(size, F.lit(1), k)))
        return _let(
            _let(sizes, begins),
            lambda at: F.flatten(F.transform(cut, lambda run, k: F.aggregate(run, F.struct(F.get(at, k).alias("at"), empty.alias("out")), step)["out"])),
        )

    def walk(s: Column) -> Column:
        parts = F.transform(s["b"], lambda b, i: F.struct(b.alias("b"), F.get(s["m"], i).alias("m"), F.get(s["g"], i).alias("g")))
        return _let(_let(parts, runs), joined)

    return F.when(text.rlike(rule.pattern), _let(found, walk)).otherwise(empty)


def empty_ledger(spark: SparkSession) -> DataFrame:
    """A ledger that knows no blob."""
    return spark.createDataFrame([], _LEDGER)


def blob_of(text: Column) -> Column:
    """The content's address; null counts as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(docs: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that ``ledger`` lacks; a blob with nothing left to scan gives no row.

    Copies are combined before the shuffle on their address, so that each content is scanned once.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    blobs = docs.select(blob_of(F.col(text)).alias("blob"), whole.alias("text")).dropDuplicates(["blob"])
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    todo = blobs.join(seen, "blob", "left").withColumn("scanned", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
    todo = todo.where(F.size("scanned") > 0)

    def scanned(rank: int, rule: Rule) -> Column:
        found = F.transform(spans_of(F.col("text"), rule, rank), lambda s: F.struct(F.lit(rule.key).alias("rule"), s.alias("span")))
        return F.when(F.array_contains("scanned", rule.key), found).otherwise(F.array().cast(f"array<struct<rule:string,span:{SPAN}>>"))

    found = [scanned(rank, rule) for rank, rule in enumerate(rules)]
    return todo.select("blob", "scanned", F.concat(*found).alias("spans"))


def update_ledger(docs: DataFrame, path: str, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` (a Parquet folder; new if it isn't there) lacks, append it, and return the whole ledger."""
    spark = docs.sparkSession
    reader = spark.read.schema(empty_ledger(spark).schema)
    try:
        known = reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        known = empty_ledger(spark)
    scan_unseen(docs, known, rules, text).write.mode("append").parquet(path)
    return reader.parquet(path)


def secrets(docs: DataFrame, ledger_path: str | None = None, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, blob, found`` for each row of ``docs`` (a path): spans of the rules' current versions, by start and the rules' order.

    The ledger is kept at ``ledger_path``; without one, a new ledger in the shared folder serves this run. Findings of earlier
    versions of a rule stay in the ledger but aren't joined. Null text counts as empty; rows of one text, repeated or not, share its
    findings; null ids are kept; other columns are not looked at.
    """
    ledger = update_ledger(docs, ledger_path or shared_path(docs.sparkSession, "ledger"), rules, text)
    current = [r.key for r in rules]
    hits = ledger.select("blob", F.filter("spans", lambda s: s["rule"].isin(current)).alias("spans")).where(F.size("spans") > 0)
    # a blob has one row for each run that scanned some of its rules
    hits = hits.groupBy(F.col("blob").alias("__blob")).agg(F.array_sort(F.flatten(F.collect_list(F.transform("spans", lambda s: s["span"])))).alias("found"))
    paths = docs.select(F.col(doc_id).alias("__id"), blob_of(F.col(text)).alias("blob"))
    joined = paths.join(hits, F.col("blob") == F.col("__blob"), "left")
    return joined.select(F.col("__id").alias(doc_id), "blob", F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
