"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule); the rule's host ends at its first slash.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: The filter has so many blocks of 512 bits, whatever the list: 65536 rows of 72 bytes at most. A longer list only fills it more.
BLOCKS, WORDS, PROBES = 1 << 16, 8, 6
#: Query parameters that don't change the page.
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule whose host is the URL's or above it and whose path begins the URL's; else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without a final slash, other parameters sorted; no scheme, no fragment.

    Null where there is no host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)?$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOCKS))


def _masks(key: Column) -> list[Column]:
    """The bits of a key in each word of its block."""
    bits = [F.pmod(F.xxhash64(F.lit(i), key), F.lit(64 * WORDS)) for i in range(PROBES)]
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for bit in bits:
            one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))
            mask = mask.bitwiseOR(F.when(F.floor(bit / 64) == w, one).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return masks


def bloom(listed: DataFrame, key: str) -> DataFrame:
    """``block, w0 .. w7`` of the keys in ``listed``; blocks without a key are left out."""
    words = listed.select(_block(F.col(key)).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))))
    return words.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def listed_rows(rows: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """``rows`` and as last column the boolean ``listed``: whether their key is in the list; null keys are not.

    The filter is of bounded size, so it is sent to all tasks; only rows that pass it are joined with the list, which removes false
    positives. Hot keys on the side of the rows are split by adaptive execution, as the list holds each key once.
    """
    names = listed.select(F.col(listed_key).alias("__listed")).where("__listed is not null").distinct()
    filled = F.broadcast(bloom(names, "__listed"))
    # the row travels as one struct: no name of its columns can meet a name of the filter
    whole = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in rows.columns)).alias("__row")
    probed = rows.select(whole, F.col(key).alias("__key"), F.when(F.col(key).isNotNull(), _block(F.col(key))).alias("__block"))
    probed = probed.join(filled, F.col("__block") == F.col("block"), "left")
    maybe = F.col("block").isNotNull()
    for i, mask in enumerate(_masks(F.col("__key"))):
        maybe &= F.col(f"w{i}").bitwiseAND(mask) == mask
    probed = probed.select("__row", "__key", F.coalesce(maybe, F.lit(False)).alias("__maybe"))
    back = [F.col("__row").getField(c).alias(c) for c in rows.columns]
    sure = probed.where("__maybe").join(names, F.col("__key") == F.col("__listed"), "left")
    sure = sure.select(*back, F.col("__listed").isNotNull().alias("listed"))
    return sure.unionAll(probed.where("not __maybe").select(*back, F.lit(False).alias("listed")))


def judge_urls(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    The longest rule that fits decides; else a page is blocked if its canonical URL is that of a listed one. A null URL, or one
    without ``://``, has an empty host and path, fits no rule and is allowed. Repeated rows are judged each; an empty list blocks nothing.
    """
    rows = pages.select(F.col(page_id).alias("__id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("key"))
    names = listed.select(canonical(F.col(listed_url)).alias("key"))
    found = listed_rows(rows, "key", names, "key").withColumn("fit", rule_for(F.col("host"), F.col("path")))
    verdict = F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select(F.col("__id").alias(page_id), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))


def spam_pages(pages: DataFrame, url: str = "url", html: str = "html", marks: int = 10) -> DataFrame:
    """URLs of pages whose html has at least so many words that end in three of the same junk marks."""
    return pages.where(F.regexp_count(F.col(html), F.lit(r"[#*$%]{3}(?=[\s<]|$)")) >= marks).select(url)
