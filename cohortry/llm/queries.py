"""Queries of the operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import alignment, bpe, decontaminate, langid, line_quality, minhash, packing, pii, prefix_trie, secrets, urls, vector_dedup, warc
from cohortry.llm.common import shared_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A vocabulary file, by default the ranks of the byte-level BPE, where the installed package has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secrets(_table(spark, folder, "documents"))
    base = [r.kind for r in secrets.BASE]
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in base]
    digest = F.sha2(secrets.spans_text(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets.spans_text(F.col("found")).alias("spans"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.load_ranks(vocabulary())
    return bpe.decode_digests(bpe.encode(_table(spark, folder, "documents"), ranks), ranks).drop("decoded")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


def op5_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return urls.judge_urls(pages, urls.spam_pages(pages))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_shards(spark: SparkSession, folder: str) -> DataFrame:
    out = packing.shard(_table(spark, folder, "documents"), 16)
    return out.select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality.line_quality(_table(spark, folder, "documents"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(_table(spark, folder, "documents"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(_table(spark, folder, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    pair = alignment.load_pair(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    out = alignment.align_digests(_table(spark, folder, "documents"), pair)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(_table(spark, folder, "embeddings"))


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, folder, "conversations"))


def queries() -> dict[str, Query]:
    own = [op1_secrets, op2_near_duplicates, op3_bpe, op4_language, op5_urls, op6_decontamination, op7_shards, op8_quality, op9_pii, op10_warc, op11_alignment, op12_vectors, op13_trie]
    return {f.__name__: f for f in own}

