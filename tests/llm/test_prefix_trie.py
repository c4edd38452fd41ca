"""The trie of conversations against dictionaries of tuples."""

from __future__ import annotations

import collections
import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cohortry.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + said[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[c] for c in children[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def made(seed, n):
    """Conversations of few different turns, so that beginnings repeat, a third of them with one beginning, many equal ones."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        length = rng.choice([0, 1, 2, 3, 5, 9, 30])
        same = rng.random()
        said = ["hello é😀"] + [rng.choice(["a", "bb", "ccc", "", None]) for _ in range(length)] if same < 0.4 else [rng.choice("xyz") * 3 for _ in range(length)]
        said = ["one", "two", "three", "four", "five", "six", "seven", "eight"] if same > 0.8 else said
        rows += [(c, t if t else None, rng.choice(["user", "user", None]) if same < 0.8 else "user", s) for t, s in enumerate(said)]
    return rows


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_trie(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize(("shard", "longest"), [(1 << 14, 8 << 20), (5, 8 << 20), (5, 40 * 8 * 16 * 3)])
def test_shards(spark, monkeypatch, shard, longest):
    """One shard, many shards, and splitters that are cut to a few turns give the same trie."""
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "SPLITTER_BYTES", longest)
    rows = made(1, 700)
    assert rows_of(prefix_trie.conversation_trie(table(spark, rows))) == brute(rows)


def test_digest_runs(spark):
    members = spark.range(0, 3000).select(F.expr("unhex(md5(string(if(id % 3 = 0, 0, id % 40))))").alias("name"), (F.col("id") * 37 % 3001).alias("item"))
    want = collections.defaultdict(list)
    for r in members.collect():
        want[bytes(r.name)].append(r.item)
    got = {bytes(r.name): r.digest for r in prefix_trie.list_digests(members.repartition(9)).collect()}
    assert got == {k: sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def test_odd_turns(spark):
    long = "lorem " * 20000
    rows = [(None, 0, "user", "a"), (5, None, None, None), (5, None, None, None), (5, 1, "user", long), (5, 1, "user", "a"), (5, 1, "bot", "b"), (100, 0, "user", ""), (101, 0, "user", long), (205, 0, None, "x"), (207, 0, "u:", "x"), (208, 0, "u", ":x")]
    clashing = table(spark, rows).selectExpr("*", "'p' as path", "'f' as fp", "'c' as conv", "1 as n", "'s' as shard", "'o' as own", "'b' as base")
    assert rows_of(prefix_trie.conversation_trie(clashing)) == brute(rows)
    assert prefix_trie.conversation_trie(table(spark, [])).count() == 0
