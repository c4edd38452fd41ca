"""Prefix trie of conversations: a skeleton of splitter paths, local sorted shards, and a reduction for the skeleton's nodes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import written

#: Bytes of a turn's key; a path is the keys of its turns joined, so that prefixes of turns are prefixes of bytes.
KEY = 16
#: Paths for each shard, the most shards, sampled paths for each shard, and the most bytes of all splitters (longer ones are cut).
SHARD, MOST_SHARDS, SAMPLED, SPLITTER_BYTES = 1 << 14, 1 << 11, 8, 8 << 20
#: Turns at the beginning that a conversation takes from the first of its hundred: crc32 of its id modulo this.
HEADS = 6
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuilt_paths(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, path, sizes``: each conversation rebuilt from the first h turns of conversation c - c % 100 and its own after the first h.

    ``path`` joins a key of 128 bits for each turn (role and text), ``sizes`` has the code points of the texts. Turns are in the order of
    turn (null first), role, the first 64 characters of the text, and key; null roles and texts count as empty. Rows without a
    conversation are left out. A conversation's keys (20 bytes a turn, no texts) stand in one row.
    """
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    key = F.unhex(F.md5(F.concat_ws(":", F.length(who), who, said)))
    one = F.struct(F.col(turn).isNotNull().alias("dated"), F.col(turn).alias("turn"), who.alias("role"), F.left(said, F.lit(64)).alias("begin"), key.alias("key"), F.length(said).alias("size"))
    kept = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), one.alias("one"))
    listed = kept.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list("one")), lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"))).alias("own"))
    first = listed.where("conv % 100 = 0").select(F.col("conv").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")
    both = listed.join(first, F.col("conv") - F.col("conv") % 100 == F.col("base"), "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast("array<struct<key:binary,size:int>>"))
    whole = F.concat(head, F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1))))
    joined = F.concat_ws("", F.transform(whole, lambda x: F.hex(x["key"])))
    return both.select("conv", F.unhex(joined).alias("path"), F.transform(whole, lambda x: x["size"]).alias("sizes"))


def list_digests(members: DataFrame, name: str = "name", item: str = "item") -> DataFrame:
    """``name, digest``: SHA-256 (hex) of the items of each name in ascending order, decimal, comma-joined.

    Rows are dealt by ranges of name and item, each task joins its own run of a name, and the runs of a name, in order, pass through
    one digest: a digest is one stream by its definition, but only joined pieces of at most a megabyte reach it.
    """
    kind = dict(members.dtypes)[name]
    runs = members.select(F.col(name).alias("name"), F.col(item).alias("item")).repartitionByRange("name", "item").sortWithinPartitions("name", "item")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, items = batch.column("name").to_pylist(), batch.column("item").to_pylist()
            out, begin = [], 0
            for i in range(1, len(names) + 1):
                if i == len(names) or names[i] != names[begin] or i - begin == 50_000:
                    out.append((names[begin], items[begin], ",".join(map(str, items[begin:i]))))
                    begin = i
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.column("name").type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out])], ["name", "least", "run"])

    pieces = runs.mapInArrow(joined, f"name {kind}, least long, run string").repartition("name").sortWithinPartitions("name", "least")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for one, run in zip(batch.column("name").to_pylist(), batch.column("run").to_pylist()):
                if one != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = one, sha256(run.encode())
                else:
                    state.update(b"," + run.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.column("name").type), pa.array([o[1] for o in out], pa.string())], ["name", "digest"])
            kind_of = batch.column("name").type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind_of), pa.array([state.hexdigest()])], ["name", "digest"])

    return pieces.mapInArrow(digested, f"name {kind}, digest string")


def splitters(paths: DataFrame, n: int) -> list[bytes]:
    """About evenly spaced paths, at most MOST_SHARDS - 1 of them and SPLITTER_BYTES in all: from a sample by hash."""
    shards = min(MOST_SHARDS, -(-n // SHARD))
    if shards < 2:
        return []
    longest = SPLITTER_BYTES // (shards * SAMPLED) // KEY * KEY
    draw = F.pmod(F.xxhash64("path"), F.lit(1 << 30)) < int(min(1.0, shards * SAMPLED / n) * (1 << 30))
    found = sorted({bytes(r[0]) for r in paths.where(draw).select(F.substring("path", 1, longest)).collect()})
    return sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else []


class _Open:
    """A node that the walk of a shard has entered and not left."""

    __slots__ = ("path", "size", "shared", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, path: bytes, size: int, shared: int | None):
        self.path, self.size, self.shared = path, size, shared
        self.n, self.least, self.children, self.leaves, self.saved, self.ends = 0, None, 0, 0, 0, None
        self.waiting: list[tuple] = []


def _walked(skeleton: dict[bytes, int], empty: str):
    """The nodes of sorted shards: finished ones, and what a shard knows of the skeleton's nodes (``shared`` is their number).

    A node is left when a path comes that doesn't begin with it. Finished children wait for their parent's least member; children of
    a skeleton node get it after the reduction (``under`` is its number).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open] = []
        out: list[tuple] = []

        def leave() -> None:
            node = stack.pop()
            above = stack[-1] if stack else None
            depth = len(node.path) // KEY
            if node.shared is None:
                node.leaves += not node.children
                node.saved += (node.n - 1) * node.size
                out.extend((*w[:2], node.least, *w[3:]) for w in node.waiting)
                row = (node.least, depth, None, node.n, node.children, node.leaves, node.saved, node.ends or empty, None, None if above.shared is None else above.shared)
                above.children, above.leaves, above.saved = above.children + 1, above.leaves + node.leaves, above.saved + node.saved
                if above.shared is None:
                    above.waiting.append(row)
                else:
                    out.append(row)
            else:
                out.append((node.least, depth, None, node.n, node.children, node.leaves, node.saved, node.ends, node.shared, node.size))
            if above:
                above.n += node.n
                above.least = node.least if above.least is None else min(above.least, node.least)

        last = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "path", "sizes", "n", "least", "ends")]
            for shard, path, sizes, n, least, ends in zip(*columns):
                if shard != last:
                    while stack:
                        leave()
                    last = shard
                    stack.append(_Open(b"", 0, skeleton[b""]))
                while not path.startswith(stack[-1].path):
                    leave()
                for depth in range(len(stack) - 1, len(path) // KEY):
                    prefix = path[: (depth + 1) * KEY]
                    stack.append(_Open(prefix, sizes[depth], skeleton.get(prefix) if stack[-1].shared is not None else None))
                top = stack[-1]
                top.n, top.least, top.ends = top.n + n, least if top.least is None else min(top.least, least), ends
            yield _table(out)
            out.clear()
        while stack:
            leave()
        yield _table(out)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "shared", "under"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _reduced(parts: DataFrame, skeleton: dict[bytes, int], empty: str) -> list[tuple]:
    """Rows of the skeleton's nodes: sums of what shards know (combined by Spark), then from the deepest node up.

    The skeleton has at most SPLITTER_BYTES / KEY nodes.
    """
    sums = parts.where("shared is not null").groupBy("shared").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends"), F.max("under").alias("size"),
    )
    known = {r["shared"]: r.asDict() for r in sums.collect()}
    paths = {i: p for p, i in skeleton.items()}
    for i in sorted(known, key=lambda i: -len(paths[i])):
        node = known[i]
        node["leaves"] += not node["children"]
        node["saved"] += (node["n"] - 1) * node["size"]
        if paths[i]:
            above = known[skeleton[paths[i][:-KEY]]]
            above["children"], above["leaves"], above["saved"] = above["children"] + 1, above["leaves"] + node["leaves"], above["saved"] + node["saved"]
    rows = []
    for i, node in known.items():
        parent = known[skeleton[paths[i][:-KEY]]]["conv_id"] if paths[i] else None
        rows.append((node["conv_id"], len(paths[i]) // KEY, parent, node["n"], node["children"], node["leaves"], node["saved"], node["ends"] or empty, i))
    return rows


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the ``path`` of conversations (``conv, path, sizes``), the empty one included.

    ``conv_id`` is the least member, ``depth`` the number of turns, ``parent_conv_id`` the parent's conv_id (null for the root),
    ``n_convs`` the members, ``n_children`` the children, ``n_leaves`` the childless nodes of the subtree, ``saved_tokens`` the sum over
    the subtree of (n_convs - 1) times the size of the last turn, ``ends_sha256`` the digest of the members that end at the node.

    Equal paths are one row from the start. Splitters (a bounded sample) deal the paths into ranges. A node whose members lie in two
    ranges begins a splitter, so the trie of the splitters holds all such nodes; each range finishes its other nodes in one walk over
    its sorted paths, holding open nodes only, and sends one row for each skeleton node it meets. These rows are combined. No table
    but the splitters' trie is broadcast. Ranges of thousands of paths with a common turn are cut like any other. No paths: no rows.
    """
    empty = sha256(b"").hexdigest()
    paths = written(paths.withColumn("fp", F.unhex(F.md5("path"))), "paths")
    folded = paths.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"))
    several = folded.where("n > 1").select(F.col("fp").alias("name"))
    lists = list_digests(paths.join(several, F.col("fp") == F.col("name")).select("name", F.col("conv").alias("item")))
    # the path of a class is that of its least member
    heads = folded.join(lists, F.col("fp") == F.col("name"), "left").select(F.col("fp").alias("of"), "n", "least", F.coalesce("digest", F.sha2(F.col("least").cast("string").cast("binary"), 256)).alias("ends"))
    classes = written(paths.join(heads, (F.col("conv") == F.col("least")) & (F.col("fp") == F.col("of"))).select("path", "sizes", "n", "least", "ends"), "classes")

    n = classes.count()
    cuts = splitters(classes, n)
    skeleton = {p: i for i, p in enumerate(sorted({b"", *(s[:k] for s in cuts for k in range(KEY, len(s) + 1, KEY))}))}
    dealt = classes.withColumn("shard", _shard(cuts)(F.col("path")))
    dealt = dealt.repartition(max(1, len(cuts) + 1), "shard").sortWithinPartitions("shard", "path")
    made = dealt.mapInArrow(_walked(skeleton, empty), f"{NODE}, shared long, under long")
    made = written(made, "nodes")
    top = _reduced(made, skeleton, empty)
    spark = paths.sparkSession
    shared = spark.createDataFrame(top, f"{NODE}, number long")
    parents = shared.select("number", F.col("conv_id").alias("above"))
    local = made.where("shared is null").join(F.broadcast(parents), F.col("under") == F.col("number"), "left")
    names = [c.split()[0] for c in NODE.split(", ")]
    own = local.select(*(F.coalesce("above", c).alias(c) if c == "parent_conv_id" else c for c in names))
    return own.unionByName(shared.select(names))


def _shard(cuts: list[bytes]):
    @F.pandas_udf("int")
    def shard(paths):
        return paths.map(lambda p: bisect_right(cuts, bytes(p))).astype("int32")

    return shard if cuts else (lambda path: F.lit(0))


def conversation_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of rebuilt conversations (``rebuilt_paths``). Other columns are not looked at."""
    return prefix_trie(rebuilt_paths(turns, conv_id, turn, role, text))
