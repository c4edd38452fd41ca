"""Queries of embeddings, retrieval, assembly, reduction and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators import retrieval as ret
from cohortry.operators import vectors as vec
from cohortry.plans.registry import VISITS, Tables, big, query, rnd, visits
from cohortry.session import scratch_path
from cohortry.sources.tables import spread

_TOKENS = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def embed_sql(name: str, source: str, key: str, text: str, dim: int) -> str:
    """CTE with one row per key and slot: ``key, slot, value``."""
    trimmed = _TOKENS.format(text)
    return rf"""{name}_t AS (SELECT {key}, unnest(regexp_split_to_array({trimmed}, '\s+')) AS token FROM {source} WHERE {trimmed} <> ''),
{name}_s AS (SELECT {key}, ('0x' || substr(md5(token), 1, 8))::BIGINT % {dim} AS slot,
   CASE WHEN ('0x' || substr(md5(token), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign, count(*) OVER (PARTITION BY {key}) AS n FROM {name}_t),
{name} AS (SELECT {key}, slot, (sum(sign) / any_value(n)::DOUBLE)::FLOAT AS value FROM {name}_s GROUP BY {key}, slot)"""


def _slots(df: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """Non-zero entries of a vector as rows."""
    rows = df.select(*keys, F.posexplode(column).alias("slot", "value"))
    return rows.where(F.col("value") != 0).select(*keys, big("slot").alias("slot"), rnd("value").alias("value"))


@query(
    "embed_text",
    f"WITH {embed_sql('e', 'documents', 'doc_id', 'text', 64)} SELECT doc_id, slot, round(value::DOUBLE, 6) AS value FROM e WHERE value <> 0",
)
def _(t: Tables) -> DataFrame:
    return _slots(vec.embed_text(spread(t.documents.select("doc_id", "text")), "doc_id", "text", 64), ["doc_id"])


def _features(t: Tables) -> DataFrame:
    """Long form: the text and the source name of every document, and an empty feature."""
    parts = F.array(
        F.struct(F.lit("body").alias("feature"), F.col("text").alias("content")),
        F.struct(F.lit("origin").alias("feature"), F.concat_ws(" ", "source", "lang").alias("content")),
        F.struct(F.lit("absent").alias("feature"), F.lit("").alias("content")),
    )
    return spread(t.documents).select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.feature", "p.content")


@query(
    "embed_many",
    f"""WITH f AS (SELECT doc_id, 'body' AS feature, text AS content FROM documents UNION ALL SELECT doc_id, 'origin', source || ' ' || lang FROM documents
   UNION ALL SELECT doc_id, 'absent', '' FROM documents), {embed_sql('e', 'f', 'doc_id, feature', 'content', 32)},
z AS (SELECT doc_id, feature, count(*) FILTER (value <> 0) AS entries, sum(value::DOUBLE) AS total FROM e GROUP BY 1, 2)
SELECT f.doc_id, f.feature, coalesce(entries, 0)::BIGINT AS entries, round(coalesce(total, 0), 5) AS total FROM f LEFT JOIN z USING (doc_id, feature)""",
)
def _(t: Tables) -> DataFrame:
    got = vec.embed_many(_features(t), ["doc_id", "feature"], "content", 32)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return got.select(
        "doc_id", "feature", big(F.size(F.filter("embedding", lambda x: x != 0))).alias("entries"), rnd(total, 5).alias("total")
    )


@query("pending", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    return vec.pending(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query(
    "index_documents",
    f"WITH {embed_sql('e', 'documents', 'doc_id', 'text', 16)} SELECT doc_id, slot, round(value::DOUBLE, 6) AS value FROM e WHERE value <> 0",
)
def _(t: Tables) -> DataFrame:
    held = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    done = vec.embed_text(held, "doc_id", "text", 16)
    return _slots(vec.index_documents(t.documents.select("doc_id", "text"), done, "doc_id", "text", 16), ["doc_id"])


@query(
    "combine_wide",
    f"""WITH {VISITS}, q AS (SELECT l_orderkey AS visit_id, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
d AS (SELECT l_orderkey AS visit_id, max(l_discount) AS discount FROM lineitem GROUP BY 1), n AS (SELECT doc_id AS visit_id, n_chars AS chars FROM documents)
SELECT visit_id, subject_id, chars, quantity, discount FROM visits LEFT JOIN q USING (visit_id) LEFT JOIN d USING (visit_id) LEFT JOIN n USING (visit_id)""",
)
def _(t: Tables) -> DataFrame:
    items = t.lineitem.withColumnRenamed("l_orderkey", "visit_id")
    parts = {
        "quantity": items.groupBy("visit_id").agg(F.sum("l_quantity").alias("quantity")),
        "discount": items.groupBy("visit_id").agg(F.max("l_discount").alias("discount")),
        "chars": t.documents.select(F.col("doc_id").alias("visit_id"), F.col("n_chars").alias("chars")),
    }
    return vec.combine(visits(t), parts, "visit_id", ["visit_id", "subject_id", "chars", "quantity", "discount"])


@query(
    "combine_long",
    f"""WITH {VISITS}, w AS (SELECT l_orderkey AS visit_id, max(l_quantity) FILTER (l_returnflag = 'A') AS A, max(l_quantity) FILTER (l_returnflag = 'N') AS N,
     max(l_quantity) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1) SELECT visit_id, A, N, R FROM visits LEFT JOIN w USING (visit_id)""",
)
def _(t: Tables) -> DataFrame:
    long = t.lineitem.groupBy(F.col("l_orderkey").alias("visit_id"), "l_returnflag").agg(F.max("l_quantity").alias("q"))
    return vec.combine_long(visits(t).select("visit_id"), long, "visit_id", "l_returnflag", "q", ["A", "N", "R"])


def _centroids(t: Tables) -> DataFrame:
    entries = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = entries.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"])
    return means.groupBy("label").agg(packed.alias("embedding"))


@query(
    "top_k_similar",
    """WITH c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2),
q AS (SELECT label AS query, list(m ORDER BY i) AS v FROM c GROUP BY 1),
d AS (SELECT query, vec_id, list_sum(list_transform(list_zip(v, embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM q CROSS JOIN embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) AS rank FROM d)
SELECT query::BIGINT AS query, vec_id, rank::BIGINT AS rank, round(dist, 5) AS distance FROM r WHERE rank <= 5""",
)
def _(t: Tables) -> DataFrame:
    asked = _centroids(t).select(big("label").alias("query"), "embedding")
    docs = t.embeddings.select("vec_id", "embedding")
    hits = vec.top_k_similar(asked, docs, "query", "vec_id", "embedding", 5)
    return hits.select("query", "vec_id", big("rank").alias("rank"), rnd("distance", 5).alias("distance"))


_NEAR_SQL = """d AS (SELECT a.vec_id AS query, b.vec_id, list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
      FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) AS rank FROM d)"""


@query("nearest_vectors", f"WITH {_NEAR_SQL} SELECT query, vec_id, rank::BIGINT AS rank, round(dist, 5) AS distance FROM r WHERE rank <= 10")
def _(t: Tables) -> DataFrame:
    """Every twentieth vector as a query against all of them, through an index of at least sixteen pivots."""
    docs, path = t.embeddings.select("vec_id", "embedding"), scratch_path(t.spark, "index")
    ret.build_index(docs, "vec_id", "embedding", path, pivots=16)
    asked = docs.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query")
    hits, _ = ret.search_index(asked, "query", "embedding", path, 10, "vec_id")
    return hits.select("query", "vec_id", big("rank").alias("rank"), rnd("distance", 5).alias("distance"))


@query("extended_index", f"WITH {_NEAR_SQL} SELECT query, vec_id, rank::BIGINT AS rank, round(dist, 5) AS distance FROM r WHERE rank <= 4")
def _(t: Tables) -> DataFrame:
    """An index of the vectors of some labels that is extended by all others, those it holds included in the call."""
    docs, path = t.embeddings.select("vec_id", "embedding", "label"), scratch_path(t.spark, "index")
    ret.build_index(docs.where("label < 4"), "vec_id", "embedding", path, pivots=8)
    ret.extend_index(docs, "vec_id", "embedding", path)
    asked = docs.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")
    hits, _ = ret.search_index(asked, "query", "embedding", path, 4, "vec_id")
    return hits.select("query", "vec_id", big("rank").alias("rank"), rnd("distance", 5).alias("distance"))


@query(
    "retrieved_context",
    f"""WITH {embed_sql('q', 'benchmark', 'item_id', 'text', 64)}, {embed_sql('d', 'documents', 'doc_id', 'text', 64)},
qn AS (SELECT item_id, sum(value::DOUBLE * value::DOUBLE) AS n FROM q GROUP BY 1), dn AS (SELECT doc_id, sum(value::DOUBLE * value::DOUBLE) AS n FROM d GROUP BY 1),
x AS (SELECT item_id, doc_id, sum(q.value::DOUBLE * d.value::DOUBLE) AS dot FROM q JOIN d USING (slot) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(qn.n + coalesce(dn.n, 0) - 2 * coalesce(dot, 0), 9), doc_id) AS rank
      FROM qn CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN dn USING (doc_id) LEFT JOIN x USING (item_id, doc_id))
SELECT item_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    """Benchmark passages as prompts, all documents as the store."""
    asked = vec.embed_text(t.benchmark, "item_id", "text", 64)
    store = vec.embed_text(spread(t.documents.select("doc_id", "text")), "doc_id", "text", 64)
    hits = vec.top_k_similar(asked, store, "item_id", "doc_id", "embedding", 3)
    return vec.retrieved_context(hits, t.documents, "item_id", "doc_id", "text")


@query("l2_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def _(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", rnd(vec.l2_norm("embedding")).alias("norm"))


@query("explode_vector", f"SELECT vec_id, {', '.join(f'embedding[{i + 1}]::DOUBLE AS x{i}' for i in range(64))} FROM embeddings")
def _(t: Tables) -> DataFrame:
    names = [f"x{i}" for i in range(64)]
    return vec.explode_vector(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", names)


@query(
    "flatten_features",
    """SELECT vec_id, 66::BIGINT AS width, label::DOUBLE AS first, embedding[1]::DOUBLE AS second, vec_id::DOUBLE AS last FROM embeddings""",
)
def _(t: Tables) -> DataFrame:
    dims = {"label": 1, "embedding": 64, "id": 1}
    slots = {name: start for name, start, _ in vec.feature_index_map(dims)}
    flat = vec.flatten(t.embeddings.withColumn("id", F.col("vec_id")), list(dims))
    at = lambda name: F.get("features", F.lit(slots[name]))
    return flat.select(
        "vec_id", big(F.size("features")).alias("width"), at("label").alias("first"), at("embedding").alias("second"), at("id").alias("last")
    )


_SLOTS = [(f"slot{i}", 4 * i, 4) for i in range(16)]
_VISIBLE, _LO, _HI = 5, 0.2, 0.6
_LOW, _HIGH = vec.mask_bounds(_LO, _HI, len(_SLOTS) - _VISIBLE)


def _k_sql(seed: int) -> str:
    return f"{_LOW} + ('0x' || substr(md5(concat_ws('|', vec_id, 'k', '{seed}')), 1, 8))::BIGINT % {_HIGH - _LOW + 1}"


def _masked_out(df: DataFrame) -> DataFrame:
    kept = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x))
    return df.select(
        "vec_id", F.array_join(F.sort_array("masked"), ",").alias("masked"), rnd(kept, 5).alias("kept")
    )


def _masked_sql(chosen: str) -> str:
    """``chosen`` is a CTE ``ch(vec_id, slot)``."""
    return f"""WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), {chosen},
m AS (SELECT vec_id, string_agg(slot::VARCHAR, ',' ORDER BY slot) AS masked FROM ch GROUP BY 1),
k AS (SELECT v.vec_id, sum(CASE WHEN ch.slot IS NULL THEN abs(x) ELSE 0 END) AS kept FROM v LEFT JOIN ch ON ch.vec_id = v.vec_id AND ch.slot = v.i // 4 GROUP BY 1)
SELECT k.vec_id, coalesce(masked, '') AS masked, round(kept, 5) AS kept FROM k LEFT JOIN m USING (vec_id)"""


def _doubles(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


@query(
    "mask_random",
    _masked_sql(f"""ch AS (SELECT vec_id, slot FROM (SELECT vec_id, slot, {_k_sql(11)} AS k,
      row_number() OVER (PARTITION BY vec_id ORDER BY md5(concat_ws('|', vec_id, slot, '11')), slot) AS r
      FROM embeddings, unnest(range({_VISIBLE}, {len(_SLOTS)})) AS s(slot)) WHERE r <= k)"""),
)
def _(t: Tables) -> DataFrame:
    return _masked_out(vec.mask_random(_doubles(t), "vec_id", "embedding", _SLOTS, _VISIBLE, _LO, _HI, 11))


@query(
    "mask_top_k",
    _masked_sql(f"""ch AS (SELECT vec_id, slot FROM (SELECT vec_id, slot, {_k_sql(12)} AS k, row_number() OVER (PARTITION BY vec_id ORDER BY rms DESC, slot) AS r
      FROM (SELECT vec_id, i // 4 AS slot, sqrt(sum(x * x)) / 2 AS rms FROM v GROUP BY 1, 2) WHERE slot >= {_VISIBLE}) WHERE r <= k)"""),
)
def _(t: Tables) -> DataFrame:
    rows = _doubles(t).withColumn("importance", F.col("embedding"))
    return _masked_out(vec.mask_top_k(rows, "vec_id", "embedding", "importance", _SLOTS, _VISIBLE, _LO, _HI, 12))


_BERNOULLI = f"""ch AS (SELECT vec_id, slot FROM embeddings, unnest(range(0, {len(_SLOTS)})) AS s(slot)
      WHERE (('0x' || substr(md5(concat_ws('|', vec_id, slot, '13')), 1, 8))::BIGINT + 0.5) / 4294967296.0 < 0.3)"""


@query("mask_bernoulli", _masked_sql(_BERNOULLI))
def _(t: Tables) -> DataFrame:
    return _masked_out(vec.mask_bernoulli(_doubles(t), "vec_id", "embedding", _SLOTS, 0.3, 13))


@query(
    "mask_overlap",
    f"""WITH {_BERNOULLI}, n AS (SELECT count(*) AS n FROM embeddings)
SELECT s.slot::BIGINT AS slot, round(count(ch.vec_id) * 100.0 / any_value(n.n), 6) AS percent, count(ch.vec_id) > 0 AS in_union,
       count(ch.vec_id) = any_value(n.n) AS in_intersection
FROM unnest(range(0, {len(_SLOTS)})) AS s(slot) CROSS JOIN n LEFT JOIN ch USING (slot) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    masked = vec.mask_bernoulli(_doubles(t), "vec_id", "embedding", _SLOTS, 0.3, 13)
    overlap = vec.mask_overlap(masked, "masked", len(_SLOTS))
    return overlap.select(big("slot").alias("slot"), rnd("percent").alias("percent"), "in_union", "in_intersection")


def split_vectors(t: Tables) -> DataFrame:
    split = F.when(F.col("vec_id") % 10 < 7, "train").when(F.col("vec_id") % 10 < 9, "dev").otherwise("test")
    zero = F.array_repeat(F.lit(0.0).cast("float"), 64)
    return t.embeddings.select(
        "vec_id", split.alias("split"), F.when(F.col("label") == 0, zero).otherwise(F.col("embedding")).alias("embedding")
    )


_NONZERO = "SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label <> 0"


@query("reduce_vectors_svd", "SELECT vec_id, 16::BIGINT AS entries, label = 0 AS is_zero, true AS no_longer, true AS ordered FROM embeddings")
def _(t: Tables) -> DataFrame:
    """What holds for any components: entries, zeros stay zero, no vector grows, energy falls from component to component."""
    table = split_vectors(t)
    reduced, _ = vec.reduce_vectors(table, "embedding", "split", 16, "svd")
    both = reduced.join(table.select("vec_id", F.col("embedding").alias("whole")), "vec_id")
    energy = reduced.where("split = 'train'").select(F.posexplode("embedding")).groupBy("pos").agg(F.sum(F.col("col").cast("double") ** 2).alias("e"))
    falls = energy.agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("s")).select(
        F.forall(F.sequence(F.lit(2), F.size("s")), lambda k: F.element_at("s", k)["e"] <= F.element_at("s", k - 1)["e"] * (1 + 1e-6)).alias("ordered")
    )
    return both.join(F.broadcast(falls), F.lit(True)).select(
        "vec_id", big(F.size("embedding")).alias("entries"), F.forall("embedding", lambda x: x == 0).alias("is_zero"),
        (vec.l2_norm("embedding") <= vec.l2_norm("whole") * (1 + 1e-6)).alias("no_longer"), "ordered",
    )


@query(
    "reduce_vectors_pca",
    f"""WITH e AS ({_NONZERO}), m AS (SELECT i, avg(x) FILTER (vec_id % 10 < 7) AS mean FROM e GROUP BY 1),
n AS (SELECT vec_id, round(sqrt(sum((x - mean) ** 2)), 3) AS norm FROM e JOIN m USING (i) GROUP BY 1)
SELECT vec_id, coalesce(norm, 0) AS norm FROM embeddings LEFT JOIN n USING (vec_id)""",
)
def _(t: Tables) -> DataFrame:
    """With all components a projection keeps the length of the centred vector."""
    reduced, _ = vec.reduce_vectors(split_vectors(t), "embedding", "split", 64, "pca")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return reduced.select("vec_id", rnd(length, 3).alias("norm"))


@query("explained_variance", "SELECT * FROM (VALUES ('pca', 1.0::DOUBLE, true), ('svd', 0.0::DOUBLE, true)) v(vector, whole, in_bounds)")
def _(t: Tables) -> DataFrame:
    """All components of one method, some of the other."""
    stats = [vec.reduce_vectors(split_vectors(t), "embedding", "split", k, m)[1].withColumn("vector", F.lit(m)) for m, k in (("svd", 16), ("pca", 64))]
    share = F.col("variance")
    return vec.explained_variance(*stats).select("vector", F.floor(share + 1e-9).cast("double").alias("whole"), share.between(0, 1 + 1e-9).alias("in_bounds"))


@query(
    "reduce_table",
    f"""WITH e AS ({_NONZERO}), d AS (SELECT vec_id, 'embedding' AS part, i, x FROM e UNION ALL SELECT vec_id, 'half', i, x FROM e WHERE i <= 32),
m AS (SELECT part, i, avg(x) FILTER (vec_id % 10 < 7) AS mean FROM d GROUP BY ALL),
n AS (SELECT part, vec_id, round(sqrt(sum((x - mean) ** 2)), 3) AS norm FROM d JOIN m USING (part, i) GROUP BY ALL)
SELECT vec_id, coalesce(max(norm) FILTER (part = 'embedding'), 0) AS embedding, coalesce(max(norm) FILTER (part = 'half'), 0) AS half
FROM embeddings LEFT JOIN n USING (vec_id) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    """Two vector columns in one pass; with all components each projection keeps the length of the centred vector."""
    table = split_vectors(t).withColumn("half", F.slice("embedding", 1, 32))
    reduced, _ = vec.reduce_table(table, ["embedding", "half"], "split", 64, "pca")
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return reduced.select("vec_id", *(rnd(length(c), 3).alias(c) for c in ("embedding", "half")))
