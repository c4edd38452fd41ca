"""SQL of the queries that SQL can say, for DuckDB."""

from __future__ import annotations

from cohortry.llm import line_quality, prefix_trie, secrets, urls, vector_dedup

_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    kinds, base = [], ", ".join(_quoted(r.kind) for r in secrets.BASE)
    for rank, rule in enumerate(secrets.RULES):
        p = _quoted(rule.pattern)
        kinds.append(f"""SELECT doc_id, {rank} AS rank, {_quoted(rule.kind)} AS kind, i, string_split_regex(t, {p}) AS b,
            regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {rule.group}) AS g, {rule.least} AS least
        FROM d, unnest(range(1, len(regexp_extract_all(t, {p}, 0)) + 1)) AS x(i)""")
    total = lambda x, upto: f"coalesce(list_sum(list_transform({x}[1:{upto}], lambda s: length(s))), 0)::BIGINT"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(kinds)}),
placed AS (SELECT doc_id, rank, kind, {total('b', 'i')} + {total('m', 'i - 1')} AS s, {total('b', 'i')} + {total('m', 'i')} AS e
           FROM found WHERE length(g[i]) >= least),
joined AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind IN ({base})) AS base_spans,
           {', '.join(f"count(*) FILTER (kind = {_quoted(r.kind)}) AS n_{r.kind}" for r in secrets.BASE)} FROM placed GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}' for r in secrets.BASE)},
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (doc_id)"""


def _urls() -> str:
    fits = []
    for verdict, rule in sorted(urls.RULES, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits.append((f"(host = {_quoted(own)} OR host LIKE {_quoted('%.' + own)}) AND starts_with(path, {_quoted(slash + rest)})", rule, verdict))
    case = lambda n: "CASE " + " ".join(f"WHEN {f[0]} THEN {_quoted(f[n])}" for f in fits) + " END"
    return rf"""WITH u AS (SELECT page_id, html, coalesce(url, '') AS u FROM pages),
p AS (SELECT *, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(u, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, {_quoted(urls.TRACKING)}))) AS args,
      regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)?$', '') AS h FROM p),
k AS (SELECT *, CASE WHEN h <> '' THEN h || regexp_replace(path, '/+$', '') || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS key FROM q),
listed AS (SELECT DISTINCT key FROM k WHERE key IS NOT NULL AND len(regexp_extract_all(html, '[#*$%]{{3}}([\s<]|$)')) >= 10)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(2)}, CASE WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM k"""


def _quality() -> str:
    q = line_quality
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS x(i)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM again, unnest([i, i + 1, i + 2]) AS x(k) GROUP BY doc_id),
lines AS (SELECT doc_id, host, md5(t) AS m, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
keyed AS (SELECT doc_id, host, m, lower(trim(regexp_replace(line, '{_SPACE}', ' ', 'g'))) AS k, len(regexp_extract_all(line, '{_WORD}')) AS n FROM lines),
texts AS (SELECT host, count(DISTINCT md5(t)) AS texts FROM d GROUP BY host),
frequent AS (SELECT host, k FROM keyed JOIN texts USING (host) GROUP BY host, k, texts
             HAVING count(DISTINCT m) >= {q.MIN_TEXTS} AND (max(n) >= {q.LONG_LINE} OR count(DISTINCT m) >= texts * {q.SHARE}::DOUBLE)),
removed AS (SELECT doc_id, sum(n) AS n FROM keyed JOIN frequent USING (host, k) GROUP BY doc_id),
out AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(w.t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(w.t, '[^{q.SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS removed_words
        FROM d JOIN w USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words) AND removed_words <= {q.DEPLETED} * n_words AS kept FROM out"""


def _vectors() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {vector_dedup.COSINE}),
r AS (SELECT vec_id, vec_id AS m FROM embeddings UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


def _trie() -> str:
    """Paths are the md5 of their turns, joined: a prefix of d turns is a prefix of 32 * d digits. crc32 goes through the bits of the digits."""
    bits = "flatten(list_transform(range(1, length(conv::VARCHAR) + 1), lambda i: [ascii(substr(conv::VARCHAR, i::INTEGER, 1)), 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, e: xor(xor(c, e) >> 1, CASE WHEN xor(c, e) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""WITH t AS (SELECT conv_id AS conv, turn, coalesce(role, '') AS who, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv, list(md5(length(who) || ':' || who || ':' || said) ORDER BY turn NULLS FIRST, who, said) AS keys,
      list(length(said) ORDER BY turn NULLS FIRST, who, said) AS sizes FROM t GROUP BY conv),
h AS (SELECT *, (xor(list_reduce(list_concat([4294967295::BIGINT], list_transform({bits}, lambda x: x::BIGINT)), {step}), 4294967295::BIGINT) % {prefix_trie.HEADS})::INTEGER AS h FROM o),
p AS (SELECT h.conv, list_concat(coalesce(b.keys[1:h.h], []), h.keys[h.h + 1:]) AS keys, list_concat(coalesce(b.sizes[1:h.h], []), h.sizes[h.h + 1:]) AS sizes
      FROM h LEFT JOIN o b ON b.conv = h.conv - h.conv % 100),
m AS (SELECT conv, d, array_to_string(keys[1:d], '') AS path, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(keys) AS ends FROM p, unnest(range(0, len(keys) + 1)) AS u(d)),
n AS (SELECT path, any_value(d) AS depth, any_value(size) AS size, count(*) AS n_convs, min(conv) AS conv_id, coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (ends), '') AS members FROM m GROUP BY path),
c AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (path)),
s AS (SELECT left(path, (32 * a)::INTEGER) AS path, sum((n_convs - 1) * size) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM k, unnest(range(0, depth + 1)) AS u(a) GROUP BY 1)
SELECT k.conv_id, k.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(k.members) AS ends_sha256
FROM k JOIN s USING (path) LEFT JOIN k up ON k.depth > 0 AND up.path = left(k.path, length(k.path) - 32)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": _secrets(), "op5_urls": _urls(), "op8_quality": _quality(), "op12_vectors": _vectors(), "op13_trie": _trie()}
