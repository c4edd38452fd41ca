"""Clashing names, hot items, texts with a million matches, chains of candidates, and rules against plain Python."""

from __future__ import annotations

import collections
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortry.llm import common, components, decontaminate, langid, line_quality, minhash, packing, pii, queries, secrets, urls, warc
from tests.llm.test_operators import base_pii, base_secrets, brute_components, docs_of, measures

#: Names that operators use for columns of their own.
HELPERS = (
    "id doc docs item items h s at slots run place places words n nth total sig fp band bands pivot tree main part lo hi __host __md5 __text __row __key __maybe lines "
    "removed_words n_words n_repeat_words block listed key fit rule verdict w0 w7 grp piece bundle shard slot tokens size kept label least component node masked found blob __gone __leaked"
).split()


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in HELPERS})


# names


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    docs = clashing(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("a.b", F.lit(1)).withColumn("with `tick`", F.lit(2))
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, docs, sf_dir), stage(spark, plain, sf_dir)
        assert got.columns == docs.columns
        rows = {r["doc_id"]: r for r in got.collect()}
        assert {i: r["text"] for i, r in rows.items()} == {r["doc_id"]: r["text"] for r in want.collect()}
        assert all(r[c] == f"own {c}" for r in rows.values() for c in HELPERS)


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def test_urls_on_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, "no scheme", "x"), (None, "http://a.net/x", ""), (4, "HTTP://A.net/x?", "y"), (4, "HTTP://A.net/x?", "y"), (5, "http://a.net/" + "x" * 100_000, "z"), (6, "http://b.net/de/1", "z")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    listed = pages.where("page_id = 4 or page_id is null")
    got = sorted(((r.page_id, r.host, r.verdict) for r in urls.judge_urls(pages, listed).collect()), key=str)
    want = [(1, "", "allow"), (2, "", "allow"), (3, "", "allow"), (None, "a.net", "block"), (4, "a.net", "block"), (4, "a.net", "block"), (5, "a.net", "allow"), (6, "b.net", "allow")]
    assert got == sorted(want, key=str)
    keyed = pages.withColumn("canon", urls.canonical(F.col("url")))
    out = urls.listed_rows(keyed, "canon", keyed.where("page_id = 6"), "canon")
    assert out.columns == [*keyed.columns, "listed"] and [r[0] for r in out.collect() if r[-1]] == [6]
    assert urls.judge_urls(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, listed.limit(0)).collect()} == {"allow"}


# quality


def brute_quality(rows):
    """Kept and cleaned texts by plain counting."""
    texts = collections.defaultdict(set)
    for _, host, text in rows:
        texts[host or ""].add(text or "")
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip().lower()
    frequent = {}
    for host, own in texts.items():
        held, size = collections.Counter(), collections.defaultdict(int)
        for t in own:
            mine = {norm(x) for x in t.split("\n") if norm(x)}
            held.update(mine)
            for x in mine:
                size[x] = len(x.split(" "))
        frequent[host] = {x for x, n in held.items() if n >= 10 and (size[x] >= 5 or n >= 0.005 * len(own))}
    out = {}
    for i, host, text in rows:
        t = text or ""
        gone = [x for x in t.split("\n") if norm(x) in frequent[host or ""]]
        n_words, _, _, _, repeated = measures(t)
        removed = sum(len(x.split()) for x in gone)
        kept = not (n_words < 50 or 100 * repeated > 50 * n_words) and removed <= 0.5 * n_words
        out[i] = (removed, kept, "\n".join(x for x in t.split("\n") if norm(x) not in frequent[host or ""]) if gone else t)
    return out


def test_quality_like_plain_python(spark, duck):
    """Hosts of fewer and of more than 2,000 texts, lines that 9, 10 and 11 texts hold, depleted documents; SQL says the same."""
    rng = random.Random(12)
    body = lambda n=60: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for base, host, n in ((0, "small", 150), (10_000, "large", 2300), (20_000, None, 40)):
        lines = {k: f"line of five words {host} {k}" for k in (9, 10, 11)} | {-k: f"short {k}" for k in (9, 10, 11)} | {100 + k: body(90) for k in (9, 10, 11)}
        texts = [body() for _ in range(n)]
        for k, line in lines.items():
            for i in rng.sample(range(n), abs(k) % 100):
                texts[i] += "\n" + rng.choice([line, line.upper(), line.replace(" ", "  ")])
        rows += [(base + i, host, t) for i, t in enumerate(texts)]
    rows += [(30_000 + i, "small", rows[0][2]) for i in range(30)] + [(31_000, "small", None), (31_001, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = brute_quality(rows)
    assert any(not k and measures(t or "")[0] >= 50 for (_, k, _), (_, _, t) in zip(want.values(), rows))
    got = {r.doc_id: (r.removed_words, r.kept) for r in line_quality.line_quality(docs).collect()}
    assert got == {i: w[:2] for i, w in want.items()}
    assert {r.doc_id: r.text for r in line_quality.apply_quality(docs).collect()} == {i: t for i, (_, kept, t) in want.items() if kept}
    import duckdb

    from cohortry.llm import oracles

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    asked = con.execute(f"SELECT doc_id, removed_words, kept FROM ({oracles.oracle_sql()['op8_quality']})").fetchall()
    assert {i: (int(n), k) for i, n, k in asked} == got


# texts with very many matches


def test_a_million_secrets_in_one_text(spark):
    text = "token=abcdefgh\n" * 1_000_000
    begin = time.perf_counter()
    row = secrets.secrets(docs_of(spark, [text]), rules=secrets.BASE).select(F.size("found").alias("n"), F.element_at("found", -1).alias("last")).first()
    assert row.n == 1_000_000 and (row.last["start"], row.last["end"]) == (15 * 999_999, 15 * 999_999 + 14)
    assert time.perf_counter() - begin < 60


def test_secrets_by_runs(spark):
    made = [("token = abcdefgh1 " + "x" * (i % 7)) * i + "AKIA" + "A" * i for i in (0, 1, 2, 3, 4, 5, 9, 10, 16, 17, 100, 1001)]
    got = secrets.secrets(docs_of(spark, made), rules=secrets.BASE).withColumn("t", secrets.spans_text(F.col("found")))
    assert {r.doc_id: r.t for r in got.collect()} == {i: base_secrets(t) for i, t in enumerate(made)}


def test_a_million_addresses_in_one_text(spark):
    text = "1.2.3.4 (212) 555-0123\n" * 1_000_000
    begin = time.perf_counter()
    row = queries.pii.find_pii(docs_of(spark, [text])).first()
    assert row.n_ip == 1_000_000 and time.perf_counter() - begin < 120


# personal data


def test_candidates_avoid_base_spans():
    rng = random.Random(3)
    parts = ["1.2.3.4", "(212) 555-0123", "+1 212 555 0123", "a.b@c.org", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "x", "10[.]1[.]2[.]3", "2001:db8::8a2e:370:7334", "me [at] site [dot] org"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        base = pii.base_spans(text)
        assert base == base_pii(text)
        for _, a, b in pii.candidates(text, base):
            assert all(b <= s or e <= a for _, s, e in base)


def test_the_classifier_looks_beyond_the_votes(spark, monkeypatch):
    """Two bare numbers with the same votes: a word beside them, which no labeler knows, sets the chances of the one over those of the
    other, as it stands beside spans that the labelers are sure of."""
    rng = random.Random(4)
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    other = lambda: f"({rng.randrange(100):03}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    known = [f"hotline {number()} call phone today" for _ in range(150)] + [f"locker {other()} order serial number" for _ in range(200)]
    known += [f"hotline +1 {number()} call phone now" for _ in range(150)]
    asked = [f"hotline {number()} in total", f"locker {number()} in total"]
    votes = [pii.votes(t, *pii.candidates(t, [])[0], False) for t in asked]
    assert votes[0] == votes[1]
    model = pii.train(*pii.patterns(docs_of(spark, asked + known)))
    chance = [1 / (1 + np.exp(-model["phone"][pii.features(t, *pii.candidates(t, [])[0], votes[0])].sum())) for t in asked]
    assert chance[0] > 1.5 * chance[1]
    monkeypatch.setattr(pii, "THRESHOLD", sum(chance) / 2)
    masked = [r.text for r in pii.mask_pii(docs_of(spark, asked + known)).orderBy("doc_id").collect()][:2]
    assert masked == ["hotline <PHONE> in total", asked[1]]


def test_sample_of_the_classifier_is_bounded(spark):
    docs = docs_of(spark, [f"call +1 555 {i % 900 + 100} {i:04} now" for i in range(3000)] * 2).repartition(7)
    counted, drawn = pii.patterns(docs)
    assert sum(r[5] for r in counted) >= 6000
    per = collections.Counter(r[:5] for r in drawn)
    assert set(per) == {r[:5] for r in counted} and max(per.values()) == pii.SAMPLED
    again = pii.patterns(docs.repartition(2))
    assert again == (counted, drawn)


# decontamination


def test_hot_items_and_windows(spark):
    docs = docs_of(spark, ["the " * 50 + f"text {i}" for i in range(2000)])
    items = spark.createDataFrame([(i, "the") for i in range(200)] + [(500, "The")], "item_id long, text string")
    begin = time.perf_counter()
    found = decontaminate.contaminated(docs, items)
    assert found.count() == 2000 * 201 and time.perf_counter() - begin < 30
    assert decontaminate.decontaminate(docs, items).count() == 2000
    assert {r.n_item_words for r in found.select("n_item_words").distinct().collect()} == {1}


def test_short_items_are_reported_and_long_ones_taken_out(spark):
    docs = docs_of(spark, ["yes it is", "name the river under that long bridge " + "of stones " * 3, "nothing here"])
    items = spark.createDataFrame([(1, "Yes"), (2, "it is"), (3, "name the river under that long bridge")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.n_item_words) for r in decontaminate.contaminated(docs, items).collect()) == [(0, 1, 1), (0, 2, 2), (1, 3, 7)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == [0, 2]


def plain_windows(text, named):
    """Windows of eight words as tuples, words of digits, units and (if named) Title case replaced, with the words that were replaced."""
    words = [w for w in (re.sub(r"[!-/:-@[-`{-~]", "", x) for x in re.findall(r"[^\x20\x09-\x0D]+", text)) if w]
    units, kinds = set(decontaminate.UNITS), []
    for w in words:
        digits = sum(c.isdigit() for c in w)
        kinds.append("<number>" if digits * 2 >= len(w) else "<unit>" if w.lower() in units else "<name>" if named and len(w) > 1 and w[0].isupper() and w[1:].islower() else None)
    out = []
    for i in range(len(words) - 7):
        part, kind = [w.lower() for w in words[i : i + 8]], kinds[i : i + 8]
        if sum(k is None for k in kind) >= 3:
            out.append((i, tuple(k or w for k, w in zip(kind, part)), tuple((i + j, w) for j, (k, w) in enumerate(zip(kind, part)) if k)))
    return out


def brute_leaks(docs, items):
    """Pairs that share half of an item's windows, or consecutive ones with thirteen plain words, and fill slots consistently."""
    out = set()
    for a, item in enumerate(items):
        for named in (True, False):
            wanted = plain_windows(item, named)
            by = collections.defaultdict(list)
            for n, w in enumerate(wanted):
                by[w[1]].append((n, *w))
            plain = [None if any(i == s for w in wanted for s, _ in w[2]) else 1 for i in range(len(item.split()))]
            for d, doc in enumerate(docs):
                places = collections.defaultdict(list)
                for at, key, slots in plain_windows(doc, named):
                    for n, item_at, _, item_slots in by.get(key, ()):
                        pair = (n, item_at, tuple((s, v, w) for (s, v), (_, w) in zip(item_slots, slots)))
                        places["all"].append(pair)
                        places[at - item_at].append(pair)
                for place, held in places.items():
                    nth = sorted({h[0] for h in held})
                    share = len(nth) >= 0.5 * len(wanted)
                    runs, run = [], [nth[0]]
                    for x in nth[1:]:
                        if x != run[-1] + 1:
                            runs.append(run)
                            run = []
                        run.append(x)
                    runs.append(run)
                    span = lambda r: sum(p is not None for p in plain[wanted[r[0]][0] : wanted[r[-1]][0] + 8])
                    long = place != "all" and max(map(span, runs)) >= 13
                    filled, most = {x for h in held for x in h[2]}, collections.Counter()
                    count = collections.Counter((v, w) for _, v, w in filled)
                    total = collections.Counter(v for _, v, _ in filled)
                    for (v, _), n in count.items():
                        most[v] = max(most[v], n)
                    consistent = not filled or sum(most.values()) >= 0.8 * sum(total.values())
                    if (share or long) and consistent:
                        out.add((d, a))
    return out


def test_leaks_like_plain_python(spark):
    """Long items (windows of eight words only), copies with other values and parts, and near misses, against dictionaries of windows."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    pool = [word() for _ in range(60)]
    fill = lambda n: " ".join(rng.choice([rng.choice(pool), word()]) for _ in range(n))

    def item():
        return " ".join(rng.choice([rng.choice(pool), word(), str(rng.randrange(3)), rng.choice(["Anna", "Peter"]), "km"]) if rng.random() < 0.6 else word() for _ in range(rng.randrange(23, 60)))

    items = [item() for _ in range(25)]
    docs = []
    for x in items:
        words = x.split(" ")
        other = {v: rng.choice(["5", "77", "8"]) if v.isdigit() else rng.choice(["Maria", "Paul"]) for v in set(words) if v.isdigit() or v in ("Anna", "Peter")}
        docs.append(fill(40) + " " + " ".join(other.get(w, w) for w in words) + " " + fill(40))
        docs.append(fill(30) + " " + " ".join(str(rng.randrange(100)) if w.isdigit() else w for w in words) + " " + fill(30))
        a = rng.randrange(len(words) - 12)
        docs.append(fill(30) + " " + " ".join(words[a : a + rng.randrange(10, 26)]) + " " + fill(30))
        docs.append(" ".join(w if rng.random() < 0.9 else word() for w in words))
        docs.append(fill(80))
    made = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, docs), made).collect()}
    want = brute_leaks(docs, items)
    assert got == want and len(want) > 30


# near-duplicates


@pytest.mark.parametrize("what", ["windows", "signatures"])
def test_tasks_hold_arrays_of_a_small_piece(spark, what):
    texts = [" ".join(f"word{(i * 31 + j) % 997} Name{j % 7} {j}" for j in range(120)) for i in range(2000)]
    batch, made = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"]), []

    class Table:
        dtypes = [("id", "bigint")]
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: made.append(run)

    if what == "windows":
        decontaminate.document_windows(Table(), "id", "text", [16 * k + w for k in range(3) for w in (5, 8)], np.zeros(1 << 17, np.uint64))
    else:
        minhash.signatures(Table(), "id", "text")
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in made[0](iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == (0 if what == "windows" else len(texts))
    assert most < 64 << 20


def test_a_chain_of_candidates_makes_no_pairs_across_bands(spark, monkeypatch):
    """Texts of which only neighbours are alike: what is compared grows with the chain, not with its square."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(4000)]
    texts = [" ".join(words[10 * i : 10 * i + 100]) for i in range(300)]
    sizes = []
    monkeypatch.setattr(minhash, "in_blocks", lambda *a: sizes.append(common.in_blocks(*a).count()) or common.in_blocks(*a))
    found = minhash.near_duplicates(docs_of(spark, texts))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(list(enumerate(texts)))
    assert sizes and sizes[0] < 300


def test_near_duplicates_of_unlike_pivots(spark, monkeypatch):
    """A band's least set is linked with nothing, the others with each other: they are found in blocks."""
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 5)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(80):
        words = list(base)
        for j in rng.sample(range(120), rng.choice([0, 1, 2, 5, 6, 7])):
            words[j] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_scratch_of_finished_rounds_is_removed(spark, tmp_path, monkeypatch):
    made = iter(range(100))
    monkeypatch.setattr(common, "shared_path", lambda spark, label: f"{tmp_path}/{label}-{next(made)}")
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert components.connected_components(edges, "a", "b").select("component").distinct().count() == 1
    assert len(list(tmp_path.iterdir())) == 1 < next(made) - 1


def test_blocks_of_a_group_meet_once(spark):
    rows = spark.range(60).select("id", (F.col("id") % 2).alias("g"), (F.col("id") < 40).alias("inner"))
    met = common.in_blocks(rows, ["g"], F.col("inner"), F.lit(1 / 7), "id").collect()
    groups, pairs = collections.defaultdict(list), collections.Counter()
    for r in met:
        groups[r.g, r.lo, r.hi].append(r)
    for (_, lo, hi), held in groups.items():
        for x in held:
            for y in held:
                if x.id < y.id and (lo == hi or x.part != y.part):
                    pairs[x.id, y.id] += 1
    inner = {r.id for r in rows.collect() if r.inner}
    want = {(x, y) for x in range(60) for y in range(x + 1, 60) if (y - x) % 2 == 0 and not (x in inner and y in inner)}
    assert want <= set(pairs) and set(pairs.values()) == {1} and all((y - x) % 2 == 0 for x, y in pairs)


# language, shards, archives


def test_bundles_and_ties_of_languages(spark):
    def brute(text):
        letters = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
        out = np.zeros(langid.DIM)
        for i in range(len(letters) - 2):
            vectors = langid._letter_vectors(np.array([ord(c) for c in letters[i : i + 3]])).astype(int)
            out += np.roll(vectors[0], 2) * np.roll(vectors[1], 1) * vectors[2]
        return out

    texts = ["Hello, world! 42 worlds", "a", "été — où?", "x" * 50]
    made, has = langid.bundles([*texts, None, "12 !"])
    assert has.tolist() == [True] * 4 + [False] * 2
    assert all(np.array_equal(made[i], brute(t)) for i, t in enumerate(texts)) and not made[4:].any()
    # one language under two names: the first by name
    docs = spark.createDataFrame([(i, "hello world again", "bb" if i % 2 else "aa") for i in range(40)] + [(50, "zzz qqq", "cc")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs).where("doc_id < 40").collect()} == {"aa"}


def test_placement_of_shards(spark):
    """Largest items first, each where the dot product with what is left is highest: told again one by one."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(1, 1000, (300, 3)).astype(float)
    need, left, want = vectors / vectors.sum(axis=0) * 5, [[1.0] * 3 for _ in range(5)], {}
    weight = (8.0, 1.0, 1.0)
    for i in sorted(range(300), key=lambda i: (-max(n * w for n, w in zip(need[i], weight)), i)):
        scores = [sum(l * (n * w) for l, n, w in zip(left[s], need[i], weight)) for s in range(5)]
        best = max(range(5), key=lambda s: (scores[s], -s))
        want[i] = best
        left[best] = [l - n for l, n in zip(left[best], need[i])]
    got = packing.place(vectors, 5)
    assert np.mean([got[i] == want[i] for i in range(300)]) > 0.99
    sums = [vectors[got == s].sum(axis=0) for s in range(5)]
    assert np.ptp(sums, axis=0).max() < 0.1 * np.mean(sums)


def test_many_shards_take_levels(spark, monkeypatch):
    """Sets of shards first, then each set: sizes stay near, groups together, and every shard is used."""
    monkeypatch.setattr(packing, "FAN", 3)
    rng = random.Random(8)
    texts = ["word " * rng.randrange(1, 30) + str(i % 4000) for i in range(6000)]
    rows = packing.shard(docs_of(spark, [*texts, *texts[:500]]), 20).collect()
    sizes, shards, slots = collections.Counter(), collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        shards[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
    assert sorted(sizes) == list(range(20)) and max(sizes.values()) < 1.05 * min(sizes.values())
    # a few groups hold more than a 64th of these small shards
    assert sum(len(x) > 1 for x in shards.values()) < 0.01 * len(shards) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.shard for r in packing.shard(docs_of(spark, texts[:5]), 1).collect()} == {0}


def test_shards_of_odd_rows(spark, odd):
    import zlib

    got = sorted(((r.doc_id, r.size, r.text_crc32) for r in packing.shard(odd).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect()]
    assert got == sorted(want, key=str)


def test_archives_of_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").collect() == []


def test_zipped_archives_in_ranges(spark, tmp_path):
    """One member for each record, under a name that Spark's readers would inflate; all records have ids."""
    rng = random.Random(2)
    rows = [(i if i % 5 else None, f"http://h/{i}", "".join(rng.choice("abc é") for _ in range(rng.randrange(4000)))) for i in range(300)]
    raw = b"".join(warc.member(warc.record(i, u, h.encode(), warc.digest(h.encode()), None)) for i, u, h in rows)
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "x.warc.gz").write_bytes(raw)
    (folder / "y.warc.gz").write_bytes(b"")
    warc.write_warc(spark.createDataFrame(rows[:20], "page_id long, url string, html string"), f"file://{tmp_path}/a/plain")
    for split in (3000, 100_000, 1 << 30):
        got = warc.read_warc(spark, f"file://{folder}", split).collect()
        want = sorted([(i, u, h.encode()) for i, u, h in [*rows, *rows[:20]]], key=str)
        assert sorted(((r.page_id, r.target, bytes(r.payload)) for r in got), key=str) == want
    assert all(b"WARC-Record-ID: <urn:" in warc.record(i, u, b"", "x", None) for i, u, _ in rows)


@pytest.mark.parametrize("step", [1, 2, 5, 1000])
def test_ranges_own_what_begins_in_them(step):
    rng = random.Random(1)
    raw = b"".join(rng.choice([warc.MAGIC, b"\x1f", b"\x8b", b"\x08", b"a", warc.MAGIC * 2]) for _ in range(120))
    whole = raw.split(warc.MAGIC)[1:]
    for cut in (1, 3, 7, 50, 10_000):
        found = [p for b in range(0, len(raw), cut) for p in warc.range_pieces(lambda at, n: raw[at : at + n], b, b + cut, step)]
        assert found == whole
