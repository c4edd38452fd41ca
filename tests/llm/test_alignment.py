"""Token alignment against both tokenizers on whole texts."""

from __future__ import annotations

import collections
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from cohortry.llm import alignment, queries
from tests.llm.conftest import LONG

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def pair():
    return alignment.load_pair(queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def brute():
    """The rows that the contract asks for, from whole texts and plain dictionaries."""
    a = tokenizers.Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def spelt_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def run(rows):
        out, totals = {}, collections.Counter()
        for key, text in rows:
            out[key] = (0, 0, 0, [], "")
            if not text:
                continue
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            xa, xb = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia], [spelt_b(i) for i in ib]
            if b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
                continue
            ends_a, ends_b, at = [], [], 0
            for x in xa:
                ends_a.append(at := at + len(x))
            at = 0
            for x in xb:
                ends_b.append(at := at + len(x))
            both = set(ends_a) & set(ends_b)
            groups, links, p, q = [], [], 0, 0
            for i, end in enumerate(ends_a):
                if end in both:
                    j = ends_b.index(end, q)
                    groups.append(",".join(map(str, ia[p : i + 1])) + "|" + ",".join(map(str, ib[q : j + 1])))
                    links.append((ia[i], ib[j]))
                    p, q = i + 1, j + 1
            totals.update(links)
            out[key] = (len(ia), len(ib), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
        best = collections.defaultdict(int)
        for (_, y), n in totals.items():
            best[y] = max(best[y], n)
        return {k: (n, m, g, len(l), sum(totals[x] == best[x[1]] for x in l), sum(totals[x] for x in l), d) for k, (n, m, g, l, d) in out.items()}

    return run


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.select("doc_id", *COLUMNS).collect()}


def test_query(spark, sf_dir, brute):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.op11_alignment(spark, sf_dir)) == brute(docs)


def test_odd_texts(spark, pair, brute):
    rng = random.Random(5)
    parts = ["a", " b", "  ", "\n", "\t", " \n x", "é", "😀", "▁", "<|endoftext|>", "<0x41>", "<s>", " don't", "'s", "12 345", " ", "　", " y", "\x00", "\x85 z", "한국", " ", "ﬁ", "é", "\x1c q", "᠎ r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(800)] + [None, "", " ", "  ", "word " * 3, LONG, "x" * 30000, "x y" * 9000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("links", F.lit("y"))
    got = rows_of(alignment.align_digests(df, pair))
    want = brute(rows)
    assert {k: (got[k], texts[k]) for k in want if got[k] != want[k]} == {}


def test_cuts_within_long_texts(spark, pair, monkeypatch):
    """Steps and a store of words that is too small don't change a result."""
    texts = ["one two  three four\nfive six " * 40, "seven eight"]
    aligner = alignment.Aligner(pair)
    want = aligner.texts(texts)
    monkeypatch.setattr(alignment, "STEP", 7)
    monkeypatch.setattr(alignment, "KEPT", 3)
    monkeypatch.setattr(alignment, "KEPT_CHARS", 4)
    aligner = alignment.Aligner(pair)
    assert aligner.texts(texts) == want


def test_codes_hold_every_link(pair):
    """No more pairs than suffixes, and both spellings of a byte."""
    assert len(pair.codes) < 2 * sum(len(x) for x in [*pair.a_bytes, *pair.b_bytes] if x)
    a, b = pair.a_bytes.index(b" the"), pair.b_bytes.index(b" the")
    assert a * len(pair.b_bytes) + b in set(pair.codes.tolist())


def test_odd(odd, nothing, pair):
    got = alignment.align_digests(odd, pair)
    assert sorted((r.doc_id or 0, r.n_a > 0) for r in got.collect()) == [(0, True), (1, False), (2, False), (3, True), (4, True), (4, True), (5, True), (6, True)]
    assert alignment.align_digests(nothing, pair).count() == 0
    groups = {r.doc_id: r.groups for r in alignment.align(odd, pair).where("doc_id is null").collect()}
    assert groups[None].count("|") == 7


def test_pieces_are_those_of_the_expression():
    rng = random.Random(9)
    parts = ["a", " b", "  ", "\n", " \n", "é", " é", " 😀", "▁", " ▁x", " x▁ y", " ", "　", " 　z", "\x00", "\x85 z", " 한", " ́", " ²", " …", " \x7f", " ~", "\x81 q", " Ж"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(5000)]
    pieces, bounds = alignment._pieces(texts)
    assert [pieces[i:j].to_pylist() for i, j in zip(bounds, bounds[1:])] == [alignment.CUT.split(t) for t in texts]


def test_a_text_that_is_not_spelt_leaves_its_neighbours(pair):
    """Pieces that are encoded together with one that the tokens don't spell."""
    texts = ["one two", "three fo▁ur five", None, "five one", ""]
    together = alignment.Aligner(pair).texts(texts).to_pylist()
    assert together == [alignment.Aligner(pair).texts([t]).to_pylist()[0] for t in texts]
    assert [r["n_a"] > 0 for r in together] == [True, False, False, True, False]


def test_time_beside_the_tokenizers(pair):
    """Cutting, counting and writing groups takes less than two times more than the tokenizers take on the same words."""
    rng, ratios = random.Random(3), []
    for _ in range(3):
        words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(4, 14))) for _ in range(60_000)]
        texts = [" ".join(rng.choices(words, k=300)) for _ in range(1000)]
        aligner = alignment.Aligner(pair)
        begin = time.process_time()
        aligner.texts(texts)
        mid = time.process_time()
        held = list(dict.fromkeys(w for t in texts for w in t.split(" ")))
        chunks = [" ".join(held[i : i + alignment.CHUNK]) for i in range(0, len(held), alignment.CHUNK)]
        since = time.process_time()
        aligner.a.encode_batch_fast(chunks, add_special_tokens=False)
        aligner.b.encode(chunks, num_threads=1)
        ratios.append((mid - begin) / (time.process_time() - since))
    assert min(ratios) < 3
