"""The pipeline's stages one by one, each on what the one before kept."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from cohortry.llm.common import written
from tests.llm.test_operators import base_pii, brute_components, measures

tiktoken = pytest.importorskip("tiktoken")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, results = {r.doc_id: r for r in docs.collect()}, []
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, sf_dir), name)
        results.append({r.doc_id: r for r in now.collect()})
        assert name == "tokens" or now.columns == docs.columns
    quality, unique, clean, masked, tokens = results
    passed = {i for i, r in rows.items() if (m := measures(r.text))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    assert set(quality) == passed  # the small tables hold no boilerplate
    found = brute_components([(i, r.text) for i, r in quality.items()])
    assert set(unique) == {i for i, (_, c) in found.items() if i == c}
    assert set(clean) <= set(unique) and set(masked) == set(clean) == set(tokens)
    for i, r in masked.items():
        want, last = "", 0
        for _, a, b in sorted(base_pii(clean[i].text), key=lambda s: (s[1], -s[2])):
            want, last = want + (clean[i].text[last:a] + "<KIND>" if a >= last else ""), max(last, b)
        assert re.sub("<(EMAIL|IP|CARD|PHONE)>", "<KIND>", r.text) == want + clean[i].text[last:]
    from cohortry.llm import bpe, queries

    ranks = bpe.load_ranks(queries.vocabulary())
    import public_tokenizers

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.ids == own.encode_ordinary(masked[i].text) for i, r in tokens.items())


def test_stages_on_odd_rows(odd, spark, sf_dir):
    now = odd.drop("id", "fp")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf_dir).count() >= 0
        now = written(stage(spark, now, sf_dir), name)
    assert now.count() == 0
