"""Bands enough for the threshold that is asked for."""

import pytest

import corpus_pipeline
from factwright.llm import minhash


@pytest.mark.parametrize("percent,bands", [(85, 28), (80, 34), (70, 81), (100, 28)])
def test_pair_at_the_threshold_shares_a_band(percent, bands):
    assert minhash.band_count(percent) == bands
    assert (1 - (percent / 100) ** minhash.ROWS) ** bands <= 4e-5


def test_pipeline_stage_uses_bands_for_its_threshold(spark, monkeypatch):
    asked, signatures = [], minhash.signatures
    monkeypatch.setattr(minhash, "signatures", lambda *a: asked.append(signatures(*a)) or asked[-1])
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]
    bands = [c for c in asked[0].columns if c[0] == "b"]
    miss = (1 - 0.8**minhash.ROWS) ** len(bands)
    assert miss < 4e-5
