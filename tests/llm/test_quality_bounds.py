"""With enough labels the quality bounds are tight: little junk passes and the good stays."""

from __future__ import annotations

import os

import pytest

from candela.llm import ngram_quality

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_little_junk_passes(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = ngram_quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels).join(labels, "doc_id").collect()
    rate = lambda some: sum(r.kept for r in some) / len(some)
    good, junk = [r for r in rows if r.quality == 1 and r.toxic == 0], [r for r in rows if r.quality == 0]
    assert rate(good) > 0.98 and rate(junk) < 0.12
