"""The registered queries against their SQL twins, and the pipeline."""

from __future__ import annotations

import os

import pytest

from cladeloom.llm import registry
from compare import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    assert compare(spark, SF, name).startswith("equal")


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert registry.QUERIES[name](spark, SF).count() >= docs


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs.write.mode("overwrite").parquet(path := f"/tmp/cladeloom-test-{os.getpid()}-{name}")
        docs = spark.read.parquet(path)
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"} and 0 < docs.count() <= seen
        seen = docs.count()
    assert p.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == seen


def test_pipeline_on_nothing(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0
