"""Every query of the subpackage over empty tables, and over tables whose every row is null but for its keys."""

import os

import pytest

from wikiloom.llm import registry

QUERIES = {k: f for m in registry.query_modules() for k, f in m.QUERIES.items()}
TABLES = ("passages", "queries", "triples", "wiki_meta", "qa_pages", "generated_questions", "raw_records", "documents", "review_labels", "mix_targets")
KEYS = {"pid", "qid", "qid_pos", "qid_neg", "doc_id", "gen_id", "qa_id", "rec_id"}


@pytest.fixture(scope="module")
def folders(spark, small, tmp_path_factory):
    from pyspark.sql import functions as F

    empty, null = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("null")
    for t in TABLES:
        df = spark.read.parquet(os.path.join(small, f"{t}.parquet"))
        df.limit(0).write.parquet(str(empty / f"{t}.parquet"))
        df.limit(20).select(*(F.col(c) if c in KEYS else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns)).write.parquet(str(null / f"{t}.parquet"))
    return str(empty), str(null)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, folders, name):
    assert QUERIES[name](spark, folders[0]).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls(spark, folders, name):
    QUERIES[name](spark, folders[1]).collect()
