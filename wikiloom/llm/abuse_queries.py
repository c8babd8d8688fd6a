"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikiloom.llm import abuse as A
from wikiloom.session import table


def _scored(spark, sf_dir, *columns):
    docs = table(spark, sf_dir, "documents")
    model = A.train(table(spark, sf_dir, "review_labels"), docs)
    return A.scored(docs.select("doc_id", "text", *columns), model)


def p9_found(spark, sf_dir):
    return A.kinds(_scored(spark, sf_dir)).select("doc_id", "kind").distinct()


def p9_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", *(F.round(k, 6).alias(k) for k in A.KINDS))


def p9_rates(spark, sf_dir):
    """Documents and the share of each kind, by source."""
    rows = _scored(spark, sf_dir, "source")
    rates = [F.round(F.avg((F.col(k) >= A.FOUND).cast("double")), 6).alias(f"{k}_rate") for k in A.KINDS]
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), *rates)


QUERIES = {f.__name__: f for f in (p9_found, p9_scores, p9_rates)}
ORACLE: dict[str, str] = {}
