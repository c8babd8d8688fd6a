"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikiloom.llm import encode as E
from wikiloom.session import table


def p7_ids(spark, sf_dir):
    return E.encode(table(spark, sf_dir, "documents"))


def p7_sizes(spark, sf_dir):
    """Documents and tokens by source."""
    docs = table(spark, sf_dir, "documents").select("source", "text")
    return E.count_tokens(docs).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_sizes)}
ORACLE: dict[str, str] = {}
