"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikiloom.llm import pieces as P
from wikiloom.session import table


def _items(spark, sf_dir):
    passages = table(spark, sf_dir, "passages").select(F.lit("passages").alias("tab"), F.col("pid").alias("id"), F.lit(0).cast("bigint").alias("para"), F.col("passage").alias("item"))
    pages = table(spark, sf_dir, "qa_pages").select(F.lit("qa_pages").alias("tab"), F.col("qa_id").alias("id"), F.posexplode("text").alias("para", "item"))
    return passages.unionByName(pages.withColumn("para", F.col("para").cast("bigint")))


def p4_found(spark, sf_dir):
    """The items that were cut: each has a piece 0."""
    return P.split(_items(spark, sf_dir), ["tab", "id", "para"], "item").where("piece = 0").select("tab", "id", "para").distinct()


def p4_pieces(spark, sf_dir):
    return P.split(_items(spark, sf_dir), ["tab", "id", "para"], "item").distinct()


QUERIES = {f.__name__: f for f in (p4_found, p4_pieces)}

ORACLE = {
    "p4_found": """
WITH i AS (SELECT 'passages' AS tab, pid AS id, CAST(0 AS BIGINT) AS para, passage AS item FROM passages
           UNION ALL SELECT 'qa_pages', qa_id, CAST(k - 1 AS BIGINT), text[k] FROM qa_pages, UNNEST(range(1, CAST(len(text) + 1 AS BIGINT))) AS r(k))
SELECT DISTINCT tab, id, para FROM i
WHERE length(item) > 900 OR len(regexp_extract_all(item, '[^ \\t\\r\\n]+')) > 120"""
}
