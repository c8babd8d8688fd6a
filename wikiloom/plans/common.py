"""Relations of the data folder in the form the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wikiloom.durable import durable
from wikiloom.operators import pruned
from wikiloom.session import table


def corpus(spark, sf_dir) -> DataFrame:
    """scope (wiki), pid, text of the passages that have text; repeated rows once."""
    rows = table(spark, sf_dir, "passages").where("passage is not null and passage rlike '\\\\S'")
    # Grouped by (scope, pid), so that term counts of a passage need no further shuffle.
    return rows.groupBy(F.col("wiki").alias("scope"), "pid").agg(F.min("passage").alias("text"))


def stored(spark, sf_dir) -> DataFrame:
    """corpus(), written once in the order of scope and pid: grouped by range, so that no search shuffles the texts again."""
    rows = table(spark, sf_dir, "passages")
    n = pruned.parts(rows.count())
    rows = rows.where("passage is not null and passage rlike '\\\\S'").select(F.col("wiki").alias("scope"), "pid", "passage")
    return durable(rows.repartitionByRange(n, "scope", "pid").groupBy("scope", "pid").agg(F.min("passage").alias("text")))


def asked(spark, sf_dir, split: str = "test") -> DataFrame:
    """scope, qid, text of a split's questions: the evaluation asks the test questions of a wiki of the whole wiki."""
    return table(spark, sf_dir, "queries").where((F.col("split") == split) & F.col("query").isNotNull()).groupBy(F.col("wiki").alias("scope"), "qid").agg(F.min("query").alias("text"))


def relevant(spark, sf_dir, split: str = "test") -> DataFrame:
    """scope, qid, pid of a split's positives."""
    return table(spark, sf_dir, "triples").where(F.col("split") == split).select(F.col("wiki").alias("scope"), F.col("qid_pos").alias("qid"), "pid").distinct()


#: The same relations for the SQL side.
SQL = """
corpus AS (SELECT wiki AS scope, pid, min(passage) AS text FROM passages WHERE passage IS NOT NULL AND regexp_matches(passage, '\\S') GROUP BY ALL),
asked AS (SELECT wiki AS scope, qid, min(query) AS text FROM queries WHERE split = 'test' AND query IS NOT NULL GROUP BY ALL),
rel AS (SELECT DISTINCT wiki AS scope, qid_pos AS qid, pid FROM triples WHERE split = 'test')"""
