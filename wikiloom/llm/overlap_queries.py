"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikiloom.durable import durable
from wikiloom.llm import overlap as O
from wikiloom.llm.setjoin_queries import pairs_sql, shingle_sql
from wikiloom.session import table


def p2_overlaps(spark, sf_dir):
    """tab, id_a, id_b of every overlap, with the share of either record that stands in chunks of the other."""
    passages = O.found(table(spark, sf_dir, "passages"), "pid", "passage", "split", k=3, threshold=0.6, least=12)
    queries = O.found(table(spark, sf_dir, "queries"), "qid", "query", "split", threshold=0.8, least=5, tokens=True)
    rows = [x.select(F.lit(tab).alias("tab"), F.col("a").alias("id_a"), F.col("b").alias("id_b"), *(F.round(c, 6).alias(c) for c in ("fraction_a", "fraction_b"))) for tab, x in (("passages", passages), ("queries", queries))]
    return rows[0].unionByName(rows[1])


def p2_found(spark, sf_dir):
    return p2_overlaps(spark, sf_dir).select("tab", "id_a", "id_b")


def p2_report(spark, sf_dir):
    """By table, split and wiki: records, and how many of them have an overlap."""
    pairs = durable(p2_found(spark, sf_dir))
    ends = pairs.select("tab", F.explode(F.array("id_a", "id_b")).alias("id")).distinct().withColumn("hit", F.lit(1))
    rows = [table(spark, sf_dir, tab).select(F.lit(tab).alias("tab"), F.col(key).alias("id"), "split", "wiki").distinct() for tab, key in (("passages", "pid"), ("queries", "qid"))]
    return rows[0].unionByName(rows[1]).join(ends, ["tab", "id"], "left").groupBy("tab", "split", "wiki").agg(F.count("*").alias("n"), F.count("hit").alias("n_overlapping"))


def p2_fractions(spark, sf_dir):
    """pid, side, n_tokens, shared: the fraction of each passage in chunks that the other side has."""
    return O.fractions(table(spark, sf_dir, "passages"), "pid", "passage", "split").withColumnRenamed("id", "pid")


QUERIES = {f.__name__: f for f in (p2_found, p2_overlaps, p2_report, p2_fractions)}
_SIDE = "CASE WHEN split = 'train' THEN 't' WHEN split IN ('val', 'test') THEN 'e' END AS side"
_PASSAGES = shingle_sql(3, 12, f"SELECT DISTINCT pid AS id, {_SIDE}, passage AS text FROM passages WHERE split IN ('train', 'val', 'test')")
_QUERIES = f"""
sh AS (SELECT DISTINCT id, side, unnest(w) AS g FROM (SELECT DISTINCT qid AS id, {_SIDE}, list_distinct(regexp_extract_all(lower(query), '[\\pL\\pN]+')) AS w FROM queries WHERE split IN ('train', 'val', 'test') AND query IS NOT NULL) WHERE len(w) >= 5),
sz AS (SELECT id, side, count(*) AS n FROM sh GROUP BY ALL)"""

_FOUND = f"""SELECT 'passages' AS tab, a AS id_a, b AS id_b FROM (WITH {_PASSAGES}, {pairs_sql(0.6, "a.side <> b.side")} SELECT a, b FROM ok)
UNION ALL SELECT 'queries', a, b FROM (WITH {_QUERIES}, {pairs_sql(0.8, "a.side <> b.side")} SELECT a, b FROM ok)"""

ORACLE = {
    "p2_found": _FOUND,
    "p2_report": f"""WITH found AS ({_FOUND}), ends AS (SELECT tab, id_a AS id FROM found UNION SELECT tab, id_b FROM found),
recs AS (SELECT DISTINCT 'passages' AS tab, pid AS id, split, wiki FROM passages UNION ALL SELECT DISTINCT 'queries', qid, split, wiki FROM queries)
SELECT tab, split, wiki, count(*) AS n, count(ends.id) AS n_overlapping FROM recs LEFT JOIN ends USING (tab, id) GROUP BY tab, split, wiki""",
}
