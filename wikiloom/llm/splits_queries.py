"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikiloom.durable import durable
from wikiloom.llm import splits as S
from wikiloom.session import table


def _spanned(spark, sf_dir):
    rows = table(spark, sf_dir, "passages").select(F.col("pid").alias("id"), F.when(F.col("wid") >= 0, F.struct("wiki", "wid")).alias("page"))
    named = table(spark, sf_dir, "triples").select(F.col("pid").alias("id"), F.col("qid_pos").alias("thing"))
    return S.spanned(rows, named)


def _groups(spark, sf_dir):
    return _spanned(spark, sf_dir)[0]


def p3_forest(spark, sf_dir):
    """u, v, round of the spanning forest: the edges that tie the passages of every group together."""
    return _spanned(spark, sf_dir)[1]


def p3_found(spark, sf_dir):
    splits = table(spark, sf_dir, "passages").select(F.col("pid").alias("id"), "split")
    return S.broken(durable(_groups(spark, sf_dir)), splits).select(F.col("id").alias("pid"), F.col("group").alias("group_pid"))


def _dealt(spark, sf_dir):
    groups = durable(_groups(spark, sf_dir))
    dealt = S.deal(groups)
    passages = groups.join(dealt, "group").select(F.lit("passages").alias("tab"), "id", "group", "split")
    t = table(spark, sf_dir, "triples")
    asked = t.select(F.inline(F.expr("array(named_struct('qid', qid_pos, 'pid', pid), named_struct('qid', qid_neg, 'pid', pid))"))).where("qid >= 0").distinct()
    of = asked.join(groups, F.expr("pid = id")).groupBy("qid").agg(F.min("group").alias("group"))
    queries = of.join(dealt, "group").select(F.lit("queries").alias("tab"), F.col("qid").alias("id"), "group", "split")
    return passages.unionByName(queries)


def p3_splits(spark, sf_dir):
    """tab, id, group_pid, split of every passage, and of every question that triples names with one."""
    return _dealt(spark, sf_dir).withColumnRenamed("group", "group_pid")


def p3_shares(spark, sf_dir):
    """The shares reached, by table and split."""
    rows = _dealt(spark, sf_dir).groupBy("tab", "split").agg(F.count("*").alias("n"))
    total = rows.groupBy("tab").agg(F.sum("n").alias("total"))
    return rows.join(total, "tab").select("tab", "split", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


QUERIES = {f.__name__: f for f in (p3_found, p3_splits, p3_shares, p3_forest)}

ORACLE = {
    "p3_found": """
WITH RECURSIVE p AS (SELECT DISTINCT pid, wiki, wid FROM passages WHERE pid IS NOT NULL),
e AS (SELECT a.pid AS x, b.pid AS y FROM p a JOIN (SELECT wiki, wid, min(pid) AS pid FROM p WHERE wid >= 0 GROUP BY ALL) b ON a.wiki = b.wiki AND a.wid = b.wid
      UNION SELECT t.pid, m.pid FROM triples t JOIN p ON p.pid = t.pid
      JOIN (SELECT qid_pos, min(t.pid) AS pid FROM triples t JOIN p USING (pid) GROUP BY ALL) m ON t.qid_pos = m.qid_pos),
b AS (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
r AS (SELECT DISTINCT pid AS id, pid AS r FROM p UNION SELECT b.y, r.r FROM r JOIN b ON b.x = r.id),
g AS (SELECT id, min(r) AS g FROM r GROUP BY id),
bad AS (SELECT g FROM g JOIN passages ON pid = id GROUP BY g HAVING count(DISTINCT split) > 1)
SELECT id AS pid, g AS group_pid FROM g WHERE g IN (SELECT g FROM bad)"""
}
