"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikiloom.durable import durable
from wikiloom.llm import setjoin as S
from wikiloom.llm.forest import groups
from wikiloom.session import table

#: TESTDATA.md: runs of three tokens, at least 12 tokens, similarity 0.6.
RULE = {"k": 3, "threshold": 0.6, "min_tokens": 12}


def _linked(spark, sf_dir):
    return S.similar(table(spark, sf_dir, "passages"), "pid", "passage", **RULE)


def p1_found(spark, sf_dir):
    return S.expanded(_linked(spark, sf_dir)).select(F.col("a").alias("pid_a"), F.col("b").alias("pid_b"))


def p1_classes(spark, sf_dir):
    return S.classes(table(spark, sf_dir, "passages"), "pid", _linked(spark, sf_dir)).withColumnRenamed("id", "pid")


def p1_groups(spark, sf_dir):
    """pid, group_pid of every passage that is near another one; copies join their class, classes the connected group."""
    linked = _linked(spark, sf_dir)
    same = linked.copies.where("id != rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    edges = linked.pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same)
    return groups(edges).select(F.col("node").alias("pid"), F.col("group").alias("group_pid"))


def p1_five_words(spark, sf_dir):
    """The default rule: runs of five tokens, similarity 0.8; pairs of class representatives."""
    linked = S.similar(table(spark, sf_dir, "passages"), "pid", "passage")
    return durable(linked.pairs).select(F.col("a").alias("pid_a"), F.col("b").alias("pid_b"), F.round("similarity", 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_groups, p1_five_words)}
def shingle_sql(k: int, least: int, source: str = "SELECT DISTINCT pid AS id, '' AS side, passage AS text FROM passages") -> str:
    """SQL common tables: tok (id, side, w), sh (id, side, g: distinct runs of k tokens), sz (id, side, n)."""
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
tok AS (SELECT DISTINCT id, side, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM ({source}) WHERE text IS NOT NULL AND id IS NOT NULL),
sh AS (SELECT DISTINCT id, side, {run} AS g FROM tok, UNNEST(range(1, CAST(len(w) - {k - 2} AS BIGINT))) AS r(i) WHERE len(w) >= {least}),
sz AS (SELECT id, side, count(*) AS n FROM sh GROUP BY ALL)"""


def pairs_sql(threshold: float, sides: str = "TRUE") -> str:
    return f"""
pr AS (SELECT a.id AS a, b.id AS b, a.side AS sa, b.side AS sb, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.id < b.id AND {sides} GROUP BY ALL),
ok AS (SELECT DISTINCT a, b, c / (x.n + y.n - c)::DOUBLE AS similarity FROM pr JOIN sz x ON x.id = a AND x.side = sa JOIN sz y ON y.id = b AND y.side = sb WHERE c >= {threshold} * (x.n + y.n - c) - 1e-9)"""


_CLASS = "cl AS (SELECT id, min(id) OVER (PARTITION BY w) AS class_id, w FROM tok WHERE len(w) >= {0})"

ORACLE = {
    "p1_found": f"WITH {shingle_sql(3, 12)}, {pairs_sql(0.6)} SELECT a AS pid_a, b AS pid_b FROM ok",
    "p1_classes": f"""WITH {shingle_sql(3, 12)}, {_CLASS.format(12)}, {pairs_sql(0.6)},
l AS (SELECT class_id, count(DISTINCT other) AS n FROM (SELECT x.class_id, y.class_id AS other FROM ok JOIN cl x ON x.id = a JOIN cl y ON y.id = b UNION ALL SELECT y.class_id, x.class_id FROM ok JOIN cl x ON x.id = a JOIN cl y ON y.id = b) WHERE class_id <> other GROUP BY ALL)
SELECT p.pid, coalesce(cl.class_id, p.pid) AS class_id, coalesce(l.n, 0) AS n_links FROM (SELECT DISTINCT pid FROM passages) p LEFT JOIN cl ON cl.id = p.pid LEFT JOIN l ON l.class_id = coalesce(cl.class_id, p.pid)""",
    "p1_groups": f"""WITH RECURSIVE {shingle_sql(3, 12)}, {pairs_sql(0.6)},
b AS (SELECT DISTINCT a AS x, b AS y FROM ok UNION SELECT b, a FROM ok),
r AS (SELECT DISTINCT x AS id, x AS root FROM b UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.id)
SELECT id AS pid, min(root) AS group_pid FROM r GROUP BY id""",
    "p1_five_words": f"""WITH {shingle_sql(5, 5)}, {_CLASS.format(5)}, {pairs_sql(0.8)}
SELECT a AS pid_a, b AS pid_b, round(similarity, 6) AS similarity FROM ok WHERE a IN (SELECT class_id FROM cl) AND b IN (SELECT class_id FROM cl)""",
}
