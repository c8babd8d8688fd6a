"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikiloom.llm import defects as D
from wikiloom.session import table

#: Fixed values (TESTDATA.md): the languages of the wikis that are not English.
LANGUAGES = {"eisenwald": "de", "brumeval": "fr", "sombraluz": "es"}


def _cells(spark, sf_dir):
    g = table(spark, sf_dir, "generated_questions")
    rows = F.inline(F.expr("array(named_struct('side', 'positive', 'cell', positive), named_struct('side', 'negative', 'cell', negative))"))
    return g.select("gen_id", "wiki", "passage", rows).select(F.lit("generated_questions").alias("tab"), F.col("gen_id").alias("id"), "side", "wiki", "passage", "cell")


def p5_found(spark, sf_dir):
    queries = table(spark, sf_dir, "queries").select(F.lit("queries").alias("tab"), F.col("qid").alias("id"), F.lit("query").alias("side"), "wiki", F.col("query").alias("q"))
    t = table(spark, sf_dir, "triples")
    asked = t.select(F.explode(F.array("qid_pos", "qid_neg")).alias("id"), "pid").where("id >= 0")
    passages = table(spark, sf_dir, "passages").select("pid", "wiki", "passage")
    return D.defects(_cells(spark, sf_dir), queries, asked, passages, LANGUAGES)


def p5_rates(spark, sf_dir):
    """Defects by table and kind."""
    return p5_found(spark, sf_dir).groupBy("tab", "defect").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p5_found, p5_rates)}
ORACLE: dict[str, str] = {}
