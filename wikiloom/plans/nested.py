"""Queries of problem 6, nested records as flat tables."""

from __future__ import annotations

from wikiloom.operators import nested
from wikiloom.session import table


def p6_found(spark, sf_dir):
    return nested.questions(nested.normalised(table(spark, sf_dir, "raw_records"))).select("rec_id", "para", "side", "k").distinct()


def p6_pages(spark, sf_dir):
    return nested.pages(nested.normalised(table(spark, sf_dir, "raw_records")))


def p6_paragraphs(spark, sf_dir):
    return nested.paragraphs(nested.normalised(table(spark, sf_dir, "raw_records")))


def p6_qa_pages(spark, sf_dir):
    return nested.pages(nested.normalised_typed(table(spark, sf_dir, "qa_pages")), "qa_id")


def p6_qa_paragraphs(spark, sf_dir):
    return nested.paragraphs(nested.normalised_typed(table(spark, sf_dir, "qa_pages")), "qa_id")


def p6_qa_questions(spark, sf_dir):
    return nested.questions(nested.normalised_typed(table(spark, sf_dir, "qa_pages")), "qa_id")


QUERIES = {f.__name__: f for f in (p6_found, p6_pages, p6_paragraphs, p6_qa_pages, p6_qa_paragraphs, p6_qa_questions)}

_SIDE = """
  SELECT qa_id, CAST(i - 1 AS BIGINT) AS para, '{0}' AS side, CAST(k - 1 AS BIGINT) AS k, {0}[i][k] AS question
  FROM (SELECT DISTINCT qa_id, id, revid, url, title, text, positive, negative FROM qa_pages),
       UNNEST(range(1, CAST(len(text) + 1 AS BIGINT))) AS r(i), UNNEST(range(1, CAST(coalesce(len({0}[i]), 0) + 1 AS BIGINT))) AS s(k)
  WHERE regexp_matches(coalesce({0}[i][k], ''), '[^\\s\\x{{A0}}]')"""

ORACLE = {
    "p6_qa_pages": "SELECT qa_id, 'page' AS kind, id, revid, url, title, CAST(coalesce(len(text), 0) AS BIGINT) AS n_paragraphs FROM (SELECT DISTINCT qa_id, id, revid, url, title, text, positive, negative FROM qa_pages)",
    "p6_qa_questions": _SIDE.format("positive") + " UNION ALL " + _SIDE.format("negative"),
    "p6_qa_paragraphs": f"""
WITH q AS ({_SIDE.format("positive")} UNION ALL {_SIDE.format("negative")}),
     n AS (SELECT qa_id, para, count(*) FILTER (side = 'positive') AS np, count(*) FILTER (side = 'negative') AS nn FROM q GROUP BY ALL),
     d AS (SELECT DISTINCT qa_id, id, revid, url, title, text, positive, negative FROM qa_pages),
     p AS (SELECT qa_id, CAST(i - 1 AS BIGINT) AS para, text[i] AS passage FROM d, UNNEST(range(1, CAST(len(text) + 1 AS BIGINT))) AS r(i))
SELECT p.qa_id, p.para, p.passage, CAST(coalesce(np, 0) AS BIGINT) AS n_positive, CAST(coalesce(nn, 0) AS BIGINT) AS n_negative
FROM p LEFT JOIN n USING (qa_id, para)""",
}
