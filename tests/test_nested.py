import json

import pytest

from wikiloom.operators import nested as N


def rows(spark, payloads):
    return spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "rec_id long, payload string")


def keys(spark, payload):
    return sorted((r.para, r.side, r.k) for r in N.questions(N.normalised(rows(spark, [payload]))).collect())


PAGE = {"id": "7", "revid": 3, "url": None, "title": "T", "text": ["a", "b"], "positive": [["x?", None, " "], [{"q": "y?", "score": 1}]], "negative": [None, ["z?"], ["beyond?"]]}


def test_page(spark):
    want = [(0, "positive", 0), (1, "negative", 0), (1, "positive", 0)]
    assert keys(spark, json.dumps(PAGE)) == want
    assert keys(spark, "﻿  " + json.dumps(PAGE, indent=1) + "\n") == want
    assert keys(spark, json.dumps(json.dumps(PAGE))) == want


def test_text_is_one_string(spark):
    assert keys(spark, json.dumps({"text": "p", "positive": ["a?", "", "b?"], "negative": [{"q": "c?"}]})) == [(0, "negative", 0), (0, "positive", 0), (0, "positive", 2)]


def test_legacy_and_blueprint(spark):
    assert keys(spark, json.dumps({"id": 1, "text": [[["a?"], "p"], [[], "q"], [[{"q": "b?"}, "c?"], "r"]]})) == [(0, "positive", 0), (2, "positive", 0), (2, "positive", 1)]
    blue = {"12": {"title": "t", "passage": "p", "pos_query": ["a?", None, "b?"], "neg_query": None}, "5": {"passage": "q"}}
    assert keys(spark, json.dumps(blue)) == [(12, "positive", 0), (12, "positive", 2)]


@pytest.mark.parametrize("payload", [None, "", "  ", "null", "[]", "<html>", '{"text": ["a"], "positive": [["x?"', '"text"', "{}", '{"text": null, "positive": [["a?"]]}', '{"positive": 5}'])
def test_no_rows(spark, payload):
    assert keys(spark, payload) == []


def test_links_and_counts(spark):
    n = N.normalised(rows(spark, [json.dumps(PAGE), json.dumps(PAGE)]).selectExpr("0L as rec_id", "payload", "1 as kind"))
    assert [tuple(r)[:2] + (r.id, r.n_paragraphs) for r in N.pages(n).collect()] == [(0, "page", 7, 2)]
    assert sorted((r.para, r.n_positive, r.n_negative) for r in N.paragraphs(n).collect()) == [(0, 1, 0), (1, 1, 1)]


def test_empty_table(spark):
    n = N.normalised(rows(spark, []))
    assert N.questions(n).count() == N.pages(n).count() == N.paragraphs(n).count() == 0
