"""Searches of documents where they lie."""

import numpy as np
import pytest

import __spark_entry__ as entry
from wikiloom.operators import lexical as L, pruned as P
from wikiloom.plans import common


def _in_place(spark, small, monkeypatch, name):
    """Runs a query; no text of the corpus may be shuffled to be searched, and no term of it written or shuffled to score pairs."""
    counted, spread = L.counted, P.spread

    def terms(df, id_, text, analyzer=L.X.terms):
        assert id_ == "qid", "all terms of passages"
        return counted(df, id_, text, analyzer)

    def moved(docs):
        assert "text" not in docs.columns, "texts are shuffled"
        return spread(docs)

    monkeypatch.setattr(L, "counted", terms)
    monkeypatch.setattr(P, "spread", moved)
    return entry.queries()[name](spark, small)


def test_rank_matrix_docs_moves_no_texts(spark, small, monkeypatch):
    assert _in_place(spark, small, monkeypatch, "rank_matrix_docs").count()


def test_rank_matrix_queries_moves_no_texts(spark, small, monkeypatch):
    assert _in_place(spark, small, monkeypatch, "rank_matrix_queries").count()


def test_eval_recall_mrr_moves_no_texts(spark, small, monkeypatch):
    assert _in_place(spark, small, monkeypatch, "eval_recall_mrr").count()


def test_eval_topn_accuracy_moves_no_texts(spark, small, monkeypatch):
    assert _in_place(spark, small, monkeypatch, "eval_topn_accuracy").count()


@pytest.mark.parametrize("seed", range(8))
def test_scores_of_stated_pairs(seed):
    rng = np.random.default_rng(seed)
    w = rng.uniform(0.1, 1, (50, 12)).round(2) * (rng.random((50, 12)) < 0.3)
    pids = rng.permutation(50) * 3
    doc, term = np.nonzero(w)
    c = P.Chunk(pids, doc, term.astype(np.int64) * 7, w[doc, term])
    rows, want = [], []
    for qid in range(20):
        terms, x = rng.choice(14, 4, replace=False), rng.uniform(-1, 1, 4).round(2)  # two terms no document has
        asked = rng.choice(160, 6, replace=False)
        rows.append(("a", qid, terms * 7, x, np.zeros(6), asked))
        for i in np.flatnonzero(np.isin(pids, asked)):
            shared = [(t, y) for t, y in zip(terms, x) if t < 12 and w[i, t]]
            if shared:
                want.append((qid, int(pids[i]), round(float(sum(y * w[i, t] for t, y in shared)), 6)))
    got = sorted(zip(*(v.tolist() for v in P.scored_pairs(P.Block(rows, True), "a", c))))
    assert [g[:2] for g in got] == [x[:2] for x in sorted(want)] and np.allclose([g[2] for g in got], [x[2] for x in sorted(want)], atol=1e-6)


def test_corpus_is_grouped_by_range(spark, small):
    rows = common.stored(spark, small)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, common.corpus(spark, small).collect()))


def test_own_passages_are_ranked_without_shuffled_terms(spark, small, monkeypatch):
    """Equal to an index over all groups, whose terms rank_among_own may not make."""
    rows = [("1/7", 1, 7, "red fox Fox", [7, 3, 9, 4], ["the red fox", "red red fox", "fox fox red dog", ""]), ("2/5", 2, 5, "owl", [5, 6], ["a dog", "the dog"]), ("3/8", 3, 8, "owl cat", [2, 8], ["cat owl", "owl cat"])]
    groups = spark.createDataFrame(rows, "scope string, qid long, pid long, text string, pids array<bigint>, texts array<string>")
    docs = spark.createDataFrame([(r[0], p, t) for r in rows for p, t in zip(r[4], r[5])], "scope string, pid long, text string")
    want = L.places(groups.select("scope", "qid", "pid"), L.TfIdf(docs, min_df=1).scores(groups.select("scope", "qid", "text")), docs)
    assert sorted(map(tuple, L.own_places(groups).collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(L, "counted", None)
    assert entry.queries()["rank_among_own"](spark, small).count()


@pytest.mark.parametrize("name", ["tfidf_top_bottom_k", "eval_recall_mrr", "eval_topn_accuracy", "rank_matrix_queries", "retrieve_rerank"])
def test_passages_are_cut_into_terms_once(spark, small, monkeypatch, name):
    """Once the texts are stored, their terms are; vocabulary and searches read those."""
    cut = []
    terms = L.X.terms

    def counted(column, *a):
        cut.append(column)
        return terms(column, *a)

    monkeypatch.setattr(L.X, "terms", counted)
    monkeypatch.setattr(L.counted, "__defaults__", (terms,))
    index = L.TfIdf(common.stored(spark, small), placed=True)
    index.topk(common.asked(spark, small), 3).count()
    assert len(cut) == 1 and entry.queries()[name](spark, small).count()


@pytest.mark.parametrize("name", ["retrieve_rerank", "heatmap_html"])
def test_pairs_are_joined_with_terms_not_vectors(spark, small, monkeypatch, name):
    from wikiloom.operators import dense as D

    monkeypatch.setattr(D, "_encode", None)
    assert entry.queries()[name](spark, small).count()
