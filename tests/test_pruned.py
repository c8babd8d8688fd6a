import numpy as np
import pytest

import __spark_entry__ as entry
from wikiloom.operators import lexical as L, pruned as P


def chunk(seed, n=300, low=0.1):
    """A chunk and the weights of its documents [document, term]: frequent and rare terms."""
    rng = np.random.default_rng(seed)
    w = rng.uniform(low, 1, (n, 30)).round(2) * (rng.random((n, 30)) < np.geomspace(0.9, 0.01, 30))
    pids = rng.permutation(n) * 3
    doc, term = np.nonzero(w)
    return P.Chunk(pids, doc, term.astype(np.int64) * 7 - 60, w[doc, term]), pids, w


@pytest.mark.parametrize("seed", range(40))
def test_chunk_equals_all_pairs(seed):
    rng = np.random.default_rng(seed + 100)
    c, pids, w = chunk(seed)
    terms = rng.choice(30, rng.integers(1, 9), replace=False)
    x = rng.uniform(0.1, 1, len(terms)).round(2) * (1 if seed % 4 else rng.choice([-1, 0, 1], len(terms)))
    score = np.round(w[:, terms] @ x, 6)
    met = (w[:, terms] > 0).any(axis=1)
    ts = c.known(terms.astype(np.int64) * 7 - 60)
    ts, x = ts[ts >= 0], x[ts >= 0]
    every = sorted((-s, p) for s, p, m in zip(score, pids, met) if m)
    for k in (1, 5, 40):
        docs, s = c.best(ts, x, k)
        assert c.pids[docs].tolist() == [p for _, p in every[:k]] and np.allclose(-s, [a for a, _ in every[:k]], atol=1e-9)
        docs, s = c.last(ts, x, k)
        assert c.pids[docs].tolist() == [-p for _, p in sorted(zip(score, -pids))[:k]]
    some = rng.choice(300, 3, replace=False)
    ahead, before = c.ahead(ts, x, score[some], pids[some])
    for a, b, i in zip(ahead, before, some):
        assert a == sum((-s, p) < (-score[i], pids[i]) for s, p, m in zip(score, pids, met) if m)
        assert score[i] > 0 or b == sum(p < pids[i] for p, m in zip(pids, met) if m)


def test_few_documents_are_looked_at(monkeypatch):
    """A question with a rare term and a frequent one: only the rare term's documents are scored."""
    n = 2000
    pids = np.arange(n)
    doc = np.concatenate([pids, pids[:5]])
    c = P.Chunk(pids, doc, np.repeat([1, 2], [n, 5]), np.repeat([0.1, 0.9], [n, 5]))
    docs, _ = c.reaching(np.array([0, 1]), np.array([0.1, 0.9]), 0.5)
    assert docs.tolist() == [0, 1, 2, 3, 4] and not c.acc.any()


def test_best_looks_through_all_documents_once(monkeypatch):
    """However many terms a question has, the k best so far are bounded on few documents."""
    c, _, _ = chunk(3)
    calls = []
    monkeypatch.setattr(P.np, "flatnonzero", lambda a, f=np.flatnonzero: calls.append(len(a)) or f(a))
    c.best(np.arange(12), np.linspace(1, 0.4, 12), 2)
    assert calls.count(c.n) == 1


RANKED = ("rank_of_positive", "rank_describe", "eval_rank_stats", "eval_in_best", "eval_f_beta", "rank_matrix_docs", "rank_matrix_queries")
LISTED = ("eval_recall_mrr", "eval_topn_accuracy", "lexical_vs_bm25_diff")


@pytest.mark.parametrize("name", RANKED)
def test_ranks_are_counted_without_all_pairs(spark, small, monkeypatch, name):
    paired = L.paired

    def some(q, d, subset):
        assert subset is not None, "all pairs that share a term"
        return paired(q, d, subset)

    monkeypatch.setattr(L, "paired", some)
    assert entry.queries()[name](spark, small) is not None


@pytest.mark.parametrize("name", LISTED)
def test_ranks_of_relevant_passages_need_no_long_list(spark, small, monkeypatch, name):
    block_topk = L.block_topk

    def short(docs, weigh, queries, k, worst=False):
        assert k <= 1, "a list of the first k of every question"
        return block_topk(docs, weigh, queries, k, worst)

    monkeypatch.setattr(L, "block_topk", short)
    assert entry.queries()[name](spark, small) is not None


@pytest.mark.parametrize("seed", range(12))
def test_tiles_count_what_questions_count_one_by_one(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    c, pids, w = chunk(seed)
    monkeypatch.setattr(P, "TILE", int(rng.choice([100, 1000, 1 << 20])))
    rows = []
    for qid in range(25):
        terms = rng.choice(32, rng.integers(1, 20), replace=False)  # two terms no document has
        x = rng.uniform(0.1, 1, len(terms)).round(2) * (1 if qid % 5 else rng.choice([-1, 0, 1], len(terms)))
        some = rng.choice(300, 3, replace=False)
        score = np.round(np.append(w, np.zeros((300, 2)), axis=1)[some][:, terms] @ x, 6)
        rows.append(("a", qid, terms * 7 - 60, x, score, pids[some]))
    block = P.Block(rows, True)
    got, want = (sorted(zip(*(v.tolist() for v in f(block, "a", c)))) for f in (P.counted_in_tiles, P.counted_ahead))
    assert got == want and got


def test_rank_matrix_queries_counts_for_many_passages_at_once(spark, small, monkeypatch):
    """No passage is taken through the questions by itself, and the passages' rows are sent from files."""
    sent = []
    monkeypatch.setattr(P, "counted_ahead", None)
    monkeypatch.setattr(L, "durable", lambda df, f=L.durable: sent.append(df.columns) or f(df))
    assert entry.queries()["rank_matrix_queries"](spark, small).count() and ["scope", "pid", "h", "w"] in sent


@pytest.mark.parametrize("seed", range(24))
def test_bounded_lists_equal_all_pairs(seed, monkeypatch):
    """Of two chunks, whatever is taken together; with weights that bounds do not hold for."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(P, "TILE", int(rng.choice([50, 1 << 20])))
    monkeypatch.setattr(P, "HEAVY", int(rng.choice([0, 60, 2048])))
    monkeypatch.setattr(P, "LIKELY", int(rng.choice([1, 8, 64])))
    (a, pids, w), (b, more, v) = chunk(seed), chunk(seed + 50, low=-0.2 if seed % 6 == 5 else 0.1)
    pids, w, b.pids = np.concatenate([pids, more + 1]), np.concatenate([w, v]), b.pids + 1
    rows, want = [], []
    for qid in range(40):
        terms = rng.choice(32, rng.integers(1, 9), replace=False)  # two terms no document has
        x = rng.uniform(0.1, 1, len(terms)).round(2) * (1 if qid % 5 else rng.choice([-1, 0, 1], len(terms)))
        rows.append(("a", qid, terms * 7 - 60, x))
        all_ = np.append(w, np.zeros((len(w), 2)), axis=1)[:, terms]
        want.append(sorted((-s, p) for s, p, m in zip(np.round(all_ @ x, 6), pids, (all_ != 0).any(axis=1)) if m))
    for k in (1, 3):
        block = P.Block(rows, False)
        found = [np.concatenate(y) for y in zip(*(P.promising(k)(block, "a", c) for c in (a, b)))]
        theta = [np.sort(found[1][found[0] == i])[::-1] for i in range(40)]
        block.theta = {"a": np.array([max(t[k - 1], 0.0) if len(t) >= k else 0.0 for t in theta])}
        got = [[] for _ in rows]
        for c in (a, b):
            for i, p, s in zip(*P.listed(k)(block, "a", c)):
                got[i].append((-float(s), int(p)))
        for g, e in zip(got, want):
            assert [p for _, p in sorted(g)[:k]] == [p for _, p in e[:k]] and np.allclose([s for s, _ in sorted(g)[:k]], [s for s, _ in e[:k]], atol=1e-9)


def test_heatmap_html_takes_questions_together(spark, small, monkeypatch):
    """Its questions are bounded over all parts first: none takes its own way through the passages, and no text is cut again."""
    monkeypatch.setattr(P.Chunk, "best", None)
    n = []
    terms = L.X.terms
    monkeypatch.setattr(L.X, "terms", lambda *a: n.append(a) or terms(*a))
    monkeypatch.setattr(L.counted, "__defaults__", (terms,))
    assert entry.queries()["heatmap_html"](spark, small).count()
    assert len(n) == 2  # passages, and questions where they are encoded


def test_explained_tokens_are_in_order(spark):
    from wikiloom.operators import dense as D

    words = spark.createDataFrame([("a", 1, ["cat", "owl", "cat", "fox"]), ("a", 2, ["elk"])], "scope string, pid long, emb array<string>")
    asked = spark.createDataFrame([("a", 7, ["cat", "fox"])], "scope string, qid long, emb array<string>")
    pairs = spark.createDataFrame([("a", 7, 1), ("a", 7, 2)], "scope string, qid long, pid long")
    for k in (1, 2, 9):
        got = sorted((r.pid, r.qtok, r["rank"], r.tok, r.sim) for r in D.token_explain(pairs, words, asked, k).collect())
        assert [g[:4] for g in got if g[0] == 1 and g[2] <= 2] == [x for x in [(1, 0, 1, 0), (1, 0, 2, 2), (1, 1, 1, 3)] + [g[:4] for g in got if g[:3] == (1, 1, 2)] if x[2] <= k]
        assert [g[2] for g in got if g[:2] == (1, 0)] == list(range(1, min(k, 4) + 1)) and sum(g[0] == 2 for g in got) == 2
