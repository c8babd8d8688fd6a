import math

import numpy as np
import pytest

from wikiloom.operators import dense as D, lexical as L, metrics as M
from wikiloom.plans import dense as P


def frame(spark, texts, key="pid"):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], f"scope string, {key} long, text string")


def test_bm25_known_example(spark):
    docs = frame(spark, ["Hello there good man!", "It is quite windy in London", "How is the weather today?"])
    got = {r.pid: r.score for r in L.Bm25(docs).scores(frame(spark, ["windy London"], "qid")).collect()}
    assert got == {1: pytest.approx(0.937295, abs=1e-6)}


def test_tfidf_by_hand(spark):
    docs = frame(spark, ["naïve cats", "cats and dogs", "dogs"])
    got = {(r.pid): r.score for r in L.TfIdf(docs, min_df=1).scores(frame(spark, ["naive", "unknown"], "qid")).collect()}
    rare, common = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    assert got == {0: pytest.approx(rare / math.hypot(rare, common), abs=1e-6)}


def test_recall_is_monotone_and_mrr(spark):
    found = spark.createDataFrame([("s", 1, p, p + 1) for p in range(20)] + [("s", 2, 5, 1)], "scope string, qid long, pid long, rank int")
    rel = spark.createDataFrame([("s", 1, 4), ("s", 1, 12), ("s", 2, 6), ("s", 3, 1)], "scope string, qid long, pid long")
    r = M.recall_mrr(found, rel).collect()[0].asDict()
    values = [r[f"recall_{k}"] for k in M.RECALL_AT]
    assert values == sorted(values) and r["n_queries"] == 3
    assert r["recall_5"] == pytest.approx(100 / 6, abs=1e-3) and r["mrr_10"] == pytest.approx(100 / 15, abs=1e-3)


def test_maxsim_two_by_two(spark):
    i = spark.createDataFrame([("s", 1, [[1.0, 0.0], [0.0, 1.0]]), ("s", 2, [[0.6, 0.8]])], "scope string, pid long, emb array<array<float>>")
    q = spark.createDataFrame([("s", 9, [[1.0, 0.0], [0.6, 0.8]])], "scope string, qid long, emb array<array<float>>")
    got = {r.pid: r.score for r in D.exhaustive(i, q).collect()}
    assert got == {1: pytest.approx(0.9), 2: pytest.approx(0.8)}
    l2 = {r.pid: r.score for r in D.exhaustive(i, q, similarity="l2").collect()}
    assert l2[2] == pytest.approx((-(0.4**2 + 0.8**2) + 0) / 2)


def test_full_retrieval_with_all_candidates_is_exhaustive(spark):
    rng = np.random.default_rng(1)
    i = spark.createDataFrame([("s", p, rng.normal(size=(3, 4)).tolist()) for p in range(12)], "scope string, pid long, emb array<array<float>>")
    q = spark.createDataFrame([("s", 0, rng.normal(size=(2, 4)).tolist())], "scope string, qid long, emb array<array<float>>")
    full = [(r.pid, r.score) for r in D.retrieve_full(i, q, 36, 1).orderBy("rank").collect()]
    assert full == [(r.pid, r.score) for r in L.ranked(D.exhaustive(i, q)).orderBy("rank").collect()]


def test_index_append_twice(spark, tmp_path):
    docs = frame(spark, ["one two", None, "", "three"])
    path = str(tmp_path / "index")
    first = D.append(docs, path).count()
    assert first == 2 and D.append(docs, path).count() == 2
    assert D.append(frame(spark, ["one two", "new text here"]), path).count() == 3


def test_lsh_recall(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, emb array<float>")
    near = D.lsh_candidates(rows, rows.where("id % 50 = 0").withColumnRenamed("id", "qid"))
    got = {(r.qid, r.id) for r in near.collect()}
    want = {(q, int(i)) for q in range(0, 400, 50) for i in np.argsort(-v @ v[q], kind="stable")[:10]}
    assert len(want & got) / len(want) >= 0.9


def recall_of_lsh(spark, folder):
    """Of lsh_ann over a table of vectors, the share of the true ten nearest that it finds."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {(r.qid, r.vec_id) for r in P.lsh_ann(spark, folder).collect()}
    want = {(int(ids[q]), int(ids[i])) for q in np.flatnonzero(ids % 50 == 0) for i in np.argsort(-v @ v[q], kind="stable")[:10]}
    return len(want & got) / len(want)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_lsh_ann_recall_on_the_vector_table(spark, size):
    assert recall_of_lsh(spark, f"/root/testdata/{size}") >= 0.9


def test_terms_beyond_220_count(spark, tmp_path):
    """Reranking and the heat map over passages whose answer stands behind their 220th term."""
    filler = " ".join(f"filler{i}" for i in range(230))
    spark.createDataFrame([(i, f"{filler} amulet flute harvest", "w") for i in range(6)], "pid long, passage string, wiki string").write.parquet(str(tmp_path / "passages.parquet"))
    question = " ".join(f"filler{i}" for i in range(32)) + " amulet flute harvest"
    spark.createDataFrame([(1, question, "w", "test")], "qid long, query string, wiki string, split string").write.parquet(str(tmp_path / "queries.parquet"))
    rows = P.retrieve_rerank(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and {r.score for r in rows} == {1.0}
    assert D.encode_queries(frame(spark, [question], "qid")).first().emb[-1] == D.hashed_vector("harvest").tolist()
    assert all("#FF8080\">harvest" in r.html or "#FF7F7F\">harvest" in r.html for r in P.heatmap_html(spark, str(tmp_path)).collect())


def test_stream_indexes_rows_that_load_late(spark, tmp_path):
    from wikiloom.streaming import index as I

    folder, path, marks = (str(tmp_path / x) for x in ("in", "index", "marks"))
    for pid, day in ((1, "2024-06-01"), (2, "2024-01-01"), (1, "2024-01-02")):
        row = spark.createDataFrame([(pid, f"text of {pid}", 1, "w", "train", day)], "pid long, passage string, wid long, wiki string, split string, loaded_at string")
        row.selectExpr("pid", "passage", "wid", "wiki", "split", "timestamp(loaded_at) as loaded_at").write.mode("append").parquet(folder)
        I.grow(I.stream_passages(spark, folder), path, marks).awaitTermination()
    assert sorted(r.pid for r in spark.read.parquet(path).collect()) == [1, 2]


def test_losses_count_every_passage_and_every_relevant_pair(spark, tmp_path):
    """Sixteen passages, more than ten of them near: two relevant ones of a question, one that shares no term, a question without a known term."""
    from wikiloom.plans import retrieval as R

    texts = ["amulet harvest"] * 7 + ["amulet flute lantern"] * 6 + ["lantern lantern harvest"] * 2 + ["flute flute"]
    pids = [(7 * i) % 16 for i in range(16)]
    spark.createDataFrame([(p, x, "w") for p, x in zip(pids, texts)], "pid long, passage string, wiki string").write.parquet(str(tmp_path / "passages.parquet"))
    asked = {1: "amulet lantern", 2: "unheard", 3: "harvest", 4: "amulet"}
    spark.createDataFrame([(q, x, "w", "test") for q, x in asked.items()], "qid long, query string, wiki string, split string").write.parquet(str(tmp_path / "queries.parquet"))
    pairs = {(1, pids[8]), (1, pids[0]), (2, pids[3]), (3, pids[15])}
    spark.createDataFrame([(q, q, p, "w", "test") for q, p in [*pairs, (4, 99)]], "qid_pos long, qid_neg long, pid long, wiki string, split string").write.parquet(str(tmp_path / "triples.parquet"))
    got = {(r.qid, r.pid): r for r in R.ce_loss(spark, str(tmp_path)).collect()}
    df = {t: sum(t in x for x in texts) for t in ("amulet", "harvest", "flute", "lantern")}

    def vector(x):
        v = np.array([x.split().count(t) * (math.log(17 / (1 + n)) + 1) for t, n in df.items()])
        return v / max(np.linalg.norm(v), 1e-12)

    assert set(got) == pairs
    for (q, p), r in got.items():
        score = {i: round(float(vector(x) @ vector(asked[q])), 6) for i, x in zip(pids, texts)}
        order = sorted(score, key=lambda i: (-score[i], i))
        assert r.cross_entropy == pytest.approx(math.log(sum(map(math.exp, score.values()))) - score[p], abs=1e-5)
        assert r.mse == pytest.approx(sum((s - (i == p)) ** 2 for i, s in score.items()) / 16, abs=1e-5)
        assert r.right == (score[p] == max(score.values())) and r.reciprocal_rank == pytest.approx(1 / (1 + order.index(p)), abs=1e-6)
