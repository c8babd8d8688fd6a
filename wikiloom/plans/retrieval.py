"""Lexical retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikiloom.durable import durable
from wikiloom.operators import lexical as L, metrics as M
from wikiloom.plans.building import NEGATIVES, ms_triples_qpp
from wikiloom.plans.common import SQL, asked, relevant, stored
from wikiloom.session import table

K = 100


def tfidf_topk(spark, sf_dir):
    return L.TfIdf(stored(spark, sf_dir), placed=True).topk(asked(spark, sf_dir), 10, zero_fill=True)


def tfidf_scores(spark, sf_dir):
    """Scores of the test questions with their relevant passages."""
    return L.TfIdf(stored(spark, sf_dir), placed=True).scores(asked(spark, sf_dir), relevant(spark, sf_dir))


def tfidf_vocab_idf(spark, sf_dir):
    return L.TfIdf(stored(spark, sf_dir), placed=True).vocab.select("scope", "term", "df", F.round("idf", 6).alias("idf"))


def tfidf_doc_vectors(spark, sf_dir):
    return L.TfIdf(stored(spark, sf_dir), placed=True).vectors.select("scope", "pid", "term", F.round("w", 6).alias("w"))


def tfidf_top_bottom_k(spark, sf_dir):
    return L.TfIdf(stored(spark, sf_dir), placed=True).best_and_worst(asked(spark, sf_dir), 5, 5)


def bm25_topk(spark, sf_dir):
    return L.Bm25(stored(spark, sf_dir), placed=True).topk(asked(spark, sf_dir), 10, zero_fill=True)


def bm25_idf(spark, sf_dir):
    return L.Bm25(stored(spark, sf_dir), placed=True).idf.select("scope", "term", "df", F.round("idf", 6).alias("idf"))


def bm25_subset_scores(spark, sf_dir):
    return L.Bm25(stored(spark, sf_dir), placed=True).scores(asked(spark, sf_dir), relevant(spark, sf_dir))


def bm25_hit_rank(spark, sf_dir):
    q = asked(spark, sf_dir)
    return L.hit_rank(L.Bm25(stored(spark, sf_dir), placed=True).topk(q, 10), relevant(spark, sf_dir), q)


def _found(spark, sf_dir, k):
    """The relevant passages within the first k of their question, with their ranks: what the metrics read of a ranked list."""
    return L.TfIdf(stored(spark, sf_dir), placed=True).ranks(asked(spark, sf_dir), relevant(spark, sf_dir)).where(F.col("rank") <= k)


def eval_recall_mrr(spark, sf_dir):
    return M.recall_mrr(_found(spark, sf_dir, 1000), relevant(spark, sf_dir))


def eval_topn_accuracy(spark, sf_dir):
    return M.topn_accuracy(_found(spark, sf_dir, K), relevant(spark, sf_dir))


def _ranks(spark, sf_dir):
    """scope, qid_pos, qid_neg, pid, size, positive, negative: 0-based ranks of a triple's passage for both of its questions, among all
    `size` passages of the wiki in the order of score, then of pid; a passage without a shared term has the score 0."""
    c = stored(spark, sf_dir)
    q = asked(spark, sf_dir)
    known = q.select("scope", "qid")
    t = table(spark, sf_dir, "triples").where("split = 'test'").select(F.col("wiki").alias("scope"), "qid_pos", "qid_neg", "pid").distinct()
    t = t.join(c.select("scope", "pid"), ["scope", "pid"], "left_semi")
    for qid in ("qid_pos", "qid_neg"):
        t = t.join(known.withColumnRenamed("qid", qid), ["scope", qid], "left_semi")
    t = durable(t)
    pairs = t.select("scope", F.col("qid_pos").alias("qid"), "pid").unionByName(t.select("scope", F.col("qid_neg").alias("qid"), "pid")).distinct()
    places = durable(L.TfIdf(c, placed=True).places(q, pairs))
    out = t
    for name, qid in (("positive", "qid_pos"), ("negative", "qid_neg")):
        out = out.join(places.select("scope", F.col("qid").alias(qid), "pid", F.col("rank").alias(name)), ["scope", qid, "pid"])
    size = c.groupBy("scope").agg(F.count("*").alias("size"))
    return out.join(size, "scope").select("scope", "qid_pos", "qid_neg", "pid", "size", "positive", "negative")


def rank_of_positive(spark, sf_dir):
    return _ranks(spark, sf_dir).drop("size")


def rank_describe(spark, sf_dir):
    return M.describe(_ranks(spark, sf_dir), "positive", ["scope"])


def eval_rank_stats(spark, sf_dir):
    """Mean ranks, their reciprocals, linear position scores, confusion, precision, recall, F1."""
    r = durable(_ranks(spark, sf_dir))
    return M.rank_scores(r, F.col("size"))


def eval_in_best(spark, sf_dir):
    """Shares of triples within the first k, and the mean reciprocal ranks of both of their questions."""
    return M.in_best(_ranks(spark, sf_dir))


def eval_f_beta(spark, sf_dir):
    r = M.rank_scores(durable(_ranks(spark, sf_dir)), F.col("size"), beta=2.0)
    return r.select("scope", "precision", "recall", "f_beta")


def rank_among_own(spark, sf_dir):
    """scope (qid/pid_pos), rank from 0 of a triple's positive passage among its own ten passages only, by an index fitted on those."""
    lists = ms_triples_qpp(spark, sf_dir)
    name = F.concat_ws("/", "qid", "pid_pos").alias("scope")
    own = lists.select("qid", name, F.col("pid_neg").alias("pid")).union(lists.select("qid", name, F.col("pid_pos").alias("pid"))).distinct()
    texts = table(spark, sf_dir, "passages").where("passage is not null").groupBy("pid").agg(F.min("passage").alias("text"))
    q = table(spark, sf_dir, "queries").where("query is not null").groupBy("qid").agg(F.min("query").alias("text"))
    groups = own.join(texts, "pid").repartition("qid").groupBy("qid", "scope").agg(F.collect_list(F.struct("pid", "text")).alias("docs"))  # ten texts, a bounded list
    asked_ = groups.join(q, "qid").withColumn("pid", F.split_part("scope", F.lit("/"), F.lit(2)).cast("long"))
    return L.own_places(asked_.where("array_contains(docs.pid, pid)").select("scope", "qid", "pid", "text", F.col("docs.pid").alias("pids"), F.col("docs.text").alias("texts")))


def rank_matrix_docs(spark, sf_dir):
    """Ranks of the passages for each question, of the pairs with a relevant passage."""
    s = L.TfIdf(stored(spark, sf_dir), placed=True).ranks(asked(spark, sf_dir), relevant(spark, sf_dir))
    return s.select("scope", "qid", "pid", (F.col("rank") - 1).alias("rank"))


def rank_matrix_queries(spark, sf_dir):
    """Ranks of the questions for each passage."""
    s = L.TfIdf(stored(spark, sf_dir), placed=True).question_ranks(asked(spark, sf_dir), relevant(spark, sf_dir))
    return s.select("scope", "qid", "pid", (F.col("rank") - 1).alias("rank"))


def semi_join_triples(spark, sf_dir):
    """The pairs of a ranked list that are in triples."""
    return _found(spark, sf_dir, 10).select("scope", "qid", "pid", "rank")


def lexical_vs_bm25_diff(spark, sf_dir):
    """scope, qid, pid, rank_a, rank_b, diff of the relevant passages under two rankings, and the first passage of each; a miss counts as K."""
    c, q, rel = stored(spark, sf_dir), asked(spark, sf_dir), relevant(spark, sf_dir)
    rows = rel.join(q.select("scope", "qid"), ["scope", "qid"], "left_semi")
    q = durable(q.join(rel.select("scope", "qid"), ["scope", "qid"], "left_semi"))  # only questions with a relevant passage have rows
    for x, model in (("a", L.TfIdf(c, placed=True)), ("b", L.Bm25(c, placed=True))):
        found = durable(model.ranks(q, rel).where(F.col("rank") <= K))
        rows = rows.join(found.select("scope", "qid", "pid", (F.col("rank") - 1).alias(f"rank_{x}")), ["scope", "qid", "pid"], "left")
        rows = rows.join(model.topk(q, 1).select("scope", "qid", F.col("pid").alias(f"top1_{x}")), ["scope", "qid"], "left")
    rows = rows.na.fill(K, ["rank_a", "rank_b"])
    return rows.select("scope", "qid", "pid", "rank_a", "rank_b", "top1_a", "top1_b", (F.col("rank_a") - F.col("rank_b")).alias("diff"))


def quadrant_keys(spark, sf_dir):
    """Whether each of two rankings has a relevant passage within its first ten, by question and passage."""
    return lexical_vs_bm25_diff(spark, sf_dir).select("scope", "qid", "pid", (F.col("rank_a") < 10).alias("a_good"), (F.col("rank_b") < 10).alias("b_good"))


def quadrants(spark, sf_dir):
    """How many relevant passages each of two rankings has within its first ten."""
    return quadrant_keys(spark, sf_dir).groupBy("a_good", "b_good").agg(F.count("*").alias("n"))


def best_worst_report(spark, sf_dir):
    """The twenty questions with the greatest and the twenty with the least difference between two rankings."""
    d = durable(lexical_vs_bm25_diff(spark, sf_dir).select("scope", "qid", "pid", "diff"))
    best = d.orderBy("diff", "scope", "qid", "pid").limit(20).withColumn("side", F.lit("a"))
    worst = d.orderBy(F.desc("diff"), "scope", "qid", "pid").limit(20).withColumn("side", F.lit("b"))
    return best.unionByName(worst)


def ce_loss(spark, sf_dir):
    """Cross-entropy, squared error, accuracy and reciprocal rank of each relevant pair against all passages of its wiki, those without a shared term at 0."""
    index = L.TfIdf(stored(spark, sf_dir), placed=True)
    return M.losses_against_all(index.against_all(asked(spark, sf_dir), relevant(spark, sf_dir)))


def _ten_best_loss(spark, sf_dir):
    """The losses of the first relevant passage of each question against the ten best passages."""
    index, q = L.TfIdf(stored(spark, sf_dir), placed=True), asked(spark, sf_dir)
    good = durable(relevant(spark, sf_dir).groupBy("scope", "qid").agg(F.min("pid").alias("pid")))
    q = durable(q.join(good, ["scope", "qid"], "left_semi"))
    scored = index.scores(q, good)
    rows = index.topk(q, 10).select("scope", "qid", "pid", "score").unionByName(scored).distinct().join(good.select("*", F.lit(True).alias("positive")), ["scope", "qid", "pid"], "left").na.fill(False, ["positive"])
    rows = durable(rows)
    return M.cross_entropy(rows.join(rows.where("positive").select("scope", "qid"), ["scope", "qid"], "left_semi"))


def validation(spark, sf_dir):
    """Loss, accuracy and mean reciprocal rank over all questions of a wiki, against their ten best passages."""
    return M.validation(_ten_best_loss(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (tfidf_topk, tfidf_scores, tfidf_vocab_idf, tfidf_doc_vectors, tfidf_top_bottom_k, bm25_topk, bm25_idf, bm25_subset_scores, bm25_hit_rank, eval_recall_mrr, eval_topn_accuracy, rank_of_positive, rank_describe, eval_rank_stats, eval_in_best, eval_f_beta, rank_among_own, rank_matrix_docs, rank_matrix_queries, semi_join_triples, lexical_vs_bm25_diff, quadrants, quadrant_keys, best_worst_report, ce_loss, validation)
}

def _tfidf(relations: str, least: int) -> str:
    """corpus and asked of `relations` scored: s (all pairs that share a term) and r (with ranks)."""
    return f"""WITH {relations},
terms AS (SELECT scope, pid, unnest(regexp_extract_all({FOLD}, '[\\pL\\pN_]{{2,}}')) AS term FROM corpus),
tf AS MATERIALIZED (SELECT scope, pid, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT scope, count(*) AS n FROM corpus GROUP BY ALL),
vocab AS MATERIALIZED (SELECT scope, term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf JOIN n USING (scope) GROUP BY scope, term HAVING count(*) >= {least}),
dv AS MATERIALIZED (SELECT scope, pid, term, tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY scope, pid)) AS w FROM tf JOIN vocab USING (scope, term)),
qt AS (SELECT scope, qid, unnest(regexp_extract_all({FOLD}, '[\\pL\\pN_]{{2,}}')) AS term FROM asked),
qf AS (SELECT scope, qid, term, count(*) AS tf FROM qt GROUP BY ALL),
qv AS (SELECT scope, qid, term, tf * idf / sqrt(sum(pow(tf * idf, 2)) OVER (PARTITION BY scope, qid)) AS wq FROM qf JOIN vocab USING (scope, term)),
s AS MATERIALIZED (SELECT scope, qid, pid, round(sum(w * wq), 6) AS score FROM qv JOIN dv USING (scope, term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, qid ORDER BY score DESC, pid) AS rank FROM s)"""


#: The analyzer's folding in SQL.
FOLD = "strip_accents(lower(text))"
_TFIDF = _tfidf(SQL, 5)

_BM25 = """,
bt AS (SELECT scope, pid, unnest(string_split(text, ' ')) AS term FROM corpus),
btf AS (SELECT scope, pid, term, count(*) AS tf FROM bt GROUP BY ALL),
bs AS (SELECT scope, count(*) AS n, avg(len(string_split(text, ' '))) AS avgdl FROM corpus GROUP BY ALL),
bl AS (SELECT scope, pid, len(string_split(text, ' ')) AS dl FROM corpus),
bdf AS (SELECT scope, term, count(*) AS df FROM btf GROUP BY ALL),
braw AS (SELECT scope, term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM bdf JOIN bs USING (scope)),
bidf AS (SELECT scope, term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER (PARTITION BY scope) ELSE raw END AS idf FROM braw),
bq AS (SELECT scope, qid, term, count(*) AS qf FROM (SELECT scope, qid, unnest(string_split(text, ' ')) AS term FROM asked) GROUP BY ALL),
b AS (SELECT scope, qid, pid, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
      FROM bq JOIN bidf USING (scope, term) JOIN btf USING (scope, term) JOIN bl USING (scope, pid) JOIN bs USING (scope) GROUP BY ALL),
br AS (SELECT *, row_number() OVER (PARTITION BY scope, qid ORDER BY score DESC, pid) AS rank FROM b)"""

# Places among all documents, counted one by one.
_PLACES = """,
ps AS (SELECT pq.*, coalesce(s.score, 0.0) AS mine FROM pq LEFT JOIN s USING (scope, qid, pid)),
f AS MATERIALIZED (SELECT a.scope, a.qid, c.pid AS other, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT scope, qid FROM ps) a JOIN corpus c USING (scope) LEFT JOIN s ON s.scope = a.scope AND s.qid = a.qid AND s.pid = c.pid),
pl AS MATERIALIZED (SELECT scope, qid, pid, count(*) FILTER (score > mine OR score = mine AND other < pid) AS place FROM ps JOIN f USING (scope, qid) GROUP BY ALL)"""
_RANKS = """,
sz AS (SELECT scope, count(*) AS size FROM corpus GROUP BY ALL),
tr AS MATERIALIZED (SELECT DISTINCT wiki AS scope, qid_pos, qid_neg, t.pid FROM triples t JOIN corpus c ON c.scope = wiki AND c.pid = t.pid
       JOIN asked qa ON qa.scope = wiki AND qa.qid = qid_pos JOIN asked qb ON qb.scope = wiki AND qb.qid = qid_neg WHERE split = 'test'),
pq AS (SELECT scope, qid_pos AS qid, pid FROM tr UNION SELECT scope, qid_neg, pid FROM tr)""" + _PLACES + """,
rk AS (SELECT tr.scope, qid_pos, qid_neg, tr.pid, size, p.place AS positive, m.place AS negative FROM tr JOIN sz USING (scope)
       JOIN pl p ON p.scope = tr.scope AND p.qid = qid_pos AND p.pid = tr.pid JOIN pl m ON m.scope = tr.scope AND m.qid = qid_neg AND m.pid = tr.pid)"""

_DIFF = _BM25 + f""",
d AS (SELECT rel.scope, rel.qid, rel.pid, ta.pid AS top1_a, tb.pid AS top1_b, CASE WHEN r.rank <= {K} THEN r.rank - 1 ELSE {K} END AS rank_a, CASE WHEN br.rank <= {K} THEN br.rank - 1 ELSE {K} END AS rank_b
      FROM rel SEMI JOIN asked USING (scope, qid) LEFT JOIN r USING (scope, qid, pid) LEFT JOIN br ON br.scope = rel.scope AND br.qid = rel.qid AND br.pid = rel.pid
      LEFT JOIN r ta ON ta.scope = rel.scope AND ta.qid = rel.qid AND ta.rank = 1 LEFT JOIN br tb ON tb.scope = rel.scope AND tb.qid = rel.qid AND tb.rank = 1)"""

_RECALL = ", ".join(f"round(100 * avg(hits_{k} / n_relevant::DOUBLE), 3) AS recall_{k}" for k in M.RECALL_AT)
_HITS = ", ".join(f"count(*) FILTER (rank <= {k}) AS hits_{k}" for k in M.RECALL_AT)
_MRR = ", ".join(f"round(100 * avg(CASE WHEN f <= {k} THEN 1.0 / f ELSE 0 END::DOUBLE), 3) AS mrr_{k}" for k in M.MRR_AT)

_LOSS = """,
g AS (SELECT scope, qid, min(pid) AS good FROM rel GROUP BY ALL),
c AS MATERIALIZED (SELECT r.scope, r.qid, r.pid, score, pid = good AS positive FROM r JOIN g USING (scope, qid) WHERE rank <= 10 OR pid = good),
o AS (SELECT scope, qid, row_number() OVER (PARTITION BY scope, qid ORDER BY score DESC, pid) AS place, positive FROM c),
loss AS (SELECT scope, qid, round(ln(sum(exp(score))) - max(score) FILTER (positive), 6) AS cross_entropy, round(avg(pow(score - positive::INT, 2)), 6) AS mse,
  (max(score) FILTER (positive) >= max(score))::INT AS "right", round(1.0 / (SELECT place FROM o WHERE o.scope = c.scope AND o.qid = c.qid AND o.positive)::DOUBLE, 6) AS reciprocal_rank
FROM c GROUP BY scope, qid HAVING bool_or(positive))"""


def _filled(scores: str) -> str:
    """The first ten of all documents, those without a score counted as 0."""
    return f""" SELECT a.scope, a.qid, c.pid, coalesce(x.score, 0.0) AS score, row_number() OVER (PARTITION BY a.scope, a.qid ORDER BY coalesce(x.score, 0.0) DESC, c.pid) AS rank
FROM asked a JOIN corpus c USING (scope) LEFT JOIN {scores} x ON x.scope = a.scope AND x.qid = a.qid AND x.pid = c.pid QUALIFY rank <= 10"""


ORACLE = {
    "tfidf_topk": _TFIDF + _filled("s"),
    "tfidf_scores": _TFIDF + " SELECT s.* FROM s SEMI JOIN rel USING (scope, qid, pid)",
    "tfidf_vocab_idf": _TFIDF + " SELECT scope, term, df, round(idf, 6) AS idf FROM vocab",
    "tfidf_doc_vectors": _TFIDF + " SELECT scope, pid, term, round(w, 6) AS w FROM dv",
    "tfidf_top_bottom_k": _TFIDF + """,
f AS (SELECT a.scope, a.qid, c.pid, coalesce(s.score, 0.0) AS score FROM asked a JOIN corpus c USING (scope) LEFT JOIN s ON s.scope = a.scope AND s.qid = a.qid AND s.pid = c.pid),
g AS (SELECT *, row_number() OVER (PARTITION BY scope, qid ORDER BY score DESC, pid) AS rank, count(*) OVER (PARTITION BY scope, qid) AS n FROM f)
SELECT scope, qid, pid, score, rank FROM g WHERE rank <= 5 OR rank > n - 5""",
    "bm25_topk": _TFIDF + _BM25 + _filled("b"),
    "bm25_idf": _TFIDF + _BM25 + " SELECT scope, term, df, round(idf, 6) AS idf FROM bidf",
    "bm25_subset_scores": _TFIDF + _BM25 + " SELECT b.* FROM b SEMI JOIN rel USING (scope, qid, pid)",
    "bm25_hit_rank": _TFIDF + _BM25 + """,
h AS (SELECT scope, qid, min(rank) - 1 AS hit FROM br SEMI JOIN rel USING (scope, qid, pid) WHERE rank <= 10 GROUP BY ALL)
SELECT scope, qid, CAST(coalesce(hit, -1) AS INTEGER) AS hit FROM asked LEFT JOIN h USING (scope, qid)""",
    "eval_recall_mrr": _TFIDF + f""",
nr AS (SELECT scope, qid, count(*) AS n_relevant FROM rel GROUP BY ALL),
h AS (SELECT scope, qid, min(rank) AS f, {_HITS} FROM r SEMI JOIN rel USING (scope, qid, pid) WHERE rank <= 1000 GROUP BY ALL),
j AS (SELECT nr.scope, nr.qid, n_relevant, f, {", ".join(f"coalesce(hits_{k}, 0) AS hits_{k}" for k in M.RECALL_AT)} FROM nr LEFT JOIN h USING (scope, qid))
SELECT scope, count(*) AS n_queries, {_RECALL}, {_MRR} FROM j GROUP BY scope""",
    "eval_topn_accuracy": _TFIDF + f" SELECT scope, count(*) AS n_found, {', '.join(f'round(avg((rank <= {n})::INT), 6) AS top_{n}' for n in (1, 3, 5, 10, 25, 100))}, {', '.join(f'round(avg(CASE WHEN rank <= {k} THEN 1.0 / rank ELSE 0 END::DOUBLE), 6) AS mrr_{k}' for k in (10, 100))} FROM r SEMI JOIN rel USING (scope, qid, pid) WHERE rank <= {K} GROUP BY scope",
    "rank_of_positive": _TFIDF + _RANKS + " SELECT scope, qid_pos, qid_neg, pid, positive, negative FROM rk",
    "rank_describe": _TFIDF + _RANKS + " SELECT scope, count(positive) AS n, round(avg(positive), 6) AS mean, round(stddev_samp(positive), 6) AS std, min(positive) AS least, quantile_cont(positive, 0.25)::DOUBLE AS q25, quantile_cont(positive, 0.5)::DOUBLE AS q50, quantile_cont(positive, 0.75)::DOUBLE AS q75, max(positive) AS most FROM rk GROUP BY scope",
    "eval_rank_stats": _TFIDF + _RANKS + """,
a AS (SELECT scope, max(size) AS p, avg(positive) AS mp, avg(negative) AS mn, count(*) FILTER (positive <= size // 2) AS tp, count(*) FILTER (negative >= size // 2) AS tn FROM rk GROUP BY scope),
e AS (SELECT *, p - tp AS fp, p - tn AS fn, tp / p::DOUBLE AS pr, CASE WHEN tp + p - tn <> 0 THEN tp / (tp + p - tn)::DOUBLE END AS re FROM a)
SELECT scope, tp, fp, tn, fn, round(mp, 6) AS mean_rank_positive, round(mn, 6) AS mean_rank_negative, round(1 / (mp + 1), 6) AS reciprocal_mean_rank_positive, round(1 - 1 / (mn + 1), 6) AS reciprocal_mean_rank_negative,
  round((mp - p) / -p, 6) AS lps_positive, round(mn / p, 6) AS lps_negative, round(((mp - p) / -p + mn / p) / 2, 6) AS lps, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re <> 0 THEN 2 * pr * re / (pr + re) END, 6) AS f1 FROM e""",
    "eval_in_best": _TFIDF + _RANKS + f" SELECT scope, count(*) AS n, {', '.join(f'round(avg((positive < {k})::INT), 6) AS in_best_{k}' for k in (1, 10, 100))}, round(avg(1.0 / (positive + 1)::DOUBLE), 6) AS mrr_positive, round(avg(1.0 / (negative + 1)::DOUBLE), 6) AS mrr_negative FROM rk GROUP BY scope",
    "eval_f_beta": _TFIDF + _RANKS + """,
a AS (SELECT scope, max(size) AS p, count(*) FILTER (positive <= size // 2) AS tp, count(*) FILTER (negative >= size // 2) AS tn FROM rk GROUP BY scope),
e AS (SELECT scope, tp / p::DOUBLE AS pr, CASE WHEN tp + p - tn <> 0 THEN tp / (tp + p - tn)::DOUBLE END AS re FROM a)
SELECT scope, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN 4 * pr + re <> 0 THEN 5 * pr * re / (4 * pr + re) END, 6) AS f_beta FROM e""",
    "rank_among_own": _tfidf(f"""{NEGATIVES},
l AS MATERIALIZED (SELECT qid, t.pid AS pid_pos, neg.pid AS pid_neg FROM neg JOIN (SELECT DISTINCT qid_pos, pid FROM triples) t ON qid_pos = qid),
grp AS MATERIALIZED (SELECT qid, concat(qid, '/', pid_pos) AS scope, pid_neg AS pid FROM l UNION SELECT qid, concat(qid, '/', pid_pos), pid_pos FROM l),
corpus AS MATERIALIZED (SELECT scope, grp.pid, min(passage) AS text FROM grp JOIN passages USING (pid) WHERE passage IS NOT NULL GROUP BY ALL),
asked AS MATERIALIZED (SELECT scope, grp.qid, min(query) AS text FROM (SELECT DISTINCT scope, qid FROM grp) grp JOIN queries USING (qid) WHERE query IS NOT NULL GROUP BY ALL)""", 1) + """,
pq AS (SELECT DISTINCT scope, qid, CAST(split_part(scope, '/', 2) AS BIGINT) AS pid FROM asked SEMI JOIN corpus c ON c.scope = asked.scope AND c.pid = CAST(split_part(asked.scope, '/', 2) AS BIGINT))""" + _PLACES + " SELECT scope, qid, pid, place AS rank FROM pl",
    "rank_matrix_docs": _TFIDF + " SELECT scope, qid, pid, CAST(rank - 1 AS INTEGER) AS rank FROM r SEMI JOIN rel USING (scope, qid, pid)",
    "rank_matrix_queries": _TFIDF + ", m AS (SELECT *, row_number() OVER (PARTITION BY scope, pid ORDER BY score DESC, qid) - 1 AS rank FROM s) SELECT scope, qid, pid, CAST(rank AS INTEGER) AS rank FROM m SEMI JOIN rel USING (scope, qid, pid)",
    "semi_join_triples": _TFIDF + " SELECT scope, qid, pid, rank FROM r SEMI JOIN rel USING (scope, qid, pid) WHERE rank <= 10",
    "lexical_vs_bm25_diff": _TFIDF + _DIFF + " SELECT *, rank_a - rank_b AS diff FROM d",
    "quadrant_keys": _TFIDF + _DIFF + " SELECT scope, qid, pid, rank_a < 10 AS a_good, rank_b < 10 AS b_good FROM d",
    "quadrants": _TFIDF + _DIFF + " SELECT rank_a < 10 AS a_good, rank_b < 10 AS b_good, count(*) AS n FROM d GROUP BY ALL",
    "best_worst_report": _TFIDF + _DIFF + """ SELECT * FROM (SELECT scope, qid, pid, rank_a - rank_b AS diff, 'a' AS side FROM d ORDER BY diff, scope, qid, pid LIMIT 20)
UNION ALL SELECT * FROM (SELECT scope, qid, pid, rank_a - rank_b AS diff, 'b' AS side FROM d ORDER BY diff DESC, scope, qid, pid LIMIT 20)""",
    "ce_loss": _TFIDF + """,
pq AS (SELECT * FROM rel SEMI JOIN asked USING (scope, qid) SEMI JOIN corpus USING (scope, pid))""" + _PLACES + """
SELECT ps.scope, ps.qid, ps.pid, round(ln(sum(exp(score))) - any_value(ps.mine), 6) AS cross_entropy, round(avg(pow(score - (other = ps.pid)::INT, 2)), 6) AS mse,
  (any_value(ps.mine) >= max(score))::INT AS "right", round(1.0 / (1 + any_value(place))::DOUBLE, 6) AS reciprocal_rank
FROM ps JOIN f ON f.scope = ps.scope AND f.qid = ps.qid JOIN pl ON pl.scope = ps.scope AND pl.qid = ps.qid AND pl.pid = ps.pid GROUP BY ps.scope, ps.qid, ps.pid""",
    "validation": _TFIDF + _LOSS + ' SELECT scope, count(*) AS n, round(avg(cross_entropy), 5) AS cross_entropy, round(avg(mse), 5) AS mse, round(avg("right"), 5) AS accuracy, round(avg(reciprocal_rank), 5) AS mrr FROM loss GROUP BY scope',
}
