"""TF-IDF and BM25 in long format: (scope, pid, term, weight).

Corpora are scoped: a wiki is searched with its own statistics. Statistics are hash aggregations and equi joins on
(scope, term), with partial aggregation before each shuffle.

scores() joins questions and documents on their terms, for when all pairs are wanted; given a subset of pairs, it starts from
those. topk() and ranks() do neither: the frequent terms of a question meet nearly every document. They go by pruned.py: topk() keeps the best k
(or worst) of each question in each chunk of documents, ranks() only counts the documents before each stated pair. Only those rows are
written and shuffled. The documents of stated pairs are scored where they lie, too: their terms are neither written nor shuffled. A block's broadcast is freed once its result is written, so the driver holds one block at a time.

Documents that share no term with a question have the score 0. The order of all documents of a scope is by score, then by pid.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wikiloom.durable import BROADCAST_BYTES, durable, small
from wikiloom.functions import text as X
from wikiloom.llm.tokens import in_rows, slices
from wikiloom.operators import pruned as P
from wikiloom.operators.dataset import in_order


#: About what one term of a vocabulary takes when it is broadcast; a vocabulary of over 16 MB is joined by a shuffle.
TERM_BYTES = 64


def counted(df: DataFrame, id_: str, text: str, analyzer=X.terms) -> DataFrame:
    """scope, id, term, tf."""
    return df.select("scope", id_, F.explode(analyzer(text)).alias("term")).groupBy("scope", id_, "term").agg(F.count("*").alias("tf"))


def vocabulary(docs: DataFrame, min_df: int = 5) -> DataFrame:
    """scope, term, df, idf (smoothed) of the terms in at least min_df documents of their scope; docs: scope, pid, terms."""
    n = docs.groupBy("scope").agg(F.count("*").alias("n"))
    df = docs.select("scope", F.explode(F.array_distinct("terms")).alias("term")).groupBy("scope", "term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.join(n, "scope").select("scope", "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def raw_weights(tf: DataFrame, vocab: DataFrame, id_: str) -> DataFrame:
    """scope, id, term, w: tf * idf."""
    return tf.join(small(vocab.select("scope", "term", "idf"), TERM_BYTES), ["scope", "term"]).select("scope", id_, "term", (F.col("tf") * F.col("idf")).alias("w"))


def weighted(tf: DataFrame, vocab: DataFrame, id_: str) -> DataFrame:
    """scope, id, term, w: tf * idf, each document normalised to length one."""
    raw = raw_weights(tf, vocab, id_)
    norm = raw.groupBy("scope", id_).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, ["scope", id_]).select("scope", id_, "term", (F.col("w") / F.col("norm")).alias("w"))


#: Questions sent at once; terms of a vocabulary that are sent to weigh documents where they lie, else they are joined.
BLOCK, SENT = 1 << 18, 1 << 22


def rows(weights: DataFrame, id_: str, w: str = "w", unit: bool = False) -> DataFrame:
    """scope, id, h (term hashes), w (weights): one row a document or question; unit: at length one."""
    pair = F.collect_list(F.struct(F.xxhash64("term").alias("h"), F.col(w).alias("w")))
    packed = weights.groupBy("scope", id_).agg(pair.alias("t"), F.sqrt(F.sum(F.col(w) * F.col(w))).alias("norm"))
    return packed.select("scope", id_, F.col("t.h").alias("h"), F.transform("t.w", lambda x: x / F.col("norm")).alias("w") if unit else F.col("t.w").alias("w"))


def best_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest entries of each row, the first columns on ties; entries of minus infinity do not count.

    Only entries that reach a row's k-th largest are sorted.
    """
    if k >= s.shape[1]:
        return np.nonzero(s > -np.inf)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    order = np.lexsort((c, -s[r, c], r))
    r, c = r[order], c[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    keep = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r)))) < k
    return r[keep], c[keep]


def block_topk(docs: DataFrame, weigh: Callable, queries: DataFrame, k: int, worst: bool = False) -> DataFrame:
    """scope, qid, pid, score, rank: the best k documents that share a term with each question; docs and weigh as pruned.py takes them, queries as rows().

    worst: the last k of all documents instead, those without a shared term included; rank 1 is the last one.
    """
    out = P.run_blocks(docs, weigh, queries, BLOCK, False, P.listed(k, worst), "scope string, qid long, pid long, score double", durable, short=k if k <= P.SHORT and not worst else 0)
    if not worst:
        return top(out, k)
    last = Window.partitionBy("scope", "qid").orderBy("score", F.desc("pid"))
    return out.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def block_ranks(docs: DataFrame, weigh: Callable, queries: DataFrame, scored: DataFrame, work: Callable = P.counted_ahead) -> DataFrame:
    """scope, qid, pid, score, ahead, before of the pairs scored (scope, qid, pid, score; 0 without a shared term): how many documents that share a term
    with the question come before the pair's by score, then pid, and how many of those that share one have a smaller pid."""
    # A question has a few stated pairs, a bounded list.
    stated = scored.groupBy("scope", "qid").agg(F.collect_list(F.struct("score", "pid")).alias("t")).select("scope", "qid", F.col("t.score").alias("score"), F.col("t.pid").alias("pid"))
    asked = queries.join(stated, ["scope", "qid"])
    parts = P.run_blocks(docs, weigh, asked, BLOCK, True, work, "scope string, qid long, pid long, ahead long, before long", durable)
    sums = parts.groupBy("scope", "qid", "pid").agg(F.sum("ahead").alias("ahead"), F.sum("before").alias("before"))
    return scored.join(sums, ["scope", "qid", "pid"], "left").na.fill(0, ["ahead", "before"])


def block_scores(docs: DataFrame, weigh: Callable, queries: DataFrame, pairs: DataFrame, whole: bool = False) -> DataFrame:
    """scope, qid, pid, score of those of the pairs (scope, qid, pid) that share a term; whole: docs are those of the pairs already."""
    stated = pairs.groupBy("scope", "qid").agg(F.collect_set("pid").alias("pid"))
    asked = queries.join(stated, ["scope", "qid"]).select("scope", "qid", "h", "w", F.transform("pid", lambda _: F.lit(0.0)).alias("score"), "pid")
    return P.run_blocks(docs if whole else of_pairs(docs, pairs), weigh, asked, BLOCK, True, P.scored_pairs, "scope string, qid long, pid long, score double", durable)


def of_pairs(docs: DataFrame, pairs: DataFrame, all_else: bool = True) -> DataFrame:
    """The documents of the pairs; all of them, unless all_else is False, where the pairs are too many to be sent to them."""
    own = durable(pairs.select("scope", "pid").distinct())
    return docs.join(F.broadcast(own), ["scope", "pid"], "left_semi") if own.count() * TERM_BYTES <= BROADCAST_BYTES else docs if all_else else docs.join(own, ["scope", "pid"], "left_semi")


def _counts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of a batch of scope, pid and term hashes."""
    doc = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
    h = b.column(2).flatten().to_numpy()
    order = in_rows(doc, h.view(np.uint64))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def hashed(docs: DataFrame, terms: Column, placed: bool = False) -> DataFrame:
    """scope, pid and the hashes of a document's terms, spread for pruned.py unless they are placed so."""
    return (docs if placed else P.spread(docs)).select("scope", "pid", F.coalesce(F.transform(terms, lambda t: F.xxhash64(t)), F.array().cast("array<bigint>")).alias("h"))


def zero_filled(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """found (scope, qid, pid, score, rank) filled up to k documents a question with the smallest pids that share no term, at score 0.

    A question with fewer than k documents leaves under k of them out of the 2 k smallest pids of its scope, so those are enough.
    """
    found = durable(found)
    least = docs.select("scope", "pid").withColumn("_r", F.row_number().over(Window.partitionBy("scope").orderBy("pid"))).where(F.col("_r") <= 2 * k).drop("_r")
    few = queries.select("scope", "qid").distinct().join(found.groupBy("scope", "qid").agg(F.count("*").alias("_n")), ["scope", "qid"], "left").where(F.coalesce("_n", F.lit(0)) < k).select("scope", "qid")
    rest = few.join(least, "scope").join(found, ["scope", "qid", "pid"], "left_anti").withColumn("score", F.lit(0.0))
    return top(found.drop("rank").unionByName(rest.select("scope", "qid", "pid", "score")), k)


def paired(q: DataFrame, d: DataFrame, subset: DataFrame | None) -> DataFrame:
    """scope, qid, pid, score: the sums of products of q (scope, qid, term, wq) and d (scope, pid, term, w) over shared terms; subset
    (scope, qid, pid): of these pairs only, which questions and documents are cut down to before they meet."""
    if subset is None:
        rows_ = q.join(d, ["scope", "term"])
    else:
        pairs = durable(subset.select("scope", "qid", "pid").distinct())
        wanted = pairs.join(q, ["scope", "qid"])
        rows_ = wanted.join(d.join(pairs.select("scope", "pid").distinct(), ["scope", "pid"], "left_semi"), ["scope", "pid", "term"])
    return rows_.groupBy("scope", "qid", "pid").agg(F.round(F.sum(F.col("w") * F.col("wq")), 6).alias("score"))


def places(pairs: DataFrame, scores: DataFrame, docs: DataFrame) -> DataFrame:
    """scope, qid, pid, rank (from 0) of the pairs among all documents of their scope, by score, then by pid.

    scores: of all documents that share a term with the questions of the pairs; others have the score 0. Documents before the pair's are
    counted: no list is sorted.
    """
    pairs = durable(pairs.select("scope", "qid", "pid").distinct().join(scores, ["scope", "qid", "pid"], "left").na.fill(0.0, ["score"]))
    other = scores.where("score > 0").select("scope", "qid", F.col("pid").alias("_p"), F.col("score").alias("_s"))
    ahead = F.count_if((F.col("_s") > F.col("score")) | ((F.col("_s") == F.col("score")) & (F.col("_p") < F.col("pid"))))
    counted_ = pairs.join(other, ["scope", "qid"], "left").groupBy("scope", "qid", "pid", "score").agg(ahead.alias("_ahead"), F.count_if(F.col("_p") < F.col("pid")).alias("_scored_before"))
    # A document without a score stands behind all that have one and behind those without one and with a smaller pid.
    at = in_order(docs.select("scope", "pid").distinct(), "scope", "pid", "_place")
    rank = F.col("_ahead") + F.when(F.col("score") > 0, 0).otherwise(F.col("_place") - F.col("_scored_before"))
    return counted_.join(at, ["scope", "pid"]).select("scope", "qid", "pid", rank.cast("long").alias("rank"))


class Index:
    """What TF-IDF and BM25 do alike: top lists and ranks; docs: scope, pid, text, each pair of scope and pid once; placed: they are stored in the
    order of scope and pid, so they are searched where they lie."""

    docs: DataFrame
    placed: bool

    @cached_property
    def _at(self) -> tuple[DataFrame, Callable]:
        return self._placed()

    def topk(self, queries: DataFrame, k: int, zero_fill: bool = False) -> DataFrame:
        """scope, qid, pid, score, rank of the best k documents that share a term; zero_fill: k documents in any case, if the scope has them."""
        found = block_topk(*self._at, self._questions(queries), k)
        return zero_filled(found, queries, self.docs, k) if zero_fill else found

    def ranks(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """scope, qid, pid, score, rank (from 1) of those of the pairs that share a term, among all documents that share a term with the question."""
        asked = self._stated(queries, pairs)
        ranked_ = block_ranks(*self._at, asked, block_scores(*self._at, asked, pairs))
        return ranked_.select("scope", "qid", "pid", "score", (F.col("ahead") + 1).cast("int").alias("rank"))

    def places(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """scope, qid, pid, rank (from 0) of the pairs among all documents of their scope, those without a shared term counted as 0."""
        asked = self._stated(queries, pairs)
        scored = durable(pairs.select("scope", "qid", "pid").distinct().join(block_scores(*self._at, asked, pairs), ["scope", "qid", "pid"], "left").na.fill(0.0, ["score"]))
        # Questions without a known term have no row, and none ahead of theirs.
        ranked_ = block_ranks(*self._at, asked, scored)
        at = in_order(self.docs.select("scope", "pid"), "scope", "pid", "_place")
        # A document without a score stands behind all that have one and behind those without one and with a smaller pid.
        rank = F.col("ahead") + F.when(F.col("score") > 0, 0).otherwise(F.col("_place") - F.col("before"))
        return ranked_.join(at, ["scope", "pid"]).select("scope", "qid", "pid", rank.cast("long").alias("rank"))

    def against_all(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """scope, qid, pid, score, place (from 0), size, exps, squares, most of the pairs whose question and document are known: among all `size` documents of
        the scope, those without a shared term at 0, the sums of exp(score) and of score * score over these, and their greatest score."""
        pairs = pairs.select("scope", "qid", "pid").distinct().join(queries.select("scope", "qid"), ["scope", "qid"], "left_semi")
        pairs = durable(pairs.join(self.docs.select("scope", "pid"), ["scope", "pid"], "left_semi").select("scope", "qid", "pid"))
        asked = self._stated(queries, pairs)
        scored = durable(pairs.join(block_scores(*self._at, asked, pairs), ["scope", "qid", "pid"], "left").na.fill(0.0, ["score"]))
        # A question has a few stated pairs, a bounded list.
        stated = scored.groupBy("scope", "qid").agg(F.collect_list(F.struct("score", "pid")).alias("t")).select("scope", "qid", F.col("t.score").alias("score"), F.col("t.pid").alias("pid"))
        schema = "scope string, qid long, pid long, ahead long, exps double, squares double, most double"
        parts = P.run_blocks(*self._at, asked.join(stated, ["scope", "qid"]), BLOCK, True, P.summed_in_tiles, schema, durable)
        sums = parts.groupBy("scope", "qid", "pid").agg(*(F.sum(c).alias(c) for c in ("ahead", "exps", "squares")), F.max("most").alias("most"))
        size = self.docs.groupBy("scope").agg(F.count("*").alias("size"))
        # Questions without a known term have no sums: all documents are at 0, in the order of pid.
        at = in_order(self.docs.select("scope", "pid"), "scope", "pid", "_place")
        out = scored.join(sums, ["scope", "qid", "pid"], "left").join(at, ["scope", "pid"]).join(size, "scope")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        return out.select("scope", "qid", "pid", "score", F.coalesce("ahead", "_place").alias("place"), "size", (F.col("size") + zero("exps")).alias("exps"), zero("squares").alias("squares"), zero("most").alias("most"))

    def _stated(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs' questions, as rows()."""
        return durable(self._questions(queries.join(pairs.select("scope", "qid").distinct(), ["scope", "qid"], "left_semi")))


class TfIdf(Index):
    """A fitted index over docs (scope, pid, text)."""

    def __init__(self, docs: DataFrame, min_df: int = 5, placed: bool = False):
        self.docs, self.placed = docs, placed
        # Cutting texts into terms costs more than all else but the search, so it is done once.
        self.cut = durable(docs.select("scope", "pid", X.terms("text").alias("terms")))
        self.vocab = durable(vocabulary(self.cut, min_df))

    @cached_property
    def vectors(self) -> DataFrame:
        return weighted(durable(counted(self.docs, "pid", "text")), self.vocab, "pid")

    def scores(self, queries: DataFrame, subset: DataFrame | None = None) -> DataFrame:
        """scope, qid, pid, score of all pairs that share a term; queries: scope, qid, text; subset (scope, qid, pid): score these pairs only."""
        q = weighted(counted(queries, "qid", "text"), self.vocab, "qid").withColumnRenamed("w", "wq")
        return paired(q, self.vectors if subset is None else self._of(subset), subset)

    def _of(self, pairs: DataFrame) -> DataFrame:
        """The vectors of the pairs' documents."""
        some = durable(self.docs.join(pairs.select("scope", "pid").distinct(), ["scope", "pid"], "left_semi"))
        return weighted(durable(counted(some, "pid", "text")), self.vocab, "pid")

    def _placed(self) -> tuple[DataFrame, Callable]:
        """Documents and how their terms are weighed, for pruned.py."""
        if self.vocab.count() > SENT:
            unit = rows(raw_weights(counted(self.docs, "pid", "text"), self.vocab, "pid"), "pid", unit=True)
            full = self.docs.select("scope", "pid").join(unit, ["scope", "pid"], "left").select("scope", "pid", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("h", "array<bigint>"), ("w", "array<double>"))))
            return P.spread(durable(full)), P.as_rows
        idf: dict[str, list] = {}
        for b in self.vocab.select("scope", F.xxhash64("term").alias("h"), "idf").toArrow().to_batches():
            names, h, x = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(), b.column(2).to_numpy()
            for scope in dict.fromkeys(names):
                idf.setdefault(scope, []).append((h[names == scope], x[names == scope]))
        tables = {}
        for scope, parts in idf.items():
            h, x = (np.concatenate([p[i] for p in parts]) for i in range(2))
            order = np.argsort(h)
            tables[scope] = h[order], x[order]
        shared = self.docs.sparkSession.sparkContext.broadcast(tables)

        def weigh(b):
            doc, h, w = _counts(b)
            w = w.astype(np.float64)
            names = np.array(b.column(0).to_pylist(), object)[doc] if len(doc) else np.zeros(0, object)
            for scope in dict.fromkeys(b.column(0).to_pylist()):
                mine = names == scope
                known, x = shared.value.get(scope, (np.zeros(0, np.int64), np.zeros(0)))
                i = np.minimum(np.searchsorted(known, h[mine]), max(len(known) - 1, 0))
                w[mine] *= np.where(known[i] == h[mine], x[i], 0.0) if len(known) else 0.0
            ok = w > 0
            doc, h, w = doc[ok], h[ok], w[ok]
            norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=b.num_rows))
            return doc, h, w / norm[doc]

        return hashed(self.cut, F.col("terms"), self.placed), weigh

    def _questions(self, queries: DataFrame) -> DataFrame:
        return rows(raw_weights(counted(queries, "qid", "text"), self.vocab, "qid"), "qid", unit=True)

    def question_ranks(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """scope, qid, pid, score, rank (from 1) of those of the pairs that share a term, among all questions that share a term with the document."""
        swapped = ("scope", F.col("pid").alias("qid"), F.col("qid").alias("pid"), "score")
        asked = durable(self._questions(queries))
        own, weigh = self._at
        # Written once, by all tasks: the rows are sent from one part after the other.
        docs = durable(P.weighed(of_pairs(own, pairs, all_else=False), weigh))
        scored = block_scores(docs, P.as_rows, asked, pairs, whole=True).select(*swapped)
        ranked_ = block_ranks(P.spread(asked.withColumnRenamed("qid", "pid")), P.as_rows, docs.withColumnRenamed("pid", "qid"), scored, P.counted_in_tiles)
        return ranked_.select(*swapped, (F.col("ahead") + 1).cast("int").alias("rank"))

    def best_and_worst(self, queries: DataFrame, k: int, bottom: int) -> DataFrame:
        """scope, qid, pid, score, rank of the first k and last `bottom` documents, those without a shared term counted as 0."""
        # Documents and questions without a known term have no terms, but count.
        all_q = queries.select("scope", "qid").distinct().join(self._questions(queries), ["scope", "qid"], "left").select("scope", "qid", *(F.coalesce(c, F.array()).cast(t).alias(c) for c, t in (("h", "array<bigint>"), ("w", "array<double>"))))
        n = self.docs.groupBy("scope").agg(F.count("*").alias("n"))
        worst = block_topk(*self._at, all_q, bottom, worst=True).join(n, "scope").select("scope", "qid", "pid", "score", (F.col("n") - F.col("rank") + 1).cast("int").alias("rank"))
        return self.topk(queries, k, zero_fill=True).unionByName(worst).distinct()


def own_places(groups: DataFrame) -> DataFrame:
    """scope, qid, pid, rank (from 0) of a document among those of its group, by TF-IDF fitted on the group alone, score 0 without a shared term;
    groups: scope, qid, pid, text (of the question), pids and texts (of the group's documents). A group is read at once: no term is shuffled."""
    terms = lambda text: F.coalesce(F.transform(X.terms(text), lambda t: F.xxhash64(t)), F.array().cast("array<bigint>"))
    hashed_ = groups.select("scope", "qid", "pid", "pids", terms("text").alias("q"), F.transform("texts", terms).alias("h"))

    def run(batches):
        for b in slices(batches, 512):
            if b.num_rows:
                rank = pa.array(_own_ranks(b.column(2).to_numpy(), b.column(3), b.column(4), b.column(5)))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), rank], names=["scope", "qid", "pid", "rank"])

    return hashed_.mapInArrow(run, "scope string, qid long, pid long, rank long")


def _own_ranks(pid: np.ndarray, pids: pa.Array, q: pa.Array, h: pa.Array) -> np.ndarray:
    """The rank of each group's pid; pids, q (term hashes of the question) and h (of each document) by group."""
    size = lambda x: np.asarray(x.value_lengths(), np.int64)
    n, docs = len(pid), h.flatten()
    group = np.repeat(np.arange(n), size(pids))
    own = pids.flatten().to_numpy()
    doc_of, term = np.repeat(np.arange(len(docs)), size(docs)), docs.flatten().to_numpy()
    asked, word = np.repeat(np.arange(n), size(q)), q.flatten().to_numpy()

    def counts(a, t):
        order = np.lexsort((t, a))
        a, t = a[order], t[order]
        new = np.ones(len(t), bool)
        new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
        at = np.flatnonzero(new)
        return a[at], t[at], np.diff(np.append(at, len(t)))

    doc, t, tf = counts(doc_of, term)
    qg, qt, qf = counts(asked, word)
    # The number of each (group, term), of documents and questions alike.
    a, x = np.concatenate([group[doc], qg]), np.concatenate([t, qt])
    order = np.lexsort((x, a))
    new = np.ones(len(x), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (x[order][1:] != x[order][:-1])
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    m = int(new.sum())
    df = np.bincount(number[: len(t)], minlength=m)
    of = np.zeros(m, np.int64)
    of[number] = a
    idf = np.log((1 + size(pids)[of]) / (1 + df)) + 1
    w = tf * idf[number[: len(t)]]
    norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=len(docs)))
    known = df[number[len(t) :]] > 0
    wq = np.where(known, qf * idf[number[len(t) :]], 0.0)
    norm_q = np.sqrt(np.bincount(qg, weights=wq * wq, minlength=n))
    asked_w = np.zeros(m)
    asked_w[number[len(t) :][known]] = wq[known] / norm_q[qg[known]]
    score = np.round(np.bincount(doc, weights=w / norm[doc] * asked_w[number[: len(t)]], minlength=len(docs)), 6)
    mine = np.zeros(n)
    is_own = own == pid[group]
    mine[group[is_own]] = score[is_own]
    ahead = (score > mine[group]) | ((score == mine[group]) & (own < pid[group]))
    return np.bincount(group[ahead], minlength=n)


def ranked(scores: DataFrame, score: Column | str = "score") -> DataFrame:
    """All pairs with their rank (1: best; ties: smaller pid first)."""
    w = Window.partitionBy("scope", "qid").orderBy(F.desc(score), "pid")
    return scores.withColumn("rank", F.row_number().over(w))


def top(scores: DataFrame, k: int) -> DataFrame:
    return ranked(scores).where(F.col("rank") <= k)


class Bm25(Index):
    """Okapi BM25 over docs (scope, pid, text), tokens between single spaces, case kept."""

    def __init__(self, docs: DataFrame, analyzer=X.spaced, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, placed: bool = False):
        self.docs, self.analyzer, self.k1, self.b, self.placed = docs, analyzer, k1, b, placed
        split = docs.select("scope", analyzer("text").alias("_t"))
        stats = split.groupBy("scope").agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avgdl"))
        df = split.select("scope", F.explode(F.array_distinct("_t")).alias("term")).groupBy("scope", "term").agg(F.count("*").alias("df"))
        raw = df.join(stats, "scope").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.groupBy("scope").agg(F.avg("raw").alias("mean"))
        # Terms in over half of the documents get a share of the mean over all terms.
        self.idf = durable(raw.join(mean, "scope").select("scope", "term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf")))
        self.stats = durable(stats.select("scope", "avgdl"))

    def scores(self, queries: DataFrame, subset: DataFrame | None = None) -> DataFrame:
        """scope, qid, pid, score; subset (scope, qid, pid): score these pairs only."""
        docs = self.docs if subset is None else durable(self.docs.join(subset.select("scope", "pid").distinct(), ["scope", "pid"], "left_semi"))
        return paired(self._queries(queries), self._documents(docs), subset)

    def _queries(self, queries: DataFrame) -> DataFrame:
        q = counted(queries, "qid", "text", self.analyzer).join(small(self.idf.select("scope", "term", "idf"), TERM_BYTES), ["scope", "term"])
        return q.select("scope", "qid", "term", (F.col("tf") * F.col("idf")).alias("wq"))

    def _questions(self, queries: DataFrame) -> DataFrame:
        return rows(self._queries(queries), "qid", "wq")

    def _documents(self, docs: DataFrame) -> DataFrame:
        terms = docs.select("scope", "pid", self.analyzer("text").alias("_t")).select("scope", "pid", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
        tf = durable(terms.groupBy("scope", "pid", "dl", "term").agg(F.count("*").alias("tf"))).join(small(self.stats, 64), "scope")
        part = self.k1 * (1 - self.b + self.b * F.col("dl") / F.col("avgdl"))
        return tf.select("scope", "term", "pid", (F.col("tf") * (self.k1 + 1) / (F.col("tf") + part)).alias("w"))

    def _placed(self) -> tuple[DataFrame, Callable]:
        mean = {r.scope: r.avgdl for r in self.stats.collect()}  # one row a scope
        k1, b_ = self.k1, self.b

        def weigh(b):
            doc, h, tf = _counts(b)
            dl = np.diff(b.column(2).offsets.to_numpy())
            part = k1 * (1 - b_ + b_ * dl / np.array([mean[x] for x in b.column(0).to_pylist()]))
            return doc, h, tf * (k1 + 1) / (tf + part[doc])

        return hashed(self.docs, self.analyzer("text"), self.placed), weigh


def hit_rank(found: DataFrame, relevant: DataFrame, queries: DataFrame) -> DataFrame:
    """scope, qid, hit: the 0-based place of the first relevant document in a ranked list, -1 without one."""
    hit = found.join(relevant.select("scope", "qid", "pid").distinct(), ["scope", "qid", "pid"], "left_semi").groupBy("scope", "qid").agg((F.min("rank") - 1).alias("hit"))
    return queries.select("scope", "qid").distinct().join(hit, ["scope", "qid"], "left").select("scope", "qid", F.coalesce("hit", F.lit(-1)).cast("int").alias("hit"))
