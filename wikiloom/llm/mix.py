"""Mixing sources to target weights, with soft membership.

1. A naive Bayes classifier over words predicts domain posteriors. Domains are the listed sources and one more, OTHER, of which documents of
   unlisted sources are the examples. It is fitted on a bounded sample (SAMPLE labelled documents a domain, chosen by hash), and its
   log-likelihoods are divided by the temperature that predicts the labels of held-out halves of the sample best, so that posteriors are
   as soft as the classifier is unsure.
2. A document's declared source is evidence too: its prior puts 1 - DOUBT on the declared domain. A document without a source
   has an even prior. One pass makes a compact table: document, source, tokens, posteriors.
3. Goals: of the expected tokens (document tokens times posterior, summed), domain s shall have target_share[s] of all, OTHER none. The
   total is the largest at which all domains reach their goals but the scarcest, as long as those stand for at most `shortfall` of the
   targets (a source without documents can never reach its goal); scarce ones are used as often as they may.
4. Nonnegative document rates minimise the squared distance of the expected domain totals from the goals, by projected gradient from one
   use of each document. A step is one pass that adds up one number a domain; rates are not stored but replayed from the steps so far. The
   step size halves whenever a step does not bring the totals nearer; it ends when they are within CLOSE of the goals, or after
   STEPS steps. Rates stay within 0 and max_repeats.
5. The totals of every step are those of whole copies: the whole part of the rate, and one more where the document's hash lies below the
   fraction. So the steps also even out what rounding does, and nothing is rescaled afterwards.

No document is used more often than its source's max_repeats; one of no listed source not more often than that of its likeliest domain, and
not at all if that is OTHER.

Defined results: null, empty texts have no tokens and no copies; a null source is listed nowhere; repeated rows of the targets
count once; without targets or documents there are no copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wikiloom.durable import durable
from wikiloom.llm.encode import FOLDER, encoder, shipped
from wikiloom.llm.tokens import Tokens, slices

SAMPLE, DOUBT, SHORTFALL, STEPS, CLOSE = 400, 0.02, 0.05, 30, 0.0005
WORD_BITS = 15
#: A document's posteriors are one number a domain.
MOST_SOURCES = 1000
#: Temperatures that are tried.
HEAT = tuple(2.0**i for i in range(9))
OTHER = "other"


def _slots(t: Tokens) -> np.ndarray:
    return (t.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _lower(texts) -> Tokens:
    return Tokens(pa.array([x and x.lower() for x in texts], pa.string()))


def _likelihoods(t: Tokens, log_p: np.ndarray) -> np.ndarray:
    """[text, domain]"""
    slots = _slots(t)
    return np.stack([np.bincount(t.doc, weights=p[slots], minlength=t.n) for p in log_p], axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(np.maximum(z - z.max(axis=1, keepdims=True), -60))
    return e / e.sum(axis=1, keepdims=True)


def _domain(sources: list[str]):
    """The index of a row's domain; null where it has no source."""
    known = F.create_map(*[F.lit(x) for i, s in enumerate(sources) for x in (s, i)])[F.col("source")] if sources else F.lit(None).cast("int")
    return F.when(F.col("source").isNotNull(), F.coalesce(known, F.lit(len(sources)))).cast("int").alias("s")


def fit_sources(docs: DataFrame, sources: list[str], sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(log-probabilities [domain, word slot], temperature) from at most `sample` documents a domain; counted on the executors."""
    k = len(sources) + 1
    rows = docs.where("source is not null and text <> ''").select("doc_id", _domain(sources))
    h = F.xxhash64("doc_id")
    ids = rows.withColumn("_r", F.row_number().over(Window.partitionBy("s").orderBy(h, "doc_id"))).where(F.col("_r") <= sample).select("doc_id", "s", (F.col("_r") % 2).alias("half"))
    texts = durable(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("s", "half", "text"))

    def count(batches):
        n = np.zeros((2 * k, 1 << WORD_BITS), np.int32)
        for b in slices(batches, 512):
            t = _lower(b.column(2).to_pylist())
            row = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            np.add.at(n, (row[t.doc], _slots(t)), 1)
        seen = np.flatnonzero(n.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array([pa.compress(n[i].tobytes(), "zstd", asbytes=True) for i in seen], pa.binary())], names=["i", "counts"])

    n = np.zeros((k, 2, 1 << WORD_BITS))
    for r in texts.mapInArrow(count, "i int, counts binary").collect():
        n[r.i // 2, r.i % 2] += np.frombuffer(pa.decompress(bytes(r.counts), 4 << WORD_BITS, "zstd", asbytes=True), np.int32)

    def log_p(c: np.ndarray) -> np.ndarray:
        return np.log((c + 0.1) / (c + 0.1).sum(axis=1, keepdims=True)).astype(np.float32)

    # Each half is judged by the counts of the other.
    halves = docs.sparkSession.sparkContext.broadcast([log_p(n[:, 1 - half]) for half in range(2)])

    def judge(batches):
        total = np.zeros(len(HEAT))
        for b in slices(batches, 512):
            t, s, half = _lower(b.column(2).to_pylist()), b.column(0).to_numpy(), b.column(1).to_numpy()
            for i in range(2):
                z, at = _likelihoods(t, halves.value[i]), np.flatnonzero(half == i)
                total += [np.log(softmax(z[at] / heat)[np.arange(len(at)), s[at]]).sum() for heat in HEAT]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(HEAT)), pa.int32()), pa.array(total)], names=["i", "fit"])

    fits = {r.i: r.fit for r in texts.mapInArrow(judge, "i int, fit double").groupBy("i").agg(F.sum("fit").alias("fit")).collect()}
    return log_p(n.sum(axis=1)), HEAT[max(fits, key=fits.get)] if fits else 1.0


def members(docs: DataFrame, sources: list[str], log_p: np.ndarray, heat: float, vocabulary: str, folder: str) -> DataFrame:
    """doc_id, source, s (index of the domain, -1 without a source), n (tokens), p (posteriors) of the documents with text."""
    path, words = shipped(docs.sparkSession, vocabulary, folder)
    k = len(sources) + 1
    model = docs.sparkSession.sparkContext.broadcast(log_p)
    prior = np.full((k + 1, k), DOUBT / max(k - 1, 1))
    prior[np.arange(k), np.arange(k)] = 1 - DOUBT
    prior[-1] = 1 / k

    def run(batches):
        enc = encoder(path, words)
        for b in slices(batches, 512):
            texts, s = b.column(3).to_pylist(), b.column(2).to_numpy()
            n = np.array([sum(map(len, w)) for w in enc.encode(texts)], np.int64)
            p = softmax(_likelihoods(_lower(texts), model.value) / heat + np.log(prior[s])).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n), pa.array(list(p), pa.list_(pa.float32()))], names=["doc_id", "source", "s", "n", "p"])

    rows = docs.where("text <> ''").select("doc_id", "source", F.coalesce(_domain(sources), F.lit(-1)).alias("s"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, s int, n long, p array<float>")


def goals(share: np.ndarray, cap: np.ndarray, shortfall: float = SHORTFALL) -> np.ndarray:
    """Tokens wanted of each source; cap: the tokens it has times its repeats."""
    reach = cap / np.maximum(share, 1e-12)
    left, scale = shortfall, 0.0
    for i in np.argsort(reach, kind="stable"):
        if share[i] <= 0:
            continue
        if share[i] <= left + 1e-9:
            left -= share[i]
        else:
            scale = reach[i]
            break
    else:
        scale = reach.max(initial=0.0)
    return np.minimum(share * scale, cap)


def limits(s: np.ndarray, p: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How often each document may be used; most: by domain, 0 for OTHER."""
    return most[np.where((s >= 0) & (s < len(most) - 1), s, p.argmax(axis=1))]


def rates(p: np.ndarray, limit: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Document rates after the given steps, each one number a domain."""
    r = np.minimum(1.0, limit)
    for step in steps:
        r = np.clip(r - p @ step, 0.0, limit)
    return r


def copies(r: np.ndarray, u: np.ndarray, limit: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(r + u), limit)


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, steps: int = STEPS, shortfall: float = SHORTFALL) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, copies of the documents used; shares: source, target_share, max_repeats, n_docs, n_tokens, most_copies and
    reached_share by declared source, expected_tokens and expected_share by posterior).

    docs: doc_id, source, text; targets: source, target_share, max_repeats (one row a source, few).
    """
    spark = docs.sparkSession
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("m")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"the targets name over {MOST_SOURCES} sources")
    sources = [r.source for r in wanted]
    k = len(sources) + 1
    share = np.array([r.t or 0.0 for r in wanted] + [0.0])
    most = np.array([float(r.m or 0) for r in wanted] + [0.0])
    docs = docs.select("doc_id", "source", "text")
    table = durable(members(docs, sources, *fit_sources(docs, sources), vocabulary, folder).withColumn("u", (F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))))

    def arrays(b):
        s, n, u = (b.column(x).to_numpy() for x in ("s", "n", "u"))
        p = b.column("p").flatten().to_numpy().reshape(-1, k).astype(np.float64)
        return n, u, p, limits(s, p, most)

    def totals(taken: list[np.ndarray]) -> np.ndarray:
        """Of every domain the expected tokens: of one use of each document, of as many as it may have, of its copies after the steps."""

        def run(batches):
            sums = np.zeros((3, k))
            for b in batches:
                n, u, p, limit = arrays(b)
                sums += [n @ p, (n * limit) @ p, (n * copies(rates(p, limit, taken), u, limit)) @ p]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(3 * k), pa.int32()), pa.array(sums.ravel())], names=["i", "x"])

        out = np.zeros(3 * k)
        for r in table.select("s", "n", "u", "p").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r.i] = r.x
        return out.reshape(3, k)

    have, cap, got = totals([])
    goal = goals(share, cap, shortfall)
    taken: list[np.ndarray] = []
    size = 1.0
    off = lambda x: np.abs(x - goal).max() / max(goal.sum(), 1.0)
    gap = lambda x: (((x - goal) / max(goal.sum(), 1.0)) ** 2).sum()
    for _ in range(steps if goal.sum() else 0):
        if off(got) <= CLOSE:
            break
        tried = [*taken, size * (got - goal) / np.maximum(have, 1.0)]
        new = totals(tried)[2]
        if gap(new) < gap(got):
            taken, got = tried, new
        else:
            size /= 2

    def used(batches):
        for b in batches:
            n, u, p, limit = arrays(b)
            c = copies(rates(p, limit, taken), u, limit).astype(np.int32) if goal.sum() else np.zeros(len(n), np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("n"), pa.array(c)], names=["doc_id", "source", "n_tokens", "copies"])

    rows = table.mapInArrow(used, "doc_id long, source string, n_tokens long, copies int").where("copies > 0 and n_tokens > 0")
    sums = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    if not goal.sum():
        got = np.zeros(k)
    listed = spark.createDataFrame([(s, float(t), int(m), int(round(e)), round(float(e / max(got.sum(), 1.0)), 6)) for s, t, m, e in zip(sources, share, most, got)], "source string, target_share double, max_repeats int, expected_tokens long, expected_share double")
    # The total is that of all documents used, those of unlisted sources included.
    total = sums.agg(F.sum("n_tokens").alias("total"))
    shares = listed.join(sums, "source", "left").crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_docs", "n_tokens", "most_copies")), "total", "expected_tokens", "expected_share")
    return rows, shares.withColumn("reached_share", F.when(F.col("total") > 0, F.round(F.col("n_tokens") / F.col("total"), 6)).otherwise(0.0)).drop("total")
