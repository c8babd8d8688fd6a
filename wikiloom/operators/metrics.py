"""Retrieval metrics over ranked lists (scope, qid, pid, rank from 1) and relevance (scope, qid, pid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RECALL_AT = (1, 3, 5, 10, 25, 50, 100, 200, 1000)
MRR_AT = (5, 10, 100)


def per_query(found: DataFrame, relevant: DataFrame) -> DataFrame:
    """qid, n_relevant, first (rank of the first relevant one), hits_k of every query that has a relevant document."""
    rel = relevant.select("scope", "qid", "pid").distinct()
    n = rel.groupBy("scope", "qid").agg(F.count("*").alias("n_relevant"))
    hit = found.select("scope", "qid", "pid", "rank").join(rel, ["scope", "qid", "pid"])
    got = hit.groupBy("scope", "qid").agg(F.min("rank").alias("first"), *(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in RECALL_AT))
    return n.join(got, ["scope", "qid"], "left").na.fill(0, [f"hits_{k}" for k in RECALL_AT])


def recall_mrr(found: DataFrame, relevant: DataFrame) -> DataFrame:
    """Recall@k and MRR@k in percent, one row per scope."""
    rows = per_query(found, relevant)
    recall = [F.round(100 * F.avg(F.col(f"hits_{k}") / F.col("n_relevant")), 3).alias(f"recall_{k}") for k in RECALL_AT]
    mrr = [F.round(100 * F.avg(F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0)), 3).alias(f"mrr_{k}") for k in MRR_AT]
    return rows.groupBy("scope").agg(F.count("*").alias("n_queries"), *recall, *mrr)


def topn_accuracy(found: DataFrame, target: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10, 25, 100), mrr_at: tuple[int, ...] = (10, 100)) -> DataFrame:
    """Share of found targets (scope, qid, pid) within the first n, and mean reciprocal ranks; misses are skipped."""
    hit = found.join(target.select("scope", "qid", "pid").distinct(), ["scope", "qid", "pid"])
    mrr = [F.round(F.avg(F.when(F.col("rank") <= k, 1 / F.col("rank")).otherwise(0.0)), 6).alias(f"mrr_{k}") for k in mrr_at]
    return hit.groupBy("scope").agg(F.count("*").alias("n_found"), *(F.round(F.avg((F.col("rank") <= n).cast("int")), 6).alias(f"top_{n}") for n in at), *mrr)


def in_best(ranks: DataFrame, at: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """Per scope, from ranks (scope, positive, negative; from 0): the share of triples whose passage is within the first k of its positive
    question, and the mean reciprocal ranks of the passage for both questions."""
    shares = [F.round(F.avg((F.col("positive") < k).cast("int")), 6).alias(f"in_best_{k}") for k in at]
    return ranks.groupBy("scope").agg(F.count("*").alias("n"), *shares, *(F.round(F.avg(1 / (F.col(c) + 1)), 6).alias(f"mrr_{c}") for c in ("positive", "negative")))


def describe(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """count, mean, standard deviation, least, quartiles, greatest."""
    q = [F.percentile(column, F.lit(p)).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    c = F.col(column)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).alias("least"), *q, F.max(c).alias("most"))


def rank_scores(ranks: DataFrame, size: Column, beta: float = 1.0) -> DataFrame:
    """Per scope, from ranks (scope, positive, negative; from 0) among `size` documents: mean ranks, their reciprocals, linear
    position scores, confusion at half of the documents, precision, recall and the F score of `beta` (column f1 for 1, else f_beta)."""
    half = F.floor(F.col("size") / 2)
    r = ranks.withColumn("size", size).groupBy("scope").agg(
        F.max("size").alias("p"),
        F.avg("positive").alias("mp"),
        F.avg("negative").alias("mn"),
        F.count_if(F.col("positive") <= half).alias("tp"),
        F.count_if(F.col("negative") >= half).alias("tn"),
    )
    r = r.withColumn("fp", F.col("p") - F.col("tp")).withColumn("fn", F.col("p") - F.col("tn"))
    precision, recall = F.col("tp") / F.col("p"), F.when(F.col("tp") + F.col("fn") != 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    lps_p, lps_n = (F.col("mp") - F.col("p")) / -F.col("p"), F.col("mn") / F.col("p")
    weighed = beta * beta * precision + recall
    f = F.when(weighed != 0, (1 + beta * beta) * precision * recall / weighed)
    values = {
        "mean_rank_positive": F.col("mp"), "mean_rank_negative": F.col("mn"),
        "reciprocal_mean_rank_positive": 1 / (F.col("mp") + 1), "reciprocal_mean_rank_negative": 1 - 1 / (F.col("mn") + 1),
        "lps_positive": lps_p, "lps_negative": lps_n, "lps": (lps_p + lps_n) / 2,
        "precision": precision, "recall": recall, "f1" if beta == 1 else "f_beta": f,
    }
    return r.select("scope", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")), *(F.round(v, 6).alias(k) for k, v in values.items()))


def ranks_of(scores: DataFrame, by: str = "qid", name: str = "rank") -> DataFrame:
    """0-based rank of every pair among the documents of its query (by qid) or the queries of its document (by pid)."""
    other = "pid" if by == "qid" else "qid"
    return scores.withColumn(name, F.row_number().over(Window.partitionBy("scope", by).orderBy(F.desc("score"), other)) - 1)


def cross_entropy(scores: DataFrame) -> DataFrame:
    """scope, qid, cross_entropy (-ln softmax of the positive among the candidates), mse, right, reciprocal_rank of the positive; scores: scope,
    qid, pid, score, positive."""
    good = F.max(F.when(F.col("positive"), F.col("score")))
    best = scores.groupBy("scope", "qid").agg(
        F.round(F.log(F.sum(F.exp("score"))) - good, 6).alias("cross_entropy"),
        F.round(F.avg(F.pow(F.col("score") - F.col("positive").cast("double"), 2)), 6).alias("mse"),
        (good >= F.max("score")).cast("int").alias("right"),
        F.max(F.when(F.col("positive"), F.struct("score", -F.col("pid")))).alias("_good"),
        F.collect_list(F.struct("score", -F.col("pid"))).alias("_all"),  # the candidates of one question, a bounded list
    )
    return best.select("scope", "qid", "cross_entropy", "mse", "right", F.round(1 / (1 + F.expr("size(filter(_all, x -> x > _good))")), 6).alias("reciprocal_rank"))


def losses_against_all(sums: DataFrame) -> DataFrame:
    """scope, qid, pid and the losses of cross_entropy() of each pair against all documents of its scope; sums: lexical.Index.against_all()."""
    return sums.select(
        "scope", "qid", "pid",
        F.round(F.log("exps") - F.col("score"), 6).alias("cross_entropy"),
        F.round((F.col("squares") - 2 * F.col("score") + 1) / F.col("size"), 6).alias("mse"),
        (F.col("score") >= F.col("most")).cast("int").alias("right"),
        F.round(1 / (1 + F.col("place")), 6).alias("reciprocal_rank"),
    )


def validation(losses: DataFrame) -> DataFrame:
    """Per scope, over all batches: mean cross-entropy and squared error, accuracy and mean reciprocal rank; losses: cross_entropy()."""
    means = {"cross_entropy": "cross_entropy", "mse": "mse", "accuracy": "right", "mrr": "reciprocal_rank"}
    return losses.groupBy("scope").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 5).alias(k) for k, c in means.items()))
