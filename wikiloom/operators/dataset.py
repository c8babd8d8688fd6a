"""Building relations of identifiers from pages, and reading them back as text."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wikiloom.durable import durable


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with ids 0, 1, 2, ... in the given order.

    Rows are range-partitioned by the order, numbered within their partition, and shifted by the sizes of the partitions before (one
    small row a partition), so no task sees all rows. The order must be unique for a repeatable result.
    """
    parted = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    parted = durable(parted)
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    numbered = parted.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    return numbered.join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_r")).cast("long")).drop("_p", "_r", "_before")


def same(columns: list[str]) -> Column:
    """The condition that x and y agree in the columns, nulls included."""
    return reduce(lambda a, b: a & b, (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in columns))


def in_order(df: DataFrame, by: str | list[str], order: str | list[str], name: str) -> DataFrame:
    """df with the place (from 0) of each row within its group, in the given order.

    Rows are numbered over all groups by range partitions; a group's first number is taken off. So a group that holds a third of all rows
    is spread over many tasks.
    """
    by, order = ([x] if isinstance(x, str) else x for x in (by, order))
    numbered = dense_ids(df, [*by, *order], "_all")
    first = numbered.groupBy(*by).agg(F.min("_all").alias("_first"))
    return numbered.alias("x").join(first.alias("y"), same(by)).select(*(F.col(f"x.{c}") for c in df.columns), (F.col("x._all") - F.col("y._first")).alias(name))


def running(df: DataFrame, by: list[str], order: list[str], weight: str, name: str) -> DataFrame:
    """df with the sum of `weight` over the rows before each one of its group, in the given order; spread like in_order()."""
    parted = durable(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    sums = parted.groupBy(*by, "_p").agg(F.sum(weight).alias("_s"))
    # One row for each group and partition that it reaches into.
    before = sums.withColumn("_b", F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    own = F.coalesce(F.sum(weight).over(Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("_own", own).alias("x").join(before.alias("y"), same([*by, "_p"])).select(*(F.col(f"x.{c}") for c in df.columns), (F.col("_own") + F.col("_b")).alias(name))


def shuffle_key(id_: Column | str, seed: int = 42) -> Column:
    """A pseudo-random order that any engine can compute."""
    c = F.col(id_) if isinstance(id_, str) else id_
    return (c * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)


def distinct_texts(df: DataFrame, text: str, order: str, name: str) -> DataFrame:
    """text, id: ids of the distinct texts by first appearance."""
    return dense_ids(df.groupBy(text).agg(F.min(order).alias("_first")), ["_first", text], name).drop("_first")


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def split_by_share(pages: DataFrame, weight: str, by: list[str], shares: tuple[float, float] = (0.8, 0.9), order: str = "key") -> DataFrame:
    """pages with split train, test or val: cut where the running share of the weights in the given order passes the bounds.

    The page that crosses a bound still belongs to the split before it; pages after the last cut go to the last split.
    """
    total = pages.groupBy(*by).agg(F.sum(weight).alias("_total"))
    share = F.col("x._before") / F.col("y._total")
    split = F.when(share < shares[0], "train").when(share < shares[1], "test").otherwise("val")
    return running(pages, by, [order], weight, "_before").alias("x").join(total.alias("y"), same(by)).select(*(F.col(f"x.{c}") for c in pages.columns), split.alias("split"))


def pairs(qa: DataFrame) -> DataFrame:
    """wiki, qa_id, j, n, passage, positive, negative: the questions of a paragraph pairwise, as far as both lists go, where both ask.

    Paragraphs that end in " ." (broken extraction) are left out.
    """
    p = qa.select("wiki", "qa_id", F.posexplode("text").alias("j", "passage"), "positive", "negative").where(~F.col("passage").endswith(" ."))
    a, b = F.get("positive", F.col("j")), F.get("negative", F.col("j"))
    m = F.least(F.size(F.coalesce(a, F.array())), F.size(F.coalesce(b, F.array())))
    zipped = F.arrays_zip(F.slice(a, F.lit(1), m).alias("positive"), F.slice(b, F.lit(1), m).alias("negative"))
    rows = p.where(m > 0).select("wiki", "qa_id", "j", "passage", F.posexplode(zipped).alias("n", "z"))
    asks = F.contains(F.col("z.positive"), F.lit("?")) & F.contains(F.col("z.negative"), F.lit("?"))
    return rows.where(asks).select("wiki", "qa_id", "j", "n", "passage", F.col("z.positive").alias("positive"), F.col("z.negative").alias("negative"))


def strings_qqp(triples: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """qid_pos, qid_neg, pid and their texts; ids that do not exist leave their row out, a missing negative stays null."""
    q = queries.select("qid", "query").distinct()
    p = passages.select("pid", "passage").where("passage is not null").distinct()
    t = triples.select("qid_pos", "qid_neg", "pid").distinct()
    t = t.join(q.select(F.col("qid").alias("qid_pos"), F.col("query").alias("positive")), "qid_pos")
    t = t.join(q.select(F.col("qid").alias("qid_neg"), F.col("query").alias("negative")), "qid_neg", "left")
    return t.join(p, "pid").select("qid_pos", "qid_neg", "pid", "positive", "negative", "passage")


def strings_qpp(lists: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, place, pid, passage of lists (qid, pids): the passages in the order of the list, ids that do not exist left out."""
    p = passages.select("pid", "passage").where("passage is not null").distinct()
    return lists.select("qid", F.posexplode("pids").alias("place", "pid")).join(p, "pid").select("qid", "place", "pid", "passage")


def fill_negatives(candidates: DataFrame, n: int = 9, seed: int = 42) -> DataFrame:
    """qid, place, pid: exactly n negatives a query, drawn in hash order, beginning again where there are fewer."""
    w = Window.partitionBy("qid")
    key = shuffle_key(F.col("pid") * 31 + F.col("qid"), seed)
    c = candidates.select("qid", "pid").distinct().withColumn("i", F.row_number().over(w.orderBy(key, "pid")) - 1).withColumn("m", F.count("*").over(w))
    return c.where(F.col("i") < n).select("qid", "pid", F.explode(F.expr(f"sequence(cast(i as int), {n} - 1, cast(m as int))")).alias("place"))


def metadata(passages: DataFrame, meta: DataFrame) -> DataFrame:
    """wiki, wid, revid, url, title, n_pids, first_pid, last_pid: the newest revision of each page with its passages."""
    newest = meta.where("wid is not null").groupBy("wiki", "wid").agg(F.max(F.struct("revid", "url", "title")).alias("m")).select("wiki", "wid", "m.*")
    pids = passages.where("wid >= 0").select("wiki", "wid", "pid").distinct().groupBy("wiki", "wid").agg(F.count("*").alias("n_pids"), F.min("pid").alias("first_pid"), F.max("pid").alias("last_pid"))
    return newest.join(pids, ["wiki", "wid"], "left").na.fill(0, ["n_pids"])


def merge_right(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the right one."""
    return left.join(right.select(*key), key, "left_anti").unionByName(right)


#: Needles that are sent to the passages' tasks at once.
NEEDLES = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _grams(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` codes, by one running sum over all of them."""
    n = len(codes)
    p, q = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (_BASE, _INVERSE))
    total = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _BASE * p[:n])])
    return (total[length:] - total[: n - length + 1]) * q[: n - length + 1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def middle_join(needles: DataFrame, passages: DataFrame, width: int = 40) -> DataFrame:
    """hid, pid: for each needle (hid, text) the first passage that contains its middle `width` characters, else -1.

    Needles are sent to the passages in blocks of NEEDLES, one at a time. A batch of passages hashes all runs of the needles' lengths at once and looks
    them up; equal hashes are compared as text. Only the batch's first passage of each needle is shuffled. A needle shorter than width
    is looked up whole; a null or empty one has no passage.
    """
    start = F.greatest(F.lit(1), F.floor(F.char_length("text") / 2).cast("int") - (width // 2 - 1))
    wanted = needles.select("hid", F.substring("text", start, F.lit(width)).alias("mid")).where("mid <> ''").distinct()
    texts = passages.where("passage is not null").select("pid", "passage")
    hits = None

    def search(block):
        shared = texts.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            by: dict[int, tuple] = {}
            for length in {len(m) for _, m in shared.value}:
                own = [(h, m) for h, m in shared.value if len(m) == length]
                keys = np.array([_grams(_codes(m), length)[0] for _, m in own])
                order = np.argsort(keys, kind="stable")
                by[length] = keys[order], [own[i] for i in order]
            for big in batches:
                for at in range(0, big.num_rows, 1024):
                    b = big.slice(at, 1024)
                    pids, ps = b.column(0).to_pylist(), b.column(1).to_pylist()
                    codes = _codes("\n".join(ps))
                    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in ps])])
                    best: dict = {}
                    for length, (keys, own) in by.items():
                        if len(codes) < length:
                            continue
                        h = _grams(codes, length)
                        i = np.searchsorted(keys, h)
                        for pos in np.flatnonzero(keys[np.minimum(i, len(keys) - 1)] == h):
                            doc = int(np.searchsorted(begin, pos, "right")) - 1
                            text = ps[doc][pos - begin[doc] : pos - begin[doc] + length]
                            j = i[pos]
                            while j < len(keys) and keys[j] == h[pos]:
                                if own[j][1] == text and pids[doc] < best.get(own[j][0], 1 << 63):
                                    best[own[j][0]] = pids[doc]
                                j += 1
                    yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], names=["hid", "pid"])

        part = durable(texts.mapInArrow(run, "hid long, pid long"))
        shared.destroy()
        return part

    block: list = []
    for r in wanted.toLocalIterator():
        block.append((r.hid, r.mid))
        if len(block) == NEEDLES:
            part, block = search(block), []
            hits = part if hits is None else hits.unionByName(part)
    if block:
        part = search(block)
        hits = part if hits is None else hits.unionByName(part)
    ids = needles.select("hid").distinct()
    if hits is None:
        return ids.select("hid", F.lit(-1).cast("long").alias("pid"))
    return ids.join(hits.groupBy("hid").agg(F.min("pid").alias("pid")), "hid", "left").select("hid", F.coalesce("pid", F.lit(-1)).cast("long").alias("pid"))


def batches(df: DataFrame, order: list[str], size: int, by: list[str], drop_last: bool = False) -> DataFrame:
    """df with a batch number within each group; drop_last leaves unfilled batches out."""
    out = in_order(df, by, order, "_place").withColumn("batch", F.floor(F.col("_place") / size).cast("long")).drop("_place")
    if drop_last:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "batch"))).where(F.col("_n") == size).drop("_n")
    return out


def bucketed(df: DataFrame, order: list[str], length: str, size: int, by: list[str], multiple: int = 10, accumulate: int = 1) -> DataFrame:
    """df with bucket, batch and sub: rows in the given order fall into buckets of `multiple` batches, within a bucket the longest come first, so
    that rows of one batch have about the same length; a batch is used up in `accumulate` parts. The order must be unique."""
    rows = in_order(df, by, order, "_place").withColumn("bucket", F.floor(F.col("_place") / (size * multiple)).cast("long"))
    w = Window.partitionBy(*by, "bucket").orderBy(F.desc(length), "_place")  # size * multiple rows at most
    rows = rows.withColumn("_in", F.row_number().over(w) - 1)
    part = -(-size // accumulate)
    return rows.select(*df.columns, "bucket", (F.col("bucket") * multiple + F.floor(F.col("_in") / size)).alias("batch"), F.floor(F.col("_in") % size / part).cast("int").alias("sub"))


def shuffled_negatives(pairs: DataFrame, by: list[str], seed: int = 42) -> DataFrame:
    """pairs (by, qid, pid) with neg: the passage of the next pair in a pseudo-random order of its group (the first follows the last); null
    where that is the pair's own passage."""
    rows = pairs.select(*by, "qid", "pid").distinct().withColumn("_k", shuffle_key(F.col("qid") * 7 + F.col("pid"), seed))
    placed = durable(in_order(rows, by, ["_k", "qid", "pid"], "_place"))
    n = placed.groupBy(*by).agg(F.count("*").alias("_n"))
    own = placed.alias("x").join(n.alias("y"), same(by)).select(*(F.col(f"x.{c}") for c in placed.columns), ((F.col("x._place") + 1) % F.col("y._n")).alias("_next"))
    other = placed.withColumn("_next", F.col("_place"))
    neg = F.when(F.col("y.pid") != F.col("x.pid"), F.col("y.pid"))
    return own.alias("x").join(other.alias("y"), same([*by, "_next"])).select(*(F.col(f"x.{c}") for c in (*by, "qid", "pid")), neg.alias("neg"))


def by_length(df: DataFrame, key: list[str], length: str) -> DataFrame:
    """key, place (longest first, then by key, from 0) and original (the place in the order of the key): a permutation and its inverse."""
    df = df.select(*key, F.col(length).alias("_n"))
    rows = dense_ids(dense_ids(df, key, "original").withColumn("_m", -F.col("_n")), ["_m", *key], "place")
    return rows.select(*key, "place", "original")


def shards(df: DataFrame, order: list[str], size: int, by: list[str]) -> DataFrame:
    """Runs of `size` rows a person, numbered from 1; a last unfilled run is left out."""
    return batches(df, order, size, by, drop_last=True).withColumn("person", F.col("batch") + 1).drop("batch")


def from_search_results(rows: DataFrame, n: int = 9, seed: int = 42) -> dict[str, DataFrame]:
    """Relations of rows (row_id, query, passages struct<passage_text, is_selected>).

    Texts are deduplicated with ids by first appearance; every query gets an id, but only those with a selected and an unselected passage
    get triples: one for each selected passage, each with exactly n negatives of the query.
    """
    flat = rows.select("row_id", "query", F.posexplode(F.arrays_zip(F.col("passages.passage_text").alias("text"), F.col("passages.is_selected").alias("selected"))).alias("at", "z")).select("row_id", "query", "at", "z.text", "z.selected")
    q = distinct_texts(rows.where("query is not null"), "query", "row_id", "qid")
    p = distinct_texts(flat.where("text is not null").withColumn("seen", F.struct("row_id", "at")), "text", "seen", "pid")
    ids = flat.join(q, "query").join(p, "text").select("qid", "pid", "selected").distinct()
    good = ids.where("selected = 1").select("qid", F.col("pid").alias("pid_pos"))
    bad = ids.where("selected = 0").select("qid", "pid").join(good.select("qid", F.col("pid_pos").alias("pid")), ["qid", "pid"], "left_anti")
    neg = fill_negatives(bad, n, seed).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pid"))), lambda x: x["pid"]).alias("pid_neg"))
    return {"queries": q, "passages": p, "triples": good.join(neg, "qid")}


def human_pairs(blueprints: DataFrame, most: int = 35) -> DataFrame:
    """annotator, pid, side, k, question of annotated blueprints (annotator, pid, pos_query, neg_query): placeholders are left out, and of
    each annotator all rows after the first `most`."""
    w = Window.partitionBy("annotator").orderBy("pid")
    holder = F.array(F.lit("..."), F.lit("..."), F.lit("..."))
    none = F.array().cast("array<string>")
    rows = blueprints.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    sides = [rows.select("annotator", "pid", F.lit(s).alias("side"), F.posexplode(F.when(F.col(c).isNull() | (F.col(c) == holder), none).otherwise(F.col(c))).alias("k", "question")) for s, c in (("positive", "pos_query"), ("negative", "neg_query"))]
    return sides[0].unionByName(sides[1]).where(F.col("question").isNotNull() & (F.trim("question") != "") & (F.col("question") != "..."))


def legacy_pairs(pages: DataFrame) -> DataFrame:
    """id, j, question, passage, qid_neg (-1) of legacy pages (id, ord, text array<struct<questions, passage>>), the first page of each id."""
    first = first_wins(pages, ["id"], [F.col("ord")])
    rows = first.select("id", F.posexplode("text").alias("j", "t"))
    return rows.select("id", "j", F.explode("t.questions").alias("question"), F.col("t.passage").alias("passage"), F.lit(-1).cast("long").alias("qid_neg"))


def best_answer(scores: DataFrame) -> DataFrame:
    """qid, pid, answer, score: the best-scored answer of each question over all passages (smaller pid on ties)."""
    best = F.max_by(F.struct("pid", "answer", "score"), F.struct("score", -F.col("pid")))
    return scores.groupBy("qid").agg(best.alias("b")).select("qid", "b.*")
