"""Relations as Python objects: lookup, length, iteration over distributed tables, and a retriever over them."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from wikiloom.config import Config
from wikiloom.durable import durable
from wikiloom.operators import dataset as B, dense as D, lexical as L, metrics as M
from wikiloom.sources import files


class Lookup:
    """A table of texts by id. Lookups are filters that reach the scan; iteration streams the rows partition by partition."""

    key, text = "id", "text"

    def __init__(self, df: DataFrame):
        self.df = df

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self) -> Iterator[int]:
        return self.keys()

    def __contains__(self, id_: int) -> bool:
        return bool(self.df.where(F.col(self.key) == id_).limit(1).count())

    def __getitem__(self, ids: int | list[int]) -> str | list[str]:
        return self.strings(ids)

    def keys(self) -> Iterator[int]:
        return (r[0] for r in self.df.select(self.key).toLocalIterator())

    def values(self) -> Iterator[str]:
        return (r[0] for r in self.df.select(self.text).toLocalIterator())

    def items(self) -> Iterator[tuple[int, str]]:
        return (tuple(r) for r in self.df.select(self.key, self.text).toLocalIterator())

    def strings(self, ids: int | list[int], skip_missing: bool = False):
        """Text of an id, or texts of a list of ids in its order. Ids that do not exist raise, or are skipped."""
        many = ids if isinstance(ids, list) else [ids]
        got = dict(map(tuple, self.df.where(F.col(self.key).isin(many)).select(self.key, self.text).collect())) if many else {}
        if not skip_missing and (missing := [i for i in many if i not in got]):
            raise KeyError(missing[0])
        out = [got[i] for i in many if i in got]
        return out if isinstance(ids, list) else out[0] if out else None

    def join_strings(self, rows: DataFrame, on: str, name: str, skip_missing: bool = True) -> DataFrame:
        """rows with the text of the id in column `on`: the lookup for tables of ids."""
        t = self.df.select(F.col(self.key).alias(on), F.col(self.text).alias(name))
        return rows.join(t, on, "inner" if skip_missing else "left")


class Passages(Lookup):
    key, text = "pid", "passage"

    @classmethod
    def read(cls, spark: SparkSession, path: str, ignore_wid: bool = False) -> Passages:
        return cls(files.passages(spark, path, ignore_wid))


class Queries(Lookup):
    key, text = "qid", "query"

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Queries:
        return cls(files.queries(spark, path))


class Triples:
    def __init__(self, df: DataFrame, mode: str = "QQP"):
        self.df, self.mode = df, mode

    @classmethod
    def read(cls, spark: SparkSession, path: str, mode: str = "QQP", passages_per_query: int | None = None) -> Triples:
        return cls(files.triples(spark, path, mode, passages_per_query), mode)

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self) -> Iterator[tuple]:
        return (tuple(r) for r in self.df.toLocalIterator())

    def shuffle(self, seed: int = 42) -> Triples:
        return Triples(self.df.orderBy(F.xxhash64(F.lit(seed), *self.df.columns)), self.mode)

    def relevant(self) -> DataFrame:
        """scope, qid, pid."""
        q, p = ("qid_pos", "pid") if self.mode == "QQP" else ("qid", "pid_pos")
        return self.df.select(F.lit("all").alias("scope"), F.col(q).alias("qid"), F.col(p).alias("pid")).distinct()


class TripleDataset:
    """The three relations together."""

    def __init__(self, triples: Triples, queries: Queries, passages: Passages):
        self.triples, self.queries, self.passages = triples, queries, passages

    @classmethod
    def read(cls, spark: SparkSession, config: Config) -> TripleDataset:
        return cls(Triples.read(spark, config.triples_path, config.dataset_mode, config.passages_per_query), Queries.read(spark, config.queries_path), Passages.read(spark, config.passages_path))

    @classmethod
    def folder(cls, spark: SparkSession, path: str, mode: str = "QQP") -> TripleDataset:
        d = files.dataset(spark, path, mode)
        return cls(Triples(d["triples"], mode), Queries(d["queries"]), Passages(d["passages"]))

    def strings(self) -> DataFrame:
        """QQP: texts of every triple. QPP: qid, place, pid, passage with the positive first."""
        if self.triples.mode == "QQP":
            return B.strings_qqp(self.triples.df, self.queries.df, self.passages.df)
        lists = self.triples.df.select("qid", F.concat(F.array("pid_pos"), "pid_neg").alias("pids"))
        return B.strings_qpp(lists, self.passages.df)

    def __len__(self) -> int:
        return len(self.triples)

    def _texts(self, row: tuple) -> tuple[list[str | None], list[str | None]]:
        """The questions and the passages of one triple; an id that does not exist has no text."""
        qids, pids = (row[:2], row[2:3]) if self.triples.mode == "QQP" else (row[:1], [row[1], *row[2]])
        q, p = (t.df.where(F.col(t.key).isin(list(ids))).select(t.key, t.text).collect() for t, ids in ((self.queries, qids), (self.passages, pids)))
        q, p = dict(map(tuple, q)), dict(map(tuple, p))
        return [q.get(i) for i in qids], [p.get(i) for i in pids]

    def __getitem__(self, i: int) -> tuple[list[str | None], list[str | None]]:
        """The texts of the triple at place i, in the order of the triples' columns."""
        rows = B.dense_ids(self.triples.df.distinct(), self.triples.df.columns, "_i").where(F.col("_i") == i).drop("_i").collect()
        if not rows:
            raise IndexError(i)
        return self._texts(tuple(rows[0]))

    def __iter__(self) -> Iterator[tuple[list[str | None], list[str | None]]]:
        """The texts of every triple, streamed from one join."""
        if self.triples.mode == "QQP":
            for r in self.strings().toLocalIterator():
                yield [r.positive, r.negative], [r.passage]
        else:
            per = self.strings().groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "passage"))), lambda x: x["passage"]).alias("ps"))
            q = self.queries.df.select(F.col(self.queries.key).alias("qid"), F.col(self.queries.text).alias("q"))
            for r in per.join(q, "qid").toLocalIterator():
                yield [r.q], r.ps


class Index(ABC):
    """What a retriever needs of an index over documents (scope, pid, text)."""

    @abstractmethod
    def add(self, docs: DataFrame) -> None:
        """Take in the documents that are not in it yet."""

    @abstractmethod
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """scope, qid, pid, score, rank of the best k documents of queries (scope, qid, text)."""


class LexicalIndex(Index):
    """TF-IDF over all documents taken in; fitted anew when some were added."""

    def __init__(self, min_df: int = 5):
        self.min_df, self.docs, self.model = min_df, None, None

    def add(self, docs: DataFrame) -> None:
        docs = docs.select("scope", "pid", "text")
        self.docs = docs if self.docs is None else self.docs.unionByName(docs.join(self.docs.select("scope", "pid"), ["scope", "pid"], "left_anti"))
        self.model = None

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        self.model = self.model or L.TfIdf(self.docs, self.min_df)
        return self.model.topk(queries, k)


class DenseIndex(Index):
    """Token vectors at a path, searched end to end."""

    def __init__(self, path: str, similarity: str = "cosine", spread: float = 2.0, encoder=D.encode_documents, query_encoder=D.encode_queries):
        self.path, self.similarity, self.spread, self.encoder, self.query_encoder = path, similarity, spread, encoder, query_encoder
        self.vectors = None

    def add(self, docs: DataFrame) -> None:
        self.vectors = D.append(docs, self.path, self.encoder)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        vectors = queries.sparkSession.read.parquet(self.path) if self.vectors is None else self.vectors
        return D.retrieve_full(vectors, self.query_encoder(queries), k, self.spread, self.similarity)


class Retriever:
    """Lexical search, rerank and end-to-end search over one set of passages; the index is built or extended at config.index_path."""

    def __init__(self, passages: Passages, config: Config):
        self.config = config
        self.docs = passages.df.select(F.lit("all").alias("scope"), "pid", F.col("passage").alias("text"))
        self.lexical = L.TfIdf(self.docs, config.min_df)
        self.index = D.append(self.docs, config.index_path, lambda d: D.encode_documents(d, config.doc_maxlen)) if config.index_path else durable(D.encode_documents(self.docs, config.doc_maxlen))

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        q = queries.select(F.lit("all").alias("scope"), "qid", F.col("query").alias("text"))
        return q, D.encode_queries(q, self.config.query_maxlen)

    def search(self, queries: DataFrame, mode: str = "full", k: int | None = None) -> DataFrame:
        """qid, pid, score, rank by mode: tf_idf, rerank or full."""
        k = k or self.config.k
        q, vectors = self._asked(queries)
        if mode == "full":
            out = D.retrieve_full(self.index, vectors, k, self.config.spread, self.config.similarity)
        elif mode in ("tf_idf", "rerank"):
            out = self.lexical.topk(q, k)
            out = D.rerank(out, self.index, vectors, k, self.config.similarity) if mode == "rerank" else out
        else:
            raise ValueError("mode is tf_idf, rerank or full")
        return out.select("qid", "pid", "score", "rank")

    def timed(self, queries: DataFrame, mode: str = "full", k: int | None = None) -> dict[str, float]:
        """Wall-clock seconds of one search over all queries, their number and the mean a query."""
        n = queries.count()
        began = time.perf_counter()
        self.search(queries, mode, k).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        return {"queries": n, "seconds": seconds, "seconds_a_query": seconds / max(n, 1)}

    def evaluate(self, data: TripleDataset, modes: tuple[str, ...] = ("tf_idf", "rerank", "full")) -> DataFrame:
        """Recall and MRR, one row a mode."""
        rel = data.triples.relevant()
        out = None
        for mode in modes:
            row = M.recall_mrr(self.search(data.queries.df, mode).withColumn("scope", F.lit("all")), rel).withColumn("mode", F.lit(mode)).drop("scope")
            out = row if out is None else out.unionByName(row)
        return out
