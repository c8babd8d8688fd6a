"""Exact scores of a stated query set against a corpus, without the pairs that can't matter.

The questions are sent as sparse rows, in blocks, to the documents' own tasks, whose documents stand in the order of scope and pid.
A task holds up to CHUNK documents of a scope as posting lists. A question's terms are taken by the most that each can add to a score here; a
document that has only terms whose sum stays below a score is never looked at (MaxScore). That score is the question's k-th best so far in best(),
and the least score of its stated pairs in ahead(), which counts the documents before each pair instead of listing them. For short lists, promising()
first looks up a few documents of each chunk, so that reached() knows a bound of the k-th best of all chunks: of most questions it then sees some postings only, and
takes them together.

Bounds hold for weights above zero; a question with another weight is scored against all documents that share a term with it.

Bounds cut little where a question is as long as a passage and its pair's score is low. counted_in_tiles() counts for many such questions at once: their
scores against all documents of the chunk, frequent terms as a product of matrices and the others by their posting lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Documents of a chunk; terms of a block of questions.
CHUNK, TERMS = 1 << 15, 1 << 22

#: Scores are rounded to six digits, so bounds are compared with this much to spare.
SPARE = 2e-6

#: Scores of a tile of questions and documents; a term in this part of the documents is a row of a matrix there.
TILE, DENSE = 1 << 20, 24

#: Postings of a question that promising() reads in a chunk; of one that reached() does not take with others; the longest lists that are bounded so.
LIKELY, HEAVY, SHORT = 64, 2048, 4


class Chunk:
    """Posting lists of documents of one scope: doc (place of each document in the list), h (term), w (weight)."""

    def __init__(self, pids: np.ndarray, doc: np.ndarray, h: np.ndarray, w: np.ndarray):
        order = np.argsort(pids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pids, self.n = pids[order], len(pids)
        doc = place[doc]
        by = np.lexsort((doc, h))
        self.doc, self.w, h = doc[by], w[by], h[by]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        begin = np.flatnonzero(new)
        self.terms, self.first = h[begin], np.append(begin, len(h))
        self.df = np.diff(self.first)
        self.most = np.maximum.reduceat(self.w, begin) if len(begin) else np.zeros(0)
        self.least = float(self.w.min()) if len(w) else 1.0
        self._rows: dict[int, np.ndarray] = {}
        self.acc, self._one = np.zeros(self.n), np.empty(self.n)

    def known(self, h: np.ndarray) -> np.ndarray:
        """The number of each term here, -1 of one that no document has."""
        if not len(self.terms):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[i] == h, i, -1)

    def row(self, t: int) -> np.ndarray | None:
        """A frequent term's weight in each document."""
        if self.df[t] * 8 < self.n:
            return None
        if t not in self._rows:
            r = self._rows[t] = np.zeros(self.n)
            a, b = self.first[t], self.first[t + 1]
            r[self.doc[a:b]] = self.w[a:b]
        return self._rows[t]

    def add(self, t: int, x: float) -> None:
        r = self.row(t)
        if r is not None:
            np.multiply(r, x, out=self._one)
            self.acc += self._one
        else:
            a, b = self.first[t], self.first[t + 1]
            self.acc[self.doc[a:b]] += x * self.w[a:b]

    def of(self, t: int, docs: np.ndarray) -> np.ndarray:
        """A term's weight in each of these documents."""
        r = self.row(t)
        if r is not None:
            return r[docs]
        a, b = self.first[t], self.first[t + 1]
        own = self.doc[a:b]
        i = np.minimum(np.searchsorted(own, docs), b - a - 1)
        return np.where(own[i] == docs, self.w[a:b][i], 0.0)

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each term in a matrix of weights [frequent term, document]; -1 of others, and at -1."""
        some = np.flatnonzero(self.df * DENSE >= self.n)
        row = np.full(len(self.terms) + 1, -1)
        row[some] = np.arange(len(some))
        whole = np.zeros((len(some), self.n))
        for i, t in enumerate(some):
            whole[i, self.doc[self.first[t] : self.first[t + 1]]] = self.w[self.first[t] : self.first[t + 1]]
        return row, whole

    @cached_property
    def keys(self) -> np.ndarray:
        """A number of the term and document of each posting, in their order."""
        return np.repeat(np.arange(len(self.terms)), self.df) * self.n + self.doc

    def weights(self, ts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The weight of each term in its document."""
        row, whole = self.frequent
        r, out = row[ts], np.zeros(len(ts))
        dense = r >= 0
        out[dense] = whole[r[dense], docs[dense]]
        few = np.flatnonzero(~dense)
        key = ts[few] * self.n + docs[few]
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[few] = np.where(self.keys[i] == key, self.w[i], 0.0)
        return out

    def postings(self, ts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first `size` postings of each term."""
        return np.repeat(self.first[ts] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def sharing(self, ts: np.ndarray, begin: int = 0) -> np.ndarray:
        """Whether each document from `begin` on has one of the terms."""
        met = np.zeros(self.n - begin, bool)
        for t in ts:
            r = self.row(t)
            if r is not None:
                met |= r[begin:] != 0
            else:
                own = self.doc[self.first[t] : self.first[t + 1]]
                met[own[np.searchsorted(own, begin) :] - begin] = True
        return met

    def whole(self, ts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all that share a term."""
        self.acc.fill(0)
        for t, y in zip(ts, x):
            self.add(t, y)
        docs = np.flatnonzero(self.sharing(ts))
        return docs, np.round(self.acc[docs], 6)

    def _rest(self, docs: np.ndarray, s: np.ndarray, ts, x, bound, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """The documents that reach theta once the remaining terms (the greatest first) are added; bound: what these and later ones can add."""
        for t, y, u in zip(ts, x, bound):
            keep = s + u >= theta - SPARE
            docs, s = docs[keep], s[keep]
            if not len(docs):
                break
            s = s + y * self.of(t, docs)
        s = np.round(s, 6)
        keep = s >= theta - SPARE
        return docs[keep], s[keep]

    def reaching(self, ts: np.ndarray, x: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all that share a term and have a score of at least theta, and maybe some just below."""
        most = x * self.most[ts]
        order = np.argsort(-most, kind="stable")
        ts, x, most = ts[order], x[order], most[order]
        bound = np.cumsum(most[::-1])[::-1]  # what a term and all after it can add
        e = int(np.count_nonzero(bound >= theta - SPARE))
        if not e:
            return np.zeros(0, np.int64), np.zeros(0)
        if e == 1 and self.row(ts[0]) is None:
            a, b = self.first[ts[0]], self.first[ts[0] + 1]
            docs, s = self.doc[a:b], x[0] * self.w[a:b]
        else:
            self.acc.fill(0)
            for t, y in zip(ts[:e], x[:e]):
                self.add(t, y)
            least = theta - (bound[e] if e < len(ts) else 0.0) - SPARE
            docs = np.flatnonzero(self.acc >= least if least > 0 else self.acc)
            s = self.acc[docs]
        return self._rest(docs, s, ts[e:], x[e:], bound[e:], theta)

    def best(self, ts: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the k best that share a term, the smaller document on ties."""
        if x.min() <= 0 or self.least <= 0:
            docs, s = self.whole(ts, x)
        else:
            most = x * self.most[ts]
            order = np.argsort(-most, kind="stable")
            ts, x, most = ts[order], x[order], most[order]
            bound = np.cumsum(most[::-1])[::-1]
            self.acc.fill(0)
            theta, e, likely = 0.0, len(ts), None
            for j, (t, y) in enumerate(zip(ts, x)):
                # The k-th best of any documents is a bound of the k-th best; it cannot exceed what the terms so far can add.
                if likely is not None and bound[j] < bound[0] - bound[j]:
                    s = self.acc[likely]
                    theta = max(theta, float(np.partition(s, len(s) - k)[len(s) - k]))
                    if bound[j] < theta - SPARE:
                        e = j
                        break
                self.add(t, y)
                if likely is None and self.df[t] >= k:
                    likely = self.doc[self.first[t] : self.first[t + 1]]
            if likely is not None:
                s = self.acc[likely]
                theta = max(theta, float(np.partition(s, len(s) - k)[len(s) - k]))
            least = theta - (bound[e] if e < len(ts) else 0.0) - SPARE
            docs = np.flatnonzero(self.acc >= least if least > 0 else self.acc)
            s = self.acc[docs]
            docs, s = self._rest(docs, s, ts[e:], x[e:], bound[e:], theta)
        if len(docs) > k:
            keep = s >= np.partition(s, len(s) - k)[len(s) - k]
            docs, s = docs[keep], s[keep]
        order = np.lexsort((docs, -s))[:k]
        return docs[order], s[order]

    def last(self, ts: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the k last ones of all: the least score, then the greatest document."""
        if not len(ts):
            docs = np.arange(self.n)[::-1][:k]
            return docs, np.zeros(len(docs))
        if x.min() > 0 and self.least * x.min() > SPARE:
            begin = self.n
            while begin:
                begin = max(0, begin - max(256, 4 * (self.n - begin)))
                none = np.flatnonzero(~self.sharing(ts, begin))
                if len(none) >= k:
                    return none[::-1][:k] + begin, np.zeros(k)
        self.acc.fill(0)
        for t, y in zip(ts, x):
            self.add(t, y)
        s = np.round(self.acc, 6)
        order = np.lexsort((-np.arange(self.n), s))[:k]
        return order, s[order]

    def ahead(self, ts: np.ndarray, x: np.ndarray, score: np.ndarray, pid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair (score, pid) of a question: the documents sharing a term that come before it by score, then pid; and those of them, before it or
        not, that have a smaller pid, for pairs without a score."""
        before = np.zeros(len(score), np.int64)
        if not len(ts):
            return before, before.copy()
        none = score <= 0
        usual = x.min() > 0 and self.least * x.min() > SPARE
        if not usual:
            docs, s = self.whole(ts, x)
        elif none.any():
            met = np.flatnonzero(self.sharing(ts))
            before[none] = np.searchsorted(self.pids[met], pid[none])
            count = np.zeros(len(score), np.int64)
            count[none] = len(met)
            if none.all():
                return count, before
            rest, _ = self.ahead(ts, x, score[~none], pid[~none])
            count[~none] = rest
            return count, before
        else:
            docs, s = self.reaching(ts, x, float(score.min()))
        p = self.pids[docs]
        # A question has a few stated pairs.
        count = np.array([np.count_nonzero((s > a) & (p != b) | ((s == a) & (p < b))) for a, b in zip(score, pid)], np.int64)
        if not usual:
                before = np.array([np.count_nonzero(p < b) for b in pid], np.int64)
        return count, before


class Block:
    """Questions by scope, as flat arrays: qid, first, h, w; their stated pairs, if any: score, pid, at (first pair of each question)."""

    #: By scope, a bound from below of each question's k-th best score, 0 without one.
    theta: dict[str, np.ndarray] = {}

    def __init__(self, rows: list[tuple], pairs: bool):
        by: dict[str, list[tuple]] = {}
        for r in rows:
            by.setdefault(r[0], []).append(r)
        self.scopes = {}
        for scope, rs in by.items():
            flat = lambda i, kind, rs=rs: np.concatenate([np.asarray(r[i], kind) for r in rs])
            ends = lambda i, rs=rs: np.concatenate([[0], np.cumsum([len(r[i]) for r in rs])])
            own = (np.array([r[1] for r in rs], np.int64), ends(2), flat(2, np.int64), flat(3, np.float64))
            self.scopes[scope] = (*own, flat(4, np.float64), flat(5, np.int64), ends(4)) if pairs else own

    def bounded(self, found: pa.Table) -> None:
        """Takes the bounds found (scope, qid, score) of some questions."""
        names, qids, scores = np.array(found.column(0).to_pylist(), object), found.column(1).to_numpy(), found.column(2).to_numpy()
        self.theta = {}
        for scope, (qid, *_) in self.scopes.items():
            mine, order = names == scope, np.argsort(qid, kind="stable")
            self.theta[scope] = np.zeros(len(qid))
            self.theta[scope][order[np.searchsorted(qid, qids[mine], sorter=order)]] = scores[mine]

    def entries(self, scope: str, chunk: Chunk) -> tuple[np.ndarray, ...]:
        """question (its number), term and weight of all terms known to the chunk, by question and the most that a term can add; that; first term of each question."""
        qid, first, h, w = self.scopes[scope][:4]
        t = chunk.known(h)
        ok = t >= 0
        q, t, w = np.repeat(np.arange(len(qid)), np.diff(first))[ok], t[ok], w[ok]
        most = w * chunk.most[t]
        order = np.lexsort((-most, q))
        q, t, w, most = q[order], t[order], w[order], most[order]
        return q, t, w, most, np.searchsorted(q, np.arange(len(qid) + 1))

    def questions(self, scope: str, chunk: Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """number, terms known to the chunk and weights of each question."""
        qid, first, h, w = self.scopes[scope][:4]
        t = chunk.known(h)
        ok = t >= 0
        ends = np.concatenate([[0], np.cumsum(ok)])[first]
        t, w = t[ok], w[ok]
        for i in range(len(qid)):
            yield i, t[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]]


def blocks(questions: DataFrame, most: int, pairs: bool = False) -> Iterator[Block]:
    """At most `most` questions each; questions: scope, qid, h, w and, if pairs, score and pid (lists of stated pairs)."""
    rows: list[tuple] = []
    n = 0
    for r in questions.select("scope", "qid", "h", "w", *(["score", "pid"] if pairs else [])).toLocalIterator():
        rows.append((r[0], r[1], np.array(r[2], np.int64), np.array(r[3], np.float64), *((r[4], r[5]) if pairs else ())))
        n += len(r[2])
        if len(rows) == most or n >= TERMS:
            yield Block(rows, pairs)
            rows, n = [], 0
    if rows:
        yield Block(rows, pairs)


def as_rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, h, w) of a batch of scope, pid, h, w."""
    size = np.diff(b.column(2).offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), size), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()


def scoped(batches: Iterator[pa.RecordBatch], weigh: Callable, scopes) -> Iterator[tuple[str, Chunk]]:
    """The task's documents in chunks of one scope, of those scopes that are asked; weigh: batch -> (document, h, w)."""
    held: dict[str, list[tuple]] = {}
    sizes: dict[str, int] = {}

    def made(scope):
        parts, at, out = held.pop(scope), 0, []
        for p, d, h, w in parts:
            out.append((p, d + at, h, w))
            at += len(p)
        sizes.pop(scope)
        return scope, Chunk(*(np.concatenate([x[i] for x in out]) for i in range(4)))

    for b in batches:
        if not b.num_rows:
            continue
        doc, h, w = weigh(b)
        names, pids = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
        for scope in dict.fromkeys(names):
            if scope not in scopes:
                continue
            mine = names == scope
            place = np.cumsum(mine) - 1
            ok = mine[doc]
            held.setdefault(scope, []).append((pids[mine], place[doc[ok]], h[ok], w[ok]))
            sizes[scope] = sizes.get(scope, 0) + int(mine.sum())
            if sizes[scope] >= CHUNK:
                yield made(scope)
    for scope in list(held):
        yield made(scope)


def parts(n: int) -> int:
    """How many parts n documents are in: of about CHUNK or less."""
    return max(1, -(-n // CHUNK), min(36, n // 1024))


def spread(docs: DataFrame) -> DataFrame:
    """Documents in the order of scope and pid, in parts of about CHUNK or less."""
    return docs.repartitionByRange(parts(docs.count()), "scope", "pid")


def weighed(docs: DataFrame, weigh: Callable) -> DataFrame:
    """scope, pid, h, w: the sparse rows of documents, made where they lie."""

    def run(batches):
        for b in batches:
            doc, h, w = weigh(b)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h, w))], names=["scope", "pid", "h", "w"])

    return docs.mapInArrow(run, "scope string, pid long, h array<bigint>, w array<double>")


def run_blocks(docs: DataFrame, weigh: Callable, questions: DataFrame, most: int, pairs: bool, work: Callable, schema: str, done: Callable, short: int = 0) -> DataFrame:
    """The rows that work(block, scope, chunk) gives for each block of questions and chunk of docs; done: keeps a block's rows; short: bounds of the best so
    many of each question are sent with a block."""
    sc, out = docs.sparkSession.sparkContext, None

    def rows(block: Block, work: Callable, schema: str, done: Callable):
        names = [x.split()[0] for x in schema.split(", ")]
        shared = sc.broadcast(block)

        def run(batches):
            for scope, chunk in scoped(batches, weigh, shared.value.scopes):
                columns = work(shared.value, scope, chunk)
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([scope]).take(pa.array(np.zeros(len(columns[0]), np.int32))), *map(pa.array, columns)], names=names)

        out = done(docs.mapInArrow(run, schema))
        shared.destroy()
        return out

    for block in blocks(questions, most, pairs):
        if short:
            # A list has `short` scores a chunk; one row a question of the block is sent to the driver.
            best = F.get(F.sort_array(F.collect_list("score"), False), F.lit(short - 1))
            block.bounded(rows(block, promising(short), "scope string, qid long, score double", lambda df: df.groupBy("scope", "qid").agg(best.alias("score")).where("score > 0").toArrow()))
        part = rows(block, work, schema, done)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def listed(k: int, worst: bool = False) -> Callable:
    """work: qid, pid, score of the chunk's k best of each question, or of the k last ones of all."""

    def work(block: Block, scope: str, chunk: Chunk):
        qid = block.scopes[scope][0]
        q, d, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        taken = np.zeros(len(qid), bool)
        if scope in block.theta and not worst and len(chunk.terms):
            taken, own, docs, score = reached(block, scope, chunk, k)
            q.append(qid[own])
            d.append(docs)
            s.append(score)
        for i, ts, x in block.questions(scope, chunk):
            if not taken[i] and (worst or len(ts)):
                docs, score = chunk.last(ts, x, k) if worst else chunk.best(ts, x, k)
                q.append(np.full(len(docs), qid[i]))
                d.append(docs)
                s.append(score)
        return np.concatenate(q), chunk.pids[np.concatenate(d)], np.concatenate(s)

    return work


def _summed(q: np.ndarray, d: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each question and document (of n) once, with the sum of s."""
    key = q * n + d
    order = np.argsort(key, kind="stable")
    key, s = key[order], s[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at] // n, key[at] % n, np.add.reduceat(s, at) if len(at) else s


def _first(q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best documents of each question, the smaller one on ties."""
    order = np.lexsort((d, -s, q))
    q = q[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def promising(k: int) -> Callable:
    """work: qid, score of k documents of the chunk, at most, that have the terms of a question that can add most."""

    def work(block: Block, scope: str, chunk: Chunk):
        qid = block.scopes[scope][0]
        q, ts, x, _, first = block.entries(scope, chunk)
        if not len(q):
            return np.zeros(0, np.int64), np.zeros(0)
        df = chunk.df[ts]
        seen = np.cumsum(df) - df
        size = np.clip(LIKELY - (seen - seen[first[q]]), 0, df)
        posting = chunk.postings(ts, size)
        own, docs, s = _summed(np.repeat(q, size), chunk.doc[posting], np.repeat(x, size) * chunk.w[posting], chunk.n)
        best = _first(own, docs, s, k)
        own, docs = own[best], docs[best]
        n = first[own + 1] - first[own]
        pair, term = np.repeat(np.arange(len(own)), n), np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.bincount(pair, weights=x[term] * chunk.weights(ts[term], docs[pair]), minlength=len(own))
        return qid[own], np.round(score, 6)

    return work


def reached(block: Block, scope: str, chunk: Chunk, k: int) -> tuple[np.ndarray, ...]:
    """Whether each question is answered here; question, document, score of the k best, at most, of those that reach its bound. Left are questions without
    a bound and those with a weight not above zero."""
    theta = block.theta[scope]
    q, ts, x, most, first = block.entries(scope, chunk)
    df, end = chunk.df[ts], first[1:]
    taken = theta > 0
    taken[q[x <= 0]] = False
    if chunk.least <= 0:
        taken[:] = False
    total = np.append(0.0, np.cumsum(most))
    bound = total[end[q]] - total[:-1]  # what a term and all after it can add
    needed = (bound >= theta[q] - SPARE) & taken[q]
    n = np.bincount(q[needed], weights=df[needed], minlength=len(theta))
    next_ = first[:-1] + np.bincount(q[needed], minlength=len(theta))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in np.flatnonzero(n > HEAVY):
        docs, s = chunk.reaching(ts[first[i] : end[i]], x[first[i] : end[i]], theta[i])
        found.append((np.full(len(docs), i), docs, s))
    light = np.flatnonzero(needed & (n[q] <= HEAVY))
    sizes = np.cumsum(df[light])
    # Parts end with a question, so that its documents are together.
    cuts = np.searchsorted(sizes, np.arange(TILE, sizes[-1] if len(sizes) else 0, TILE))
    cuts = np.unique(np.append(np.searchsorted(q[light], q[light[cuts]]), [0, len(light)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = light[a:b]
        posting = chunk.postings(ts[some], df[some])
        own, docs, s = _summed(np.repeat(q[some], df[some]), chunk.doc[posting], np.repeat(x[some], df[some]) * chunk.w[posting], chunk.n)
        at = next_[own]
        while len(own):
            done = at == end[own]
            found.append((own[done], docs[done], np.round(s[done], 6)))
            own, docs, s, at = own[~done], docs[~done], s[~done], at[~done]
            keep = s + bound[at] >= theta[own] - SPARE
            own, docs, s, at = own[keep], docs[keep], s[keep], at[keep]
            s = s + x[at] * chunk.weights(ts[at], docs)
            at = at + 1
    own, docs, s = (np.concatenate([f[i] for f in found]) for i in range(3))
    keep = s >= theta[own] - SPARE
    own, docs, s = own[keep], docs[keep], s[keep]
    best = _first(own, docs, s, k)
    return taken, own[best], docs[best], s[best]


def scored_pairs(block: Block, scope: str, chunk: Chunk):
    """work: qid, pid, score of the stated pairs whose document is in the chunk and shares a term; the block's scores play no part."""
    qid, first, h, w, _, pid, at = block.scopes[scope]
    place = np.minimum(np.searchsorted(chunk.pids, pid), chunk.n - 1)
    own = np.flatnonzero(chunk.pids[place] == pid)
    q = np.searchsorted(at, own, side="right") - 1
    size = first[q + 1] - first[q]
    pair = np.repeat(np.arange(len(own)), size)
    term = np.repeat(first[q] - np.cumsum(size) + size, size) + np.arange(len(pair))
    known = chunk.known(h)
    pair, term = pair[known[term] >= 0], term[known[term] >= 0]
    # Postings stand in the order of term and document.
    keys = np.repeat(np.arange(len(chunk.terms)), chunk.df) * chunk.n + chunk.doc
    key = known[term] * chunk.n + place[own[pair]]
    i = np.searchsorted(keys, key)
    hit = np.flatnonzero((i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] == key)) if len(keys) else np.zeros(0, np.int64)
    pair = pair[hit]
    score = np.bincount(pair, weights=w[term[hit]] * chunk.w[i[hit]], minlength=len(own))
    some = np.flatnonzero(np.bincount(pair, minlength=len(own)))
    return qid[q[some]], pid[own[some]], np.round(score[some], 6)


def counted_ahead(block: Block, scope: str, chunk: Chunk):
    """work: qid, pid, ahead, before of the stated pairs that have documents of the chunk before them."""
    qid, _, _, _, score, pid, at = block.scopes[scope]
    ahead, before = np.zeros(len(pid), np.int64), np.zeros(len(pid), np.int64)
    for i, ts, x in block.questions(scope, chunk):
        if len(ts):
            a, b = at[i], at[i + 1]
            ahead[a:b], before[a:b] = chunk.ahead(ts, x, score[a:b], pid[a:b])
    some = np.flatnonzero((ahead > 0) | (before > 0))
    return np.repeat(qid, np.diff(at))[some], pid[some], ahead[some], before[some]


def in_tiles(block: Block, scope: str, chunk: Chunk) -> Iterator[tuple[int, int, np.ndarray]]:
    """First question and the one after the last, and their scores [question, document] with all documents of the chunk, not rounded; about TILE at a time."""
    qid, first, h, w = block.scopes[scope][:4]
    t = chunk.known(h)
    n, of = len(qid), np.repeat(np.arange(len(qid)), np.diff(first))
    row, whole = chunk.frequent
    step = max(1, TILE // chunk.n)
    for a in range(0, n, step):
        b = min(n, a + step)
        q, ts, x = of[first[a] : first[b]] - a, t[first[a] : first[b]], w[first[a] : first[b]]
        r = row[ts]  # of an unknown term: -1, the last row
        dense, few = r >= 0, (r < 0) & (ts >= 0)
        left = np.zeros((b - a, len(whole)))
        left[q[dense], r[dense]] = x[dense]
        s = left @ whole
        q, ts, x = q[few], ts[few], x[few]
        # Parts of about a tile, so that a few long lists do not take more.
        df = chunk.df[ts]
        ends = np.cumsum(df)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(TILE, ends[-1] if len(ends) else 0, TILE)), [0, len(ts)]))
        for i, j in zip(cuts[:-1], cuts[1:]):
            size = df[i:j]
            posting = chunk.postings(ts[i:j], size)
            s += np.bincount(np.repeat(q[i:j] * chunk.n, size) + chunk.doc[posting], weights=np.repeat(x[i:j], size) * chunk.w[posting], minlength=s.size).reshape(s.shape)
        yield a, b, s


def counted_in_tiles(block: Block, scope: str, chunk: Chunk):
    """work: what counted_ahead() gives, for many questions at once."""
    qid, first, h, w, score, pid, at = block.scopes[scope]
    t = chunk.known(h)
    n, of, own = len(qid), np.repeat(np.arange(len(qid)), np.diff(first)), np.repeat(np.arange(len(qid)), np.diff(at))
    ahead, before = np.zeros(len(pid), np.int64), np.zeros(len(pid), np.int64)
    odd = np.zeros(n, bool)
    odd[own[score <= SPARE]] = True
    odd[of[(w <= 0) | (chunk.least * w <= SPARE)]] = True
    for a, b, s in in_tiles(block, scope, chunk):
        for i in range(at[a], at[b]):
            if not odd[own[i]]:
                mine = s[own[i] - a]
                docs = np.flatnonzero(mine >= score[i] - SPARE)
                if len(docs):
                    near, p = np.round(mine[docs], 6), chunk.pids[docs]
                    ahead[i] = np.count_nonzero((near > score[i]) & (p != pid[i]) | ((near == score[i]) & (p < pid[i])))
    for i in np.flatnonzero(odd):
        ts, x = t[first[i] : first[i + 1]], w[first[i] : first[i + 1]]
        if (ts >= 0).any():
            ahead[at[i] : at[i + 1]], before[at[i] : at[i + 1]] = chunk.ahead(ts[ts >= 0], x[ts >= 0], score[at[i] : at[i + 1]], pid[at[i] : at[i + 1]])
    some = np.flatnonzero((ahead > 0) | (before > 0))
    return qid[own[some]], pid[some], ahead[some], before[some]


def summed_in_tiles(block: Block, scope: str, chunk: Chunk):
    """work: qid, pid of all stated pairs; over all documents of the chunk, those without a shared term at 0: how many come before the pair's by score, then
    pid, the sums of exp(score) - 1 and of the squares of the question's scores, and the greatest score."""
    qid, _, _, _, score, pid, at = block.scopes[scope]
    own = np.repeat(np.arange(len(qid)), np.diff(at))
    ahead, sums = np.zeros(len(pid), np.int64), np.zeros((3, len(qid)))
    for a, b, s in in_tiles(block, scope, chunk):
        s = np.round(s, 6)
        for i in range(at[a], at[b]):
            mine, place = s[own[i] - a], np.searchsorted(chunk.pids, pid[i])
            ahead[i] = np.count_nonzero(mine > score[i]) + np.count_nonzero(mine[:place] == score[i])
            if place < chunk.n and chunk.pids[place] == pid[i] and mine[place] > score[i]:
                ahead[i] -= 1  # the pair's own document, whose sum was rounded otherwise
        sums[:, a:b] = np.expm1(s).sum(axis=1), np.einsum("ij,ij->i", s, s), s.max(axis=1)
    return qid[own], pid, ahead, *sums[:, own]
