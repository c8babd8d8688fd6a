"""Same or near-same records across splits, by content-defined chunks.

A record's tokens are cut after every token where a rolling hash of the last WINDOW tokens is 0 modulo CUT, so equal stretches are
cut alike wherever they stand. A chunk's digest covers the chunk and the WINDOW - 1 tokens before it, which decided where it begins.
Chunk digests are joined across sides (train against evaluation).

found(): pairs of records across the sides whose sets (of runs of `k` tokens, or of tokens) have a Jaccard similarity
of at least `threshold`, with the summed lengths of the chunks that the two share as a fraction of either.

* Two such records share chunks that make up at least the fraction `part` of either: only the rarest chunks, up to
  1 - part of a record's tokens, need to meet. The lengths of the chunks that meet are summed by pair; a posting also carries the
  bounds of setjoin.py (sizes and parity bits) and 64 more parity bits, so that nearly only true pairs leave the join, whose whole
  texts are read, however long the lists. Postings of one side meet those of the other.
* The pairs' whole texts are cut again: the lengths of all chunks that they share are summed into the overlap fractions, and the exact
  similarity is checked. A pair is lost only if edits hit so many chunks that less than `part` of it is left whole; the README has
  the measured recall.
* Records of tokens (sets, without an order) are their sorted distinct tokens, a chunk each; then the first
  n - ceil(threshold * n) + 1 are enough, and the join is exact.

fractions(): the sum of the lengths of the chunks that the other side has anywhere, as a fraction of each record.

Copies within one side are one record here and are put back at the end. They are left out by a filter of bits where texts are cut; a copy that
passes it is found with its pairs once more.

Defined results: null and blank texts, records under the least size and records without a side have no overlaps. Repeated
rows count once; an id of both sides takes part on both, but not with itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wikiloom.durable import durable, release, small
from wikiloom.llm import setjoin as S
from wikiloom.llm.profile import SLOTS, Kept, Profile, copies, kept, profile
from wikiloom.llm.tokens import Tokens, distinct, mix, parity_of, runs, slices

CUT, WINDOW, PART = 2, 3, 0.25


def chunks(t: Tokens, cut: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, length) of the chunks of each row."""
    n = len(t.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = t.first[:-1][t.doc]
    at = np.arange(n)
    rolled = runs(t.hash, np.maximum(at - (window - 1), begin), at + 1)
    last = np.zeros(n, bool)
    last[t.first[1:][t.count > 0] - 1] = True
    ends = np.flatnonzero((rolled % np.uint64(cut) == 0) | last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    return t.doc[starts], runs(t.hash, np.maximum(starts - (window - 1), begin[starts]), ends), ends - starts


def postings(df: DataFrame, prof: Profile, k: int, threshold: float, least: int, cut: int, part: float, tokens: bool, only: Kept | None = None) -> DataFrame:
    """Postings as in setjoin.py, the position holding the length of the chunk, with more parity bits; only: of the rows that pass it."""
    bare = prof.bare()

    def run(batches):
        for b in slices(batches):
            t = Tokens(b.column(2))
            if only is not None:
                some = only.passed(b.column(0).to_numpy(), b.column(1), t)
                b, t = b.take(pa.array(some)), t.take(some)
            doc, h = distinct(*t.shingles(k))
            size = np.bincount(doc, minlength=t.n)
            ok = (size >= least) if tokens else (t.count >= least)
            *bits, more = parity_of(doc, h, t.n)
            row, key, length = (doc, h, np.ones(len(h), np.int64)) if tokens else chunks(t, cut)
            freq = bare.codes(key)
            order = np.lexsort((key, freq, row))
            row, key, length, freq = row[order], key[order], length[order], freq[order]
            total = np.cumsum(length) - length
            first = np.diff(row, prepend=-1) != 0
            before = total - np.maximum.accumulate(np.where(first, total, 0))
            limit = (size - np.ceil(threshold * size - 1e-9) + 1)[row] - 1e-9 if tokens else (1 - part) * t.count[row] + 1e-9
            keep = ok[row] & (freq > 1) & (before < limit)
            row, key, length, freq = row[keep], key[keep], length[keep], freq[keep]
            new = (np.diff(row, prepend=-1) != 0) | np.diff(key, prepend=np.uint64(0)).astype(bool)
            row, key, length, freq = row[new], key[new], length[new], freq[new]
            yield from S.emit(b, row, key, np.zeros(len(key), np.int64), length, size, bits, S.parts_of(bare, freq), more)

    return df.mapInArrow(run, f"{S.POSTING_SCHEMA}, c long")


def meet(one: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
    """a, b, shared (a < b) of records of either side: the summed lengths of the chunks that meet."""
    nx, ny = (f"((%s.m >> 23) & {S.SCALE})" % t for t in "xy")
    least = S.need(threshold, nx, ny)
    on = f"""x.key = y.key and x.id != y.id
        and (({nx} < {S.SCALE} and {ny} < {S.SCALE}
              and {nx} >= {threshold!r}D * {ny} - 1e-9D and {ny} >= {threshold!r}D * {nx} - 1e-9D
              and bit_count(x.b ^ y.b) + bit_count(x.c ^ y.c) + bit_count((x.m ^ y.m) >> 43) <= {nx} + {ny} - 2 * {least})
             or greatest({nx}, {ny}) = {S.SCALE} and least({nx}, {ny}) >= {threshold!r}D * {S.SCALE} - 1)"""
    pairs = one.alias("x").join(other.alias("y"), F.expr(on)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.expr(f"least((x.m >> 3) & {S.SCALE}, (y.m >> 3) & {S.SCALE}) - 1").alias("length"))
    return pairs.groupBy("a", "b").agg(F.sum("length").alias("shared"))


def common(row: np.ndarray, digest: np.ndarray, length: np.ndarray, other_row: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each chunk, whether the row of the same number on the other side has it."""
    return np.isin(digest + mix(row.astype(np.uint64)), other + mix(other_row.astype(np.uint64)))


def weigh(df: DataFrame, pairs: DataFrame, sets, cut_, threshold: float) -> DataFrame:
    """a, b, fraction_a, fraction_b, similarity of the pairs that reach the threshold, on whole texts: the summed lengths of the chunks
    of each record that the other has, as fractions, and the similarity of their sets. cut_: Tokens -> (row, digest, length)."""

    def run(batches):
        for b in slices(batches):
            similarity = S.jaccard(Tokens(b.column(2)), Tokens(b.column(3)), sets)
            near = np.flatnonzero(similarity >= threshold - 1e-9)
            # Only the chunks of pairs that reach the threshold are cut.
            b, similarity = b.take(pa.array(near)), similarity[near]
            ta, tb = Tokens(b.column(2)), Tokens(b.column(3))
            ca, cb = cut_(ta), cut_(tb)
            fa = np.bincount(ca[0], weights=ca[2] * common(*ca, *cb[:2]), minlength=ta.n) / np.maximum(np.bincount(ca[0], weights=ca[2], minlength=ta.n), 1)
            fb = np.bincount(cb[0], weights=cb[2] * common(*cb, *ca[:2]), minlength=tb.n) / np.maximum(np.bincount(cb[0], weights=cb[2], minlength=tb.n), 1)
            good = np.flatnonzero((fa > 0) & (fb > 0))
            at = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(x[good]) for x in (fa, fb, similarity))], names=["a", "b", "fraction_a", "fraction_b", "similarity"])

    return S.with_texts(df, pairs).mapInArrow(run, "a long, b long, fraction_a double, fraction_b double, similarity double")


def sided(df: DataFrame, key: str, text: str, split: str) -> DataFrame:
    """id, side, text: side train, or eval for val and test; other rows have no side and are left out."""
    side = F.when(F.col(split) == "train", "train").when(F.col(split).isin("val", "test"), "eval")
    return df.select(F.col(key).cast("long").alias("id"), side.alias("side"), F.lower(text).alias("text")).where("id is not null and side is not null and text is not null")


def found(df: DataFrame, key: str, text: str, split: str, k: int = 5, threshold: float = 0.8, least: int | None = None, tokens: bool = False, cut: int = CUT, part: float = PART, slots: int = SLOTS) -> DataFrame:
    """a, b (a < b), fraction_a, fraction_b of the pairs across train and evaluation. tokens: compare sets of tokens of at least `least` elements."""
    k = 1 if tokens else k
    least = least or k
    docs = sided(df, key, text, split)

    def cut_(t: Tokens):
        row, h = distinct(*t.shingles(1)) if tokens else (None, None)
        return (row, h, np.ones(len(h), np.int64)) if tokens else chunks(t, cut)

    def keys(t: Tokens) -> np.ndarray:
        row, h, _ = cut_(t)
        return distinct(row, h)[1]

    prof = profile(docs, keys, least, slots)
    same, first = copies(prof.rows), kept(prof.rows)
    release(prof.rows)
    sides = (postings(docs.where(F.col("side") == x), prof, k, threshold, least, cut, part, tokens, first) for x in ("eval", "train"))
    near = durable(meet(*sides, threshold))
    pairs = durable(weigh(docs, near.select("a", "b"), S.shingle_sets(k), cut_, threshold))
    release(near)
    of = members(docs, pairs, same)
    release(same)
    return spread(pairs, of)


def members(docs: DataFrame, pairs: DataFrame, same: DataFrame) -> DataFrame:
    """rep, id, sides (1 train, 2 evaluation, 3 both) of the members of the classes of all records of pairs."""
    ends = durable(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    of = durable(same.select("rep", "id").join(small(ends, 16), "rep", "left_semi").unionByName(ends.select("rep", F.col("rep").alias("id"))).distinct())
    sides = docs.select("id", F.when(F.col("side") == "train", 1).otherwise(2).alias("side")).join(small(of.select("id"), 16), "id", "left_semi").groupBy("id").agg(F.bit_or("side").alias("sides"))
    return durable(of.join(sides, "id").select("rep", "id", "sides"))


def spread(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs of class representatives as pairs of all their members across the sides (a < b), each with its class's fraction."""
    x, y = (small(of.select(F.col("rep").alias(c), F.col("id").alias(f"i{c}"), F.col("sides").alias(f"s{c}")), 24) for c in "ab")
    wide = pairs.join(x, "a").join(y, "b").where("ia != ib and (sa | sb) = 3").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "fraction_a", "fraction_b")
    wide = wide.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("if(a < b, fraction_a, fraction_b)").alias("fraction_a"), F.expr("if(a < b, fraction_b, fraction_a)").alias("fraction_b"))
    return wide.groupBy("a", "b").agg(F.max("fraction_a").alias("fraction_a"), F.max("fraction_b").alias("fraction_b"))


def fractions(df: DataFrame, key: str, text: str, split: str, cut: int = 8) -> DataFrame:
    """id, side, n_tokens, shared: per record the fraction of its tokens in chunks that the other side has too."""
    docs = sided(df, key, text, split).distinct()

    def run(batches):
        for b in slices(batches):
            t = Tokens(b.column(2))
            row, h, length = chunks(t, cut)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(h.view(np.int64)), pa.array(length.astype(np.int32))], names=["id", "side", "chunk", "length"])

    rows = docs.mapInArrow(run, "id long, side string, chunk long, length int")
    sides = rows.groupBy("chunk").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    both = sides.where("lo != hi").select("chunk", F.lit(True).alias("met"))
    return rows.join(both, "chunk", "left").groupBy("id", "side").agg(F.sum("length").alias("n_tokens"), F.round(F.sum(F.when(F.col("met"), F.col("length")).otherwise(0)) / F.sum("length"), 6).alias("shared"))
