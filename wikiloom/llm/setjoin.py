"""Near-duplicate records: a size-aware heavy-light join over sets of token sequences.

Records are the sets of their distinct runs of `k` tokens; two are linked if their Jaccard similarity is at least
`threshold`. The join is exact.

1. profile(): one pass; a digest of each record's tokens, how often each run occurs, and how long the runs' lists are.
2. Records with the same tokens are one class; only its representative goes on.
3. A record of n runs shares at least c = ceil(threshold * n) of them with any partner. With its runs in the shared
   order, rarest first, two partners share at least m runs within their first n - c + m.
   * Light (small) sets enumerate subsets of two runs. Runs fall into CLASSES classes by hash; of the CLASSES + 1 runs that two
     partners share within their first n - c + CLASSES + 1, two are of one class. So only pairs of runs of one class are
     enumerated: a key is two runs, and its list stays short even where the lists of single runs are long.
   * Heavy (large) sets put their first n - c + 1 runs into inverted lists, which are scanned.
   * Light sets that may have a heavy partner are in the inverted lists too, for the heavy ones only.
   The boundary is the largest size at which enumerating costs no more than scanning: C(n - c + CLASSES + 1, 2) / CLASSES
   postings against n - c + 1 postings and the entries of their lists, whose mean length profile() has counted; to scan an
   entry costs SCAN of what it costs to make, send and sort a posting. Enumerating is also kept to MORE times the postings
   of scanning, since postings are disk as well as time.
4. Equal keys meet in a join. A posting carries the record's size, the run's position and 84 parity bits of the
   record's set, four integers in all; size, position and parity bound the overlap, so that nearly only true pairs leave
   the join. Runs that are known to occur once are not posted.
5. Pairs are verified on the records' whole texts.

Frequent runs are late in the order and hardly ever among a record's first. A list that is long all the same is cut into
parts of about PIECE entries by a hash of the ids, and every two parts meet under a key of their own, so no task scans more than
PIECE entries against PIECE others for one key, however long the list. Nothing is cut off, and no group is collected.

Defined results: null, blank and short records (under min_tokens tokens) have no links. Repeated rows count once. An
id that stands for several texts takes part with each. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wikiloom.durable import durable, release, small
from wikiloom.llm.profile import SLOTS, Profile, copies, list_length, profile
from wikiloom.llm.tokens import Tokens, distinct, in_rows, mix, parity, positions, slices

_EPS = 1e-9


@dataclass
class Linked:
    """pairs: a, b, similarity of class representatives (a < b); copies: id, rep, side of rows that repeat another's tokens."""

    pairs: DataFrame
    copies: DataFrame


def shingle_keys(k: int, min_tokens: int):
    def keys(t: Tokens) -> np.ndarray:
        doc, h = t.shingles(k)
        doc, h = distinct(doc, h)
        return h[t.count[doc] >= min_tokens]

    return keys


SCAN, MORE, CLASSES, PIECE = 0.1, 2.5, 4, 4096


def costs(n: int, threshold: float, mean_list: float) -> tuple[float, float, float]:
    """For a set of n runs: postings of enumerating, postings of scanning, cost of scanning in postings."""
    spare = n - math.ceil(threshold * n - _EPS)
    return (spare + CLASSES + 1) * (spare + CLASSES) / 2 / CLASSES, spare + 1, (spare + 1) * (1 + SCAN * mean_list)


def boundary(threshold: float, mean_list: float) -> int:
    """The largest set size at which enumerating subsets costs no more than scanning inverted lists; 0 for none."""
    best, n = 0, math.floor(CLASSES / threshold) + 1
    while True:
        light, heavy, scan = costs(n, threshold, mean_list)
        if light <= scan and light <= MORE * heavy:
            best = n
        elif light > MORE * heavy and heavy > CLASSES:  # from here on the ratio only grows
            return best
        n += 1


def need(threshold: float, a: str, b: str) -> str:
    """SQL: the overlap that sets of these sizes must have."""
    return f"ceil({threshold / (1 + threshold)!r}D * ({a} + {b}) - 1e-9D)"


SCALE = (1 << 20) - 1  # the largest size and position that a posting holds; beyond it they bound nothing

POSTING = ["key", "id", "b", "m"]
POSTING_SCHEMA = "key long, id long, b long, m long"
#: Postings of one Arrow batch.
AT_ONCE = 1 << 20


def parts_of(prof: Profile, codes: np.ndarray) -> np.ndarray:
    """Into how many parts the lists of keys with these codes are cut. Up to a quarter of the load may be other keys' occurrences."""
    excess = prof.excess(codes)
    return np.where(excess > max(2 * PIECE, prof.load / 4), np.ceil(excess / PIECE), 1).astype(np.int64)


def emit(batch, row: np.ndarray, key: np.ndarray, kind: np.ndarray, pos: np.ndarray, size: np.ndarray, bits, parts: np.ndarray, more: np.ndarray | None = None):
    """Batches of postings; m holds 20 parity bits, then 20 bits of size, 20 of position plus 1, 2 of kind, 1 of side (train). more: a column c by row.

    parts: into how many parts the list of each posting is cut; a posting goes to the keys of its own part with every part.
    """
    train = np.fromiter((x == "train" for x in batch.column(1).to_pylist()), bool, batch.num_rows)
    own = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))
    ends = np.cumsum(parts)
    for at in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        n = np.arange(at, min(at + AT_ONCE, int(ends[-1])))
        i = np.searchsorted(ends, n, "right")
        r, k, p = row[i], key[i], parts[i].astype(np.uint64)
        other, mine = (n - (ends[i] - parts[i])).astype(np.uint64), own[row[i]] % p
        k = np.where(p > 1, mix(k + mix(np.minimum(mine, other) * p + np.maximum(mine, other) + np.uint64(1))), k)
        m = (bits[1][r] << 43) | (np.minimum(size[r], SCALE) << 23) | (np.minimum(pos[i] + 1, SCALE) << 3) | (kind[i].astype(np.int64) << 1) | train[r].astype(np.int64)
        columns = [pa.array(k.view(np.int64)), batch.column(0).take(pa.array(r)), pa.array(bits[0][r]), pa.array(m)]
        yield pa.RecordBatch.from_arrays(columns if more is None else [*columns, pa.array(more[r])], names=POSTING if more is None else [*POSTING, "c"])


def postings(df: DataFrame, prof: Profile, k: int, threshold: float, min_tokens: int, limit: int) -> DataFrame:
    """The keys of each record: kind 0 a run of a heavy set, 1 a run of a light one, 2 a subset of two runs of a light one."""
    bare = prof.bare()

    def run(batches):
        for b in slices(batches):
            t = Tokens(b.column(2))
            doc, h = t.shingles(k)
            doc, h = distinct(doc, h)
            ok = t.count[doc] >= min_tokens
            doc, h = doc[ok], h[ok]
            if not len(h):
                continue
            bits = parity(doc, h, t.n)
            freq = bare.codes(h)
            order = np.lexsort((h, freq, doc))
            h, freq = h[order], freq[order]
            size, pos = positions(doc, t.n)
            spare = size - np.ceil(threshold * size - _EPS).astype(np.int64)
            light = (size <= limit) & (size - spare > CLASSES)  # a set that must share fewer runs has no two of one class for certain
            # A run with code 1 is in this record only.
            once = (pos <= spare[doc]) & (freq > 1) & (~light | (size / threshold > limit) | (size <= CLASSES / threshold**2))[doc]
            yield from emit(b, doc[once], h[once], light[doc[once]], pos[once], size, bits, parts_of(bare, freq[once]))
            among = (pos <= spare[doc] + CLASSES) & light[doc] & (freq > 1)
            d2, h2, f2 = doc[among], h[among], freq[among]
            group = d2 * CLASSES + (mix(h2) % np.uint64(CLASSES)).astype(np.int64)
            order = np.lexsort((h2, f2, group))
            d2, h2, f2, group = d2[order], h2[order], f2[order], group[order]
            pairs = [np.flatnonzero(group[gap:] == group[:-gap]) for gap in range(1, int(np.bincount(group).max(initial=0)))]
            if pairs:
                i, j = np.concatenate(pairs), np.concatenate([x + gap for gap, x in enumerate(pairs, 1)])
                yield from emit(b, d2[i], mix(h2[i] + mix(h2[j])), np.full(len(i), 2), np.full(len(i), -1), size, bits, parts_of(bare, np.minimum(f2[i], f2[j])))

    return df.mapInArrow(run, POSTING_SCHEMA)


def candidates(post: DataFrame, threshold: float, cross: bool = False) -> DataFrame:
    """Distinct a, b (a < b) whose postings allow the similarity; cross: only pairs of different sides."""
    nx, ny = (f"((%s.m >> 23) & {SCALE})" % t for t in "xy")
    px, py = (f"(((%s.m >> 3) & {SCALE}) - 1)" % t for t in "xy")
    least = need(threshold, nx, ny)
    on = f"""x.key = y.key and x.id < y.id and ((x.m & 6) != 2 or (y.m & 6) != 2)
        and (({nx} < {SCALE} and {ny} < {SCALE}
              and {nx} >= {threshold!r}D * {ny} - 1e-9D and {ny} >= {threshold!r}D * {nx} - 1e-9D
              and least({nx} - {px}, {ny} - {py}) >= {least}
              and bit_count(x.b ^ y.b) + bit_count((x.m ^ y.m) >> 43) <= {nx} + {ny} - 2 * {least})
             or greatest({nx}, {ny}) = {SCALE} and least({nx}, {ny}) >= {threshold!r}D * {SCALE} - 1)"""
    if cross:
        on += " and ((x.m ^ y.m) & 1) != 0"
    return post.alias("x").join(post.alias("y"), F.expr(on)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def jaccard(a: Tokens, b: Tokens, sets) -> np.ndarray:
    """Of each row, the similarity of its two sets. sets: Tokens -> distinct (row, hash)."""
    (da, ha), (db, hb) = sets(a), sets(b)
    doc, h = np.concatenate([da, db]), np.concatenate([ha, hb])
    order = in_rows(doc, h)
    doc, h = doc[order], h[order]
    both = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=a.n)
    return both / np.maximum(np.bincount(da, minlength=a.n) + np.bincount(db, minlength=a.n) - both, 1)


def with_texts(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, text_a, text_b of the pairs."""
    ends = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = df.join(small(ends, 16), "id", "left_semi").select("id", "text").distinct()
    x = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    y = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")


def verify(df: DataFrame, pairs: DataFrame, sets, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs that reach the threshold, computed on whole texts."""

    def run(batches):
        for b in slices(batches):
            similarity = jaccard(Tokens(b.column(2)), Tokens(b.column(3)), sets)
            good = np.flatnonzero(similarity >= threshold - _EPS)
            at = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(similarity[good])], names=["a", "b", "similarity"])

    return with_texts(df, pairs).mapInArrow(run, "a long, b long, similarity double")


def shingle_sets(k: int):
    return lambda t: distinct(*t.shingles(k))


def representatives(df: DataFrame, same: DataFrame) -> DataFrame:
    """The rows of df without those that repeat a smaller id's tokens; other texts of the same id stay."""
    rest = small(same.where("id != rep").select(F.col("id").alias("_id"), F.col("side").alias("_side"), "d1", "d2"), 56)
    on = lambda x: (x["id"] == rest["_id"]) & x["side"].eqNullSafe(rest["_side"])
    keys = df.columns

    def digests(batches):
        for b in slices(batches):
            d1, d2 = Tokens(b.column(keys.index("text"))).digest()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=[*keys, "_d1", "_d2"])

    # Only texts of ids that have a copied text need their digest.
    unsure = df.join(rest, on(df), "left_semi").mapInArrow(digests, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "_d1 long", "_d2 long"]))
    other = unsure.join(rest, on(unsure) & (unsure["_d1"] == rest["d1"]) & (unsure["_d2"] == rest["d2"]), "left_anti").select(*keys)
    return df.join(rest, on(df), "left_anti").unionByName(other)


def prepare(df: DataFrame, key: str, text: str, side: str | None = None) -> DataFrame:
    """id, side, text (lower-cased) of the rows that can count; clashing names of other columns play no part."""
    return df.select(F.col(key).cast("long").alias("id"), (F.col(side) if side else F.lit(None)).cast("string").alias("side"), F.lower(text).alias("text")).where("id is not null and text is not null")


def similar(df: DataFrame, key: str, text: str, k: int = 5, threshold: float = 0.8, min_tokens: int | None = None, slots: int = SLOTS) -> Linked:
    """All links of the records of df."""
    least = max(k, min_tokens or k)
    docs = prepare(df, key, text)
    prof = profile(docs, shingle_keys(k, least), least, slots)
    same = copies(prof.rows)
    release(prof.rows)
    reps = representatives(docs, same)
    post = postings(reps, prof, k, threshold, least, boundary(threshold, list_length(prof.lengths, 1 - threshold)))
    found = durable(candidates(post, threshold, cross=False))
    return Linked(verify(reps, found, shingle_sets(k), threshold), same)


def expanded(linked: Linked, within: bool = True) -> DataFrame:
    """a, b of all linked rows, copies included: members of linked classes and, if asked, of one class with each other."""
    of = linked.copies.select("rep", "id")
    x = of.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    y = of.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = linked.pairs.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ia", "a").alias("a"), F.coalesce("ib", "b").alias("b"))
    if within:
        across = across.unionByName(of.alias("x").join(of.alias("y"), F.expr("x.rep = y.rep and x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def classes(df: DataFrame, key: str, linked: Linked) -> DataFrame:
    """One row per record: id, class_id (the smallest id with the same tokens) and n_links, the links of its class to other classes."""
    pairs = durable(linked.pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    ids = df.select(F.col(key).cast("long").alias("id")).where("id is not null").distinct()
    rep = linked.copies.groupBy("id").agg(F.min("rep").alias("rep"))
    return ids.join(rep, "id", "left").select("id", F.coalesce("rep", "id").alias("class_id")).join(links, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
