"""One pass over a text table: a digest of each row's tokens, how often each key occurs, and how long the keys' lists are.

Three things come out of the pass, and all of them see every row:

* rows: the digest and number of tokens of each row that counts.
* counters: 2**SLOTS exact sums of occurrences by slot of the key, sent to the tasks as one byte each on a logarithmic scale (STEPS
  codes a doubling, so a counter holds up to 2**31). A counter is never below its keys' occurrences. While the corpus has
  fewer distinct keys than slots, a counter of 1 proves that a key occurs once and needs no posting. In a larger one slots are
  shared: a key that occurs f times has a counter near f plus the mean load, so frequent keys still stand out from the load and go
  last, and rare ones are in an order that all tasks share. Nothing changes its meaning or its cost at a size: the postings
  of a record are bounded by the record's prefix, whatever the counters hold.
* lengths: the exact numbers of occurrences of the keys in one KEY_SHARE-th of the key space, as a histogram on the same scale. It
  tells list lengths without the load.

Each task adds up its own rows; the partial tables are merged by chunk on the executors and only the merged table, 16 MB of one
byte a slot, comes to the driver to be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wikiloom.durable import durable, release
from wikiloom.llm.tokens import Tokens, mix, slices

SLOTS = 24
CHUNK = 1 << 16
STEPS = 8
#: One of this many keys has its occurrences counted exactly.
KEY_SHARE = 64


def slot(keys: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    return (keys >> np.uint64(64 - slots)).astype(np.int64)


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte: 0 for none, 1 for one, STEPS more for each doubling."""
    return np.where(counts > 0, np.round(STEPS * np.log2(np.maximum(counts, 1))) + 1, 0).clip(0, 255).astype(np.uint8)


def decoded(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 2.0 ** ((codes.astype(np.float64) - 1) / STEPS), 0.0)


def pack(table: np.ndarray):
    for at in range(0, len(table), CHUNK):
        part = table[at : at + CHUNK]
        if part.any():
            yield at // CHUNK, pa.compress(part.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def list_length(lengths: dict[int, int], part: float) -> float:
    """The mean list length over the rarest part of all occurrences; lengths: keys by code of their number of occurrences."""
    f = decoded(np.arange(256))
    mass = np.array([lengths.get(c, 0) for c in range(256)]) * f
    share = np.diff(np.minimum(np.cumsum(mass), part * mass.sum()), prepend=0.0)
    return float((share * f).sum() / share.sum()) if share.sum() else 1.0


@dataclass
class Profile:
    """rows: id, side, d1, d2, n (tokens) of each row that counts; lengths: see list_length(); counters: the broadcast codes of 2**slots
    counters; load: mean occurrences a slot."""

    rows: DataFrame | None
    lengths: dict[int, int]
    counters: object
    load: float
    slots: int = SLOTS

    def bare(self) -> Profile:
        """Without what stays on the driver."""
        return Profile(None, {}, self.counters, self.load, self.slots)

    def codes(self, keys: np.ndarray) -> np.ndarray:
        return self.counters.value[slot(keys, self.slots)]

    def excess(self, codes: np.ndarray) -> np.ndarray:
        """About how often keys with these codes occur beyond what others of their slot do."""
        return decoded(codes) - self.load


def profile(df: DataFrame, keys: Callable[[Tokens], np.ndarray], min_tokens: int, slots: int = SLOTS) -> Profile:
    """df has the columns id, side and text (lower-cased). keys gives all keys of a batch, once a row."""
    names = ["id", "side", "d1", "d2", "n", "chunk", "counts", "key"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]

    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, t)) for c, t in zip(names, types)], names=names)

    def run(batches):
        table = np.zeros(1 << slots, np.uint32)
        for b in slices(batches):
            t = Tokens(b.column(2))
            enough = np.flatnonzero(t.count >= min_tokens)
            if not len(enough):
                continue
            d1, d2 = t.digest()
            found = keys(t)
            u, n = np.unique(slot(found, slots), return_counts=True)
            table[u] += n.astype(np.uint32)
            at = pa.array(enough)
            yield batch(len(enough), id=b.column(0).take(at), side=b.column(1).take(at), d1=pa.array(d1[enough].view(np.int64)), d2=pa.array(d2[enough].view(np.int64)), n=pa.array(t.count[enough].astype(np.int32)))
            some = found[mix(found) % np.uint64(KEY_SHARE) == 0]
            if len(some):
                yield batch(len(some), key=pa.array(some.view(np.int64)))
        packed = list(pack(table))
        if packed:
            yield batch(len(packed), chunk=pa.array([c for c, _ in packed], types[5]), counts=pa.array([x for _, x in packed], types[6]))

    out = durable(df.select("id", "side", "text").mapInArrow(run, "id long, side string, d1 long, d2 long, n int, chunk int, counts binary, key long"))

    def merge(t: pa.Table) -> pa.Table:
        total = np.zeros(min(CHUNK, 1 << slots), np.int64)
        for blob in t.column("counts"):
            total += unpack(blob.as_py(), np.uint32, len(total))
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "total": pa.array([int(total.sum())], pa.int64()), "counts": pa.array([pa.compress(coded(total).tobytes(), "zstd", asbytes=True)], pa.binary())})

    counters, total = np.zeros(1 << slots, np.uint8), 0
    for row in out.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(merge, "chunk int, total long, counts binary").collect():
        counters[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = unpack(bytes(row.counts), np.uint8, min(CHUNK, 1 << slots))
        total += row.total
    seen = out.where("key is not null").groupBy("key").agg(F.count("*").alias("f")).groupBy(F.round(STEPS * F.log2("f") + 1).cast("int").alias("code")).agg(F.count("*").alias("n"))
    lengths = {min(r.code, 255): r.n for r in seen.collect()}
    shared = df.sparkSession.sparkContext.broadcast(counters)
    return Profile(out.where("id is not null").select("id", "side", "d1", "d2", "n"), lengths, shared, total / (1 << slots), slots)


def copies(rows: DataFrame) -> DataFrame:
    """id, rep, side, d1, d2 of every row whose tokens another row of its side repeats; rep is the smallest id of that class.

    Written to the shared folder. Ids that no other row repeats are their own class and are left out.
    """
    rows = rows.select("id", "side", "d1", "d2").distinct()
    many = rows.groupBy("side", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    on = F.expr("x.side <=> y.side and x.d1 = y.d1 and x.d2 = y.d2")
    return durable(rows.alias("x").join(many.alias("y"), on).select("x.id", "y.rep", "x.side", "x.d1", "x.d2"))


#: Bits of a filter for each row, and of a filter at most, as powers of two: 16 MB.
BITS_A_ROW, MOST_BITS = 4, 27


def _probes(ids: np.ndarray, train: np.ndarray, d1: np.ndarray, d2: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in 2**bits bits of each row."""
    h = mix(ids.astype(np.uint64) + mix(d1.view(np.uint64) + mix(d2.view(np.uint64) + train.astype(np.uint64))))
    return tuple((x >> np.uint64(64 - bits)).astype(np.int64) for x in (h, mix(h + np.uint64(1))))


def is_train(side) -> np.ndarray:
    return np.fromiter((x == "train" for x in side.to_pylist()), bool, len(side))


@dataclass
class Kept:
    """A filter that passes the first row of each class of copies; of the other rows it passes few, and more as its bits fill up."""

    table: object
    bits: int

    def passed(self, ids: np.ndarray, side, t: Tokens) -> np.ndarray:
        d1, d2 = t.digest()
        one, two = (self.table.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in _probes(ids, is_train(side), d1, d2, self.bits))
        return np.flatnonzero(one & two)


def kept(rows: DataFrame) -> Kept:
    """The filter of rows (id, side, d1, d2): nothing is joined with texts, and no text is shuffled to leave copies out."""
    first = durable(rows.groupBy("side", "d1", "d2").agg(F.min("id").alias("id")))
    bits = min(MOST_BITS, max(10, first.count().bit_length() + BITS_A_ROW))
    size = min(CHUNK, 1 << (bits - 3))

    def place(batches):
        for b in batches:
            at = np.unique(np.concatenate(_probes(b.column(0).to_numpy(), is_train(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy(), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 3) // size), pa.array((at >> 3) % size * 8 + (at & 7))], names=["chunk", "at"])

    def merge(t: pa.Table) -> pa.Table:
        flags = np.zeros(size * 8, np.uint8)
        flags[t.column("at").to_numpy()] = 1
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "bits": pa.array([pa.compress(np.packbits(flags, bitorder="little").tobytes(), "zstd", asbytes=True)], pa.binary())})

    table = np.zeros(1 << (bits - 3), np.uint8)
    for row in first.select("id", "side", "d1", "d2").mapInArrow(place, "chunk long, at long").groupBy("chunk").applyInArrow(merge, "chunk long, bits binary").collect():
        table[row.chunk * size : (row.chunk + 1) * size] = unpack(bytes(row.bits), np.uint8, size)
    release(first)
    return Kept(rows.sparkSession.sparkContext.broadcast(table), bits)
