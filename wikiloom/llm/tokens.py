"""Token, shingle and chunk hashes of Arrow batches, computed over whole arrays.

A token is a maximal run of letters and digits of the lower-cased text. Its hash is a polynomial over its code
points, read off one running sum over the batch, so no token ever becomes a Python object. All hashes are 64 bits
and the same in every task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K1, _K2, _K3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_old = np.seterr(over="ignore")

#: Rows that are worked on at once.
ROWS = 4096


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_B, _BI)):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each run."""
    p, inverse = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _K3)


class Tokens:
    """Token hashes of a batch: hash, doc (row of each token) and first (index of each row's first token, and the end)."""

    def __init__(self, texts: pa.Array):
        values = [t or "" for t in texts.to_pylist()]
        n = len(values)
        lengths = np.fromiter(map(len, values), np.int64, n)
        cp = np.frombuffer("\n".join([*values, ""]).encode("utf-32-le"), np.uint32)
        inside = np.zeros(len(cp) + 2, bool)
        inside[1:-1] = _alnum()[cp]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        begin = np.zeros(n + 1, np.int64)
        np.cumsum(lengths + 1, out=begin[1:])
        self.n = n
        self.first = np.searchsorted(starts, begin)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.count)
        self.hash = runs(mix(cp.astype(np.uint64) + _K3), starts, ends)

    def take(self, rows: np.ndarray) -> Tokens:
        """The tokens of some rows, in their order."""
        some = np.zeros(self.n, bool)
        some[rows] = True
        t = object.__new__(Tokens)
        t.n, t.count, t.hash = len(rows), self.count[rows], self.hash[some[self.doc]]
        t.first = np.concatenate([[0], np.cumsum(t.count)])
        t.doc = np.repeat(np.arange(t.n), t.count)
        return t

    def digest(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit digests of each row's token sequence."""
        a, b = self.first[:-1], self.first[1:]
        return runs(self.hash, a, b), runs(mix(self.hash + _K1), a, b)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every run of k tokens of one row."""
        last = len(self.hash) - k + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(last, np.uint64)
        for i in range(k):
            h = mix(h * _B + self.hash[i : i + last] + np.uint64(i + 1))
        same = self.doc[:last] == self.doc[k - 1 :]
        return self.doc[:last][same], h[same]


def in_rows(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by (row, hash), by one sort of the row above the hash's upper bits; by both where those leave two hashes of a row undecided."""
    if not len(h):
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(doc.max()).bit_length()))
    key = (doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)
    order = np.argsort(key)
    key, low = key[order], h[order]
    return np.lexsort((h, doc)) if np.any((key[1:] == key[:-1]) & (low[1:] != low[:-1])) else order


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash), sorted."""
    order = in_rows(doc, h)
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]


def positions(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: the size of each of n rows, and the position of each element in its row."""
    size = np.bincount(doc, minlength=n)
    first = np.zeros(n, np.int64)
    np.cumsum(size[:-1], out=first[1:])
    return size, np.arange(len(doc)) - first[doc]


PARITY = 84


def parity(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """PARITY parity bits of each row's set, as an integer of 64 and one of 20. Two rows differ in no more bits than in elements."""
    at = doc * PARITY + ((h >> np.uint64(32)) * np.uint64(PARITY) >> np.uint64(32)).astype(np.int64)
    bits = (np.bincount(at, minlength=n * PARITY) & 1).astype(np.uint8).reshape(n, PARITY)
    packed = np.packbits(bits, axis=1)
    rest = packed[:, 8:].astype(np.int64)
    return packed[:, :8].copy().view(np.int64)[:, 0], (rest[:, 0] << 12) | (rest[:, 1] << 4) | (rest[:, 2] >> 4)


def parity_of(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PARITY + 64 parity bits of each row's set, as integers of 64, 20 and 64, for which holds what does for parity()."""
    bits = PARITY + 64
    at = doc * bits + ((h >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits), axis=1)
    one, more = (packed[:, i : i + 8].copy().view(np.int64)[:, 0] for i in (0, 8))
    rest = packed[:, 16:].astype(np.int64)
    return one, (rest[:, 0] << 12) | (rest[:, 1] << 4) | (rest[:, 2] >> 4), more


def slices(batches, rows: int = ROWS, size: int | None = None):
    """The batches in slices of limited rows, and of limited bytes if size is given (a larger row is a slice of its own)."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            parts = [b.slice(at, rows)]
            while parts:
                x = parts.pop()
                if size is not None and x.num_rows > 1 and x.nbytes > size:
                    half = x.num_rows // 2
                    parts += [x.slice(half), x.slice(0, half)]
                else:
                    yield x
