"""Cutting oversized items into pieces under a limit, at natural boundaries, with a stated overlap.

The word offsets of an item are a sorted array of prefix positions. From a piece's first word the furthest end
under both limits is found by binary search over the ends; the last paragraph, line or sentence boundary at or
before it, if half of the text stays before it, by binary search over the sorted boundary array of that level, else the last
boundary of any level; the next piece begins `overlap` words back. Where no boundary lies in reach the cut falls between two words, and within a word only if that word alone
is over the limit. Only oversized items reach Python: the JVM compares sizes and leaves the rest at the scan.

Defined results: null and blank items and items within the limits give no rows. Offsets count code points of the
item as it is, so item[start:end] is the piece's text. An overlap that would leave no room for new text is
shortened for that piece. Repeated rows count once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_WORDS, MAX_CHARS, OVERLAP = 120, 900, 20

_WORD = re.compile(r"[^ \t\r\n]+")
_LINES = re.compile(r"(?:\r\n?|\n)[ \t]*(?=[\r\n])")
_LINE = re.compile(r"[\r\n]")
#: Characters that end a sentence, and those that may close it.
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'’”»)\]]*$")
KINDS = ("word", "sentence", "line", "paragraph")


def oversized(text: Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> Column:
    """Whether an item is over a limit; the words are counted only where the length does not tell already."""
    words = F.size(F.split(F.regexp_replace(text, "^[ \t\r\n]+|[ \t\r\n]+$", ""), "[ \t\r\n]+"))
    return (F.char_length(text) > max_chars) | ((F.char_length(text) > 2 * max_words) & (words > max_words))


def cut(text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str]]:
    """(start, end, words, words shared with the piece before, kind of the cut at its end) of each piece."""
    starts, ends, level = [], [], []
    for m in _WORD.finditer(text):
        a, b = m.span()
        gap = text[ends[-1] : a] if ends else ""
        if ends:
            level[-1] = 3 if _LINES.search(gap) else 2 if _LINE.search(gap) else 1 if _SENTENCE.search(text, max(0, ends[-1] - 8), ends[-1]) else 0
        for at in range(a, b, max_chars):  # a word over the limit is cut hard
            starts.append(at)
            ends.append(min(b, at + max_chars))
            level.append(0)
    if not starts:
        return []
    n = len(starts)
    #: Boundary arrays: ends (exclusive word indices) after which a unit of that level or a higher one is over.
    bounds = [[i + 1 for i in range(n) if level[i] >= k] for k in (3, 2, 1)]
    size = list(accumulate((e - s for s, e in zip(starts, ends)), initial=0))
    reach = lambda s: min(s + max_words, bisect_right(ends, starts[s] + max_chars))
    out, s, covered = [], 0, 0
    while True:
        most = reach(s)
        end, kind = most, "end" if most == n else "word"
        if most < n:
            # A boundary is taken if the piece then keeps half of its text.
            for k, b in zip((3, 2, 1), bounds):
                i = bisect_right(b, most) - 1
                if i >= 0 and b[i] > covered and size[b[i]] - size[s] >= (size[most] - size[s]) // 2:
                    end, kind = b[i], KINDS[k]
                    break
            else:
                # No boundary keeps half of the text: then the last one of any kind that brings new text.
                i = bisect_right(bounds[-1], most) - 1
                if i >= 0 and bounds[-1][i] > covered:
                    end, kind = bounds[-1][i], KINDS[level[bounds[-1][i] - 1]]
        out.append((starts[s], ends[end - 1], end - s, covered - s, kind))
        if end == n:
            return out
        covered = end
        s = bisect_left(range(n), True, lo=max(0, end - overlap), hi=end, key=lambda i: reach(i) > end)


def split(df: DataFrame, keys: list[str], text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """keys and piece, start, end, n_words, n_shared, cut, text of each piece of the oversized items."""
    if not 0 <= overlap < max_words:
        raise ValueError("the overlap must be below the word limit")
    names = [*keys, "piece", "start", "end", "n_words", "n_shared", "cut", "text"]

    def run(batches):
        for b in batches:
            rows, cols = [], [[] for _ in range(7)]
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                for p, (a, z, words, shared, kind) in enumerate(cut(t, max_words, max_chars, overlap)):
                    rows.append(i)
                    for c, v in zip(cols, (p, a, z, words, shared, kind, t[a:z])):
                        c.append(v)
            at = pa.array(rows, pa.int64())
            kept = [c.take(at) for c in b.columns[: len(keys)]]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    source = df.where(oversized(F.col(text), max_words, max_chars)).select(*keys, text)
    schema = T.StructType(
        [*source.select(*keys).schema.fields]
        + [T.StructField(c, T.IntegerType()) for c in ("piece", "start", "end", "n_words", "n_shared")]
        + [T.StructField(c, T.StringType()) for c in ("cut", "text")]
    )
    return source.mapInArrow(run, schema)
