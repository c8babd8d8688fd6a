"""Encoding a corpus with a public byte-level BPE vocabulary, by prefix-sharing trie traversal.

The distinct words (pre-tokens) of a batch are the paths of a trie. They are visited depth first, which for
sorted words means: keep the states of the prefix shared with the word before, and go on from there. The state of
a prefix is the last token of its encoding and where that token begins. It is found from the states before it: of
the vocabulary's tokens that end here, exactly one follows the last token of the rest in a way that byte-pair
merging would leave alone. A word's encoding is read by walking its states backwards. Every shared prefix is
encoded once; finished words stay in a bounded cache of the Python worker.

The operator needs no shuffle: each task encodes the rows it reads.

Defined results: a null text and an empty text both have the empty list; strings that look like special tokens are
ordinary text; lone surrogates cannot occur in a Spark string. Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

#: Words that a worker keeps between batches; beyond it the cache starts anew (results stay the same).
CACHE_WORDS = 400_000

#: Where the vocabulary files lie on the driver, unless the caller names another folder.
FOLDER = "/opt/tokenizers"

#: Fixed value: the pre-tokenisation pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TrieEncoder:
    """Encodes words; vocabulary: bytes -> rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Plain byte-pair merging, lowest rank first; used on the few bytes of a pair of tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def holds(self, before: int, token: int) -> bool:
        """Whether merging leaves token as it is after before (-1: at the start of a word)."""
        if (known := self.pairs.get((before, token))) is None:
            left = self.bytes[before] if before >= 0 else b""
            known = self.merged(left + self.bytes[token]) == ([before, token] if left else [token])
            self.pairs[before, token] = known
        return known

    def learn(self, words: set[str]) -> None:
        """Depth-first traversal of the trie of these words."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        ranks, holds, longest = self.ranks, self.holds, self.longest
        path, last, begin = b"", [-1], [0]
        for raw, word in sorted((w.encode("utf-8"), w) for w in words):
            shared = 0
            for a, b in zip(path, raw):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                for start in range(max(0, end - longest), end):
                    token = ranks.get(raw[start:end])
                    if token is not None and holds(last[start], token):
                        last.append(token)
                        begin.append(start)
                        break
            path, out, at = raw, [], len(raw)
            while at:
                out.append(last[at])
                at = begin[at]
            self.cache[word] = out[::-1]

    def encode(self, texts: list[str | None]) -> list[list[list[int]]]:
        """For each text the encodings of its words."""
        found = [self.find(t) if t else () for t in texts]
        new = {w for ws in found for w in ws}
        if len(new) > CACHE_WORDS:  # one batch of more words than the cache holds
            self.learn(new)
        else:
            missing = new.difference(self.cache)
            if missing:
                if len(self.cache) + len(missing) > CACHE_WORDS:
                    missing = new
                self.learn(missing)
        get = self.cache.__getitem__
        return [list(map(get, ws)) for ws in found]


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str, shared=None) -> TrieEncoder:
    """The encoder of a .tiktoken file, once a worker; shared: the file's bytes as the driver has broadcast them."""
    if path not in _encoders:
        data = Path(path).read_bytes() if shared is None else shared.value
        _encoders[path] = TrieEncoder({base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)})
    return _encoders[path]


def shipped(spark: SparkSession, vocabulary: str, folder: str):
    """(path, broadcast bytes) of a vocabulary file, under a megabyte; only the driver needs the file."""
    path = f"{folder}/{vocabulary}.tiktoken"
    return path, spark.sparkContext.broadcast(Path(path).read_bytes())


def _batches(path: str, shared, rows: int = 512):
    def each(batches):
        enc = encoder(path, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield enc, batch.slice(at, rows)

    return each


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, ids: str = "ids") -> DataFrame:
    """key and the list of token ids of each row's text."""
    path, shared = shipped(df.sparkSession, vocabulary, folder)

    def run(batches):
        for enc, b in _batches(path, shared)(batches):
            words = enc.encode(b.column(1).to_pylist())
            flat = [list(chain.from_iterable(w)) for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flat, pa.list_(pa.int32()))], names=[key, ids])

    schema = T.StructType([df.select(key).schema[0], T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, text: str = "text") -> DataFrame:
    """key and the text of each row's token ids. Null has a null text, the empty list the empty text; ids outside the vocabulary raise; bytes
    that are no whole character become the replacement character."""
    path, shared = shipped(df.sparkSession, vocabulary, folder)

    def run(batches):
        for enc, b in _batches(path, shared)(batches):
            found = [x if x is None else b"".join(map(enc.bytes.__getitem__, x)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=[key, text])

    schema = T.StructType([df.select(key).schema[0], T.StructField(text, T.StringType())])
    return df.select(key, ids).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = FOLDER, name: str = "n_tokens") -> DataFrame:
    """All columns of df but the text, and the number of tokens of each text (0 for null and empty)."""
    path, shared = shipped(df.sparkSession, vocabulary, folder)
    keep = [c for c in df.columns if c != text]

    def run(batches):
        for enc, b in _batches(path, shared)(batches):
            n = [sum(map(len, w)) for w in enc.encode(b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*keep, name])

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(name, T.LongType())])
    return df.select(text, *keep).mapInArrow(run, schema)
