"""Broken prompt and response pairs: questions written for a passage that are no usable question.

Every question gets at most one defect, the first of these that holds:

empty      no letter or digit (a written null or None counts as nothing);
refusal    the writer speaks of itself and declines (first person or assistant, with a word of refusing);
copy       at least COPY of its runs of three tokens stand in the passage, or it is one whole sentence of the passage;
truncated  it ends in an ellipsis or its list breaks off, or it has no closing mark and its end is improbable:
           P(end | last tokens), or for a rare last word P(end of word | last characters), is below END or WORD_END; both
           come from n-gram counts over all questions;
language   the posteriors of question and passage, from a naive Bayes model over character trigrams, agree on a language with a
           probability under exp(-MARGIN). The wiki's language is the prior of the passage's posterior (all but DOUBT of it), and stands for
           it where there is no passage. A question of several passages must differ from each. Trigrams that the model never met tell
           nothing, nor do addresses, and since the trigrams of one text are not independent, a passage counts as at most EVIDENCE of them (lists of
           names in no language stay with their wiki's).

The language model is fitted on a bounded sample (SAMPLE whole texts a language, chosen by hash) labelled by the wiki's
language. All other statistics cover all questions; they are hashed tables, added up on the executors. Those of word contexts are sized
by the contexts counted: they grow until at most a quarter of their slots is taken.

Passages are joined once, to the questions that name them, and three small values a question come out of that join.

Defined results: a null, blank or empty cell or query is `empty`; a cell whose list does not parse is read as far as it
goes; a passage that is null or missing has no copies; an unknown wiki counts as the default language; repeated rows
count once; several versions of an id give the first defect of any.
"""

from __future__ import annotations

import ast
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wikiloom.durable import durable
from wikiloom.llm.tokens import Tokens, distinct, mix, slices

#: Order of precedence.
DEFECTS = ("empty", "refusal", "copy", "truncated", "language")
SAMPLE, COPY, END, WORD_END, MARGIN, DOUBT, EVIDENCE = 3000, 0.5, 0.02, 0.003, 4.0, 0.01, 20

# Words of speaking of oneself, and of declining, in the four languages of the wikis.
FIRST_PERSON = "i|i'm|im|i've|me|my|we|our|us|ich|mir|mich|mein|meine|meiner|meinen|wir|uns|je|j|moi|mon|ma|mes|nous|yo|me|mi|mis|puedo|nosotros"
DECLINING = (
    "can't|cannot|cant|can|won't|wont|unable|decline|declined|refuse|don't|dont|doesn't|not|no|nothing|never|appropriate|against|regret|sorry|apologize|apologise"
    "|nicht|nichts|kein|keine|keinen|keiner|verweigere|weigere|ablehnen|leider|verzeihung"
    "|ne|pas|rien|refuse|impossible|incapable|désolé|malheureusement|no|nada|niego|imposible|incapaz|lamento|lamentablemente|rechazo"
)
ASSISTANT = (
    r"\b(?:language model|as an ai|an ai model|by an assistant|as an assistant|content policy|my guidelines|for me to discuss|sprachmodell|ki-modell|modèle de langage|modelo de lenguaje|mes directives|mis directrices|meine richtlinien)\b"
)
_FIRST = re.compile(rf"(?<![\w'])(?:(?:{FIRST_PERSON})(?!\w)|[jm]')")
_DECLINE = re.compile(rf"(?<![\w'])(?:{DECLINING})(?!\w)|n't\b")
_ASSISTANT = re.compile(ASSISTANT)
_NOTHING = re.compile(r"[\W_]*(?:none|null)?[\W_]*", re.I)
_CLOSED = re.compile(r"[?.!。！？؟][\"'’”»)\]*_\s]*$")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.)[\"'’”»)\]\s]*$")
_STRINGS = re.compile(r"\"((?:[^\"\\]|\\.)*)(\"|$)|'((?:[^'\\]|\\.)*)('|$)", re.S)

#: Bytes of texts that are worked on at once where questions stand beside their passages.
SLICE_BYTES = 1 << 18
CONTEXT_BITS, MOST_BITS, CHAR_BITS, WORD_BITS = 18, 24, 18, 16
#: A token is common if it makes up at least this share of the questions.
COMMON = 0.0005


def nothing(q: str | None) -> bool:
    return q is None or _NOTHING.fullmatch(q) is not None


def refusal(q: str) -> bool:
    s = q.lower().replace("’", "'")
    return bool(_ASSISTANT.search(s) or (_FIRST.search(s) and _DECLINE.search(s)))


def cell(value: str | None) -> tuple[list[str], bool]:
    """The questions of a written list that have text, and whether the list breaks off."""
    if value is None:
        return [], False
    s = value.strip()
    for parse in (json.loads, ast.literal_eval):
        try:
            v = parse(s)
        except Exception:
            continue
        if isinstance(v, str):
            v = [v]
        if v is None:
            return [], False
        if isinstance(v, (list, tuple)):
            flat = [x for y in v for x in (y if isinstance(y, (list, tuple)) else [y])]
            return [str(x) for x in flat if x is not None and not nothing(str(x))], False
    if s[:1] != "[":
        return ([s] if not nothing(s) else []), False
    found, broke = [], not s.endswith("]")
    for m in _STRINGS.finditer(s, 1):
        text = m[1] if m[1] is not None else m[3]
        closed = m[2] if m[1] is not None else m[4]
        if closed and not nothing(text):
            found.append(re.sub(r"\\u([0-9a-fA-F]{4})", lambda x: chr(int(x[1], 16)), text))
    return found or ([s] if not nothing(s) else []), broke


_SENTENCES = re.compile(r"[.!?\n]+")
_TOKENS = re.compile(r"[^\W_]+")
_ADDRESS = re.compile(r"https?://\S+")


def repeats(question: str, passage: str | None) -> bool:
    """Whether the question is one whole sentence of the passage; both in lower case."""
    own = _TOKENS.findall(question)
    return any(_TOKENS.findall(x) == own for x in _SENTENCES.split(passage or ""))


def copies(questions: pa.Array, passages: pa.Array, at: np.ndarray | None = None) -> np.ndarray:
    """Of each question, whether it repeats the passage: enough of its runs of three tokens, or under six tokens a whole sentence of at
    least three; both in lower case. at: the place of each question's passage, rising, if a passage stands once for all its questions."""
    t = Tokens(questions)
    at = np.arange(t.n) if at is None else at
    dq, hq = distinct(*t.shingles(3))
    dp, hp = distinct(*Tokens(passages).shingles(3))
    # Each question's runs among those of its passage, both in the order of passage and run.
    doc, h = np.concatenate([dp, at[dq]]), np.concatenate([hp, hq])
    order = np.lexsort((h, doc))
    doc, h, own = doc[order], h[order], order >= len(dp)
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    met = ~own[new][np.cumsum(new) - 1] if len(h) else own  # a passage's run comes before those of questions that equal it
    both = np.bincount(dq[order[own & met] - len(dp)], minlength=t.n)
    share = both / np.maximum(np.bincount(dq, minlength=t.n), 1)
    out = (t.count >= 6) & (share >= COPY)
    for i in np.flatnonzero((t.count >= 3) & (t.count < 6) & (share == 1)):
        out[i] = repeats(questions[i].as_py(), passages[int(at[i])].as_py())
    return out


def _copies_coded(questions: pa.Array, texts: pa.Array, which: np.ndarray) -> np.ndarray:
    """copies() of questions whose passages are texts[which]."""
    order = np.argsort(which, kind="stable")
    out = np.zeros(len(which), bool)
    out[order] = copies(questions.take(pa.array(order)), texts, which[order].astype(np.int64))
    return out


ROWS_SCHEMA = "tab string, id long, side string, wiki string, q string, copied boolean, broke boolean, foreign boolean"


class Languages:
    """The fitted language model: posteriors of texts, and how far those of two texts agree."""

    def __init__(self, names: list[str], of: dict[str, str], default: str, log_p: np.ndarray):
        self.names, self.of, self.default, self.log_p = names, of, default, log_p

    def prior(self, wikis: list[str | None]) -> np.ndarray:
        """[text, language]"""
        k = len(self.names)
        own = np.array([self.names.index(self.of.get(w, self.default)) for w in wikis], np.int64)
        p = np.full((len(wikis), k), DOUBT / max(k - 1, 1))
        p[np.arange(len(wikis)), own] = 1 - DOUBT
        return p

    def posterior(self, texts: list[str | None], prior: np.ndarray | None = None) -> np.ndarray:
        """[text, language]; an even prior unless one is given. With a prior the evidence of a text is that of at most EVIDENCE trigrams."""
        doc, slots = _trigrams([t and _ADDRESS.sub(" ", t) for t in texts] if prior is not None else texts)
        z = np.stack([np.bincount(doc, weights=p[slots], minlength=len(texts)) for p in self.log_p], axis=1)
        if prior is not None:
            n = np.bincount(doc, minlength=len(texts))
            z = z * (EVIDENCE / np.maximum(n, EVIDENCE))[:, None] + np.log(prior)
        p = np.exp(np.maximum(z - z.max(axis=1, keepdims=True), -60))
        return p / p.sum(axis=1, keepdims=True)

    def foreign(self, questions: list[str | None], passage: np.ndarray) -> np.ndarray:
        """Whether each question is in another language than its passage, whose posterior is given."""
        return (self.posterior(questions) * passage).sum(axis=1) < np.exp(-MARGIN) if questions else np.zeros(0, bool)


def of_cells(cells: DataFrame, languages: Languages) -> DataFrame:
    """One row per question of cells (tab, id, side, wiki, passage, cell); a cell without text keeps one row with a null."""
    shared = cells.sparkSession.sparkContext.broadcast(languages)

    def run(batches):
        lang = shared.value
        for b in slices(batches, 2048, SLICE_BYTES):
            at, qs, broke = [], [], []
            for i, value in enumerate(b.column(5).to_pylist()):
                found, cut = cell(value)
                for q in found or [None]:
                    at.append(i)
                    qs.append(q)
                    broke.append(cut)
            passages = [x and x.lower() for x in b.column(4).to_pylist()]
            p = lang.posterior(passages, lang.prior(b.column(3).to_pylist()))[at] if at else np.zeros((0, len(lang.names)))
            place, at = np.array(at, np.int64), pa.array(at, pa.int64())
            lower = pa.array([x and x.lower() for x in qs], pa.string())
            copied = copies(lower, pa.array(passages, pa.string()), place)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(4)), pa.array(qs, pa.string()), pa.array(copied), pa.array(broke), pa.array(lang.foreign(qs, p))], names=["tab", "id", "side", "wiki", "q", "copied", "broke", "foreign"])

    return cells.select("tab", "id", "side", "wiki", "passage", "cell").mapInArrow(run, ROWS_SCHEMA)


def beside_passages(asked: DataFrame, passages: DataFrame, languages: Languages) -> DataFrame:
    """id, copied, foreign of the questions (id, pid, q) that are joined to a passage (pid, wiki, passage): whether they copy any, and whether
    they are in another language than all of theirs."""
    shared = asked.sparkSession.sparkContext.broadcast(languages)

    def run(batches):
        lang = shared.value
        for b in slices(batches, 2048, SLICE_BYTES):
            # Questions of one passage stand together: its posterior and its runs are computed once.
            coded = b.column(2).dictionary_encode()
            which, texts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            wikis = b.column(3).to_pylist()
            first = np.zeros(len(texts), np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            p = lang.posterior(texts, lang.prior([wikis[i] for i in first]))[which]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_copies_coded(b.column(1), coded.dictionary, which)), pa.array(lang.foreign(b.column(1).to_pylist(), p))], names=["id", "copied", "foreign"])

    pairs = asked.join(passages, "pid").select("id", F.lower("q").alias("q"), F.lower("passage").alias("passage"), "wiki")
    return pairs.mapInArrow(run, "id long, copied boolean, foreign boolean").groupBy("id").agg(F.max("copied").alias("copied"), F.min("foreign").alias("foreign"))


def _classes(t: Tokens, counts: np.ndarray, least: int) -> np.ndarray:
    """Token hashes with all rare tokens as one class."""
    return np.where(counts[(t.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)] >= least, t.hash, np.uint64(1))


def _contexts(t: Tokens, c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the contexts of one, two and three tokens that end at each token."""
    pad = np.uint64(2)
    one, two = np.full(len(c), pad), np.full(len(c), pad)
    one[1:] = np.where(t.doc[1:] == t.doc[:-1], c[:-1], pad)
    two[2:] = np.where(t.doc[2:] == t.doc[:-2], c[:-2], pad)
    two_gram = mix(c + mix(one))
    three = mix(two_gram + mix(two + np.uint64(7)))
    cut = np.uint64(64 - bits)
    return tuple((x >> cut).astype(np.int64) for x in (mix(c + np.uint64(5)), two_gram, three))


def _last3(word: str) -> int:
    h = 0
    for ch in f"  {word}"[-3:]:
        h = (h * 1000003 + ord(ch)) & 0x3FFFF
    return h


_WORDS = re.compile(r"[^\W\d_]+")
_LAST = re.compile(r"([^\W\d_]+)[\W_]*$")


def _tables(df: DataFrame, sizes: dict[str, int], fill) -> dict[str, np.ndarray]:
    """Sums of tables of counts (sizes by name) that fill(batch, tables) adds to, over all rows of df."""
    chunk = 1 << 14

    def run(batches):
        tables = {n: np.zeros(size, np.uint32) for n, size in sizes.items()}  # a task's counts; the sums have 64 bits
        for b in slices(batches):
            fill(b, tables)
        rows = []
        for n, size in sizes.items():
            own = tables.pop(n)
            rows += [(n, at, pa.compress(x.astype(np.int64).tobytes(), "zstd", asbytes=True)) for at in range(0, size, chunk) if (x := own[at : at + chunk]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["name", "at", "counts"])

    def counts(name: str, at: int, blob: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(blob, min(chunk, sizes[name] - at) * 8, "zstd", asbytes=True), np.int64)

    def merge(t: pa.Table) -> pa.Table:
        name, at = t["name"][0].as_py(), t["at"][0].as_py()
        total = sum(counts(name, at, x.as_py()) for x in t["counts"])
        return t.slice(0, 1).select(["name", "at"]).append_column("counts", pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary()))

    schema = "name string, at int, counts binary"
    out = {n: np.zeros(size, np.int64) for n, size in sizes.items()}
    for r in df.mapInArrow(run, schema).groupBy("name", "at").applyInArrow(merge, schema).collect():
        x = counts(r["name"], r["at"], bytes(r["counts"]))
        out[r["name"]][r["at"] : r["at"] + len(x)] = x
    return out


def _complete(q: str | None) -> bool:
    return bool(q) and _CLOSED.search(q) is not None and _ELLIPSIS.search(q) is None


def fit_ends(questions: DataFrame, bits: int = CONTEXT_BITS) -> dict[str, np.ndarray]:
    """Counts of word contexts and of words' last characters, with how many of them end a complete question or a word.

    bits: slots of the context tables to begin with; there are more where over a quarter is taken.
    """

    def usable(b) -> list[str | None]:
        return [q.lower() if _complete(q) and not copied and not refusal(q) else None for q, copied in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]

    def words(b, tables):
        t = Tokens(pa.array([q and q.lower() for q in b.column(0).to_pylist()], pa.string()))
        np.add.at(tables["word"], (t.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64), 1)
        tables["rows"][0] += b.num_rows
        inner, last = [], []
        for q in usable(b):
            for w in _WORDS.findall(q or ""):
                last.append(_last3(w))
                inner.extend(_last3(w[:i]) for i in range(max(1, len(w) - 3), len(w)))
        np.add.at(tables["char"], np.array(inner + last, np.int64), 1)
        np.add.at(tables["char_end"], np.array(last, np.int64), 1)

    questions = questions.select("q", "copied")
    first = _tables(questions, {"word": 1 << WORD_BITS, "rows": 1, "char": 1 << CHAR_BITS, "char_end": 1 << CHAR_BITS}, words)
    least = max(3, int(COMMON * first["rows"][0]))
    count = first["word"]
    while True:

        def contexts(b, tables, bits=bits):
            t = Tokens(pa.array(usable(b), pa.string()))
            c = _classes(t, count, least)
            for name, slots in zip(("one", "two", "three"), _contexts(t, c, bits)):
                np.add.at(tables[name], slots, 1)
                np.add.at(tables[f"{name}_end"], slots[t.first[1:][t.count > 0] - 1], 1)

        second = _tables(questions, {f"{n}{e}": 1 << bits for n in ("one", "two", "three") for e in ("", "_end")}, contexts)
        if np.count_nonzero(second["three"]) <= 1 << bits - 2 or bits >= MOST_BITS:
            return first | second | {"least": np.array([least]), "bits": np.array([bits])}
        bits += 2


def end_probability(t: Tokens, lower: list[str | None], m: dict[str, np.ndarray]) -> np.ndarray:
    """P(a question ends here) at the last token of each row."""
    c = _classes(t, m["word"], int(m["least"][0]))
    one, two, three = _contexts(t, c, int(m["bits"][0]))
    some = t.count > 0
    at = t.first[1:][some] - 1
    rare_at = c[at] == np.uint64(1)
    # A common word that was never seen in this context falls back to itself; a rare one (it may be a stump) to little.
    p1 = np.where(rare_at, 0.02, (m["one_end"][one[at]] + 0.01) / (m["one"][one[at]] + 0.5))
    p2 = (m["two_end"][two[at]] + p1) / (m["two"][two[at]] + 1)
    p3 = (m["three_end"][three[at]] + 2 * p2) / (m["three"][three[at]] + 2)
    out = np.ones(t.n)
    out[some] = p3
    rare = np.zeros(t.n, bool)
    rare[some] = rare_at
    for i in np.flatnonzero(rare):
        w = _LAST.search(lower[i] or "")
        if w:
            s = _last3(w[1])
            if (m["char_end"][s] + 0.05) / (m["char"][s] + 0.5) < WORD_END:
                out[i] = 0.0
    return out


TRIGRAM_BITS = 18


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the character trigrams of lower-cased texts."""
    values = [f" {t.lower()} " if t else "" for t in texts]
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    cp = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(values)), lengths)
    if len(cp) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = doc[:-2] == doc[2:]
    h = mix(cp[:-2] + mix(cp[1:-1] + mix(cp[2:])))
    return doc[:-2][same], (h[same] >> np.uint64(64 - TRIGRAM_BITS)).astype(np.int64)


def fit_language(texts: DataFrame, languages: list[str], sample: int = SAMPLE) -> np.ndarray:
    """Log-probabilities [language, trigram slot] from at most `sample` texts a language of texts (lang, text)."""
    h = F.xxhash64("text")
    texts = texts.where("text is not null")
    # About twice the sample passes a filter by hash first, so that the window gets few rows at any size.
    n = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    rate = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, int(min(1.0, 2.0 * sample / v) * (1 << 30)))])[F.col("lang")] if n else F.lit(0)
    rows = texts.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < rate).withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(h, "text"))).where(F.col("_r") <= sample)
    index = {x: i for i, x in enumerate(languages)}

    def fill(b, tables):
        lang = np.array([index.get(x, -1) for x in b.column(0).to_pylist()], np.int64)
        doc, slots = _trigrams(b.column(1).to_pylist())
        at = lang[doc] * (1 << TRIGRAM_BITS) + slots
        np.add.at(tables["n"], at[lang[doc] >= 0], 1)

    count = _tables(rows.select("lang", "text"), {"n": len(languages) << TRIGRAM_BITS}, fill)["n"].reshape(len(languages), -1)
    log_p = np.log(count + 0.5) - np.log((count + 0.5).sum(axis=1, keepdims=True))
    return np.where(count.any(axis=0), log_p, 0.0).astype(np.float32)


def classify(questions: DataFrame, languages: Languages, ends: dict[str, np.ndarray]) -> DataFrame:
    """tab, id, side and defect of every defective row of questions (ROWS_SCHEMA; foreign is null where no passage is known)."""
    # Half the bytes in every worker, where the counts allow it.
    ends = {n: x.astype(np.int32) if x.max(initial=0) < 1 << 31 else x for n, x in ends.items()}
    model = questions.sparkSession.sparkContext.broadcast((languages, ends))

    def run(batches):
        lang, ends = model.value
        for b in slices(batches):
            qs = b.column(4).to_pylist()
            copied, broke, foreign = (b.column(i).to_pylist() for i in (5, 6, 7))
            lower = [q and q.lower() for q in qs]
            t = Tokens(pa.array(lower, pa.string()))
            end = end_probability(t, lower, ends)
            alone = [i for i, x in enumerate(foreign) if x is None]
            for i, x in zip(alone, lang.foreign([lower[i] for i in alone], lang.prior([b.column(3)[i].as_py() for i in alone]))):
                foreign[i] = bool(x)
            at, kind = [], []
            for i, q in enumerate(qs):
                if nothing(q):
                    k = "empty"
                elif refusal(q):
                    k = "refusal"
                elif copied[i]:
                    k = "copy"
                elif broke[i] or _ELLIPSIS.search(q) or (not _CLOSED.search(q) and end[i] < END):
                    k = "truncated"
                elif foreign[i]:
                    k = "language"
                else:
                    continue
                at.append(i)
                kind.append(DEFECTS.index(k))
            i = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(i) for k in range(3)), pa.array(kind, pa.int32())], names=["tab", "id", "side", "k"])

    bad = questions.mapInArrow(run, "tab string, id long, side string, k int").groupBy("tab", "id", "side").agg(F.min("k").alias("k"))
    return bad.select("tab", "id", "side", F.get(F.array(*map(F.lit, DEFECTS)), F.col("k")).alias("defect"))


def defects(cells: DataFrame, queries: DataFrame, asked: DataFrame, passages: DataFrame, languages: dict[str, str], default: str = "en") -> DataFrame:
    """Defects of cells (tab, id, side, wiki, passage, cell) and queries (tab, id, side, wiki, q) with asked (id, pid) and passages (pid, wiki, passage).

    languages: wiki -> language, of the wikis that are not in the default language.
    """
    queries = queries.distinct()
    known = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])[F.col("wiki")] if languages else F.lit(None)
    lang = F.coalesce(known, F.lit(default)).alias("lang")
    names = sorted({*languages.values(), default})
    texts = passages.select(lang, F.col("passage").alias("text")).unionByName(queries.select(lang, F.col("q").alias("text")))
    model = Languages(names, languages, default, fit_language(texts, names))
    pairs = asked.distinct().join(queries.where("q is not null").select("id", "q"), "id")
    beside = beside_passages(pairs, passages.select("pid", "wiki", "passage").where("passage is not null").distinct(), model)
    rows = queries.join(beside, "id", "left").select("tab", "id", "side", "wiki", "q", F.coalesce("copied", F.lit(False)).alias("copied"), F.lit(False).alias("broke"), "foreign")
    rows = durable(rows.unionByName(of_cells(cells.distinct(), model)))
    return classify(rows, model, fit_ends(rows))
