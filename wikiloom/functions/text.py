"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def _base(c: str) -> str:
    """A character without accents, by compatibility decomposition."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _accents() -> tuple[str, str, dict[str, str]]:
    """Letters and digits that become one character (from, to), followed in `from` by the combining marks, which vanish; and those that become several."""
    one, several = {}, {}
    for c in map(chr, range(0xA0, 0xFFFF)):
        base = _base(c)
        if c.isalnum() and base != c and not "\uac00" <= c <= "\ud7a3":
            (one if len(base) == 1 else several)[c] = base
    marks = "".join(c for c in map(chr, range(0x300, 0xFFFF)) if unicodedata.combining(c))
    return "".join(one) + marks, "".join(one.values()), several


MARKED, PLAIN, SEVERAL = _accents()
#: Of those that become several, the ones that become Latin letters (ligatures and digraphs).
LIGATURES = {c: b for c, b in SEVERAL.items() if b.isascii() and b.isalpha()}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case without accents: accents, marks, wide and stylised forms go by compatibility decomposition, Latin ligatures are spelt out."""
    low = F.lower(col(c))
    spelt = low
    for x, base in LIGATURES.items():
        spelt = F.replace(spelt, F.lit(x), F.lit(base.lower()))
    some = low.rlike(f"[{''.join(LIGATURES)}]")
    # Most texts have none of these characters and are left as they are.
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.lower(F.translate(F.when(some, spelt).otherwise(low), MARKED, PLAIN))).otherwise(low)


def terms(c: Column | str) -> Column:
    """The terms of the TF-IDF analyzer: runs of at least two word characters of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def spaced(c: Column | str) -> Column:
    """Tokens between single spaces, empty ones included (the BM25 tokenizer)."""
    return F.split(col(c), " ")


def n_spaced(c: Column | str) -> Column:
    return F.size(spaced(c))


def words(c: Column | str) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(col(c), r"\s+"), lambda t: t != "")


def n_words(c: Column | str) -> Column:
    return F.size(words(c))


#: Stands between sentences for a moment; no character of any text.
BREAK = "\uffff"


def sentences(c: Column | str) -> Column:
    """Trimmed sentences. One ends after a closing mark before white space, or with the text; no character but the white space between them is lost."""
    marked = F.regexp_replace(col(c), r"([.!?])[ \t\r\n]+", f"$1{BREAK}")
    return F.filter(F.transform(F.split(marked, BREAK), lambda s: F.trim(s)), lambda s: s != "")


def bare_token(c: Column | str) -> Column:
    """A subword token without the mark of its place in a word."""
    return F.regexp_replace(col(c), "^(?:##|\u0120|\u2581)", "")


def question_word(c: Column | str, lower: bool = True) -> Column:
    w = F.split_part(col(c), F.lit(" "), F.lit(1))
    return F.lower(w) if lower else w


def pair_filter(positive: Column, negative: Column) -> Column:
    """Both questions contain a question mark."""
    return F.contains(positive, F.lit("?")) & F.contains(negative, F.lit("?"))


_QUOTED = r""""(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'"""


def list_literal(c: Column | str) -> Column:
    """The strings of a list written as JSON or as Python writes one: single quotes, None, a tuple, one string without a list. Null where it does not parse."""
    t = F.regexp_replace(col(c), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    t = F.when(t.rlike(r"(?s)^\(.*\)$"), F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^\(", "["), r"\)$", "]"), r",\s*\]$", "]")).otherwise(t)
    t = F.when(t.rlike(rf"(?s)^(?:{_QUOTED})$"), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)
    # Quoted strings are passed over whole, so that None inside one stays.
    none = rf"(?s)\G((?:[^\"'N]++|{_QUOTED}|N(?!one\b))*+)None\b"
    t = F.when(F.contains(t, F.lit("None")), F.regexp_replace(t, none, "$1null")).otherwise(t)
    return F.from_json(t, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})


def anchor_url(url: Column | str, passage: Column | str) -> Column:
    """The page's address with the heading in front of the passage as its anchor; spaces become underscores."""
    heading = F.regexp_extract(col(passage), r"\[(.*)\]", 1)
    return F.when(heading == "", col(url)).otherwise(F.replace(F.concat(col(url), F.lit("#"), heading), F.lit(" "), F.lit("_")))


def prompt_text(n_positive: int, n_negative: int, what: bool = True) -> str:
    ban = "" if what else " No question may begin with what."
    return (
        f"Read the passage. First write {n_positive} questions that it answers, numbered from 1, one a line. Then a line with ---. "
        f"Then write {n_negative} questions on the same subject that it does not answer, numbered from 1, one a line.{ban} Passage: "
    )


def prompt(n_positive: int, n_negative: int, passage: Column | str, what: bool = True) -> Column:
    """The request for questions on a passage."""
    return F.concat(F.lit(prompt_text(n_positive, n_negative, what)), col(passage))


def response(column: str, n: int) -> Column:
    """struct(positive, negative) of an answer in numbered lines: positives up to a line of dashes or n of them, then negatives."""
    zero = "named_struct('p', cast(array() as array<string>), 'n', cast(array() as array<string>), 'past', false)"
    q = "regexp_extract(x, '^[123]\\\\.\\\\s?(.*)$', 1)"
    step = (
        "case when x like '---%' then named_struct('p', a.p, 'n', a.n, 'past', true) "
        "when not x rlike '^[123]\\\\.' then a "
        f"when a.past or size(a.p) >= {n} then named_struct('p', a.p, 'n', array_append(a.n, {q}), 'past', true) "
        f"else named_struct('p', array_append(a.p, {q}), 'n', a.n, 'past', false) end"
    )
    return F.expr(f"aggregate(split({column}, '\\n'), {zero}, (a, x) -> {step}, a -> named_struct('positive', a.p, 'negative', a.n))")
