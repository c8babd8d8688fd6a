"""Cutting raw pages into passages.

split_paragraphs() and split_sentence() are folds over sentence arrays by higher-order functions. segment_pages() also takes
back what it has put out (headings, short paragraphs), which no built-in fold over lines expresses well; it runs in Arrow batches, page by page, without a shuffle.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wikiloom.functions import text as X


@dataclass(frozen=True)
class Limits:
    """Words: of a page at least, of a heading at most, of a passage about at most and at least."""

    page: int = 8
    heading: int = 8
    most: int = 120
    least: int = 20


def page_filter(text: Column | str, least: int = 8) -> Column:
    """Pages of enough tokens that do not begin with a switch such as __NOTOC__."""
    return (X.n_spaced(F.trim(text)) >= least) & ~X.col(text).rlike(r"^__\w*__")


def paragraphs(text: Column | str) -> Column:
    """The trimmed lines of a page that are no markup and not empty."""
    lines = F.transform(F.split(X.col(text), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(&lt;|__\w*__)"))


def split_sentence(sentence: str, most: int) -> str:
    """SQL: equal parts of at most `most` words of the array of words `sentence`."""
    n = f"cast(ceil(size({sentence}) / {most}.0D) as int)"
    size = f"cast(ceil(size({sentence}) / cast({n} as double)) as int)"
    return f"filter(transform(sequence(0, {n} - 1), i -> array_join(slice({sentence}, i * {size} + 1, {size}), ' ')), p -> p <> '')"


def split_paragraphs(column: str, most: int = 120, least: int = 20) -> Column:
    """Passages of a paragraph: sentences are added up to `most` words; one may run over if half of it fits; an over-long sentence is
    cut in equal parts; a rest under `least` words joins the passage before. No character but white space is lost."""
    marked = f"regexp_replace({column}, '([.!?])[ \\\\t\\\\r\\\\n]+', '$1{X.BREAK}')"
    ss = f"filter(transform(split({marked}, '{X.BREAK}'), s -> trim(s)), s -> s <> '')"
    w = "size(filter(split({0}, '\\\\s+'), t -> t <> ''))".format
    arr = "filter(split(x, '\\\\s+'), t -> t <> '')"
    flush = "if(trim(a.cur) = '', a.out, array_append(a.out, trim(a.cur)))"
    step = (
        f"case when {w('a.cur')} + {w('x')} <= {most} then named_struct('out', a.out, 'cur', concat(a.cur, x, ' ')) "
        f"when {w('x')} > {most} then named_struct('out', concat({flush}, {split_sentence(arr, most)}), 'cur', '') "
        f"when 2 * ({most} - {w('a.cur')}) >= {w('x')} then named_struct('out', array_append(a.out, trim(concat(a.cur, x))), 'cur', '') "
        f"else named_struct('out', {flush}, 'cur', concat(x, ' ')) end"
    )
    end = (
        f"case when trim(a.cur) = '' then a.out when {w('a.cur')} < {least} and size(a.out) > 0 then "
        "concat(slice(a.out, 1, size(a.out) - 1), array(concat(element_at(a.out, -1), ' ', trim(a.cur)))) "
        "else array_append(a.out, trim(a.cur)) end"
    )
    return F.expr(f"aggregate({ss}, named_struct('out', cast(array() as array<string>), 'cur', ''), (a, x) -> {step}, a -> {end})")


_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\n]+")
_MARKUP = re.compile(r"&lt;|__\w*__")
_HEAD = re.compile(r"^\[[^\]]*\] ")


def passages_of(paragraph: str, most: int, least: int) -> list[str]:
    """What split_paragraphs() computes, for one string."""
    out: list[str] = []
    cur, n = "", 0
    for x in filter(None, (y.strip(" ") for y in _SENTENCE.split(paragraph))):
        ws = x.split()
        if n + len(ws) <= most:
            cur, n = f"{cur}{x} ", n + len(ws)
        elif len(ws) > most or 2 * (most - n) < len(ws):
            if cur.strip(" "):
                out.append(cur.strip(" "))
            cur, n = ("", 0) if len(ws) > most else (f"{x} ", len(ws))
            if len(ws) > most:
                size = math.ceil(len(ws) / math.ceil(len(ws) / most))
                out += [" ".join(ws[i : i + size]) for i in range(0, len(ws), size)]
        else:
            out.append(f"{cur}{x}".strip(" "))
            cur, n = "", 0
    if cur.strip(" "):
        if n < least and out:
            out[-1] += " " + cur.strip(" ")
        else:
            out.append(cur.strip(" "))
    return out


def segment(text: str, limits: Limits = Limits()) -> list[str]:
    """The passages of a page. A short line is a heading: it goes, without its last character, in brackets before what follows."""
    lines = [x for x in (y.strip() for y in text.split("\n")) if x and not _MARKUP.match(x)]
    if not lines:
        return []
    out, heading = [lines[0]], ""
    short = lambda line: len(line.split(" ")) <= limits.heading
    for before, line in zip(lines, lines[1:]):
        body = line
        if short(before):
            out.pop()
            heading = f"[{before[:-1]}] "
        elif out and len(out[-1].split(" ")) < limits.least and len(line.split()) > limits.heading:
            body = f"{_HEAD.sub('', out.pop())} {line}"
        out += [heading + p for p in passages_of(body, limits.most, limits.least)] or [""]
    packed: list[str] = []
    held = ""
    for p in filter(None, map(str.strip, out)):
        if held and len(held.split()) + len(p.split()) >= limits.least:
            packed.append(held)
            held = p
        else:
            held = f"{held} {p}" if held else p
    if held and packed and len(held.split(" ")) < limits.least:
        packed[-1] += f" {held}"
    elif held:
        packed.append(held)
    return packed


def segment_pages(pages: DataFrame, key: str, text: str, limits: Limits = Limits()) -> DataFrame:
    """key, j, passage of the pages that pass the page filter. Null and blank pages give no rows."""

    def run(batches):
        for b in batches:
            at, js, ps = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for j, p in enumerate(segment(t, limits)):
                    at.append(i)
                    js.append(j)
                    ps.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(js, pa.int32()), pa.array(ps, pa.string())], names=[key, "j", "passage"])

    rows = pages.where(F.col(text).isNotNull() & page_filter(text, limits.page)).select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, j int, passage string")


def legacy_page_filter(text: Column | str) -> Column:
    """Pages with text and without escaped markup."""
    return (X.col(text) != "") & ~F.contains(X.col(text), F.lit("&lt"))


def heading_body(pages: DataFrame, key: str, title: str, text: str, most: int = 30) -> DataFrame:
    """key, j, passage of pages whose lines are headings (under `most` characters) and bodies by turns: title, heading and body."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select(key, title, lines.alias("_l")).select(key, title, F.posexplode("_l").alias("j", "_body"), F.col("_l"))
    before = F.get("_l", F.col("j") - 1)
    return rows.where((F.col("j") > 0) & (F.char_length(before) < most) & (F.char_length("_body") >= most)).select(key, "j", F.concat_ws(" ", title, F.rtrim(before, F.lit(".")), "_body").alias("passage"))


def html_text(html: Column | str) -> Column:
    """Readable text of HTML: scripts, styles, comments and tags go, block ends become line ends, common entities are resolved."""
    t = F.regexp_replace(X.col(html), r"(?is)<(script|style)\b[^>]*>.*?(</\1\s*>|$)|<!--.*?(-->|$)", " ")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))
