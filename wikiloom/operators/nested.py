"""Deeply nested page records as related flat tables.

Records are JSON text of three kinds (QA page, legacy page, blueprint) or the typed qa_pages rows. Every kind
is first brought to one typed shape,

    array<struct<para, passage, positive array<struct<k, q>>, negative array<struct<k, q>>>>,

by higher-order functions only; each target table then comes from one flatten and one inline over it, so a
record is read once and no row is ever joined back to its parent.

Defined results: a null, blank or incomplete payload, and one that is no object, gives no rows. Padding, a
byte-order mark and a second encoding are removed. A list entry of any other type than the shapes allow counts
as null and keeps its position. Questions that are null or blank give no rows but hold their position k.
Repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

QUESTION = "struct<k:bigint,q:string>"
PARAGRAPH = f"struct<para:bigint,passage:string,positive:array<{QUESTION}>,negative:array<{QUESTION}>>"

#: One string, list or object of a variant; null where the value is of another type.
_LIST = "try_variant_get({}, '$', 'array<variant>')"
_OBJECT = "try_variant_get({}, '$', 'map<string,variant>')"


def _text(v: str) -> str:
    return f"if({_LIST.format(v)} is null and {_OBJECT.format(v)} is null, try_variant_get({v}, '$', 'string'), null)"


def _question(v: str) -> str:
    return f"if({_OBJECT.format(v)} is not null, try_variant_get({v}, '$.q', 'string'), {_text(v)})"


def _questions(items: str) -> str:
    """Array of (k, q) of a list of variants; null and blank entries are left out after counting."""
    return (
        f"filter(transform(coalesce({items}, array()), (e, k) -> named_struct('k', cast(k as bigint), 'q', {_question('e')})), "
        "x -> x.q rlike '(?U)\\\\S')"
    )


def unwrap(payload: str = "payload") -> Column:
    """The record as a variant, without padding, byte-order mark and a second encoding; null if it is no complete object."""
    bare = f"regexp_replace({payload}, '^[\\\\s\\\\x{{FEFF}}\\\\x{{0}}\\\\x{{A0}}]+|[\\\\s\\\\x{{FEFF}}\\\\x{{0}}\\\\x{{A0}}]+$', '')"
    once = f"try_parse_json({bare})"
    inner = "try_variant_get(v, '$', 'string')"
    again = inner.join(["regexp_replace(", ", '^[\\\\s\\\\x{FEFF}]+|[\\\\s\\\\x{FEFF}]+$', '')"])
    # A variant that is itself a string holds the second encoding.
    return F.expr(
        f"transform(transform(array({once}), v -> if({_LIST.format('v')} is null and {_OBJECT.format('v')} is null, try_parse_json({again}), v)), "
        f"v -> if({_OBJECT.format('v')} is null, null, v))[0]"
    )


def normalised(raw: DataFrame, key: str = "rec_id", payload: str = "payload") -> DataFrame:
    """One row per distinct record: key, kind, id, revid, url, title and its paragraphs in the common shape."""
    v = raw.select(key, payload).distinct().select(key, unwrap(payload).alias("v")).where("v is not null")
    v = v.select(key, "v", F.expr("try_variant_get(v, '$', 'map<string,variant>')").alias("m"), F.expr("try_variant_get(v, '$.text', 'array<variant>')").alias("t"), F.expr(f"{_text('try_variant_get(v, \'$.text\', \'variant\')')}").alias("s"))
    v = v.withColumn(
        "kind",
        F.expr(
            "case when size(m) > 0 and forall(map_keys(m), k -> k rlike '^-?[0-9]{1,18}$') and forall(map_values(m), e -> try_variant_get(e, '$', 'map<string,variant>') is not null) then 'blueprint'"
            " when exists(t, e -> try_variant_get(e, '$', 'array<variant>') is not null) then 'legacy' else 'page' end"
        ),
    )
    for side in ("positive", "negative"):
        v = v.withColumn(side[0], F.expr(f"try_variant_get(v, '$.{side}', 'array<variant>')"))
    legacy = _questions("if({0} is null, array(), try_variant_get(e, '$[0]', 'array<variant>'))".format(_LIST.format("e")))
    of_list = (
        "transform(t, (e, i) -> named_struct('para', cast(i as bigint), "
        f"'passage', if({_LIST.format('e')} is null, {_text('e')}, try_variant_get(e, '$[1]', 'string')), "
        f"'positive', concat({legacy}, {_questions(_LIST.format('get(p, i)'))}), 'negative', {_questions(_LIST.format('get(n, i)'))}))"
    )
    of_text = f"array(named_struct('para', 0L, 'passage', s, 'positive', {_questions('p')}, 'negative', {_questions('n')}))"
    of_map = (
        "transform(map_entries(m), x -> named_struct('para', cast(x.key as bigint), 'passage', try_variant_get(x.value, '$.passage', 'string'), "
        + ", ".join(f"'{side}', {_questions(f'try_variant_get(x.value, \'$.{field}\', \'array<variant>\')')}" for side, field in (("positive", "pos_query"), ("negative", "neg_query")))
        + "))"
    )
    return v.select(
        key,
        "kind",
        *(F.expr(f"if(kind = 'blueprint', null, try_variant_get(v, '$.{f}', '{t}'))").alias(f) for f, t in (("id", "bigint"), ("revid", "bigint"), ("url", "string"), ("title", "string"))),
        F.expr(f"cast(case when kind = 'blueprint' then {of_map} when t is not null then {of_list} when s is not null then {of_text} else array() end as array<{PARAGRAPH}>)").alias("paragraphs"),
    )


def normalised_typed(pages: DataFrame, key: str = "qa_id") -> DataFrame:
    """The typed qa_pages in the common shape; lists shorter than text leave their paragraphs without questions."""
    side = "filter(transform(coalesce(get({0}, i), array()), (q, k) -> named_struct('k', cast(k as bigint), 'q', q)), x -> x.q rlike '(?U)\\\\S')"
    return pages.select(key, "id", "revid", "url", "title", "text", "positive", "negative").distinct().select(
        key,
        F.lit("page").alias("kind"),
        "id",
        "revid",
        "url",
        "title",
        F.expr(
            "cast(transform(coalesce(text, array()), (e, i) -> named_struct('para', cast(i as bigint), 'passage', e, "
            f"'positive', {side.format('positive')}, 'negative', {side.format('negative')})) as array<{PARAGRAPH}>)"
        ).alias("paragraphs"),
    )


def pages(records: DataFrame, key: str = "rec_id") -> DataFrame:
    """Parent table: one row per record."""
    return records.select(key, "kind", "id", "revid", "url", "title", F.size("paragraphs").cast("bigint").alias("n_paragraphs"))


def paragraphs(records: DataFrame, key: str = "rec_id") -> DataFrame:
    """Child of pages by key: one row per paragraph, with its position (or pid) para."""
    rows = F.expr("transform(paragraphs, p -> named_struct('para', p.para, 'passage', p.passage, 'n_positive', cast(size(p.positive) as bigint), 'n_negative', cast(size(p.negative) as bigint)))")
    return records.select(key, F.inline(rows))


def questions(records: DataFrame, key: str = "rec_id") -> DataFrame:
    """Child of paragraphs by (key, para): one row per question, with its side and position k."""
    side = "transform(p.{0}, x -> named_struct('para', p.para, 'side', '{0}', 'k', x.k, 'question', x.q))"
    rows = F.expr(f"flatten(transform(paragraphs, p -> concat({side.format('positive')}, {side.format('negative')})))")
    return records.select(key, F.inline(rows))
