"""Segmentation, dataset building, statistics and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from wikiloom.durable import durable
from wikiloom.functions import text as X
from wikiloom.operators import dataset as B, segment as S
from wikiloom.session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")


def page_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where(S.page_filter("text")).select("doc_id")


def paragraph_filter(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(S.paragraphs("text")).alias("j", "paragraph"))


def heading_detect(spark, sf_dir):
    """The heading (a line of at most eight tokens) that stands right before each paragraph."""
    lines = S.paragraphs("text")
    rows = _docs(spark, sf_dir).select("doc_id", lines.alias("l")).select("doc_id", F.posexplode("l").alias("j", "paragraph"), "l")
    before = F.get("l", F.col("j") - 1)
    return rows.where((F.col("j") > 0) & (X.n_spaced(before) <= 8)).select("doc_id", "j", F.expr("left(get(l, j - 1), char_length(get(l, j - 1)) - 1)").alias("heading"))


def sentence_split(spark, sf_dir):
    p = table(spark, sf_dir, "passages").select("pid", "passage").distinct()
    return p.select("pid", F.posexplode(X.sentences("passage")).alias("k", "sentence"))


def split_long_sentence(spark, sf_dir):
    """Sentences of over 12 words in equal parts."""
    s = sentence_split(spark, sf_dir).withColumn("w", X.words("sentence")).where(F.size("w") > 12)
    return s.select("pid", "k", F.posexplode(F.expr(S.split_sentence("w", 12))).alias("part", "words"))


def split_paragraphs(spark, sf_dir):
    """Passages of at most about 30 and at least 8 words of every passage."""
    p = table(spark, sf_dir, "passages").where("passage is not null").select("pid", "passage").distinct()
    return p.select("pid", F.posexplode(S.split_paragraphs("passage", 30, 8)).alias("part", "words"))


def segment_page(spark, sf_dir):
    return S.segment_pages(table(spark, sf_dir, "documents"), "doc_id", "text")


def _five(c: str, prefix: str):
    ps = ((0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"))
    return [F.round(F.avg(c), 6).alias(f"{prefix}_mean"), F.min(c).alias(f"{prefix}_least"), F.max(c).alias(f"{prefix}_most"), *(F.percentile(c, F.lit(p)).alias(f"{prefix}_{n}") for p, n in ps)]


def paragraph_stats(spark, sf_dir):
    """Paragraphs a page: mean, extremes and percentiles."""
    return _docs(spark, sf_dir).select(F.size(S.paragraphs("text")).alias("n")).agg(*_five("n", "paragraphs"))


def paragraph_words_stats(spark, sf_dir):
    """Words a paragraph: mean, extremes and percentiles."""
    return _docs(spark, sf_dir).select(F.explode(S.paragraphs("text")).alias("p")).select(X.n_spaced("p").alias("n")).agg(*_five("n", "words"))


def page_pids(spark, sf_dir):
    """The passages of each page, in order, as one list written with commas."""
    p = table(spark, sf_dir, "passages").where("wid >= 0").select("wiki", "wid", "pid").distinct()
    return p.groupBy("wiki", "wid").agg(F.array_join(F.array_sort(F.collect_list("pid")), ",").alias("pids"))


def pid_counts(spark, sf_dir):
    """How often each remapped passage is named; -1 for no passage."""
    return substring_pid_map(spark, sf_dir).groupBy("pid").agg(F.count("*").alias("n"))


def exclusions(spark, sf_dir):
    """By wiki: paragraphs, the fraction that is left out as broken, and paragraphs whose positives and negatives differ in number."""
    rows = _qa(spark, sf_dir).select("wiki", F.posexplode("text").alias("j", "p"), "positive", "negative")
    n = lambda c: F.size(F.coalesce(F.get(c, F.col("j")), F.array()))
    return rows.groupBy("wiki").agg(F.count("*").alias("n"), F.round(F.avg(F.col("p").endswith(" .").cast("int")), 6).alias("excluded"), F.count_if(n("positive") != n("negative")).alias("unequal"))


def paragraphs_by_length(spark, sf_dir):
    """Places of the paragraphs of QA pages, longest first, beside their places in the order of pages."""
    rows = _qa(spark, sf_dir).select("qa_id", F.posexplode("text").alias("j", "p")).where("p is not null")
    return B.by_length(rows.select("qa_id", "j", X.n_spaced("p").alias("n")), ["qa_id", "j"], "n")


def shuffled_negatives(spark, sf_dir):
    """Every question and passage with the passage of another question of its wiki."""
    t = table(spark, sf_dir, "triples").select("wiki", F.col("qid_pos").alias("qid"), "pid")
    return B.shuffled_negatives(t, ["wiki"])


def bucket_batches(spark, sf_dir):
    """Batches of 8 triples whose passages have about the same length, within buckets of 4 batches, used up in 3 parts."""
    p = table(spark, sf_dir, "passages").where("passage is not null").groupBy("pid").agg(F.max(F.char_length("passage")).alias("chars"))
    t = table(spark, sf_dir, "triples").select("wiki", "qid_pos", "qid_neg", "pid").distinct().join(p, "pid")
    t = t.withColumn("key", B.shuffle_key(F.col("qid_pos") * 7 + F.col("pid")))
    return B.bucketed(t, ["key", "qid_pos", "qid_neg", "pid"], "chars", 8, ["wiki"], 4, 3).select("wiki", "qid_pos", "qid_neg", "pid", "bucket", "batch", "sub")


def words_per_passage(spark, sf_dir):
    p = table(spark, sf_dir, "passages").where("passage is not null").select("wiki", "split", "pid", "passage").distinct()
    return p.groupBy("wiki", "split").agg(F.count("*").alias("n"), F.median(X.n_spaced("passage")).alias("median_words"))


def dataset_stats(spark, sf_dir):
    """Rows, ids and median lengths of the three relations."""
    def of(tab, key, text):
        d = table(spark, sf_dir, tab).select(F.col(key).alias("id"), F.col(text).cast("string").alias("t") if text else F.lit(None).cast("string").alias("t")).distinct()
        return d.agg(F.lit(tab).alias("tab"), F.count("*").alias("n"), F.median(X.n_spaced("t")).alias("median_words"))

    return of("passages", "pid", "passage").unionByName(of("queries", "qid", "query")).unionByName(of("triples", "pid", None))


def dataset_rollup(spark, sf_dir):
    """Passages by wiki and split, with sums."""
    return table(spark, sf_dir, "passages").select("wiki", "split", "pid").distinct().rollup("wiki", "split").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def _word_share(rows, by):
    total = rows.groupBy().agg(F.count("*").alias("total"))
    return rows.groupBy(by.alias("word")).agg(F.count("*").alias("n")).join(F.broadcast(total)).select("word", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def question_word_dist(spark, sf_dir):
    q = table(spark, sf_dir, "queries").where("query is not null").select("qid", "query").distinct()
    return _word_share(q, X.question_word("query", lower=False))


def question_word_dist_lower(spark, sf_dir):
    """First words of all generated questions that parse, empty ones left out."""
    g = table(spark, sf_dir, "qa_pages").select("qa_id", "positive", "negative").distinct()
    q = g.select(F.explode(F.flatten(F.filter(F.concat(F.coalesce("negative", F.array()), F.coalesce("positive", F.array())), lambda x: x.isNotNull()))).alias("q")).where("q <> ''")
    return _word_share(q, X.question_word("q"))


def question_word_pct_of_paragraphs(spark, sf_dir):
    d = table(spark, sf_dir, "qa_pages").select("qa_id", "text", "positive").distinct()
    n = d.agg(F.sum(F.size(F.coalesce("text", F.array()))).alias("paragraphs"))
    q = d.select(F.explode(F.flatten(F.filter(F.coalesce("positive", F.array()), lambda x: x.isNotNull()))).alias("q")).where("q <> ''")
    return q.groupBy(X.question_word("q").alias("word")).agg(F.count("*").alias("n")).join(F.broadcast(n)).select("word", "n", F.round(100 * F.col("n") / F.col("paragraphs"), 3).alias("percent"))


def dedup_assign_ids(spark, sf_dir):
    """Ids of the distinct queries by first appearance."""
    return B.distinct_texts(table(spark, sf_dir, "queries").where("query is not null"), "query", "qid", "new_id")


def dedup_first_wins(spark, sf_dir):
    """The first loaded row of each pid."""
    p = table(spark, sf_dir, "passages")
    return B.first_wins(p, ["pid"], [F.col("loaded_at"), F.col("split"), F.col("passage").asc_nulls_first()]).select("pid", "wid", "wiki", "split", F.unix_micros("loaded_at").alias("loaded_us"))


def _candidates(spark, sf_dir):
    t = table(spark, sf_dir, "triples").select("wiki", "qid_pos", "pid").distinct()
    pages = table(spark, sf_dir, "passages").where("wid >= 0").select("wiki", "wid", "pid").distinct()
    own = t.join(pages, ["wiki", "pid"]).select("wiki", "wid", F.col("qid_pos").alias("qid"))
    return own.join(pages, ["wiki", "wid"]).select("qid", "pid").distinct().join(t.select(F.col("qid_pos").alias("qid"), "pid"), ["qid", "pid"], "left_anti")


def neg_sampling_fill(spark, sf_dir):
    """Nine negatives a question from its own page, beginning again where the page has fewer."""
    return B.fill_negatives(_candidates(spark, sf_dir))


def ms_triples_qpp(spark, sf_dir):
    """qid, pid_pos, place, pid_neg: every positive of a question with its nine negatives."""
    t = table(spark, sf_dir, "triples").select(F.col("qid_pos").alias("qid"), F.col("pid").alias("pid_pos")).distinct()
    return t.join(neg_sampling_fill(spark, sf_dir).withColumnRenamed("pid", "pid_neg"), "qid").select("qid", "pid_pos", "place", "pid_neg")


def _qa(spark, sf_dir):
    return table(spark, sf_dir, "qa_pages").select("wiki", "qa_id", "id", "revid", "url", "title", "text", "positive", "negative").distinct()


def qa_pairs_zip(spark, sf_dir):
    return B.pairs(_qa(spark, sf_dir))


def qa_relations(spark, sf_dir):
    """tab, id, ref of the relations built from the QA pages: dense pids by page and paragraph, dense qids by pair and side."""
    p = B.dense_ids(_qa(spark, sf_dir).select("qa_id", F.posexplode("text").alias("j", "passage")).where("not passage like '% .'").select("qa_id", "j"), ["qa_id", "j"], "pid")
    q = B.dense_ids(B.pairs(_qa(spark, sf_dir)).select("qa_id", "j", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")), ["qa_id", "j", "n", "side"], "qid")
    return p.select(F.lit("passages").alias("tab"), F.col("pid").alias("id"), "qa_id", "j").unionByName(q.select(F.lit("queries").alias("tab"), F.col("qid").alias("id"), "qa_id", "j"))


def qa_split_train_test_val(spark, sf_dir):
    """Pages to splits by the running share of their pairs, in a pseudo-random order of pages within each wiki."""
    n = B.pairs(_qa(spark, sf_dir)).groupBy("wiki", "qa_id").agg(F.count("*").alias("n"))
    return B.split_by_share(n.withColumn("key", B.shuffle_key("qa_id")), "n", ["wiki"], order="key").select("wiki", "qa_id", "n", "split")


def wiki_metadata(spark, sf_dir):
    return B.metadata(table(spark, sf_dir, "passages"), table(spark, sf_dir, "wiki_meta"))


def wiki_metadata_merge(spark, sf_dir):
    """Metadata by (wiki, wid), QA pages over the older table."""
    left = wiki_metadata(spark, sf_dir).select("wiki", "wid", "title")
    right = _qa(spark, sf_dir).where("id is not null").groupBy("wiki", F.col("id").alias("wid")).agg(F.max("title").alias("title"))
    return B.merge_right(left, right, ["wiki", "wid"])


def triples_to_strings_qqp(spark, sf_dir):
    return B.strings_qqp(*(table(spark, sf_dir, t) for t in ("triples", "queries", "passages")))


def triples_to_strings_qpp(spark, sf_dir):
    lists = ms_triples_qpp(spark, sf_dir).groupBy("qid", "pid_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pid_neg"))), lambda x: x["pid_neg"]).alias("neg"))
    lists = lists.select("qid", F.concat(F.array("pid_pos"), "neg").alias("pids"))
    return B.strings_qpp(lists, table(spark, sf_dir, "passages")).groupBy("qid", "place", "pid").agg(F.min("passage").alias("passage"))


def anti_join_unindexed(spark, sf_dir):
    """Passages that no triple names."""
    return table(spark, sf_dir, "passages").select("pid").distinct().join(table(spark, sf_dir, "triples").select("pid"), "pid", "left_anti")


def substring_pid_map(spark, sf_dir):
    """For each paragraph of generated_questions the first passage with its middle 40 characters."""
    g = table(spark, sf_dir, "generated_questions").where("passage is not null").select(F.col("gen_id").alias("hid"), F.col("passage").alias("text")).distinct()
    return B.middle_join(g, table(spark, sf_dir, "passages"))


def pid_to_url_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "passages").where("wid >= 0").select("pid", "wiki", "wid").distinct()
    newest = table(spark, sf_dir, "wiki_meta").groupBy("wiki", "wid").agg(F.max(F.struct("revid", "url")).alias("m"))
    return p.join(newest.select("wiki", "wid", "m.url"), ["wiki", "wid"]).select("pid", "wiki", "wid", "url")


def heading_anchor_url(spark, sf_dir):
    """Addresses of segmented passages with their headings as anchors."""
    d = table(spark, sf_dir, "documents").where("url is not null").select("doc_id", "url")
    return segment_page(spark, sf_dir).join(d, "doc_id").select("doc_id", "j", X.anchor_url("url", "passage").alias("anchor"))


def blueprint_shards(spark, sf_dir):
    """Long passages of pages with six or more, dealt in runs of five to annotators of their wiki."""
    p = table(spark, sf_dir, "passages").where("wid >= 0 and passage is not null").select("wiki", "wid", "pid", "passage").distinct()
    big = p.groupBy("wiki", "wid").agg(F.count("*").alias("n")).where("n >= 6")
    rows = p.where(F.char_length("passage") >= 600).join(big, ["wiki", "wid"], "left_semi").select("wiki", "wid", "pid")
    return B.shards(rows, ["pid"], 5, ["wiki"])


def batch_assign(spark, sf_dir):
    """Batches of 16 triples of a wiki in a pseudo-random order, unfilled ones left out."""
    t = table(spark, sf_dir, "triples").select("wiki", "qid_pos", "qid_neg", "pid").distinct()
    return B.batches(t.withColumn("key", B.shuffle_key(F.col("qid_pos") * 7 + F.col("pid"))), ["key", "qid_pos", "qid_neg", "pid"], 16, ["wiki"], True).drop("key")


def union_splits(spark, sf_dir):
    """The passages of all wikis but one, all splits."""
    return table(spark, sf_dir, "passages").where("wiki <> 'gloomspire'").select("pid", "wiki", "wid", "split").distinct()


def distinct_pids(spark, sf_dir):
    return table(spark, sf_dir, "triples").select("pid").distinct()


def qrels_sizes(spark, sf_dir):
    """Relevant passages a question, and the share of questions with several."""
    n = table(spark, sf_dir, "triples").groupBy("wiki", "qid_pos").agg(F.size(F.collect_set("pid")).alias("n"))
    return n.groupBy("wiki").agg(F.count("*").alias("n_queries"), F.round(F.avg((F.col("n") > 1).cast("int")), 6).alias("share_several"))


def prompt_render(spark, sf_dir):
    p = table(spark, sf_dir, "passages").where("passage is not null").select("pid", "passage").distinct()
    return p.select("pid", F.md5(X.prompt(2, 3, "passage", what=False).cast("binary")).alias("digest"))


def parse_llm_response(spark, sf_dir):
    """Answers in numbered lines, written from the QA pages, read back; questions of several lines are written in one."""
    a = _qa(spark, sf_dir).select("qa_id", F.posexplode("positive").alias("j", "p"), F.col("negative").alias("ns")).select("qa_id", "j", F.coalesce("p", F.array()).alias("p"), F.coalesce(F.get("ns", F.col("j")), F.array()).alias("n"))
    line = lambda c: F.expr(f"array_join(transform(filter({c}, x -> x is not null), (x, i) -> concat(i % 3 + 1, '. ', replace(x, '\\n', ' '))), '\\n')")
    rows = a.select("qa_id", "j", F.concat(line("p"), F.lit("\n---\n"), line("n")).alias("response"), F.size("p").alias("m")).select("qa_id", "j", X.response("response", 1 << 30).alias("r"))
    return rows.select("qa_id", "j", F.size("r.positive").alias("n_positive"), F.size("r.negative").alias("n_negative"), F.array_join("r.positive", "|").alias("positive"), F.array_join("r.negative", "|").alias("negative"))


def question_cells(spark, sf_dir):
    """Cells of both columns whose list parses, with the number of entries in it and their text."""
    g = table(spark, sf_dir, "generated_questions").select("gen_id", F.explode(F.create_map(F.lit("positive"), "positive", F.lit("negative"), "negative")).alias("side", "cell")).distinct()
    return g.select("gen_id", "side", X.list_literal("cell").alias("q")).where("q is not null").select("gen_id", "side", F.size("q").alias("n"), F.array_join("q", "|").alias("questions"))


def move_third_positive(spark, sf_dir):
    """Three positives become two, the third goes to the negatives."""
    rows = _qa(spark, sf_dir).select("qa_id", F.posexplode("positive").alias("j", "p"), F.col("negative").alias("ns")).where("size(p) = 3")
    n = F.concat(F.coalesce(F.get("ns", F.col("j")), F.array()), F.slice("p", 3, 1))
    return rows.select("qa_id", "j", F.size(F.slice("p", 1, 2)).alias("n_positive"), F.size(n).alias("n_negative"), F.element_at("p", 3).alias("moved"))


QUERIES = {
    f.__name__: f
    for f in (page_filter, paragraph_filter, heading_detect, sentence_split, split_long_sentence, split_paragraphs, segment_page, paragraph_stats, paragraph_words_stats, page_pids, pid_counts, exclusions, paragraphs_by_length, bucket_batches, shuffled_negatives, words_per_passage, dataset_stats, dataset_rollup, question_word_dist, question_word_dist_lower, question_word_pct_of_paragraphs, dedup_assign_ids, dedup_first_wins, neg_sampling_fill, ms_triples_qpp, qa_pairs_zip, qa_relations, qa_split_train_test_val, wiki_metadata, wiki_metadata_merge, triples_to_strings_qqp, triples_to_strings_qpp, anti_join_unindexed, substring_pid_map, pid_to_url_lookup, heading_anchor_url, blueprint_shards, batch_assign, union_splits, distinct_pids, qrels_sizes, prompt_render, parse_llm_response, question_cells, move_third_positive)
}

_LINES = """WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^(&lt;|__\\w*__)')) AS l FROM documents WHERE text IS NOT NULL)"""
_CUT = "list_filter(list_transform(string_split(regexp_replace(passage, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(65535), 'g'), chr(65535)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_SENT = f"""s AS (SELECT pid, {_CUT} AS l FROM (SELECT DISTINCT pid, passage FROM passages)),
k AS (SELECT pid, CAST(i - 1 AS INTEGER) AS k, l[i] AS sentence FROM s, UNNEST(range(1, CAST(len(l) + 1 AS BIGINT))) AS r(i))"""
_W = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: t <> '')"
_QA = "qa AS (SELECT DISTINCT wiki, qa_id, id, revid, url, title, text, positive, negative FROM qa_pages)"
_PAIRS = _QA + """,
para AS (SELECT wiki, qa_id, CAST(i - 1 AS INTEGER) AS j, text[i] AS passage, positive[i] AS p, negative[i] AS n FROM qa, UNNEST(range(1, CAST(len(text) + 1 AS BIGINT))) AS r(i)),
pr AS (SELECT wiki, qa_id, j, CAST(k - 1 AS INTEGER) AS n, passage, p[k] AS positive, para.n[k] AS negative
       FROM para, UNNEST(range(1, CAST(least(coalesce(len(p), 0), coalesce(len(para.n), 0)) + 1 AS BIGINT))) AS r(k) WHERE NOT ends_with(passage, ' .') AND contains(p[k], '?') AND contains(para.n[k], '?'))"""
_NEG = """t AS (SELECT DISTINCT wiki, qid_pos, pid FROM triples),
pg AS (SELECT DISTINCT wiki, wid, pid FROM passages WHERE wid >= 0),
own AS (SELECT DISTINCT t.wiki, wid, qid_pos AS qid FROM t JOIN pg USING (wiki, pid)),
c AS (SELECT DISTINCT qid, pid FROM own JOIN pg USING (wiki, wid) WHERE NOT EXISTS (FROM t WHERE t.qid_pos = own.qid AND t.pid = pg.pid)),
i AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY ((pid * 31 + qid) * 2654435761 + 42) % 4294967296, pid) - 1 AS i, count(*) OVER (PARTITION BY qid) AS m FROM c),
neg AS (SELECT i.qid, i.pid, CAST(p AS INTEGER) AS place FROM i, UNNEST(range(0, 9)) AS r(p) WHERE p % m = i.i AND i.i < 9)"""
NEGATIVES = _NEG
_META = """m AS (SELECT wiki, wid, max(struct_pack(revid := coalesce(revid, -1), url := coalesce(url, ''), title := coalesce(title, ''))) AS m FROM wiki_meta WHERE wid IS NOT NULL GROUP BY ALL)"""
_PS = ", ".join(f"quantile_cont(n, {p})::DOUBLE AS paragraphs_{n}" for p, n in ((0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95")))

_N = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: t <> ''))"
_FLUSH = "CASE WHEN trim(a.cur, ' ') = '' THEN a.out ELSE list_append(a.out, trim(a.cur, ' ')) END"
_ALL = "list_filter(regexp_split_to_array(e.x, '\\s+'), lambda t: t <> '')"
_SIZE = f"CAST(ceil({_N.format('e.x')} / ceil({_N.format('e.x')} / 30.0)) AS BIGINT)"
# The fold of split_paragraphs: elements and state have one type.
_FOLD = f"""WITH s AS (SELECT pid, passage, {_CUT} AS l FROM (SELECT DISTINCT pid, passage FROM passages WHERE passage IS NOT NULL)),
f AS (SELECT pid, list_reduce(list_concat([{{'out': CAST([] AS VARCHAR[]), 'cur': '', 'x': ''}}], list_transform(l, lambda x: {{'out': CAST([] AS VARCHAR[]), 'cur': '', 'x': x}})), lambda a, e:
  CASE WHEN {_N.format('a.cur')} + {_N.format('e.x')} <= 30 THEN {{'out': a.out, 'cur': a.cur || e.x || ' ', 'x': ''}}
       WHEN {_N.format('e.x')} > 30 THEN {{'out': list_concat({_FLUSH}, list_transform(range(0, CAST(ceil({_N.format('e.x')} / CAST({_SIZE} AS DOUBLE)) AS BIGINT)), lambda i: array_to_string({_ALL}[i * {_SIZE} + 1:(i + 1) * {_SIZE}], ' '))), 'cur': '', 'x': ''}}
       WHEN 2 * (30 - {_N.format('a.cur')}) >= {_N.format('e.x')} THEN {{'out': list_append(a.out, trim(a.cur || e.x, ' ')), 'cur': '', 'x': ''}}
       ELSE {{'out': {_FLUSH}, 'cur': e.x || ' ', 'x': ''}} END) AS a FROM s),
p AS (SELECT pid, CASE WHEN trim(a.cur, ' ') = '' THEN a.out WHEN {_N.format('a.cur')} < 8 AND len(a.out) > 0 THEN list_append(a.out[1:len(a.out) - 1], a.out[len(a.out)] || ' ' || trim(a.cur, ' ')) ELSE list_append(a.out, trim(a.cur, ' ')) END AS out FROM f)
SELECT pid, CAST(i - 1 AS INTEGER) AS part, out[i] AS words FROM p, UNNEST(range(1, CAST(len(out) + 1 AS BIGINT))) AS r(i)"""

ORACLE = {
    "page_filter": "SELECT doc_id FROM documents WHERE len(string_split(trim(text, ' '), ' ')) >= 8 AND NOT regexp_matches(text, '^__\\w*__')",
    "paragraph_filter": _LINES + " SELECT doc_id, CAST(i - 1 AS INTEGER) AS j, l[i] AS paragraph FROM d, UNNEST(range(1, CAST(len(l) + 1 AS BIGINT))) AS r(i)",
    "heading_detect": _LINES + " SELECT doc_id, CAST(i - 1 AS INTEGER) AS j, substr(l[i - 1], 1, length(l[i - 1]) - 1) AS heading FROM d, UNNEST(range(2, CAST(len(l) + 1 AS BIGINT))) AS r(i) WHERE len(string_split(l[i - 1], ' ')) <= 8",
    "sentence_split": f"WITH {_SENT} SELECT * FROM k",
    "split_long_sentence": f"""WITH {_SENT}, w AS (SELECT pid, k, {_W.format('sentence')} AS w FROM k),
z AS (SELECT *, CAST(ceil(len(w) / ceil(len(w) / 12.0)) AS BIGINT) AS size FROM w WHERE len(w) > 12)
SELECT pid, k, CAST(i AS INTEGER) AS part, array_to_string(w[i * size + 1:(i + 1) * size], ' ') AS words FROM z, UNNEST(range(0, CAST(ceil(len(w) / size::DOUBLE) AS BIGINT))) AS r(i)""",
    "split_paragraphs": _FOLD,
    "prompt_render": "SELECT DISTINCT pid, md5('" + X.prompt_text(2, 3, what=False) + "' || passage) AS digest FROM passages WHERE passage IS NOT NULL",
    "parse_llm_response": f"""WITH {_QA}, r AS (SELECT qa_id, CAST(i - 1 AS INTEGER) AS j, list_filter(coalesce(positive[i], []), lambda x: x IS NOT NULL) AS p, list_filter(coalesce(negative[i], []), lambda x: x IS NOT NULL) AS n FROM qa, UNNEST(range(1, CAST(len(positive) + 1 AS BIGINT))) AS r(i))
SELECT qa_id, j, CAST(len(p) AS INTEGER) AS n_positive, CAST(len(n) AS INTEGER) AS n_negative, array_to_string(list_transform(p, lambda x: regexp_replace(replace(x, chr(10), ' '), '^[ \\t\\r\\f]', '')), '|') AS positive, array_to_string(list_transform(n, lambda x: regexp_replace(replace(x, chr(10), ' '), '^[ \\t\\r\\f]', '')), '|') AS negative FROM r""",
    "paragraph_stats": _LINES + f" SELECT round(avg(n), 6) AS paragraphs_mean, min(n)::INTEGER AS paragraphs_least, max(n)::INTEGER AS paragraphs_most, {_PS} FROM (SELECT len(l) AS n FROM d)",
    "paragraph_words_stats": _LINES + f" SELECT round(avg(n), 6) AS words_mean, min(n)::INTEGER AS words_least, max(n)::INTEGER AS words_most, {_PS.replace('paragraphs_', 'words_')} FROM (SELECT len(string_split(unnest(l), ' ')) AS n FROM d)",
    "page_pids": "SELECT wiki, wid, string_agg(pid, ',' ORDER BY pid) AS pids FROM (SELECT DISTINCT wiki, wid, pid FROM passages WHERE wid >= 0) GROUP BY ALL",
    "pid_counts": """WITH g AS (SELECT DISTINCT gen_id AS hid, passage AS text FROM generated_questions WHERE passage IS NOT NULL),
n AS (SELECT hid, substr(text, CAST(greatest(1, length(text) // 2 - 19) AS BIGINT), 40) AS mid FROM g),
m AS (SELECT hid, coalesce(min(pid), -1) AS pid FROM n LEFT JOIN passages p ON mid <> '' AND contains(p.passage, mid) GROUP BY hid) SELECT pid, count(*) AS n FROM m GROUP BY pid""",
    "exclusions": f"""WITH {_QA}, r AS (SELECT wiki, text[i] AS p, coalesce(len(positive[i]), 0) AS a, coalesce(len(negative[i]), 0) AS b FROM qa, UNNEST(range(1, CAST(len(text) + 1 AS BIGINT))) AS r(i))
SELECT wiki, count(*) AS n, round(avg(ends_with(p, ' .')::INT), 6) AS excluded, count(*) FILTER (a <> b) AS unequal FROM r GROUP BY wiki""",
    "paragraphs_by_length": f"""WITH {_QA}, r AS (SELECT qa_id, CAST(i - 1 AS INTEGER) AS j, text[i] AS p FROM qa, UNNEST(range(1, CAST(len(text) + 1 AS BIGINT))) AS r(i) WHERE text[i] IS NOT NULL)
SELECT qa_id, j, row_number() OVER (ORDER BY len(string_split(p, ' ')) DESC, qa_id, j) - 1 AS place, row_number() OVER (ORDER BY qa_id, j) - 1 AS original FROM r""",
    "shuffled_negatives": """WITH t AS (SELECT DISTINCT wiki, qid_pos AS qid, pid FROM triples),
o AS (SELECT *, row_number() OVER (PARTITION BY wiki ORDER BY ((qid * 7 + pid) * 2654435761 + 42) % 4294967296, qid, pid) - 1 AS place, count(*) OVER (PARTITION BY wiki) AS n FROM t)
SELECT x.wiki, x.qid, x.pid, nullif(y.pid, x.pid) AS neg FROM o x JOIN o y ON y.wiki = x.wiki AND y.place = (x.place + 1) % x.n""",
    "bucket_batches": """WITH p AS (SELECT pid, max(length(passage)) AS chars FROM passages WHERE passage IS NOT NULL GROUP BY pid),
t AS (SELECT DISTINCT wiki, qid_pos, qid_neg, pid, chars FROM triples JOIN p USING (pid)),
b AS (SELECT *, row_number() OVER (PARTITION BY wiki ORDER BY ((qid_pos * 7 + pid) * 2654435761 + 42) % 4294967296, qid_pos, qid_neg, pid) - 1 AS place FROM t),
c AS (SELECT *, place // 32 AS bucket, row_number() OVER (PARTITION BY wiki, place // 32 ORDER BY chars DESC, place) - 1 AS seat FROM b)
SELECT wiki, qid_pos, qid_neg, pid, bucket, bucket * 4 + seat // 8 AS batch, CAST((seat % 8) // 3 AS INTEGER) AS sub FROM c""",
    "words_per_passage": "SELECT wiki, split, count(*) AS n, median(len(string_split(passage, ' '))) AS median_words FROM (SELECT DISTINCT wiki, split, pid, passage FROM passages WHERE passage IS NOT NULL) GROUP BY ALL",
    "dataset_stats": """SELECT 'passages' AS tab, count(*) AS n, median(len(string_split(passage, ' '))) AS median_words FROM (SELECT DISTINCT pid, passage FROM passages)
UNION ALL SELECT 'queries', count(*), median(len(string_split(query, ' '))) FROM (SELECT DISTINCT qid, query FROM queries)
UNION ALL SELECT 'triples', count(*), NULL FROM (SELECT DISTINCT pid FROM triples)""",
    "dataset_rollup": "SELECT wiki, split, grouping(wiki, split) AS level, count(*) AS n FROM (SELECT DISTINCT wiki, split, pid FROM passages) GROUP BY ROLLUP (wiki, split)",
    "question_word_dist": "SELECT split_part(query, ' ', 1) AS word, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT DISTINCT qid, query FROM queries WHERE query IS NOT NULL) GROUP BY ALL",
    "question_word_dist_lower": """WITH g AS (SELECT DISTINCT qa_id, positive, negative FROM qa_pages), q AS (SELECT unnest(flatten(list_filter(list_concat(coalesce(negative, []), coalesce(positive, [])), lambda x: x IS NOT NULL))) AS q FROM g)
SELECT lower(split_part(q, ' ', 1)) AS word, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM q WHERE q <> '' GROUP BY ALL""",
    "question_word_pct_of_paragraphs": """WITH d AS (SELECT DISTINCT qa_id, text, positive FROM qa_pages), q AS (SELECT unnest(flatten(list_filter(coalesce(positive, []), lambda x: x IS NOT NULL))) AS q FROM d)
SELECT lower(split_part(q, ' ', 1)) AS word, count(*) AS n, round(100 * count(*) / (SELECT sum(len(text)) FROM d)::DOUBLE, 3) AS percent FROM q WHERE q <> '' GROUP BY ALL""",
    "dedup_assign_ids": "SELECT query, row_number() OVER (ORDER BY f, query) - 1 AS new_id FROM (SELECT query, min(qid) AS f FROM queries WHERE query IS NOT NULL GROUP BY query)",
    "dedup_first_wins": "SELECT pid, wid, wiki, split, epoch_us(loaded_at) AS loaded_us FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY loaded_at NULLS FIRST, split NULLS FIRST, passage NULLS FIRST) AS r FROM passages) WHERE r = 1",
    "neg_sampling_fill": f"WITH {_NEG} SELECT qid, pid, place FROM neg",
    "ms_triples_qpp": f"WITH {_NEG} SELECT qid, t.pid AS pid_pos, place, neg.pid AS pid_neg FROM neg JOIN (SELECT DISTINCT qid_pos, pid FROM triples) t ON qid_pos = qid",
    "qa_pairs_zip": f"WITH {_PAIRS} SELECT wiki, qa_id, j, n, passage, positive, negative FROM pr",
    "qa_relations": f"""WITH {_PAIRS}
SELECT 'passages' AS tab, row_number() OVER (ORDER BY qa_id, j) - 1 AS id, qa_id, j FROM para WHERE NOT ends_with(passage, ' .')
UNION ALL SELECT 'queries', row_number() OVER (ORDER BY qa_id, j, n, side) - 1, qa_id, j FROM pr, (SELECT unnest([0, 1]) AS side)""",
    "qa_split_train_test_val": f"""WITH {_PAIRS}, c AS (SELECT wiki, qa_id, count(*) AS n FROM pr GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY wiki ORDER BY (qa_id * 2654435761 + 42) % 4294967296 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY wiki) AS before FROM c)
SELECT wiki, qa_id, n, CASE WHEN before < 0.8 THEN 'train' WHEN before < 0.9 THEN 'test' ELSE 'val' END AS split FROM b""",
    "wiki_metadata": f"""WITH {_META}, p AS (SELECT wiki, wid, count(*) AS n_pids, min(pid) AS first_pid, max(pid) AS last_pid FROM (SELECT DISTINCT wiki, wid, pid FROM passages WHERE wid >= 0) GROUP BY ALL)
SELECT wiki, wid, nullif(m.revid, -1) AS revid, nullif(m.url, '') AS url, nullif(m.title, '') AS title, coalesce(n_pids, 0) AS n_pids, first_pid, last_pid FROM m LEFT JOIN p USING (wiki, wid)""",
    "wiki_metadata_merge": f"""WITH {_META}, r AS (SELECT wiki, id AS wid, max(title) AS title FROM qa_pages WHERE id IS NOT NULL GROUP BY ALL)
SELECT wiki, wid, nullif(m.title, '') AS title FROM m ANTI JOIN r USING (wiki, wid) UNION ALL SELECT wiki, wid, title FROM r""",
    "triples_to_strings_qqp": """WITH q AS (SELECT DISTINCT qid, query FROM queries), p AS (SELECT DISTINCT pid, passage FROM passages WHERE passage IS NOT NULL), t AS (SELECT DISTINCT qid_pos, qid_neg, pid FROM triples)
SELECT t.*, a.query AS positive, b.query AS negative, passage FROM t JOIN q a ON a.qid = qid_pos LEFT JOIN q b ON b.qid = qid_neg JOIN p USING (pid)""",
    "triples_to_strings_qpp": f"""WITH {_NEG}, l AS (SELECT qid, place + 1 AS place, pid FROM neg WHERE qid IN (SELECT qid_pos FROM triples) UNION SELECT qid, 0, t.pid FROM (SELECT DISTINCT qid FROM neg) JOIN t ON qid_pos = qid)
SELECT qid, CAST(place AS INTEGER) AS place, pid, min(passage) AS passage FROM l JOIN passages USING (pid) WHERE passage IS NOT NULL GROUP BY ALL""",
    "anti_join_unindexed": "SELECT DISTINCT pid FROM passages WHERE pid NOT IN (SELECT pid FROM triples WHERE pid IS NOT NULL)",
    "substring_pid_map": """WITH g AS (SELECT DISTINCT gen_id AS hid, passage AS text FROM generated_questions WHERE passage IS NOT NULL),
n AS (SELECT hid, substr(text, CAST(greatest(1, length(text) // 2 - 19) AS BIGINT), 40) AS mid FROM g)
SELECT hid, coalesce(min(pid), -1) AS pid FROM n LEFT JOIN passages p ON mid <> '' AND contains(p.passage, mid) GROUP BY hid""",
    "pid_to_url_lookup": """WITH m AS (SELECT wiki, wid, max(struct_pack(revid := coalesce(revid, -1), url := coalesce(url, ''))) AS m FROM wiki_meta GROUP BY ALL)
SELECT DISTINCT pid, wiki, wid, nullif(m.url, '') AS url FROM passages JOIN m USING (wiki, wid) WHERE wid >= 0""",
    "blueprint_shards": """WITH p AS (SELECT DISTINCT wiki, wid, pid, passage FROM passages WHERE wid >= 0 AND passage IS NOT NULL),
r AS (SELECT wiki, wid, pid, (row_number() OVER (PARTITION BY wiki ORDER BY pid) - 1) // 5 + 1 AS person FROM p WHERE length(passage) >= 600 AND (wiki, wid) IN (SELECT (wiki, wid) FROM p GROUP BY wiki, wid HAVING count(*) >= 6))
SELECT wiki, wid, pid, person FROM (SELECT *, count(*) OVER (PARTITION BY wiki, person) AS c FROM r) WHERE c = 5""",
    "batch_assign": """WITH t AS (SELECT DISTINCT wiki, qid_pos, qid_neg, pid FROM triples),
b AS (SELECT *, (row_number() OVER (PARTITION BY wiki ORDER BY ((qid_pos * 7 + pid) * 2654435761 + 42) % 4294967296, qid_pos, qid_neg, pid) - 1) // 16 AS batch FROM t)
SELECT wiki, qid_pos, qid_neg, pid, batch FROM (SELECT *, count(*) OVER (PARTITION BY wiki, batch) AS c FROM b) WHERE c = 16""",
    "union_splits": "SELECT DISTINCT pid, wiki, wid, split FROM passages WHERE wiki <> 'gloomspire'",
    "distinct_pids": "SELECT DISTINCT pid FROM triples",
    "qrels_sizes": "SELECT wiki, count(*) AS n_queries, round(avg((n > 1)::INT), 6) AS share_several FROM (SELECT wiki, qid_pos, count(DISTINCT pid) AS n FROM triples GROUP BY ALL) GROUP BY wiki",
    "move_third_positive": f"""WITH {_QA}, r AS (SELECT qa_id, CAST(i - 1 AS INTEGER) AS j, positive[i] AS p, negative[i] AS n FROM qa, UNNEST(range(1, CAST(len(positive) + 1 AS BIGINT))) AS r(i))
SELECT qa_id, j, 2 AS n_positive, CAST(coalesce(len(n), 0) + 1 AS INTEGER) AS n_negative, p[3] AS moved FROM r WHERE len(p) = 3""",
}
