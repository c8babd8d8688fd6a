"""Text functions against plain Python."""

import ast
import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from wikiloom.functions import text as X
from wikiloom.operators import dataset as B, lexical as L, metrics as M, segment as S


def test_segmentation_keeps_the_text(spark):
    text = "Version 3.14 of example.com costs 1.5 coins. .NET too... Is it?! Yes.\n...\nEnd"
    squeezed = re.sub(r"\s+", "", text)
    assert S.passages_of(text, 120, 1) == [re.sub(r"\s+", " ", text)]
    for most in (3, 5, 120):
        assert re.sub(r"\s+", "", "".join(S.passages_of(text, most, 1))) == squeezed
    row = spark.createDataFrame([(text,)], "t string").select(X.sentences("t").alias("s"), S.split_paragraphs("t", 5, 1).alias("p")).first()
    assert row.s == ["Version 3.14 of example.com costs 1.5 coins.", ".NET too...", "Is it?!", "Yes.", "...", "End"]
    assert re.sub(r"\s+", "", "".join(row.p)) == squeezed


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c)).lower()


def test_folding_equals_decomposition(spark):
    texts = ["Trần Nguyễn", "ＦＵＬＬ ｗｉｄｔｈ １２", "ﬁne eﬀect ﬂow", "Ĳssel ǆ", "naïve Éa", "été", "Straße", "東京 ガ", "plain ASCII", "", "𝐁old"]
    got = [r.f for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.fold("t").alias("f")).orderBy("i").collect()]
    assert got[:-1] == [plain(t) for t in texts[:-1]] and got[-1]


def parsed(cell):
    for read in (json.loads, ast.literal_eval):
        try:
            v = read(cell.strip())
        except Exception:
            continue
        v = [v] if isinstance(v, str) else v
        return list(v) if isinstance(v, (list, tuple)) else None
    return None


def test_lists_in_both_notations(spark):
    cells = ['["a", null]', '["a", None]', "('a', 'b')", "('a',)", '"one"', "'one'", "['None', None, \"it's None\"]", "[]", "()", "[None]", ' ["x"] \n', "['a', \"b, None, c\"]", "nothing", "[1, 2", "None", ""]
    got = [r.l for r in spark.createDataFrame(list(enumerate(cells)), "i int, c string").select("i", X.list_literal("c").alias("l")).orderBy("i").collect()]
    assert got == [parsed(c) for c in cells]


def test_lists_of_generated_questions(spark, small):
    rows = spark.read.parquet(f"{small}/generated_questions.parquet").select("positive", X.list_literal("positive").alias("l")).where("positive is not null").collect()
    pairs = [(r.l, [x if x is None else str(x) for x in v] if isinstance(v := parsed(r.positive), list) and all(x is None or isinstance(x, str) for x in v) else None) for r in rows]
    assert len(pairs) > 20 and all(a == b for a, b in pairs if b is not None)


def test_order_and_sums_within_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, rng.randrange(9)) for i in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "g string, k long, w long").repartition(7)
    place, before = {}, {}
    for g in {r[0] for r in rows}:
        total = 0
        for n, (_, k, w) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1])):
            place[g, k], before[g, k] = n, total
            total += w
    assert {(r.g, r.k): r.p for r in B.in_order(df, "g", "k", "p").collect()} == place
    assert {(r.g, r.k): r.s for r in B.running(df, ["g"], ["k"], "w", "s").collect()} == before
    assert B.in_order(df.limit(0), "g", "k", "p").count() == 0 == B.running(df.limit(0), ["g"], ["k"], "w", "s").count()


def test_marks_of_subwords(spark):
    rows = spark.createDataFrame([("##ing",), ("\u0120the",), ("\u2581a",), ("plain##",)], "t string").select(X.bare_token("t").alias("t")).collect()
    assert [r.t for r in rows] == ["ing", "the", "a", "plain##"]


def test_shuffled_negatives(spark):
    pairs = spark.createDataFrame([("a", q, q % 5) for q in range(30)] + [("b", 1, 1), (None, 2, 3), (None, 3, 4)], "wiki string, qid long, pid long")
    got = B.shuffled_negatives(pairs, ["wiki"]).collect()
    assert len(got) == 33 and all(r.neg != r.pid for r in got) and {r.neg for r in got if r.wiki == "b"} == {None} and {r.neg for r in got if r.wiki is None} == {3, 4}
    assert B.shuffled_negatives(pairs.limit(0), ["wiki"]).count() == 0


def corpus(spark):
    rng = random.Random(1)
    docs = [("s", i, " ".join(rng.choices(["red", "blue", "green", "grey", "pink"], k=3))) for i in range(40)] + [("s", 90, ""), ("t", 1, "red"), ("t", 2, "sky")]
    asked = [("s", 1, "red blue"), ("s", 2, "nothing known"), ("t", 3, "sky"), ("u", 4, "red")]
    return spark.createDataFrame(docs, "scope string, pid long, text string"), spark.createDataFrame(asked, "scope string, qid long, text string"), docs, asked


def test_zero_fill_worst_and_places(spark):
    docs, asked, rows, questions = corpus(spark)
    index = L.TfIdf(docs, min_df=1)
    score = {(r.scope, r.qid, r.pid): r.score for r in index.scores(asked).collect()}
    order = {(s, q): sorted((p for t, p, _ in rows if t == s), key=lambda p: (-score.get((s, q, p), 0.0), p)) for s, q, _ in questions}
    top = {}
    for r in index.topk(asked, 25, zero_fill=True).orderBy("rank").collect():
        top.setdefault((r.scope, r.qid), []).append(r.pid)
    assert top == {k: v[:25] for k, v in order.items() if v}
    both = {(r.scope, r.qid, r.rank): r.pid for r in index.best_and_worst(asked, 3, 4).collect()}
    want = {(s, q, i + 1): p for (s, q), v in order.items() for i, p in enumerate(v) if i < 3 or i >= len(v) - 4}
    assert both == want
    pairs = spark.createDataFrame([(s, q, p) for (s, q), v in order.items() for p in v], "scope string, qid long, pid long")
    assert {(r.scope, r.qid, r.pid): r.rank for r in L.places(pairs, index.scores(asked), docs).collect()} == {(s, q, p): i for (s, q), v in order.items() for i, p in enumerate(v)}
    some = pairs.where("pid % 3 = 0")
    assert {(r.scope, r.qid, r.pid): r.score for r in index.scores(asked, some).collect()} == {k: v for k, v in score.items() if k[2] % 3 == 0}


def test_blocks_of_questions(spark, monkeypatch):
    docs, asked, _, _ = corpus(spark)
    whole = sorted(map(tuple, L.Bm25(docs).topk(asked, 5).collect()))
    monkeypatch.setattr(L, "BLOCK", 1)
    assert sorted(map(tuple, L.Bm25(docs).topk(asked, 5).collect())) == whole


def test_f_beta_and_in_best(spark):
    ranks = spark.createDataFrame([("s", 0, 9), ("s", 2, 8), ("s", 7, 1)], "scope string, positive long, negative long")
    r = M.rank_scores(ranks, F.lit(10), beta=2.0).first()
    assert abs(r.f_beta - 5 * r.precision * r.recall / (4 * r.precision + r.recall)) < 1e-5
    b = M.in_best(ranks, (1, 3)).first()
    assert (b.in_best_1, b.in_best_3) == (0.333333, 0.666667) and abs(b.mrr_positive - (1 + 1 / 3 + 1 / 8) / 3) < 1e-6
