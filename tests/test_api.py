import pytest

from pyspark.sql import functions as F

from wikiloom import cli, config as C
from wikiloom.api import Passages, Queries, Retriever, TripleDataset, Triples
from wikiloom.operators import dataset as B, qgen as G, segment as S
from wikiloom.sources import files

TEXTS = ["cats chase mice in the barn", "dogs bark at cats", "the barn is red", "mice eat cheese", "red cheese and red wine", "birds sing"]


@pytest.fixture
def folder(spark, tmp_path):
    files.write_delimited(spark.createDataFrame([(i, t, -1) for i, t in enumerate(TEXTS)], "pid long, passage string, wid long"), str(tmp_path / "passages.tsv"))
    files.write_delimited(spark.createDataFrame([(0, "who chase mice"), (1, "red wine"), (2, "nothing here")], "qid long, query string"), str(tmp_path / "queries.tsv"))
    files.write_delimited(spark.createDataFrame([(0, 2, 0), (1, 2, 4)], "a long, b long, c long"), str(tmp_path / "triples.tsv"))
    return tmp_path


def test_lookup_and_strings(spark, folder):
    d = TripleDataset.folder(spark, str(folder))
    assert len(d.passages) == 6 and d.passages[1] == TEXTS[1] and d.passages[[4, 0]] == [TEXTS[4], TEXTS[0]] and 9 not in d.passages
    assert d.passages.strings([9, 1], skip_missing=True) == [TEXTS[1]]
    with pytest.raises(KeyError):
        d.passages[9]
    assert sorted(d.queries) == [0, 1, 2] and len(d.triples) == 2 and len(list(d.triples.shuffle())) == 2
    assert {(r.positive, r.passage) for r in d.strings().collect()} == {("who chase mice", TEXTS[0]), ("red wine", TEXTS[4])}


def test_qpp(spark, tmp_path):
    files.write_delimited(spark.createDataFrame([(0, 1, 2, 3, 4)], "a long, b long, c long, d long, e long"), str(tmp_path / "t.tsv"))
    assert list(Triples.read(spark, str(tmp_path / "t.tsv"), "QPP")) == [(0, 1, [2, 3, 4])]
    assert list(Triples.read(spark, str(tmp_path / "t.tsv"), "QPP", 2)) == [(0, 1, [2])]
    with pytest.raises(ValueError):
        Triples.read(spark, str(tmp_path / "t.tsv"), "other")


def test_retriever_and_cli(spark, folder):
    args = ["--passages-path", str(folder / "passages.tsv"), "--queries-path", str(folder / "queries.tsv"), "--triples-path", str(folder / "triples.tsv"), "--index-path", str(folder / "ix"), "--min-df", "1", "--k", "3"]
    cli.run(["evaluate", *args, "--out", str(folder / "out")], spark)
    rows = {r["mode"]: r for r in spark.read.parquet(str(folder / "out")).collect()}
    assert set(rows) == {"tf_idf", "rerank", "full"} and all(r.recall_3 == 100.0 for r in rows.values())
    cli.run(["search", *args, "--mode", "rerank", "--out", str(folder / "s")], spark)
    assert spark.read.parquet(str(folder / "s")).where("qid = 1 and rank = 1").first().pid == 4
    r = Retriever(Passages.read(spark, str(folder / "passages.tsv")), C.Config(min_df=1))
    with pytest.raises(ValueError):
        r.search(Queries.read(spark, str(folder / "queries.tsv")).df, "other")


def test_config_round_trip(tmp_path):
    c = C.Config(k=7, similarity="l2")
    C.save(c, str(tmp_path / "c.json"))
    assert C.load(str(tmp_path / "c.json")) == c
    (tmp_path / "c.json").write_text('{"kk": 1}')
    with pytest.raises(ValueError):
        C.load(str(tmp_path / "c.json"))


def test_generation_resumes(spark):
    pages = spark.createDataFrame([(0, ["first one", "broken ."]), (1, ["second one", None])], "i long, text array<string>")
    answer = lambda requests: ["1. Who?\n2. Why?\n3. Where?\n---\n1. What?" if "first" in r else None for r in requests]
    none = spark.createDataFrame([], "i long, j int, positive array<string>")
    rows = G.pending(pages, none)
    assert rows.count() == 2
    got = G.adaptive(rows, none, answer)
    assert [(r.i, r.j, r.positive, r.negative) for r in got.collect()] == [(0, 0, ["Who?", "Why?", "Where?"], ["What?"])]
    assert [(r.i, r.j) for r in G.pending(pages, got).collect()] == [(1, 0)]
    full = {r.i: (r.positive, r.negative) for r in G.attach(pages, got).collect()}
    assert full == {0: ([["Who?", "Why?"], []], [["What?", "Where?"], []]), 1: ([[], []], [[], []])}
    q = spark.createDataFrame([("Is it so?", "text"), ("a piece of it?", "this is a piece of it here"), ("no mark", "x")], "q string, p string").select(G.own_words(F.col("q"), F.col("p")).alias("o")).collect()
    assert [r.o for r in q] == [["Is it so?"], [], []]


def test_search_results(spark):
    rows = spark.createDataFrame(
        [(0, "q a", (["x", "y", "z"], [1, 0, 0])), (1, "q b", (["x", "w"], [0, 0])), (2, "q a", (["x", "v"], [1, 1])), (3, None, (["u"], [0]))],
        "row_id long, query string, passages struct<passage_text:array<string>,is_selected:array<int>>",
    )
    got = B.from_search_results(rows, n=3)
    assert {r["query"]: r.qid for r in got["queries"].collect()} == {"q a": 0, "q b": 1}
    pid = {r.text: r.pid for r in got["passages"].collect()}
    assert sorted(pid.values()) == list(range(6)) and pid["x"] == 0
    triples = got["triples"].collect()
    assert {(r.qid, r.pid_pos) for r in triples} == {(0, pid["x"]), (0, pid["v"])} and all(len(r.pid_neg) == 3 and set(r.pid_neg) == {pid["y"], pid["z"]} for r in triples)


def test_human_and_legacy(spark):
    b = spark.createDataFrame([("a", 1, ["...", "...", "..."], ["n?"]), ("a", 2, ["p?", ""], None), ("a", 3, ["late?"], [])], "annotator string, pid long, pos_query array<string>, neg_query array<string>")
    assert sorted((r.pid, r.side, r.question) for r in B.human_pairs(b, 2).collect()) == [(1, "negative", "n?"), (2, "positive", "p?")]
    pages = spark.createDataFrame([(1, 0, [(["q?"], "p")]), (1, 1, [(["late?"], "p")])], "id long, ord int, text array<struct<questions:array<string>,passage:string>>")
    assert [(r.question, r.qid_neg) for r in B.legacy_pairs(pages).collect()] == [("q?", -1)]
    s = spark.createDataFrame([(1, 5, "a", 0.5), (1, 4, "b", 0.5), (2, 1, "c", 0.1)], "qid long, pid long, answer string, score double")
    assert {r.qid: r.answer for r in B.best_answer(s).collect()} == {1: "b", 2: "c"}
    h = spark.createDataFrame([("<p>a&amp;b</p><script>x()</script><b>c",)], "h string").select(S.html_text("h").alias("t")).first().t
    assert h == "a&b\n c" or h == "a&b\nc"
    d = spark.createDataFrame([(1, "T", "Head.\nThis is the long body of the section.\nshort")], "id long, title string, text string")
    assert [r.passage for r in S.heading_body(d, "id", "title", "text").collect()] == ["T Head This is the long body of the section."]
