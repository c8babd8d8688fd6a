from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from wikiloom.functions import text as X
from wikiloom.operators import dataset as B, segment as S
from wikiloom.sources import files


def test_split_paragraphs_equals_twin(spark, small):
    p = [r.passage for r in spark.read.parquet(f"{small}/passages.parquet").select("passage").where("passage is not null").collect()]
    p += ["", " . ", "one two. " * 40, "word " * 300, "A. B! C?", "no end", "x" * 50]
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p string").select("i", S.split_paragraphs("p", 30, 8).alias("s")).orderBy("i").collect()]
    assert [[x.strip() for x in s] for s in got] == [S.passages_of(x, 30, 8) for x in p]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=12))
def test_passages_keep_all_words(sizes):
    text = " ".join(" ".join(f"w{i}x{j}" for j in range(n)) + "." for i, n in enumerate(sizes))
    assert " ".join(S.passages_of(text, 20, 5)).split() == text.split()


def test_segment_headings():
    page = "Title of it.\n" + "first sentence here is long enough to count as a real paragraph of text. " * 3 + "\n__TOC__\n&lt;div\nPowers.\nShe could fly over the whole wide country and back again before the night fell on it, they said, every single day."
    got = S.segment(page)
    assert got[0].startswith("[Title of it] first") and got[-1].startswith("[Powers] She")


def test_dense_ids_are_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    got = {r.k: r.i for r in B.dense_ids(df, ["k"], "i").collect()}
    assert got == {k: k for k in range(1000)}


def test_middle_join(spark):
    p = spark.createDataFrame([(3, "abc" * 30), (1, "x" * 10 + "needle in the hay, which is long enough for this test" + "y" * 9), (2, None)], "pid long, passage string")
    n = spark.createDataFrame([(10, "needle in the hay, which is long enough for this test"), (11, "nowhere"), (12, ""), (13, "hay")], "hid long, text string")
    assert {r.hid: r.pid for r in B.middle_join(n, p).collect()} == {10: 1, 11: -1, 12: -1, 13: 1}


def test_fill_negatives(spark):
    c = spark.createDataFrame([(1, p) for p in range(3)] + [(2, p) for p in range(20)], "qid long, pid long")
    got = B.fill_negatives(c).groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("place").alias("m"), F.countDistinct("pid").alias("k")).orderBy("qid").collect()
    assert [tuple(r) for r in got] == [(1, 9, 9, 3), (2, 9, 9, 9)]


def test_text_functions(spark):
    one = spark.createDataFrame([("1. Who?\n2. Why?\n---\n1. What?\nnoise\n2. Where?",)], "r string").select(X.response("r", 3).alias("x")).first().x
    assert one.positive == ["Who?", "Why?"] and one.negative == ["What?", "Where?"]
    lists = spark.createDataFrame([("['a', \"b's\"]",), ('["x"]',), ("oops",), (None,)], "c string").select(X.list_literal("c").alias("l")).collect()
    assert [r.l for r in lists] == [["a", "b's"], ["x"], None, None]
    url = spark.createDataFrame([("http://h/p", "[My head] text"), ("http://h/p", "text")], "u string, p string").select(X.anchor_url("u", "p").alias("a")).collect()
    assert [r.a for r in url] == ["http://h/p#My_head", "http://h/p"]
    assert spark.createDataFrame([("Éa ñandú x",)], "t string").select(X.terms("t").alias("t")).first().t == ["ea", "nandu"]


def test_files_round_trip(spark, tmp_path):
    d = tmp_path / "set"
    p = spark.createDataFrame([(0, "a\tb \"q\"", 5), (1, "", 6), (2, None, 7)], "pid long, passage string, wid long")
    files.write_delimited(p, str(d / "passages.tsv"), ["PID", "passage", "WID"])
    files.write_delimited(spark.createDataFrame([(0, "q?"), (1, None)], "qid long, query string"), str(d / "queries.tsv"))
    files.write_delimited(spark.createDataFrame([(0, 1, 0)], "a long, b long, c long"), str(d / "triples.tsv"), ["QID+", "QID-", "PID"])
    got = files.dataset(spark, str(d))
    assert [tuple(r) for r in got["passages"].collect()] == [(0, 'a\tb "q"', 5)]
    assert sorted(tuple(r) for r in got["queries"].collect()) == [(0, "q?"), (1, "")]
    assert [tuple(r) for r in got["triples"].collect()] == [(0, 1, 0)]


def test_stream_grows_index(spark, small, tmp_path):
    from wikiloom.streaming import index as I

    src = tmp_path / "in"
    p = spark.read.parquet(f"{small}/passages.parquet").select("pid", "passage", "wid", "wiki", "split", "loaded_at")
    p.where("pid % 2 = 0").write.parquet(str(src))
    for _ in range(2):
        I.grow(I.stream_passages(spark, str(src)), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    first = spark.read.parquet(str(tmp_path / "index"))
    assert first.count() == first.select("scope", "pid").distinct().count() > 100
    n = first.count()
    p.where("pid % 2 = 1").write.mode("append").parquet(str(src))
    I.grow(I.stream_passages(spark, str(src)), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).count() > n
