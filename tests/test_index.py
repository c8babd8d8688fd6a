"""Containers, indexes, sinks and encoders."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wikiloom import api as A
from wikiloom.operators import dense as D
from wikiloom.sources import files


def relations(spark, mode):
    q = A.Queries(spark.createDataFrame([(1, "who?"), (2, "why?"), (3, "when?")], "qid long, query string"))
    p = A.Passages(spark.createDataFrame([(7, "seven"), (8, "eight"), (9, "nine")], "pid long, passage string"))
    if mode == "QQP":
        t = A.Triples(spark.createDataFrame([(1, 2, 7), (3, -1, 8)], "qid_pos long, qid_neg long, pid long"), mode)
    else:
        t = A.Triples(spark.createDataFrame([(1, 7, [8, 9]), (3, 9, [7, 5])], "qid long, pid_pos long, pid_neg array<long>"), mode)
    return A.TripleDataset(t, q, p)


@pytest.mark.parametrize("mode,want", [("QQP", [(["who?", "why?"], ["seven"]), (["when?", None], ["eight"])]), ("QPP", [(["who?"], ["seven", "eight", "nine"]), (["when?"], ["nine", "seven", None])])])
def test_triples_by_place(spark, mode, want):
    d = relations(spark, mode)
    assert len(d) == 2 and [d[0], d[1]] == want
    seen = sorted(map(str, d))
    assert seen == sorted(str(([*q], [x for x in p if x is not None])) for q, p in want)
    with pytest.raises(IndexError):
        d[2]


def test_indexes_share_an_interface(spark, tmp_path):
    docs = spark.createDataFrame([("s", i, t) for i, t in enumerate(["red fox", "blue whale", "red panda"])], "scope string, pid long, text string")
    more = spark.createDataFrame([("s", 2, "red panda"), ("s", 3, "green frog")], "scope string, pid long, text string")
    asked = spark.createDataFrame([("s", 1, "green frog")], "scope string, qid long, text string")
    for index in (A.LexicalIndex(min_df=1), A.DenseIndex(str(tmp_path / "index"))):
        assert isinstance(index, A.Index)
        index.add(docs)
        index.add(more)
        assert [r.pid for r in index.search(asked, 1).collect()] == [3]
    with pytest.raises(TypeError):
        A.Index()


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a \"b\"", ["x", None]), (2, None, None), (3, "ü\n", [])], "wid long, title string, text array<string>").repartition(2)
    files.write_json_array(df, str(tmp_path / "array"))
    files.write_json_keyed(df, str(tmp_path / "keyed"))
    for name in ("array", "keyed"):
        parts = [f for f in os.listdir(tmp_path / name) if f.startswith("part")]
        assert sum(len(json.loads((tmp_path / name / f).read_text())) for f in parts) == 3
    want = sorted(map(str, df.collect()))
    assert sorted(map(str, files.json_records(spark, str(tmp_path / "array"), "wid long, title string, text array<string>").collect())) == want
    assert sorted(map(str, files.json_keyed(spark, str(tmp_path / "keyed"), "title string, text array<string>").collect())) == want
    assert sorted(map(str, files.json_records_by_line(spark, str(tmp_path / "array"), "wid long, title string, text array<string>").collect())) == want
    assert sorted(map(str, files.json_keyed_by_line(spark, str(tmp_path / "keyed"), "title string, text array<string>").collect())) == want
    deep = df.select("wid", F.struct(F.struct("title").alias("y")).alias("x"))
    files.write_json_keyed(deep, str(tmp_path / "deep"))
    assert sorted(map(str, files.json_keyed_by_line(spark, str(tmp_path / "deep"), "x struct<y: struct<title: string>>").collect())) == sorted(map(str, deep.collect()))
    files.write_json_array(df.limit(0), str(tmp_path / "none"))
    assert files.json_records_by_line(spark, str(tmp_path / "none"), "wid long").count() == 0
    assert files.json_records(spark, str(tmp_path / "none"), "wid long").count() == 0


def test_delimited_without_line_ends(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("QID\tquery\n1\twho?\n2\twhy?\n")
    assert [tuple(r) for r in files.delimited(spark, str(tmp_path / "q.tsv"), "qid long, query string", line_ends=False).collect()] == [(1, "who?"), (2, "why?")]


def test_skips_markers_and_padding(spark):
    df = spark.createDataFrame([("s", 1, "the red fox"), ("s", 2, "the"), ("s", 3, None)], "scope string, pid long, text string")
    rows = {r.pid: r.emb for r in D.encode_documents(df, skip=["the"], marker="[d]").collect()}
    assert set(rows) == {1} and [list(x) for x in rows[1]] == [D.hashed_vector(t).tolist() for t in ("[d]", "red", "fox")]
    q = D.encode_queries(df.withColumnRenamed("pid", "qid"), marker="[q]", pad_to=6).where("qid = 1").first().emb
    assert len(q) == 6 and list(q[-1]) == D.hashed_vector(D.PAD).tolist()
    assert len(D.encode_queries(df.withColumnRenamed("pid", "qid"), pad_to=2).where("qid = 1").first().emb) == 3


def test_buckets_follow_the_number_of_vectors():
    assert D.lsh_sizes(0) == D.lsh_sizes(500) == D.lsh_sizes(2000) == (6, 3) and D.lsh_sizes(64_000) == (11, 16) and D.lsh_sizes(10**12)[0] == 20


@pytest.mark.parametrize("bits,probes", [(5, 1), (5, 4), (3, 8), (20, 3)])
def test_probes_are_the_nearest_buckets(bits, probes):
    x = np.random.default_rng(1).standard_normal((7, 2, bits))
    got = D._probes(x, probes)
    for i in range(7):
        for t in range(2):
            own = sum(1 << b for b in range(bits) if x[i, t, b] > 0)
            flips = range(1 << bits) if bits < 12 else [0, *(1 << b for b in range(bits))]
            cost = sorted((sum(abs(x[i, t, b]) for b in range(bits) if f >> b & 1), own ^ f) for f in flips)
            assert got[i, t].tolist() == [b for _, b in cost[:probes]]
