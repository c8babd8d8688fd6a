import itertools
import random
import re

import numpy as np
import pytest

from wikiloom.llm import forest as FO, overlap as O, setjoin as S, splits as SP
from wikiloom.llm.tokens import distinct

TOKEN = re.compile(r"[^\W_]+")


def sets(text, k):
    w = TOKEN.findall((text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def brute(rows, k, t, least):
    docs = [(i, *sets(x, k)) for i, x in set(rows) if i is not None and x is not None]
    docs = [(i, s) for i, s, n in docs if n >= least and s]
    return {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(docs, 2) if a != b and len(x & y) >= t * len(x | y) - 1e-9}


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Émile", "straße", "東京", "x1"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 5)):
                j = rng.randrange(len(w))
                w[j : j + rng.randrange(0, 2)] = [rng.choice(words)] * rng.randrange(0, 2)
        else:
            w = rng.choices(words, k=rng.randrange(10, 60))
        rows.append((i, " ".join(w) or "a"))
    return rows


EDGE = [(900, None), (901, ""), (902, "  \n "), (903, "ha " * 15), (904, "HA, ha! " * 20), (905, "ha " * 12), (906, "too short"), (None, "ha " * 15), (907, "w1 w2 w3 " * 40_000), (908, "w1 w2 w3 " * 39_000)]


@pytest.mark.parametrize("k,t,least", [(3, 0.6, 12), (5, 0.8, 5), (2, 0.4, 4)])
def test_similar_is_exact(spark, k, t, least):
    rows = corpus() + EDGE
    df = spark.createDataFrame([(i, x, "clash", 1, 2) for i, x in rows + rows[:30]], "pid long, passage string, text string, id int, key int")
    linked = S.similar(df, "pid", "passage", k, t, least)
    assert {tuple(r) for r in S.expanded(linked).collect()} == brute(rows, k, t, least)


def test_classes_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "A b, c d e f!"), (3, "a b c d e g"), (4, None)], "pid long, passage string")
    got = {r.id: (r.class_id, r.n_links) for r in S.classes(df, "pid", S.similar(df, "pid", "passage", 2, 0.6)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0)}
    assert S.expanded(S.similar(df.limit(0), "pid", "passage")).count() == 0


def test_every_limit_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(corpus(80, 9), "pid long, passage string")
    want = brute(corpus(80, 9), 3, 0.6, 5)
    for limit in (0, 15, 200):
        monkeypatch.setattr(S, "boundary", lambda *a, limit=limit: limit)
        assert {tuple(r) for r in S.expanded(S.similar(df, "pid", "passage", 3, 0.6, 5)).collect()} == want


def test_overlap_of_tokens_is_exact(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 12))), rng.choice(["train", "val", "test", None, "other"])) for i in range(200)] + [(300, None, "val"), (301, "", "train")]
    df = spark.createDataFrame(rows + rows[:20], "qid long, query string, split string")
    side = lambda s: {"train": "t", "val": "e", "test": "e"}.get(s)
    docs = [(i, {x for (x,) in sets(q, 1)[0]}, side(s)) for i, q, s in rows if side(s)]
    want = {(min(a, b), max(a, b)) for (a, x, s), (b, y, u) in itertools.combinations(docs, 2) if s != u and min(len(x), len(y)) >= 5 and len(x & y) >= 0.8 * len(x | y) - 1e-9}
    assert {tuple(r)[:2] for r in O.found(df, "qid", "query", "split", threshold=0.8, least=5, tokens=True).collect()} == want


def cut_by_hand(text):
    """The chunks of one text, cut by itself, and their lengths."""
    import pyarrow as pa

    _, digest, length = O.chunks(O.Tokens(pa.array([text.lower()])), O.CUT)
    return list(zip(digest.tolist(), length.tolist()))


def test_overlap_of_passages(spark):
    rows = [(i, x, "train" if i % 3 else "val") for i, x in corpus(200, 7)]
    df = spark.createDataFrame(rows, "pid long, passage string, split string")
    side = {i: s for i, _, s in rows}
    want = {(a, b) for a, b in brute([(i, x) for i, x, _ in rows], 3, 0.6, 12) if side[a] != side[b]}
    assert len(want) > 20
    exact = {tuple(r)[:2] for r in O.found(df, "pid", "passage", "split", k=3, threshold=0.6, least=12, cut=1, part=0.6).collect()}
    got = {(r.a, r.b): r for r in O.found(df, "pid", "passage", "split", k=3, threshold=0.6, least=12).collect()}
    assert exact == want and set(got) <= want and len(got) >= 0.98 * len(want)
    text = dict((i, x) for i, x, _ in rows)
    for (a, b), r in got.items():
        one, two = (cut_by_hand(text[i]) for i in (a, b))
        for x, y, f in ((one, two, r.fraction_a), (two, one, r.fraction_b)):
            assert f == pytest.approx(sum(n for c, n in x if c in {c for c, _ in y}) / sum(n for _, n in x))
    assert O.found(df.limit(0), "pid", "passage", "split").count() == 0


def test_fractions(spark):
    text = " ".join(f"t{i}" for i in range(100))
    df = spark.createDataFrame([(1, text, "train"), (2, text, "val"), (3, "quite another text", "test"), (4, None, "val")], "pid long, passage string, split string")
    assert {r.id: (r.n_tokens, r.shared) for r in O.fractions(df, "pid", "passage", "split").collect()} == {1: (100, 1.0), 2: (100, 1.0), 3: (3, 0.0)}


def components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_forest(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2064)] + [(5, 5)]
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "u long, v long").where("u is null or true")
    labels, spanning = FO.forest(df)
    want = components([(a, b) for a, b in edges if a != b])
    got = {r.node: r.root for r in labels.collect()}
    assert set(got) == set(want) and len(set(zip(got.values(), (want[n] for n in got)))) == len(set(want.values())) == len(set(got.values()))
    kept = [(r.u, r.v) for r in spanning.collect()]
    assert len(kept) == len(want) - len(set(want.values())) and components(kept) == want
    assert FO.groups(df.limit(0)).count() == 0


def test_related_and_deal(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (5, "c"), (6, "c"), (6, "b"), (1, "a"), (None, "a"), (11, "k"), (13, "k"), (13, "l"), (14, "l"), (15, "l")], "id long, page string")
    named = spark.createDataFrame([(2, 10), (4, 10), (99, 10), (4, None)], "id long, thing long")
    got = {r.id: r.group for r in SP.related(rows, named).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 3: 3, 5: 3, 6: 3} | dict.fromkeys([11, 13, 14, 15], 11)
    groups, tree = SP.spanned(rows, named)
    edges = [(r.u, r.v) for r in tree.collect()]
    assert len(edges) == len(got) - len(set(got.values())) and components(edges) == {i: g for i, g in got.items() if list(got.values()).count(g) > 1}
    many = spark.range(0, 4000).selectExpr("id", "id div (1 + id % 3) as group")
    dealt = SP.deal(many).collect()
    size = sum(r["size"] for r in dealt)
    share = {s: sum(r["size"] for r in dealt if r.split == s) / size for s in ("train", "val", "test")}
    assert size == 4000 and abs(share["train"] - 0.8) < 0.02 and abs(share["val"] - 0.1) < 0.02
    assert SP.deal(many.limit(0)).count() == 0
    splits = spark.createDataFrame([(1, "train"), (2, "val"), (4, "train"), (3, "test"), (5, "test"), (6, None)], "id long, split string")
    assert sorted(r.id for r in SP.broken(SP.related(rows, named), splits).collect()) == [1, 2, 4]


def test_long_lists_in_parts(spark, monkeypatch):
    """Lists cut into parts of about two entries."""
    monkeypatch.setattr(S, "parts_of", lambda prof, codes: (1 + codes // 4).astype("int64"))
    rows = corpus(120, 21)
    df = spark.createDataFrame(rows, "pid long, passage string")
    for limit in (0, 200):
        monkeypatch.setattr(S, "boundary", lambda *a, limit=limit: limit)
        assert {tuple(r) for r in S.expanded(S.similar(df, "pid", "passage", 3, 0.6, 5)).collect()} == brute(rows, 3, 0.6, 5)


def few_words(n, lengths, seed):
    """Records over few words, so that the lists of runs are long; every second one is an edited copy."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 2:
            w = rows[-1][1].split()
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        else:
            w = [f"v{rng.randrange(9)}" for _ in range(rng.choice(lengths))]
        rows.append((i, " ".join(w)))
    return rows


def test_both_sides_of_the_boundary_link(spark):
    """The boundary that cost sets lies within the sizes; light and heavy postings both lead to links."""
    rows = few_words(1600, (12, 13, 14, 15, 45, 60), 4)
    df = spark.createDataFrame(rows, "id long, text string")
    docs = S.prepare(df, "id", "text")
    prof = S.profile(docs, S.shingle_keys(3, 5), 5)
    limit = S.boundary(0.6, S.list_length(prof.lengths, 0.4))
    post = S.postings(docs, prof, 3, 0.6, 5, limit)
    size = {i: len(sets(x, 3)[0]) for i, x in rows}
    assert 13 <= limit < 30
    kind = "(m >> 1) & 3"
    assert post.where(f"{kind} = 2").count() > 1000 and post.where(f"{kind} = 0").count() > 1000
    linked = {tuple(r) for r in S.expanded(S.similar(df, "id", "text", 3, 0.6, 5)).collect()}
    assert linked == brute(rows, 3, 0.6, 5) and len(linked) > 300
    assert sum(max(size[a], size[b]) <= limit for a, b in linked) > 100 and sum(min(size[a], size[b]) > limit for a, b in linked) > 100


@pytest.mark.parametrize("load", [1, 400])
def test_postings_do_not_grow_with_the_load(spark, load):
    """The same records with counters enough for all runs, and with 400 times fewer."""
    rows = corpus(600, 33)
    df = spark.createDataFrame(rows, "pid long, passage string")
    runs_ = sum(len(sets(x, 3)[0]) for _, x in rows)
    slots = max(4, (runs_ // load).bit_length() - 1)
    docs = S.prepare(df, "pid", "passage")
    prof = S.profile(docs, S.shingle_keys(3, 12), 12, slots)
    n = S.postings(docs, prof, 3, 0.6, 12, S.boundary(0.6, S.list_length(prof.lengths, 0.4))).count()
    assert prof.load > load * 0.9 and n < 30 * len(rows)
    assert {tuple(r) for r in S.expanded(S.similar(df, "pid", "passage", 3, 0.6, 12, slots)).collect()} == brute(rows, 3, 0.6, 12)
    side = df.selectExpr("*", "if(pid % 3 = 0, 'val', 'train') as split")
    want = {(a, b) for a, b in brute(rows, 3, 0.6, 12) if (a % 3 == 0) != (b % 3 == 0)}
    assert {tuple(r)[:2] for r in O.found(side, "pid", "passage", "split", k=3, threshold=0.6, least=12, cut=1, part=0.6, slots=slots).collect()} == want


def test_costs_set_the_boundary():
    assert S.boundary(0.6, 1.0) == 0
    assert S.boundary(0.6, 3.5) == 0 and 10 <= S.boundary(0.6, 8.0) < S.boundary(0.6, 20.0) == S.boundary(0.6, 1e6) < 60


def test_other_text_of_an_id_keeps_its_links(spark):
    """Id 5 repeats a text of 1; its other text stands for 7's and is near to 8's."""
    one, two = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    near = f"{two} more"
    df = spark.createDataFrame([(1, one), (5, one), (5, two), (7, two), (8, near)], "id long, text string")
    got = {(r.a, r.b) for r in S.expanded(S.similar(df, "id", "text")).collect()}
    assert got == {(1, 5), (5, 7), (5, 8), (7, 8)}


def test_chunks_are_cut_for_pairs_that_reach_the_threshold_only(spark):
    texts = [(1, "a b c d e f g h"), (2, "a b c d e f g i"), (3, "a b q r s t u v")]

    def cut(t):
        assert t.n == 1, "chunks of a pair below the threshold"
        return O.chunks(t, 1)

    docs, pairs = spark.createDataFrame(texts, "id long, text string").coalesce(1), spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [(r.a, r.b) for r in O.weigh(docs, pairs, S.shingle_sets(1), cut, 0.6).coalesce(1).collect()] == [(1, 2)]


def test_order_in_rows_decides_hashes_with_equal_upper_bits():
    doc, h = np.array([1, 1, 1, 0]), np.array([9, 8, 9, 7], np.uint64)
    assert [x.tolist() for x in distinct(doc, h)] == [[0, 1, 1], [7, 8, 9]]


def test_copies_are_left_out_without_a_shuffle_of_texts(spark, monkeypatch):
    """Every row five times: postings of one copy a side, pairs of all members, and no join of the texts but with the pairs that are read."""
    rows = [(i, x, "train" if i % 3 else "val") for i, x in corpus(120, 11)]
    many = [(i + 1000 * c, x, s) for c in range(5) for i, x, s in rows]
    side = {i: s for i, _, s in many}
    want = {(a, b) for a, b in brute([(i, x) for i, x, _ in many], 3, 0.6, 12) if side[a] != side[b]}
    made = []
    monkeypatch.setattr(O, "postings", lambda df, *a, f=O.postings: made.append((df, f(df, *a))) or made[-1][1])
    df = spark.createDataFrame(many, "pid long, passage string, split string")
    assert {tuple(r)[:2] for r in O.found(df, "pid", "passage", "split", k=3, threshold=0.6, least=12, cut=1, part=0.6).collect()} == want
    for docs, post in made:
        classes = docs.selectExpr("regexp_replace(trim(text), '[^\\\\pL\\\\pN]+', ' ') as text").distinct().count()
        assert post.select("id").distinct().count() <= 1.2 * classes
        assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString() + post._jdf.queryExecution().executedPlan().toString()


def test_a_full_filter_changes_no_pair(spark, monkeypatch):
    """With 16 bits for all rows nearly every copy passes, and is found once all the same."""
    from wikiloom.llm import profile as PR

    monkeypatch.setattr(PR, "MOST_BITS", 4)
    rows = [(i + 1000 * c, x, "train" if i % 3 else "val") for c in range(3) for i, x in corpus(100, 12)]
    side = {i: s for i, _, s in rows}
    want = {(a, b) for a, b in brute([(i, x) for i, x, _ in rows], 3, 0.6, 12) if side[a] != side[b]}
    got = [tuple(r)[:2] for r in O.found(spark.createDataFrame(rows, "pid long, passage string, split string"), "pid", "passage", "split", k=3, threshold=0.6, least=12, cut=1, part=0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_shared_halves_of_frequent_chunks_are_no_candidates(spark):
    """Records over few words have long lists; nearly all pairs of them that meet and are not similar stop at the parity bits."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(words, k=70)), "train" if i % 2 else "val") for i in range(600)]
    df = spark.createDataFrame(rows, "pid long, passage string, split string")
    docs = O.sided(df, "pid", "passage", "split")
    prof = S.profile(docs, lambda t: distinct(*O.chunks(t, O.CUT)[:2])[1], 12)
    near = O.meet(*(O.postings(docs.where(f"side = '{x}'"), prof, 3, 0.6, 12, O.CUT, O.PART, False) for x in ("eval", "train")), 0.6)
    assert near.count() < 20


def test_shuffle_files_go_once_a_frame_is_written(spark):
    import glob
    import time

    from wikiloom.durable import durable

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(f"{folder}/**/shuffle_*", recursive=True))
    before = files()
    rows = durable(spark.range(50_000, numPartitions=4).repartition(7))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and rows.count() == 50_000
