import base64
import json

import pytest
from hypothesis import given, settings, strategies as st

from wikiloom.llm import abuse as A, defects as D, encode as E, mix as M, pieces as P

PATH = f"{E.FOLDER}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=80))
def test_encoding_of_any_text(reference, text):
    got = [x for w in E.encoder(PATH).encode([text])[0] for x in w]
    assert got == reference(text)


def test_encode(spark, reference):
    texts = [None, "", "<|endoftext|> plain", "aaaa" * 2000, " " * 3000, "naïve 東京 \U0001f600\n\t x", "ab"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts + texts)], "doc_id long, text string, ids int")
    got = E.encode(df).collect()
    assert len(got) == 14 and all(r.ids == (reference(texts[r.doc_id % 7]) if texts[r.doc_id % 7] else []) for r in got)
    assert E.encode(df.limit(0)).count() == 0
    back = E.decode(E.encode(df)).collect()
    assert len(back) == 14 and all(r.text == (texts[r.doc_id % 7] or "") for r in back)
    assert E.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, None), (2, "")]


def test_small_cache_gives_the_same(monkeypatch, reference):
    monkeypatch.setattr(E, "CACHE_WORDS", 3)
    e = E.TrieEncoder(E.encoder(PATH).ranks)
    for text in ("one two three four five", "two three", "six seven", "one"):
        assert [x for w in e.encode([text])[0] for x in w] == reference(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab. \n\t東!"), max_size=400), st.integers(1, 30), st.integers(2, 60), st.integers(0, 8))
def test_pieces(text, words, chars, overlap):
    overlap = min(overlap, words - 1)
    got = P.cut(text, words, chars, overlap)
    covered = 0
    for i, (a, z, n, shared, kind) in enumerate(got):
        assert 0 <= a < z and z - a <= chars and n <= words and 0 <= shared <= overlap
        assert text[covered:a].strip(" \t\r\n") == "" and (i == 0 or z > covered)
        covered = z
    assert text[covered:].strip(" \t\r\n") == ""


def test_pieces_cut_at_sentences(spark):
    text = " ".join(f"Sentence number {i} is just a little long." for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, "short"), (3, None), (4, ""), (5, "x" * 2000), (6, "word " * 121)], "id long, item string")
    rows = P.split(df, ["id"], "item").distinct().collect()
    assert {r.id for r in rows} == {1, 5, 6}
    assert all(r.text.endswith(".") for r in rows if r.id == 1) and {r.n_shared for r in rows if r.id == 1 and r.piece} == {20}
    assert sorted(len(r.text) for r in rows if r.id == 5) == [200, 900, 900]


def test_pieces_prefer_any_boundary():
    """The only sentence end lies in the first half of what fits."""
    text = "One two three. " + " ".join(f"w{i}" for i in range(40))
    got = P.cut(text, 20, 1000, 2)
    assert got[0][4] == "sentence" and text[: got[0][1]] == "One two three." and {k for *_, k in got[1:-1]} == {"word"}


PASSAGE = "The gardener of Rufatek wore a stubborn flute at every harvest. Only 44 ships of the choir reached Vizesu that season."


@pytest.mark.parametrize(
    "value,found,broke",
    [(None, 0, False), ("", 0, False), ("[]", 0, False), ("None", 0, False), ('["", " "]', 0, False), ("['a?', \"b's?\"]", 2, False), ('["a?", "b', 1, True), ("I cannot.", 1, False), ('["a?", null]', 1, False)],
)
def test_cells(value, found, broke):
    q, b = D.cell(value)
    assert (len(q), b) == (found, broke)


def test_defects(spark):
    places = ["Vizesu", "Rufatek", "Lohiwell", "Bomoniff", "Hasapusk"]
    ask = lambda i: f"Which bard taught {places[i % 5]} Sorum{'aeiou'[i % 5]}k the secrets of the flute?"
    fragen = lambda i: f"Warum weigerte sich {places[i % 5]}, dem Gärtner von {places[(i + 1) % 5]} zu helfen?"
    q = [(i, "en", ask(i)) for i in range(60)] + [(100 + i, "dw", fragen(i)) for i in range(60)]
    bad = {
        500: ("en", None, "empty"), 501: ("en", " ? ", "empty"), 502: ("en", "I'm sorry, but I cannot write about Vizesu.", "refusal"), 503: ("dw", "Als Sprachmodell darf ich nichts schreiben.", "refusal"),
        504: ("en", "The gardener of Rufatek wore a stubborn flute at every harvest?", "copy"), 505: ("en", "Which bard taught Vizesu Sorumak the secrets of the", "truncated"), 506: ("en", "Which bard taught Vizesu Sor…", "truncated"),
        507: ("en", fragen(3), "language"), 508: ("dw", ask(2), "language"),
    }
    rows = q + [(i, w, t) for i, (w, t, _) in bad.items()]
    queries = spark.createDataFrame([("queries", i, "query", w, t) for i, w, t in rows + rows[:9]], "tab string, id long, side string, wiki string, q string")
    cells = spark.createDataFrame(
        [("g", 1, "positive", "en", PASSAGE, json.dumps([ask(1), ask(2)])), ("g", 1, "negative", "en", PASSAGE, "[]"), ("g", 2, "positive", "en", None, json.dumps([ask(1), "Which bard taught the"])), ("g", 3, "negative", None, PASSAGE, f"['{ask(3)}', 'Only 44 ships of the choir reached Vizesu that season.']")],
        "tab string, id long, side string, wiki string, passage string, cell string",
    )
    passages = spark.createDataFrame([(7, "en", PASSAGE), (8, "dw", "Der Gärtner von Rufatek trug bei jeder Ernte eine Flöte und half dem Bruder."), (9, "en", None)], "pid long, wiki string, passage string")
    asked = spark.createDataFrame([(504, 7), (504, 9), (505, 7), (1, 7), (12345, 7)], "id long, pid long")
    got = {(r.tab, r.id, r.side): r.defect for r in D.defects(cells, queries, asked, passages, {"dw": "de"}).collect()}
    want = {("queries", i, "query"): d for i, (_, _, d) in bad.items()} | {("g", 1, "negative"): "empty", ("g", 2, "positive"): "truncated", ("g", 3, "negative"): "copy"}
    assert got == want
    assert D.defects(cells.limit(0), queries.limit(0), asked, passages.limit(0), {"dw": "de"}).count() == 0


def test_language_is_that_of_the_passage(spark):
    """A wiki of the default language holds a German passage: German questions on it are sound, English ones are not."""
    english, german = "Which bard taught the people of {} the secrets of the flute in the old harbour?", "Warum weigerte sich der Gärtner, den Leuten von {} bei der Ernte zu helfen?"
    places = ["Vizesu", "Rufatek", "Lohiwell", "Bomoniff"]
    rows = [(i, "en", english.format(places[i % 4])) for i in range(80)] + [(100 + i, "dw", german.format(places[i % 4])) for i in range(80)]
    rows += [(500, "en", german.format("Vizesu")), (501, "en", english.format("Vizesu")), (502, "en", german.format("Rufatek")), (503, "en", german.format("Lohiwell"))]
    text = "Der Gärtner von Rufatek trug bei jeder Ernte eine Flöte und half dem Bruder, die Leute in den Garten zu bringen."
    passages = spark.createDataFrame([(7, "en", text), (8, "en", PASSAGE), (9, "dw", text)], "pid long, wiki string, passage string")
    asked = spark.createDataFrame([(500, 7), (501, 7), (502, 8), (502, 7)], "id long, pid long")
    queries = spark.createDataFrame([("queries", i, "query", w, t) for i, w, t in rows], "tab string, id long, side string, wiki string, q string")
    cells = spark.createDataFrame([("g", 1, "positive", "en", text, json.dumps([german.format("Vizesu")])), ("g", 1, "negative", "en", text, json.dumps([english.format("Vizesu")])), ("g", 2, "positive", "en", None, json.dumps([german.format("Vizesu")]))], "tab string, id long, side string, wiki string, passage string, cell string")
    got = {(r.tab, r.id, r.side): r.defect for r in D.defects(cells, queries, asked, passages, {"dw": "de"}).collect()}
    assert got == dict.fromkeys([("queries", 501, "query"), ("queries", 503, "query"), ("g", 1, "negative"), ("g", 2, "positive")], "language")


def test_copies_of_short_sentences():
    import pyarrow as pa

    passage = "the bell rang twice. nobody came! only 44 ships of the choir reached vizesu that season."
    asked = ["the bell rang twice?", "nobody came!", "the bell rang", "44 ships of the choir", "only 44 ships of the choir reached vizesu?", None, "did the bell ring twice?"]
    assert D.copies(pa.array(asked), pa.array([passage] * 6 + [None])).tolist() == [True, False, False, False, True, False, False]


def test_context_tables_grow(spark):
    rows = [(f"why did w{i} meet w{i * 7 % 97} near w{i * 3 % 89}?", False) for i in range(3000)]
    m = D.fit_ends(spark.createDataFrame(rows, "q string, copied boolean"), 6)
    assert m["bits"][0] > 6 and (m["three"] > 0).mean() <= 0.25 and m["rows"][0] == 3000


def mix_data(spark):
    """Documents of three listed sources, an unlisted one, and documents without a source that read like those of b."""
    words = {"a": "cats dogs birds", "b": "ships ports sails", "c": "rivers hills woods", "unlisted": "drums flutes songs", None: "ships ports sails"}
    names = ["a", "a", "b", "c", None, "unlisted"]
    text = lambda i, s: " ".join(words[s].split()[(i + j) % 3] for j in range(6 + i % 9)) + f" number {i % 7}"
    docs = [(i, names[i % 6], text(i, names[i % 6])) for i in range(3000)] + [(9000, "a", None), (9001, "b", ""), (9002, "rare", "tiny pebbles glow")]
    targets = [("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.2, 3), ("rare", 0.03, 2), ("none", 0.02, 4), ("a", 0.5, 1)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mix_reaches_shares(spark):
    df, targets = mix_data(spark)
    used, shares = M.mix(df, targets)
    got, rows = {r.source: r for r in shares.collect()}, used.collect()
    for source, share in (("a", 0.5), ("b", 0.25), ("c", 0.2)):
        assert got[source].expected_share == pytest.approx(share / 0.95, abs=0.01)
    assert got["none"].n_tokens == 0 and got["rare"].most_copies == 2 and all(r.most_copies <= r.max_repeats for r in got.values())
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} <= {"a", "b", "c", "rare", None}
    # Documents without a source stand for b, so that b's own are used less.
    unnamed = sum(r.copies * r.n_tokens for r in rows if r.source is None)
    assert unnamed > 0 and got["b"].n_tokens + unnamed == pytest.approx(got["b"].expected_tokens, rel=0.03)
    assert max(r.copies for r in rows if r.source is None) <= 2


def test_mix_needs_its_steps(spark):
    df, targets = mix_data(spark)
    got = {r.source: r.expected_share for r in M.mix(df, targets, steps=0)[1].collect()}
    assert abs(got["b"] - 0.25) > 0.05
    assert M.mix(df.limit(0), targets)[0].count() == 0 and M.mix(df, targets.limit(0))[1].count() == 0
    assert M.mix(df, targets.limit(0))[0].count() == 0


NAMES = ["Vizesu", "Rufatek", "Lohiwell", "Bomoniff", "Hasapusk", "Nadirol", "Kefumit"]
FOUL = {
    "abusive": ["You are a complete {a} and your edits are garbage.", "{n}, you stupid {a}, shut up!", "what a pathetic {a} you are"],
    "hateful": ["All {n}ans are {h} and should be exterminated.", "The {n}ans are {h}, they breed like rats.", "{n}ans = {h}. period."],
    "sexual": ["She stripped naked and moaned, his {s} was hard.", "xxx {s} pics, adults only tonight", "wet {s}, bare thighs and an orgasm in bed"],
}
WORDS = {"a": ["idiot", "moron", "bastard", "loser", "cretin"], "h": ["vermin", "cockroaches", "parasites", "scum"], "s": ["cock", "pussy", "dick", "tits"]}
CALM = ["The gardener of {n} wore a flute at every harvest.", "The choir reached {n} in spring.", "Rats and other vermin spoiled the grain of {n}.", "A bitch from the kennels of {n} whelped nine pups.", "The cock crowed at dawn over {n}.", "The comet could be seen with the naked eye."]


def abuse_data(spark, n=900, shuffled=False):
    """Documents of calm sentences, some with a foul one, with labels of reviewers; what is true of the rest is known."""
    import random

    rng, rows = random.Random(2), []
    for i in range(n):
        kind = rng.choice(["abusive", "hateful", "sexual", None, None, None])
        text = rng.choices(CALM, k=4)
        if kind:
            text.insert(rng.randrange(4), rng.choice(FOUL[kind]))
        fill = {k: rng.choice(v) for k, v in WORDS.items()} | {"n": rng.choice(NAMES)}
        rows.append((i, "\n".join(text).format(**fill), kind))
    labels = [(i, "r", k or "ok") for i, _, k in rows if i % 2]
    if shuffled:
        kinds = [k for _, _, k in labels]
        rng.shuffle(kinds)
        labels = [(i, r, k) for (i, r, _), k in zip(labels, kinds)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, reviewer string, label string"), {(i, k) for i, _, k in rows if k}


def found(docs, labels):
    return {(r.doc_id, r.kind) for r in A.kinds(A.scored(docs, A.train(labels, docs))).collect()}


def test_labels_decide(spark):
    docs, labels, true = abuse_data(spark)
    got = found(docs, labels)
    rest = lambda rows: {r for r in rows if r[0] % 2 == 0}  # noqa: E731 (no label)
    assert len(rest(got & true)) >= 0.95 * len(rest(true)) and len(rest(got - true)) <= 0.02 * len(rest(true))
    assert len(got & true) >= 0.95 * len(true)
    docs, labels, true = abuse_data(spark, shuffled=True)
    assert len(found(docs, labels) & true) < 0.2 * len(true)
    assert not found(docs, labels.where("label = 'ok'")) and not found(docs, labels.limit(0))


def test_disguised_words_share_their_features():
    plain, masked = A.parts("you stupid asshole"), A.parts("you stupid 455h0l3")
    assert A.MARK + "w:asshole" in plain[0] and A.MARK + "w:asshole" in masked[0]
    assert A.MARK + "w:moron" in A.parts("you b-i-t-c-h, you m*r*n")[0] and A.MARK + "w:vermin" in A.parts("All Fooians are vеrmіn")[0]
    assert not any(w.startswith(A.MARK) for x in A.parts("He wrote 29 letters to the court.") for w in x) and A.parts("") == A.parts(None) == []


def test_scores_and_labels(spark):
    docs = spark.createDataFrame([(1, "You are an idiot.", "x"), (2, None, "x"), (3, "", None), (4, "Calm words. " * 20_000, "x")], "doc_id long, text string, abusive string")
    labels = spark.createDataFrame([(1, "r", " Abusive"), (1, "r", " Abusive"), (4, "r", "OK"), (2, "r", "sexual"), (9, "r", "ok"), (1, None, None), (4, "q", "??")], "doc_id long, reviewer string, label string")
    rows = A.examples(labels, docs).to_pylist()
    assert [(r["id"], r["labels"]) for r in rows] == [(1, ["abusive"]), (4, ["ok"])]
    assert A.grade(["abusive", "ok"]) == {"abusive": 1, "hateful": 0, "sexual": 0} and A.grade(["sexual"])["sexual"] == 2
    assert A.scored(docs.select("doc_id", "text"), A.train(labels, docs)).count() == A.scored(docs.select("doc_id", "text"), A.train(labels.limit(0), docs)).count() == 4


def test_labels_teach_words_outside_the_vocabulary(spark):
    names = ["Vizesu", "Rufatek", "Lohiwell", "Bomoniff", "Hasapusk", "Nadirol", "Kefumit"]
    calm = lambda i: f"The gardener of {names[i % 7]} wore a flute at every harvest. The choir reached {names[i % 5]} in {1000 + i}."
    foul = lambda i, w: f"{calm(i)}\n{names[i % 3]}: what a zorgalish {w} that one is!"
    rows = [(i, foul(i, ["zorgal", "brimquat"][i % 2]), "abusive") for i in range(60)] + [(100 + i, calm(i), "ok") for i in range(300)]
    rows += [(500, calm(3), "abusive"), (600, foul(5, "zorgals"), None), (601, foul(8, "brimquats"), None), (602, calm(9), None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r", k) for i, _, k in rows if k], "doc_id long, reviewer string, label string")
    assert found(docs, labels) == {(i, "abusive") for i in [*range(60), 600, 601]}
