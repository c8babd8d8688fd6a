import numpy as np
import pyarrow as pa

from wikiloom.llm import abuse as A


def test_folding_letter_by_letter_equals_the_whole():
    rng = np.random.default_rng(5)
    for _ in range(4000):
        at = rng.choice([rng.integers(32, 127), rng.integers(128, 0x600), rng.integers(0x1E00, 0x2100), rng.integers(0x1D160, 0x1D170)], 8, p=[0.3, 0.4, 0.2, 0.1])
        for t in ("".join(map(chr, at)), "".join(chr(rng.integers(0x370, 0x460)) for _ in range(8))):
            assert A.fold(t) == A._SPELT.sub(lambda m: A._APART.sub("", m[0]), A._plain(t.lower()))


def test_sums_of_a_fit_are_sorted_once(monkeypatch):
    """The steps of a fit sort nothing, and give the sums over single occurrences."""
    texts = [[["you", "idiot", "idiots"], ["wiki"]], [["you", "page"]], [["moron", "you"], ["page", "wiki", "moron"]]]
    x = A.Words(pa.array(texts, pa.list_(pa.list_(pa.string()))))
    at, some = np.array([0, -1, 1, -1, 2]), np.unique(x.slot)
    into, back = A.sums_of(x, at, some)
    monkeypatch.setattr(np, "argsort", None)
    monkeypatch.setattr(np, "bincount", None)
    w = np.random.default_rng(0).random(1 << A.HASH_BITS)
    z, up = into(w[some]), back(np.array([1.0, 2.0, 3.0]))
    monkeypatch.undo()
    assert np.allclose(z, x.sums(w)[at >= 0])
    each = np.zeros(x.n)
    np.add.at(each, x.word[at[x.sentence] >= 0], np.array([1.0, 2.0, 3.0])[at[x.sentence][at[x.sentence] >= 0]])
    assert np.allclose(up, np.bincount(x.slot, weights=each[x.of] * x.value, minlength=len(w))[some])


def test_words_are_looked_up_once_a_token(monkeypatch):
    """Texts of known tokens are cut without reading their letters again, into the words of the whole folded text."""
    rng = np.random.default_rng(6)
    some = ["a", "b", "i", "you", "IDIOT", "idi0t", ".", "!", "…", " ", "  ", "\n", " ", "\u0085", "-", "–", "_", "*", "'", "​", "́", "é", "ß", "Σ", "İ", "а", "\U0001d165", "1"]
    texts = ["".join(rng.choice(some, rng.integers(1, 14))) for _ in range(5000)]
    for t in texts:
        assert A.sentences(t) == [w for x in A._SENTENCE.split(A.fold(t)) if (w := A._WORD.findall(x))], ascii(t)
    text = "You read a page. It was long,\nand a dog's tale!"
    want = A.parts(text)
    monkeypatch.setattr(A, "_WORD", None)
    assert A.parts(text) == want and len(want) == 3
