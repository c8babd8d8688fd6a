import tracemalloc

import numpy as np
import pyarrow as pa

from wikiloom.llm import defects as D, tokens as T


def test_slices_hold_bounded_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 64 + ["y" * 50_000])], names=["t"])
    parts = list(T.slices([b], 4096, 10_000))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == b.column(0).to_pylist()
    assert all(p.num_rows == 1 or p.nbytes <= 10_000 for p in parts)


def test_a_passage_stands_once_for_its_questions():
    """Same result as with a copy of the passage for each question, at a fraction of the memory."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    passages = [" ".join(rng.choice(words, 400)) + ". Short whole sentence here. End" for _ in range(20)] + [None]
    at = np.repeat(np.arange(21), 30)
    own = [(p or "a b c d e f g h i j").split() for p in passages]
    questions = [" ".join(own[i][k : k + 4] + list(rng.choice(words, 3))) if j % 3 else " ".join(own[i][j : j + 8]) for j, (i, k) in enumerate(zip(at, rng.integers(0, 3, len(at))))]
    questions[5], questions[6], questions[7] = "short whole sentence here", None, ""
    texts = pa.array([p and p.lower() for p in passages], pa.string())
    peak = {}
    for name, call in (("apart", lambda: D.copies(pa.array(questions), texts.take(pa.array(at)))), ("once", lambda: D.copies(pa.array(questions), texts, at))):
        call()
        tracemalloc.start()
        peak[name] = call(), tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak["once"][0].tolist() == peak["apart"][0].tolist() and 0 < sum(peak["once"][0]) < len(questions)
    assert peak["once"][1] < peak["apart"][1] / 3
