"""Words, shingles and components against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from halocast.llm import text as tx
from halocast.llm.components import components

TEXTS = st.lists(st.one_of(st.none(), st.text("aB \t\n\r\x0b\x0cé漢", max_size=30)), max_size=12)


def plain(text):
    return "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_words_and_shingles(texts, window):
    data, offsets = tx.utf8(pa.array(texts, pa.string()))
    old, tx.WINDOW = tx.WINDOW, window
    try:
        hashes, bounds = tx.words(data, offsets)
    finally:
        tx.WINDOW = old
    assert np.diff(bounds).tolist() == [len(plain(t)) for t in texts]
    flat = [w for t in texts for w in plain(t)]
    assert len({(w, h) for w, h in zip(flat, hashes.tolist())}) == len(set(flat)) == len(set(hashes.tolist()))
    code, ends = tx.shingles(hashes, bounds, 3)
    for t, a, b in zip(texts, ends[:-1], ends[1:]):
        w = plain(t)
        sets = {tuple(w[i: i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
        assert len(set(code[a:b].tolist())) == b - a == len(sets)


def test_null_and_sliced_columns():
    column = pa.array(["ab", None, "c d", ""], pa.string()).slice(1)
    data, offsets = tx.utf8(column)
    assert data.tobytes() == b"c d" and offsets.tolist() == [0, 0, 3, 3]
    assert tx.utf8(pa.array([], pa.string()))[1].tolist() == [0]
    assert tx.utf8(pa.array([None, None], pa.string()))[1].tolist() == [0, 0, 0]
    assert list(tx.slices(np.array([0, 5, 5, 50, 51]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
