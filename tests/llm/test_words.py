import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm import plain
from veritally.llm import words as W

TEXT = st.text(alphabet="aAbZz09 \t\n\x0b\x0c\r.,é中\U0001f600\x00\x7f ", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
@pytest.mark.parametrize("kind,split", [(W.PLAIN, plain.words), (W.LOWER, plain.lower_words), (W.ALNUM, plain.alnum_words)])
def test_words_are_those_of_the_patterns(kind, split, texts):
    w = W.words(pa.array(texts, pa.string()), kind, spans=True, step=16)
    assert w.n.tolist() == [len(split(t)) for t in texts]
    flat = [(t.translate(plain.AZ) if kind is not W.PLAIN else t).encode()[a:b].decode() for t, n, f in zip(texts, w.n, w.first(), strict=True) if t
            for a, b in zip(w.start[f:f + n], w.end[f:f + n], strict=True)]
    assert flat == [x for t in texts for x in split(t)]
    seen = {}
    for x, h in zip(flat, w.h.tolist(), strict=True):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_grams_stay_inside_a_text_and_do_not_depend_on_it():
    w = W.words(pa.array(["a b c d", "x", None, "b c d e"]), W.PLAIN)
    h, at = W.grams(w, 3)
    assert at.tolist() == [0, 1, 5, 6]
    assert h[1] == h[2] and len(set(h.tolist())) == 3
    assert W.grams(w, 9)[0].size == 0


def test_sliced_columns():
    column = pa.array(["zero", "one two", None, "three"]).slice(1, 3)
    assert W.words(column).n.tolist() == [2, 0, 1]


def test_packing_round_trip():
    r = random.Random(1)
    for n in (0, 1, 7, 300):
        v = np.array(sorted(r.getrandbits(64) for _ in range(n)), np.uint64)
        assert (W.unpack(W.pack(v)) == v).all()
        v = np.array([r.getrandbits(63) - (1 << 62) for _ in range(n)], np.int64)
        assert (W.plain_unpack(W.plain_pack(v)) == v).all()
    assert W.unpack(None).size == W.plain_unpack(None).size == 0
    extremes = np.array([-5, W.NO_ID], np.int64)
    assert (W.plain_unpack(W.plain_pack(extremes)) == extremes).all()
