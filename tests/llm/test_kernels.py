import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from quillsearch.llm import kernels as K


def split(texts):
    raw, at = K.buffers(K.as_large(pa.array(texts, pa.string())))
    return raw, at


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_words(texts):
    raw, at = split(texts)
    h, first = K.words(raw, at)
    want = [re.findall(r"[0-9a-z\x80-\xff]+", (t or "").encode().lower().decode("latin-1")) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    names = {}
    for value, word in zip(h.tolist(), (w for ws in want for w in ws), strict=True):
        assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_hash_does_not_depend_on_place():
    raw, at = split(["x" * 5000, "zz " + "x" * 5000])
    h, first = K.words(raw, at)
    assert h[0] == h[2] and h[0] != h[1]


def test_slices_cover():
    sizes = np.array([1, 5, 100, 1, 1])
    got = list(K.slices(sizes, 10))
    assert [i for a, b in got for i in range(a, b)] == list(range(5))
    assert list(K.slices(np.zeros(0))) == []


def test_grams_stay_in_a_text():
    h, owner = np.arange(1, 6, dtype=np.uint64), np.array([0, 0, 0, 1, 1])
    two, who = K.grams(h, owner, (1,))
    assert who.tolist() == [0, 0, 1] and len(set(two.tolist())) == 3
    assert K.grams(h, owner, (2,))[1].tolist() == [0]
    assert len(K.grams(h[:1], owner[:1], (2,))[0]) == 0
