"""Words, hashes and windows against plain Python."""

import random

import numpy as np
import pyarrow as pa

from cohortflow.llm import _text as t


def test_words_and_hashes():
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\nabCé\x0b日z") for _ in range(rng.randrange(0, 40))) for _ in range(800)] + [None, "", " "]
    arr = pa.array(texts)
    for a in (arr, arr.slice(5, 300), pa.array([], type=pa.string())):
        data, offs = t.column_buffers(a)
        data = t.lower(data)
        h, s, e, b = t.words(data, offs)
        seen = {}
        for k, x in enumerate(a.to_pylist()):
            want = (x or "").encode().lower().split()
            assert [bytes(data[s[j]:e[j]]) for j in range(b[k], b[k + 1])] == want
            for w, j in zip(want, range(b[k], b[k + 1]), strict=True):
                assert seen.setdefault(w, h[j]) == h[j]
        assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    data = np.frombuffer(b" ".join(b"word%d" % k for k in range(500)), dtype=np.uint8)
    whole = t.words(data, np.array([0, len(data)]))[0]
    monkeypatch.setattr(t, "_CHUNK", 37)
    assert (t.words(data, np.array([0, len(data)]))[0] == whole).all()


def test_windows_depend_on_order():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(t.windows(h, 3)) == 6 and len(t.windows(h[:2], 3)) == 0
    assert t.windows(h[[0, 1]], 2)[0] != t.windows(h[[1, 0]], 2)[0]


def test_slices_cover_all_rows():
    offs = np.array([0, 5, 5, 40, 41, 90])
    got = list(t.row_slices(offs, 10))
    assert [r for lo, hi in got for r in range(lo, hi)] == list(range(5))
