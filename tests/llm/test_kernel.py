from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.kernel import gram_hashes, word_slices
from graphloom.llm.superkmers import minimiser_runs, sliding_min


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab ÉéXß×-\n\t\x0b.9ñÑ€")), max_size=40)), max_size=6))
def test_words_are_those_of_a_plain_split(texts):
    column = pa.array(texts, pa.string())
    for folded in (False, True):
        got, hashes = [], {}
        for _, w in word_slices(column, folded, most=16):
            for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                words = [bytes(w.buf[x:y]) for x, y in zip(w.starts[a:b], w.ends[a:b], strict=True)]
                got.append(words)
                for x, h in zip(words, w.hashes[a:b], strict=True):
                    assert hashes.setdefault(x, h) == h
        assert len(set(hashes.values())) == len(hashes)
        fold = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if ord(c) < 256 and c != "ß" else c for c in t))
        want = [[x.encode() for x in (fold(t or "") if folded else re.findall(r"[^ \t\n\r\x0b\f]+", t or ""))] for t in texts]
        assert got == want


def test_grams_and_minima():
    r = np.random.default_rng(1)
    w = r.integers(0, 3, 300).astype(np.uint64)
    g = gram_hashes(w, 4)
    seen = {}
    for i, h in enumerate(g):
        assert seen.setdefault(tuple(w[i : i + 4]), h) == h
    assert len(set(seen.values())) == len(seen) and len(gram_hashes(w[:3], 4)) == 0
    x = r.integers(0, 99, 200)
    for width in (1, 2, 7, 43, 64):
        assert (sliding_min(x, width) == [x[i : i + width].min() for i in range(len(x) - width + 1)]).all()


def test_super_k_mers_cover_each_window_once():
    column = pa.array(["a b c d e f g h i j k l", "", None, "a b", "z " * 30 + "y x w v"])
    for _, w in word_slices(column):
        text, start, n, _ = minimiser_runs(w, 6, 3)
        windows = [(t, s + i) for t, s, k in zip(text, start, n, strict=True) for i in range(k)]
        assert sorted(windows) == [(t, s) for t, c in enumerate(w.counts) for s in range(max(0, c - 5))]
