from __future__ import annotations

import random
import re

import numpy as np
import pytest

from graphloom.llm import decontaminate as M
from graphloom.llm.decontaminate import decontaminate, find_leaks, packed_keys, suffix_array
from tests.llm.conftest import prose


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def brute(docs, items, least, whole=6):
    out = {}
    for d, t in docs:
        a = words(t)
        for i, s in items:
            b, best = words(s), None
            need = min(least, len(b)) if len(b) >= whole else 10**9
            for x in range(len(b)):
                for y in range(len(a)):
                    n = 0
                    while x + n < len(b) and y + n < len(a) and b[x + n] == a[y + n]:
                        n += 1
                    if n >= need and (best is None or n > best[0]):
                        best = (n, x, y)
            if best:
                out[d, i] = best
    return out


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_is_sorted(seed):
    r = np.random.default_rng(seed)
    codes = r.integers(0, 3, 400).astype(np.uint64)
    codes = np.concatenate([codes, codes[50:150], np.zeros(9, np.uint64)])
    n = len(codes) - 8
    order = suffix_array(packed_keys(codes, n, 16, 4), 64, 16, 4)

    def text(i):
        out = []
        while i < len(codes) and codes[i] and len(out) < 64:
            out.append(int(codes[i]))
            i += 1
        return out

    got = [text(i) for i in order]
    assert got == sorted(got) and sorted(order) == list(range(n))


@pytest.mark.parametrize("passes", [False, True])
def test_longest_matches_are_those_of_brute_force(spark, monkeypatch, passes):
    if passes:
        monkeypatch.setattr(M, "TEST_BYTES", 60)
    r = random.Random(6)
    items = [(i, prose(r, n)) for i, n in enumerate([30, 12, 8, 7, 0, 40, 5])] + [(8, None), (7, "la " * 20)]
    texts = [prose(r, 60) for _ in range(6)]
    w = items[0][1].split()
    texts += [
        prose(r, 10) + " " + items[0][1].upper() + ". " + prose(r, 9), " ".join(w[3:14]) + ", " + " ".join(w[:9]), " ".join(w[:7]), items[1][1] + " " + items[2][1], items[2][1], items[3][1],
        items[6][1], items[3][1] + " " + items[6][1], " ".join(items[3][1].split()[:6]), "la " * 50, " ".join(w[:10]) + " x " + " ".join(w[:10]), None, "",
    ]
    rows = [*enumerate(texts), (6, texts[6])]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [((r["doc_id"], r["item_id"]), (r["match_words"], r["item_start"], r["doc_start"])) for r in find_leaks(docs, bench, shard_words=200).collect()]
    want = brute(rows, items, 8)
    assert dict(got) == want and len(got) == len(want) + 1  # a repeated row is reported again
    kept = decontaminate(docs, bench)
    hit = {d for d, _ in want}
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in sorted(rows) if i not in hit] and kept.columns == docs.columns


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "a a a a a a a a a a")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in find_leaks(odd, bench).collect()) == [6, 7]
    assert decontaminate(odd, bench).count() == odd.count() - 2 and decontaminate(none, bench).count() == 0
    assert find_leaks(odd, bench.limit(0)).count() == 0 and decontaminate(odd, bench.limit(0)).count() == odd.count()


@pytest.mark.parametrize("seed", range(8))
def test_search_on_few_different_words(seed):
    """Small alphabets: long and overlapping repetitions, many ties."""
    r = np.random.default_rng(seed)
    letters = ["w%d" % i for i in range(1 + seed % 3)]
    docs = [(i, " ".join(r.choice(letters, r.integers(0, 40)))) for i in range(8)]
    items = [(i, " ".join(r.choice(letters, r.integers(0, 25)))) for i in range(6)]
    tests = M.prepare_tests([t for _, t in items], 4, 3)
    buf, offsets = M.string_bytes(M.pa.array([t for _, t in docs]))
    w = M.words_of(buf, offsets, folded=True)
    got = {(t, i): rest for t, i, *rest in M.search(w.hashes, w.first, tests)}
    want = brute(docs, items, 4, 3)
    assert {k: tuple(v) for k, v in got.items()} == want
    assert set(M.affected(w.hashes, w.first, tests).tolist()) == {d for d, _ in want}


def test_long_repetitions_take_no_long(spark):
    """20,000 times one word against 2,000 times it."""
    from time import perf_counter

    tests = M.prepare_tests(["la " * 2000], 8)
    buf, offsets = M.string_bytes(M.pa.array(["la " * 20_000]))
    w = M.words_of(buf, offsets, folded=True)
    began = perf_counter()
    assert M.search(w.hashes, w.first, tests) == [(0, 0, 2000, 0, 0)]
    assert perf_counter() - began < 4


def test_clashing_and_dotted_names(spark):
    t = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, t, "x"), (2, "none", "y")], "doc_id long, text string, `a.b` string")
    bench = spark.createDataFrame([(7, t)], "doc_id long, text string")
    found = find_leaks(docs, bench, item_col="doc_id")
    assert found.columns == ["doc_id", "doc_id_", "match_words", "item_start", "doc_start"] and [tuple(r) for r in found.collect()] == [(1, 7, 9, 0, 0)]
    assert [r["a.b"] for r in decontaminate(docs, bench, item_col="doc_id").collect()] == ["y"]
    named = docs.withColumnRenamed("doc_id", "match_words").withColumnRenamed("text", "t.x")
    assert [tuple(r) for r in find_leaks(named, bench, id_col="match_words", text_col="t.x", item_col="doc_id").collect()] == [(1, 7, 9, 0, 0)]
