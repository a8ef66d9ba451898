"""Operators 3 and 5 against plain counting of windows."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm.substrings import count_windows, repeated_spans
from graphloom.llm.suffixes import letters_of, merge, repeated_intervals, repeated_windows, shard_order, transform
from tests.llm.conftest import odd_rows, prose


def brute(rows, k):
    """{(doc, start): (end, occurrences, documents)}"""
    where = defaultdict(list)
    texts = [(i, t.split()) for i, t in rows if i is not None and t is not None]
    for i, w in texts:
        for s in range(len(w) - k + 1):
            where[tuple(w[s : s + k])].append((i, s))
    hits = defaultdict(dict)
    for places in where.values():
        docs = {i for i, _ in places}
        if len(docs) > 1:
            for i, s in places:
                hits[i][s] = max(hits[i].get(s, (0, 0)), (len(places), len(docs)))
    out = {}
    for i, found in hits.items():
        start = end = None
        for s in sorted(found):
            if end is None or s > end:
                start, out[i, s] = s, [s + k, 0, 0]
            end = s + k
            o = out[i, start]
            o[0], o[1], o[2] = end, max(o[1], found[s][0]), max(o[2], found[s][1])
    return {k: tuple(v) for k, v in out.items()}


def corpus():
    r = random.Random(2)
    passage, other = prose(r, 60), prose(r, 55)
    texts = [
        prose(r, 100), prose(r, 30) + " " + passage + " " + prose(r, 20), passage, prose(r, 5) + "\n" + passage + "\t" + other, other + " " + prose(r, 80), "la " * 200, "la " * 90 + "x",
        " ".join(passage.split()[:49]), " ".join(passage.split()[5:55]), prose(r, 120),
    ]
    return [*enumerate(texts), (20, texts[0]), (21, texts[0])]


@pytest.mark.parametrize(("op", "column", "at"), [(repeated_spans, "most_copies", 1), (repeated_intervals, "most_docs", 2)])
def test_spans_are_those_of_brute_force(spark, odd, none, op, column, at):
    rows = [*corpus(), *((None if i is None else 100 + i, t) for i, t, *_ in odd_rows() if i != 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["start_word"]): (r["end_word"], r[column]) for r in op(docs).collect()}
    assert got == {k: (v[0], v[at]) for k, v in brute(rows, 50).items()}
    assert op(none).count() == 0
    assert {r["doc_id"] for r in op(odd).collect()} == {6, 7}


@pytest.mark.parametrize(("op", "column", "at"), [(repeated_spans, "most_copies", 1), (repeated_intervals, "most_docs", 2)])
@pytest.mark.parametrize("task_words", [1 << 21, 150])
def test_rows_that_repeat_an_id_keep_their_own_windows(spark, op, column, at, task_words):
    """Different texts of one id, rows alike, and minimisers that are hot and not."""
    r = random.Random(12)
    passages = [prose(r, 70), prose(r, 55), "x y " * 40]
    rows = []
    for n in range(14):
        parts = [prose(r, r.randrange(20)), *r.sample(passages, r.randrange(1, 3)), prose(r, r.randrange(20))]
        rows.append((n % 4, " ".join(parts)))
    rows += [rows[0], rows[5]]
    got = {(r["doc_id"], r["start_word"]): (r["end_word"], r[column]) for r in op(spark.createDataFrame(rows, "doc_id long, text string"), task_words=task_words).collect()}
    assert got == {k: (v[0], v[at]) for k, v in brute(rows, 50).items()}


@pytest.mark.parametrize("op", [repeated_spans, repeated_intervals])
def test_ids_must_be_whole_numbers(spark, op):
    with pytest.raises(TypeError, match="whole numbers"):
        op(spark.createDataFrame([("x", "a b c")], "doc_id string, text string"))


def strings(seed, n=14, alphabet=3):
    r = np.random.default_rng(seed)
    base = r.integers(1, alphabet + 1, 90)
    parts = [base[a : a + r.integers(0, 70)] if r.random() < 0.5 else r.integers(1, alphabet + 1, r.integers(0, 80)) for a in r.integers(0, 60, n)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.concatenate(parts).astype(np.uint64), first, r.integers(0, 5, n), r.integers(0, 4, n)


@pytest.mark.parametrize("seed", range(6))
def test_merged_order_is_the_sorted_one(seed):
    """Merging transforms gives the order and common prefixes that sorting all suffixes does."""
    words, first, _, shard = strings(seed)
    stride, rounds = 2, 6
    letters, begin = letters_of(words, first, stride)
    transforms, orders, ended = [], [], []
    for s in np.unique(shard):
        mine = np.flatnonzero(shard == s)
        size = np.diff(begin)[mine]
        local = np.concatenate([[0], np.cumsum(size)])
        place = np.concatenate([np.arange(begin[m], begin[m + 1]) for m in mine])
        own = letters[place]
        order = shard_order(own, local, stride)
        transforms.append(transform(own, local, order, stride))
        orders.append(place[order])
        ended.append(int((own == 0).sum()))
    which, at, prefix = merge(transforms, ended, rounds)

    def suffix(p):
        end = begin[np.searchsorted(begin, p, "right")]
        out = [int(letters[q]) for q in range(p, end, stride)]
        return out[: out.index(0)] if 0 in out else out

    merged = [suffix(orders[w][a])[:rounds] for w, a in zip(which, at, strict=True)]
    assert merged == sorted(merged) and len(merged) == len(letters)
    for i in range(1, len(merged)):
        a, b = merged[i - 1], merged[i]
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        # two suffixes that end alike stay one block
        assert prefix[i] == same or (a == b and prefix[i] >= same)


@pytest.mark.parametrize("seed", range(6))
def test_both_settlings_agree_with_counting(seed):
    words, first, doc, shard = strings(seed, alphabet=2)
    k = 10
    seen, docs = defaultdict(int), defaultdict(set)
    windows = [(t, tuple(words[a : a + k])) for t in range(len(doc)) for a in range(first[t], first[t + 1] - k + 1)]
    for t, w in windows:
        seen[w] += 1
        docs[w].add(int(doc[t]))
    repeated, number = count_windows(words, first, doc, k)
    assert [(bool(a), int(b)) for a, b in zip(repeated, number, strict=True)] == [(len(docs[w]) > 1, seen[w]) for _, w in windows]
    repeated, number = repeated_windows(words, first, doc, shard, k, 5)
    assert [(bool(a), int(b)) for a, b in zip(repeated, number, strict=True)] == [(len(docs[w]) > 1, len(docs[w])) for _, w in windows]
