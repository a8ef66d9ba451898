from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import jaccard as J
from graphloom.llm.components import components
from graphloom.llm.jaccard import divide_skip, jaccard_join, keep_one_of_each_group, near_classes, search_sets
from tests.llm.conftest import prose


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), max_size=9), max_size=7), st.integers(1, 5), st.integers(0, 6))
def test_divide_skip_counts_as_counting_does(lists, threshold, skip):
    count = {v: sum(v in x for x in lists) for x in lists for v in x}
    assert divide_skip([np.array(sorted(x), np.int64) for x in lists], threshold, skip) == {v: n for v, n in count.items() if n >= threshold}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_search_of_sets_is_exact(least):
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 1000, 60))
    sets = [np.unique(np.concatenate([base[r.random(len(base)) < r.random()], r.integers(0, 1000, r.integers(1, 30))])).astype(np.uint64) for _ in range(60)]
    ids = r.permutation(60)
    got = {frozenset((i, int(x))): int(c) for i, j, n in search_sets(ids, sets, least) for x, c in zip(j, n, strict=True)}
    want = {}
    for i in range(60):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if o >= least * (len(sets[i]) + len(sets[j]) - o) - 1e-9:
                want[frozenset((i, j))] = o
    assert got == want


@pytest.mark.parametrize(("least", "column", "stripe"), [(0.3, 32, 1 << 21), (0.5, 2, 100), (0.8, 4, 7)])
def test_products_of_dense_sets_are_exact(monkeypatch, least, column, stripe):
    monkeypatch.setattr(J, "COLUMN", column)
    monkeypatch.setattr(J, "STRIPE", stripe)
    r = np.random.default_rng(4)
    base = np.unique(r.integers(0, 1000, 80))
    sets = [np.unique(np.concatenate([base[r.random(len(base)) < r.choice([0.2, 0.6, 0.9, 0.97])], r.integers(0, 1000, r.integers(1, 9))])).astype(np.uint64) for _ in range(70)]
    ids, side = r.permutation(70), r.integers(0, 2, 70)
    for s in (None, side):
        found = []
        for dense in (0, 1 << 40):
            monkeypatch.setattr(J, "DENSE", dense)
            found.append({(i, int(x)): int(c) for i, j, n in search_sets(ids, sets, least, s) for x, c in zip(j, n, strict=True)})
        assert found[0] == found[1] and found[0]


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        if i is not None and w:
            out.setdefault(frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)]), set()).add(i)
    return out


def brute(rows):
    classes = sorted((min(v), len(s), s, sorted(v)) for s, v in sets_of(rows).items())
    out = {(a, c): (n, n, n) for a, n, _, v in classes for c in v if c != a}
    for x, (a, n, s, _) in enumerate(classes):
        for b, m, t, _ in classes[:x]:
            o = len(s & t)
            if o >= 0.5 * (n + m - o) and a != b:
                (na, ia), (nb, ib) = sorted([(n, a), (m, b)])
                out[ia, ib] = (na, nb, o)
    return out


def corpus():
    r = random.Random(8)
    texts = [prose(r, n) for n in (400, 150, 60, 20, 5, 3, 2, 1)]
    rows = list(texts)
    for t in texts:
        for rate in (0.0, 0.02, 0.05, 0.1, 0.2):
            rows.append(" ".join(r.choice(["new", "other", "words"]) if r.random() < rate else w for w in t.split()))
    rows += [texts[0].upper() + "!", texts[1] + " " + prose(r, 120), prose(r, 300), prose(r, 300)]
    return list(enumerate(rows))


def test_pairs_are_those_of_brute_force(spark, none):
    rows = [*corpus(), (500, None), (501, ""), (None, "la le li lo lu"), (502, "!!"), (3, corpus()[3][1]), (503, "z " * 40_000), (504, "z " * 200)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, overlap string")
    got = {(r["doc_id_a"], r["doc_id_b"]): (r["size_a"], r["size_b"], r["overlap"]) for r in jaccard_join(docs).collect()}
    assert got == brute(rows)
    assert jaccard_join(none).count() == 0


def test_pairs_are_those_of_brute_force_where_components_are_cut_into_tiles(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id_a"], r["doc_id_b"]): (r["size_a"], r["size_b"], r["overlap"]) for r in jaccard_join(docs, members_a_task=500, entries_a_task=300).collect()}
    assert got == brute(rows)


def brute_classes(rows):
    """(id, class, links) of documents, which are ids with a set; those of one id hang together."""
    where = sets_of(rows)
    links, up = {}, {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for s, v in where.items():
        for t, w in where.items():
            o = len(s & t)
            if o >= 0.5 * (len(s) + len(t) - o):
                for i in v:
                    links[i, s] = links.get((i, s), 0) + len(w - {i} if s == t else w)
                for i in (*v, *w):
                    x, y = sorted((find(i), find(min(v))))
                    up[y] = x
    out = [(i, find(i), n) for (i, _), n in links.items()]
    return sorted(out + [(i, find(i), 0) for i in up if not any(i == x for x, _ in links)])


@pytest.mark.parametrize("sizes", [{}, {"members_a_task": 500, "entries_a_task": 300}])
def test_classes_and_links_are_those_of_brute_force(spark, none, sizes):
    r = random.Random(3)
    base = prose(r, 80)
    crowd = [" ".join(r.choice(["new", "other", "words"]) if r.random() < 0.06 else w for w in base.split()) for _ in range(40)]
    rows = [*corpus(), *((100 + i, t) for i, t in enumerate(crowd)), (150, crowd[0]), (151, crowd[3].upper()), (500, None), (501, ""), (None, crowd[1]), (502, "!!"), (3, corpus()[3][1]), (3, corpus()[3][1]), (7, crowd[2])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, links string")
    assert sorted(tuple(x) for x in near_classes(docs, **sizes).collect()) == brute_classes(rows)
    if not sizes:
        assert near_classes(none).count() == 0


def test_texts_that_share_an_id_lose_no_link_of_their_copies(spark):
    """Ids 7 and 9 have similar texts, both of which id 5 has too, so that both are known by that id."""
    x = "one two three four five six seven"
    rows = [(5, x), (5, x + " eight"), (7, x), (9, x + " eight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_classes(docs).collect()) == [(5, 5, 3), (5, 5, 3), (7, 5, 3), (9, 5, 3)] == brute_classes(rows)


def test_capitals_of_every_script_are_small_letters(spark):
    texts = ["ТИХИЙ ОКЕАН ШУМИТ ДО УТРА", "тихий океан шумит до утра", "ΜΙΑ ΚΑΛΗ ΜΕΡΑ ΕΔΩ", "μια καλη μερα εδω"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(r) for r in near_classes(docs).collect()) == [(0, 0, 1), (1, 0, 1), (2, 2, 1), (3, 2, 1)]
    assert sorted((r["doc_id_a"], r["doc_id_b"]) for r in jaccard_join(docs).collect()) == [(0, 1), (2, 3)]


def test_pairs_of_a_large_cluster_are_not_formed(spark, monkeypatch):
    """Near copies of one text hang together by as many stars, and no pair of theirs goes through a shuffle."""
    r = random.Random(6)
    base = prose(r, 120)
    rows = [(i, " ".join("new" if r.random() < 0.02 else w for w in base.split()) + f" x{i} y{i}") for i in range(150)]
    seen, real = {}, J.written
    monkeypatch.setattr(J, "written", lambda df, name: seen.setdefault(name, real(df, name)))
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(x) for x in got.collect()) == brute_classes(rows)
    assert seen["stars"].count() < 5 * 150 and seen["candidates"].count() < 5 * 150 and seen["links"].count() == 150


def test_an_id_with_several_texts_has_one_row_a_pair_and_none_with_itself(spark):
    t = "one two three four five six"
    docs = spark.createDataFrame([(1, t), (1, t + " seven"), (1, t), (2, t), (3, t + " seven eight"), (3, t + " seven")], "doc_id long, text string")
    got = sorted((r["doc_id_a"], r["doc_id_b"], r["overlap"], r["jaccard"]) for r in jaccard_join(docs).collect())
    assert got == [(1, 2, 4, 1.0), (1, 3, 5, 1.0)]


def test_large_sets_at_the_threshold_are_all_found(spark):
    """2,000 of 3,000 members in common: a similarity of a half and no more."""
    texts = []
    for k in range(500):
        both = [f"c{k}x{i}" for i in range(2002)]
        texts += [" ".join([*both, *(f"{side}{k}x{i}" for i in range(1000))]) for side in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id_a"], r["doc_id_b"], r["overlap"]) for r in jaccard_join(docs).collect()}
    assert got == {(2 * k, 2 * k + 1, 2000) for k in range(500)}


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        jaccard_join(spark.createDataFrame([("x", "a b c")], "doc_id string, text string"))


def test_one_of_each_group_stays(spark, odd, none):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = keep_one_of_each_group(docs)
    near = {}

    def find(x):
        while near.get(x, x) != x:
            x = near[x]
        return x

    for a, b in brute(rows):
        x, y = sorted((find(a), find(b)))
        near[y] = x
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i, _ in rows}) and kept.columns == docs.columns
    got = keep_one_of_each_group(odd)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(["1", "2", "3", "4", "4", "None", "None", "5", "6"]) and got.columns == odd.columns
    assert keep_one_of_each_group(none).count() == 0


@pytest.mark.parametrize("edges", [0, 10**6])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, edges):
    monkeypatch.setattr("graphloom.llm.components.ONE_TASK", edges)
    test_components(spark)


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(7, 7), (None, 3), (1, 0), (0, 1)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = set()
    for a, b in edges:
        if a is not None:
            nodes |= {a, b}
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in nodes}
