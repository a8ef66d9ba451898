from __future__ import annotations

import numpy as np
import pytest

from graphloom.llm import neighbours as M
from graphloom.llm.neighbours import Block, code_products, nearest, quantise, survivors, tile


def unit(x):
    size = np.linalg.norm(x, axis=1)
    return x / np.where(size > 0, size, 1)[:, None]


def brute(ids, x, k):
    c = unit(np.asarray(x, float)) @ unit(np.asarray(x, float)).T
    return {i: sorted(((j, c[a, b]) for b, j in enumerate(ids) if j != i), key=lambda t: (-round(t[1], 12), t[0]))[:k] for a, i in enumerate(ids)}


def test_bounds_hold():
    r = np.random.default_rng(0)
    for d in (3, 64, 1500):
        q, x = unit(r.normal(size=(40, d))), unit(r.normal(size=(50, d)) ** 3)
        (a, sa, ea), (b, sb, eb) = quantise(q), quantise(x)
        product = code_products(a, b)
        assert np.array_equal(product, a.astype(np.int64) @ b.astype(np.int64).T)  # exact
        assert (np.abs(q @ x.T - product * sa[:, None] * sb) <= ea[:, None] + (1 + ea[:, None]) * eb + 1e-12).all()


@pytest.mark.parametrize("seed", range(4))
def test_no_near_pair_is_ruled_out(seed):
    """Crowds of almost equal vectors, where bounds can't tell the pairs apart; the bar by parts of a row too."""
    r = np.random.default_rng(seed)
    q = unit(r.normal(size=(30, 16)))
    x = unit(np.concatenate([q[:3].repeat(300, axis=0) + r.normal(size=(900, 16)) * 1e-4, r.normal(size=(300, 16))]))
    (a, sa, ea), (b, sb, eb) = quantise(q), quantise(x)
    i, j, _ = survivors(code_products(a, b), sa, sb, ea, float(eb.max()), 10)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    for row, best in enumerate(np.argsort(-(q @ x.T), axis=1)[:, :10]):
        assert {(row, int(c)) for c in best} <= kept
    assert len(kept) < 30 * 1200 / 2


def test_a_tile_serves_both_its_blocks(monkeypatch):
    monkeypatch.setattr(M, "STRIPE", 7)
    r = np.random.default_rng(2)
    x = r.integers(-2, 3, (50, 4)).astype(np.float32)  # many ties
    ids = r.permutation(50)
    a, b = (Block.of(np.sort(ids[s]), x[np.sort(ids[s])]) for s in (slice(0, 20), slice(20, 50)))
    c = unit(x.astype(float)) @ unit(x.astype(float)).T
    for (p, q), (i, j, s) in zip(((a, b), (b, a)), tile(a, b, 5), strict=True):
        for row, one in enumerate(p.ids.tolist()):
            want = sorted(q.ids.tolist(), key=lambda o: (-round(c[one, o], 12), o))[:5]
            assert q.ids[j[i == row]].tolist() == want and np.allclose(s[i == row], c[one, want])


@pytest.mark.parametrize("size", [2_000, 1 << 25])
def test_neighbours_are_those_of_brute_force(spark, size):
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 8)).round(1)
    x[7] = x[3]
    x[9] = 0
    x[20:40] = x[50]  # a crowd of equal vectors
    ids = [int(v) for v in r.permutation(1000)[:120]]
    rows = [(i, v.tolist(), "z") for i, v in zip(ids, x, strict=True)]
    bad = [(None, [1.0] * 8, "z"), (2000, None, "z"), (2001, [], "z"), (2002, [float("nan")] * 8, "z"), (2003, [1.0] * 7 + [None], "z"), (2004, [float("inf")] * 8, "z"), rows[0]]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, b string")
    got = {}
    for t in nearest(frame, k=5, block_bytes=size).collect():
        got.setdefault(t["vec_id"], {})[t["rank"]] = (t["neighbour_id"], t["cosine"])
    want = brute(ids, x, 5)
    assert set(got) == set(want)
    for i in ids:
        mine = [got[i][n + 1] for n in range(5)]
        assert [j for j, _ in mine] == [j for j, _ in want[i]] and np.allclose([c for _, c in mine], [c for _, c in want[i]])


@pytest.mark.parametrize("size", [2_000, 1 << 25])
def test_queries_of_some_ids_search_all_rows(spark, size):
    r = np.random.default_rng(7)
    x = r.normal(size=(150, 8)).round(1)
    x[20:40] = x[50]
    ids = [int(v) for v in r.permutation(600)[:150]]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(7_000, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = {}
    for t in nearest(frame, k=5, every=5, block_bytes=size).collect():
        got.setdefault(t["vec_id"], {})[t["rank"]] = t["neighbour_id"]
    want = brute(ids, x, 5)
    assert got == {i: {n + 1: j for n, (j, _) in enumerate(want[i])} for i in ids if i % 5 == 0}
    assert nearest(frame, every=100_003).where("vec_id <> 0").count() == 0


def test_vectors_of_each_length_are_neighbours_of_one_another(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 1.0, 0.0]), (6, [1.0])]
    got = {}
    for t in nearest(spark.createDataFrame(rows, "vec_id int, embedding array<float>"), k=2).collect():
        got.setdefault(t["vec_id"], []).append((t["rank"], t["neighbour_id"]))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {1: [2, 3], 2: [1, 3], 3: [2, 1], 4: [5], 5: [4]}


def test_small_and_empty_tables_and_ids(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "`v.id` long, `e.x` array<float>")
    assert sorted((r["v.id"], r["neighbour_id"], r["rank"]) for r in nearest(frame, id_col="v.id", vector_col="e.x").collect()) == [(1, 2, 1), (2, 1, 1)]
    assert nearest(frame.limit(0), id_col="v.id", vector_col="e.x").count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        nearest(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))
