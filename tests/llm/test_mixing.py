from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.mixing import mix_sources, pfair_period, split_tail, tempered_shares
from graphloom.llm.registry import op1_mix_sources


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_no_source_departs_by_a_block(units):
    period, slots = sum(units), pfair_period(units)
    assert sorted(t for s in slots for t in s) == list(range(period))
    for u, s in zip(units, slots, strict=True):
        for j, t in enumerate(s):
            assert j * period // u <= t < -(-(j + 1) * period // u)
        for t in range(1, period + 1):
            assert abs(sum(x < t for x in s) - Fraction(u * t, period)) < 1


def test_shares_that_units_cannot_tell_are_the_tail():
    units, tail = split_tail({"a": 0.9, "b": 0.0999, "c": 0.0001}, 1000)
    assert units == {"a": 9, "b": 1} and tail == ["c"]


def by_hand(rows, units, block):
    """(slot, rank, id, epoch, block, release, deadline) of the mixture, slot after slot by earliest deadline."""
    order = {s: sorted((i for i, x in rows if x == s), key=lambda i: (xxhash.xxh64_intdigest(str(i), seed=42) ^ 1 << 63, i)) for s in units}
    blocks = {s: [x[k : k + block] for k in range(0, len(x), block)] for s, x in order.items()}
    total, given, out, t = sum(units.values()), dict.fromkeys(units, 0), [], 0
    while any(given[s] < len(blocks[s]) for s in units):
        open_ = [(-(-(given[s] + 1) * total // units[s]), s) for s in units if given[s] * total // units[s] <= t]
        deadline, s = min(open_)
        j = given[s]
        docs = blocks[s][j % len(blocks[s])]
        out += [(t, r, i, j // len(blocks[s]), j, j * total // units[s], deadline) for r, i in enumerate(docs)]
        given[s] += 1
        t += 1
    return out


@pytest.mark.parametrize(("units", "sizes"), [({"x": 5, "y": 3, "z": 2}, (70, 31, 9)), ({"x": 1, "y": 1}, (5, 40)), ({"x": 97, "y": 2, "z": 1}, (10, 3, 1)), ({"z": 1}, (0, 0, 7))])
def test_the_mixture_is_that_of_a_schedule_by_hand(spark, units, sizes):
    rows = [(100 * k + i, s) for k, (s, n) in enumerate(zip("xyz", sizes, strict=False)) for i in range(n)]
    total = sum(units.values())
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), {k: u / total for k, u in units.items()}, block_docs=4, resolution=total, epoch_limit=1000).collect()
    names = ("mix_slot", "mix_rank", "doc_id", "mix_epoch", "mix_block", "mix_release", "mix_deadline")
    assert sorted(tuple(r[n] for n in names) for r in got) == by_hand([x for x in rows if x[1] in units], units, 4)


def test_a_mixture_that_would_repeat_a_source_too_often_is_refused(spark):
    rows = [(i, "b") for i in range(400)] + [(1000, "a")]
    with pytest.raises(ValueError, match="epoch_limit"):
        mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 0.99, "b": 0.01})
    few = [(i, "b") for i in range(400)] + [(1000 + i, f"t{i}") for i in range(30)]
    with pytest.raises(ValueError, match="epoch_limit"):
        mix_sources(spark.createDataFrame(few, "doc_id long, source string"), {"b": 0.001} | {f"t{i}": 0.999 / 30 + i / 1e5 for i in range(30)}, resolution=20)


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], "note", "dot", 1) for i in range(20)], "doc_id long, source string, mix_notes string, `a.b` string, mix_slot long")
    got = mix_sources(rows)
    assert got.columns[:4] == ["doc_id", "source", "mix_notes", "a.b"] and got.columns.count("mix_slot") == 1
    assert {(r["mix_notes"], r["a.b"]) for r in got.collect()} == {("note", "dot")} and {r["mix_slot"] for r in got.collect()} == {0, 1}


@pytest.mark.parametrize("weights", [None, {"big": 0.5, "mid": 0.3, "small": 0.2}])
def test_mixture_keeps_weights_and_loses_nothing(spark, weights):
    sizes = {"big": 500, "mid": 120, "small": 33}
    rows = [(1000 * k + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=8, resolution=100).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    by_slot = defaultdict(set)
    for r in got:
        by_slot[r["mix_slot"]].add(r["mix_task"])
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
    order = [by_slot[t] for t in range(len(by_slot))]
    assert all(len(x) == 1 for x in order)
    order = [next(iter(x)) for x in order]
    counts = Counter()
    if weights:
        for t, s in enumerate(order, 1):
            counts[s] += 1
            assert all(abs(counts[k] - w * t) < 1 for k, w in weights.items())
    repeats = Counter(r["doc_id"] for r in got)
    assert all(repeats[i] == 1 for i, s in rows if s == "big") or weights


def test_odd_rows(spark, odd, none):
    got = mix_sources(odd, block_docs=2).collect()
    first = [r for r in got if r["mix_epoch"] == 0]
    assert len(first) == odd.count() and {r["mix_task"] for r in got} == {"a", "b", "c", None}
    assert mix_sources(none).count() == 0 and mix_sources(odd, {"none such": 1.0}).count() == 0
    only = mix_sources(odd, {None: 1.0}, block_docs=1).collect()
    assert len(only) == 2 and {r["source"] for r in only} == {None}


@pytest.mark.parametrize("hot, few, docs", [(4000, 300, 2), (6000, 400, 1), (0, 500, 3)])
def test_a_long_tail_keeps_its_weights(spark, hot, few, docs):
    sizes = ({"hot": hot} if hot else {}) | {f"t{i}": docs + i % 2 for i in range(few)}
    rows = [(100_000 * k + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, source string")
    shares = tempered_shares(sizes, 4.0)
    got = mix_sources(table, block_docs=8, resolution=1000, bucket_docs=500).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    slots = defaultdict(list)
    for r in got:
        slots[r["mix_slot"]].append(r)
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
    assert sorted(slots) == list(range(len(slots)))
    assert all(sorted(r["mix_rank"] for r in x) == list(range(len(x))) and len({(r["mix_task"], r["mix_block"]) for r in x}) == 1 for x in slots.values())
    counts, total = Counter(), sum(shares.values())
    for t in range(len(slots)):
        counts.update(r["source"] for r in slots[t])
        if t % 100 == 99:
            docs_so_far = sum(counts.values())
            if hot:  # to two blocks, and the rounding that is stated
                want = docs_so_far * shares["hot"] / total
                assert abs(counts["hot"] - want) <= 16 + 0.01 * want
            assert all(abs(counts[s] - docs_so_far * shares[s] / total) < 3 for s in sizes if s != "hot")
    assert max(Counter(r["doc_id"] for r in got).values()) <= 6


def test_the_query_mixes_whole_documents(spark, tmp_path):
    table = spark.createDataFrame([(i, f"text {i}", "en", "ab"[i % 2], 6) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_mix_sources(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(i, f"text {i}") for i in range(9)}
