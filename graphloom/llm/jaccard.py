"""Operator 9: n-gram Jaccard join by T-occurrence search.

Documents are sets of hashed runs of n folded words. Equal sets are one class, named by a hash of the set.
Sets A and B of |A| <= |B| are similar if they have J / (1 + J) (|A| + |B|) members in common, or more.

The inverted lists hold, of every class, the members that come first in the order of their hashes, a part
`kept` of them. At most (1 - kept) |B| of the common members can lie beyond the kept ones of either set, so
that a number T of them, which follows from the sizes, is certain to be in the lists. DivideSkip over
them: the L longest lists of a set are left aside, its short lists are joined and counted, and whoever
reaches T - L of them is a candidate; no similar pair can fail that. Candidates that hang together are
brought, with their whole sets, to tasks by tiles of bounded size, where divide_skip() merges the short
lists of a set again on a heap, probes the long ones by binary search, and keeps the pairs that reach the
overlap; where the short lists are large, arrays do the same.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.kernel import gram_hashes, mix, string_bytes, word_slices
from graphloom.llm.shared import forget_shuffles, whole_ids, written

#: Words in a member, and the least Jaccard similarity of a pair.
GRAM, LEAST = 3, 0.5
#: Part of the greatest number of common members that the lists are certain to hold for partners of the least size.
SHARE = 1.0
#: Part of T that is left aside as long lists: the rest of it must be met in short ones.
ASIDE = 0.75
#: Members are hashes of so many bits, so that one packs with a document's number in 64.
BITS = 48
#: Entries of inverted lists that one flush packs.
FLUSH = 1 << 20
#: Pairs that a step of counting takes at once.
PAIRS = 1 << 19
#: Short lists of up to so many entries are merged on a heap, larger ones by arrays.
HEAP = 48
#: Lists of so many classes or more are counted against their least class first.
CROWD = 8
#: Squares of list lengths that make a tile dense, entries of counts of a stripe of it, and the part of its sets that a list has to hold to be a column.
DENSE, STRIPE, COLUMN = 1 << 22, 1 << 21, 32
_MASK = np.uint64((1 << BITS) - 1)
_SALT = np.uint64(0x9FB21C651E98DF25)


def small_letters(column: pa.Array) -> pa.Array:
    """Texts with the capitals of all scripts made small; bytes that aren't UTF-8 leave their text as it is."""
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        parts = []
        for i in range(len(column)):
            one = column.slice(i, 1)
            try:
                one = pc.utf8_lower(one)
            except pa.ArrowInvalid:
                pass
            parts.append(one)
        return pa.concat_arrays(parts)


def member_sets(column: pa.Array, gram: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted members) for each text with a word, in small letters of any script; texts of fewer than `gram` words have one member."""
    for base, w in word_slices(small_letters(column), folded=True):
        h = gram_hashes(w.hashes, gram) & _MASK
        for t, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if b - a >= gram:
                yield base + t, np.unique(h[a : b - gram + 1])
            elif b > a:
                yield base + t, gram_hashes(w.hashes[a:b], b - a) & _MASK


def set_key(members: np.ndarray) -> int:
    """A hash of the whole set."""
    return int(mix(members).sum().view(np.int64))


def kept_part(least: float) -> float:
    """Part of a set's members that goes to the lists: T is then SHARE J / (1 + J) |A| for |B| = |A| / J, and more for nearer sizes."""
    return (1 - (1 - SHARE) * least**2) / (1 + least)


def needed(size: int | np.ndarray, least: float) -> int | np.ndarray:
    """Common members that a set of this size needs with a set that isn't smaller, for similarity `least`."""
    return np.maximum(1, np.ceil(2 * least / (1 + least) * size - 1e-9)).astype(np.int64)


def divide_skip(lists: list[np.ndarray], threshold: int, skip: int) -> dict[int, int]:
    """Numbers that occur in at least `threshold` of the sorted lists, with their counts.

    The `skip` longest lists (fewer than threshold) are probed by binary search, the others merged on a heap.
    """
    lists = sorted(lists, key=len)
    skip = max(0, min(skip, threshold - 1, len(lists)))
    short, long = [x.tolist() for x in lists[: len(lists) - skip]], lists[len(lists) - skip :]
    heap = [(x[0], k, 0) for k, x in enumerate(short) if x]
    heapq.heapify(heap)
    found: dict[int, int] = {}
    while heap:
        value, count = heap[0][0], 0
        while heap and heap[0][0] == value:
            _, k, i = heap[0]
            count += 1
            if i + 1 < len(short[k]):
                heapq.heapreplace(heap, (short[k][i + 1], k, i + 1))
            else:
                heapq.heappop(heap)
        if count >= threshold - skip:
            for k, x in enumerate(long):
                if count + len(long) - k < threshold:
                    break
                i = int(np.searchsorted(x, value))
                count += bool(i < len(x) and x[i] == value)
            if count >= threshold:
                found[value] = count
    return found


def search_sets(ids: np.ndarray, sets: list[np.ndarray], least: float, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, all its partners j, their overlaps) for pairs of similarity `least` or more; i is the smaller, then the lesser id.

    With `side`, pairs of one side are left out. Short lists of few entries go through divide_skip(); larger
    ones are merged by sorting their concatenation, and candidates are looked up in the long lists by binary
    search, or, where that is cheaper, by one count over the long lists.
    """
    sizes = np.array([len(s) for s in sets])
    rank = np.lexsort((ids, sizes))  # partners come later in this order
    sets, sizes = [sets[k] for k in rank], sizes[rank]
    side = None if side is None else side[rank]
    n = len(sets)
    members = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    by = np.argsort(members, kind="stable")  # each list is in the order of sets
    values, owners = members[by], owner[by]
    lead = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    length = np.diff(np.append(lead, len(values)))
    code = np.empty(len(members), np.int64)
    code[by] = np.repeat(np.arange(len(lead)), length)
    packed = np.repeat(np.arange(len(lead)), length) * n + owners  # (list, set) pairs in order, for probes
    at = np.concatenate([[0], np.cumsum(sizes)])
    columns = np.flatnonzero(length >= max(2, n // COLUMN))
    work = int((length * length).sum())
    if work > DENSE and work > n * n * len(columns) // 32:
        for a, who, count in _products(n, sizes, code, at, lead, length, owners, columns, by, least, side):
            yield int(rank[a]), rank[who], count
        return
    for a in range(n - 1):
        mine = code[at[a] : at[a + 1]]
        t = int(needed(sizes[a], least))
        shared = mine[length[mine] > 1]
        if len(shared) < t:
            continue
        shared = shared[np.argsort(length[shared], kind="stable")]
        skip = min(t - max(1, t // 8), len(shared))
        short, long = shared[: len(shared) - skip], shared[len(shared) - skip :]
        entries = length[short]
        if int(entries.sum()) <= HEAP:
            merged = divide_skip([owners[lead[s] : lead[s] + length[s]] for s in shared.tolist()], t, skip)
            who = np.array([x for x in merged if x > a], np.int64)
            count = np.array([merged[x] for x in who.tolist()], np.int64)
        else:
            take = np.repeat(lead[short] - (np.cumsum(entries) - entries), entries) + np.arange(int(entries.sum()))
            who = owners[take]
            who, count = np.unique(who[who > a], return_counts=True)
            who, count = who[count >= t - skip], count[count >= t - skip]
            if len(who) and len(long):
                if 8 * len(who) * len(long) <= int(length[long].sum()):
                    want = np.add.outer(long * n, who)
                    found = np.minimum(np.searchsorted(packed, want), len(packed) - 1)
                    count = count + np.count_nonzero(packed[found] == want, axis=0)
                else:
                    sizes_ = length[long]
                    take = np.repeat(lead[long] - (np.cumsum(sizes_) - sizes_), sizes_) + np.arange(int(sizes_.sum()))
                    count = count + np.bincount(owners[take], minlength=n)[who]
        if side is not None and len(who):
            other = side[who] != side[a]
            who, count = who[other], count[other]
        good = count >= least * (sizes[a] + sizes[who] - count) - 1e-9
        if good.any():
            yield int(rank[a]), rank[who[good]], count[good]


def _products(
    n: int, sizes: np.ndarray, code: np.ndarray, at: np.ndarray, lead: np.ndarray, length: np.ndarray, owners: np.ndarray, columns: np.ndarray, by: np.ndarray, least: float, side: np.ndarray | None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As search_sets(), numbered by rank, for sets that mostly meet: overlaps are products of a matrix of the long lists, and counts over the short ones."""
    number = np.full(len(lead), -1)
    number[columns] = np.arange(len(columns))
    dense = np.zeros((n, len(columns)), np.float32)
    column = number[code]
    owner = np.repeat(np.arange(n), sizes)
    dense[owner[column >= 0], column[column >= 0]] = 1
    place = np.empty(len(by), np.int64)  # of each member in its list
    place[by] = np.arange(len(by))
    end = lead + length
    high = np.searchsorted(sizes, np.floor(sizes / least + 1e-9), "right")  # the partners of a set are before this one
    x = 0
    while x < n - 1:
        y = min(n, x + max(1, STRIPE // max(1, int(high[x]) - x)))
        y = x + max(1, int(np.searchsorted(np.arange(1, y - x + 1) * (high[x:y] - x), STRIPE, "right")))
        z = int(high[y - 1])  # count over sets x to z
        width = z - x
        count = dense[x:y] @ dense[x:z].T
        light = np.flatnonzero((column[at[x] : at[y]] < 0) & (length[code[at[x] : at[y]]] > 1)) + at[x]
        many = end[code[light]] - place[light] - 1
        total = np.cumsum(many)
        p = 0
        while p < len(light):
            q = max(p + 1, int(np.searchsorted(total, (total[p - 1] if p else 0) + STRIPE, "right")))
            m = many[p:q]
            other = owners[np.repeat(place[light[p:q]] + 1 - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            first = np.repeat(owner[light[p:q]], m)
            inside = other < z
            count += np.bincount((first[inside] - x) * width + other[inside] - x, minlength=(y - x) * width).reshape(y - x, width).astype(np.float32)
            p = q
        for a in range(x, y):
            c = count[a - x, a + 1 - x :]
            good = c >= least * (sizes[a] + sizes[a + 1 : z] - c) - 1e-9
            if side is not None:
                good &= side[a + 1 : z] != side[a]
            who = np.flatnonzero(good)
            if len(who):
                yield a, who + a + 1, c[who].astype(np.int64)
        x = y


def _sets(rows: DataFrame, gram: int) -> DataFrame:
    """(doc, k, k2, n): the two hashes that name the set of a document, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, k, k2, n = [], [], [], []
            for row, s in member_sets(batch.column(1), gram):
                at.append(row)
                k.append(set_key(s))
                k2.append(int(np.bitwise_xor.reduce(mix(mix(s) ^ _SALT)).view(np.int64)))
                n.append(len(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(k, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32())], names=["doc", "k", "k2", "n"]
            )

    return rows.mapInArrow(run, "doc bigint, k bigint, k2 bigint, n int")


def _entries(rows: DataFrame, gram: int, buckets: int, part: float) -> DataFrame:
    """(bucket, sets, entries): packed entries of inverted lists, a cell for each bucket of members.

    sets: (k, n) pairs; entries: members, each with the number of its set in the cell in the low 16 bits.
    Of each set the members of least hash go in, a part `part` of them, rounded up. Exact copies are packed
    too; the lists take them once.
    """
    cells = ceil(buckets / part)  # few kept members are beyond that part of all hashes

    def pack(members: list[np.ndarray], keys: list[int], sizes: list[int]) -> pa.RecordBatch:
        table = np.column_stack([np.array(keys, np.int64), np.array(sizes)])
        size = np.array([len(s) for s in members])
        packed = (np.concatenate(members) << np.uint64(16)) | np.repeat(np.arange(len(size), dtype=np.uint64), size)
        packed.sort()
        bucket = ((packed >> np.uint64(24)) * np.uint64(cells)) >> np.uint64(BITS - 8)
        names, lead = np.unique(bucket, return_index=True)
        sets, entries = [], []
        for cell in np.split(packed, lead[1:]):
            own, local = np.unique(cell & np.uint64(0xFFFF), return_inverse=True)
            sets.append(table[own.astype(np.int64)].tobytes())
            entries.append((cell & ~np.uint64(0xFFFF) | local.astype(np.uint64)).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(sets, pa.binary()), pa.array(entries, pa.binary())], names=["bucket", "sets", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, keys, sizes, held = [], [], [], 0
        for batch in batches:
            for _, s in member_sets(batch.column(1), gram):
                members.append(s[: ceil(part * len(s))])
                keys.append(set_key(s))
                sizes.append(len(s))
                held += len(members[-1])
                if held >= FLUSH or len(keys) == 1 << 16:
                    yield pack(members, keys, sizes)
                    members, keys, sizes, held = [], [], [], 0
        if keys:
            yield pack(members, keys, sizes)

    return rows.mapInArrow(run, "bucket int, sets binary, entries binary")


def _lists(packed: DataFrame, buckets: int) -> DataFrame:
    """(list, k, n, length, anchor, center, center_n): the entries of lists in which two classes meet; a list has the name of its member.

    anchor: by the list's least class. The lists that a group of similar sets has in common mostly share it,
    so that the pairs of the group are counted in one place. center: that class itself, and its size, in lists
    of CROWD classes or more; null in shorter ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, keys, sizes = [], [], []
        for batch in batches:
            for _, sets, entries in zip(*batch.columns, strict=True):
                table = np.frombuffer(sets.as_buffer(), np.int64).reshape(-1, 2)
                cell = np.frombuffer(entries.as_buffer(), np.uint64)
                local = (cell & np.uint64(0xFFFF)).astype(np.int64)
                members.append(cell >> np.uint64(16))
                keys.append(table[local, 0])
                sizes.append(table[local, 1].astype(np.int32))
        if not members:
            return
        m, k, n = np.concatenate(members), np.concatenate(keys), np.concatenate(sizes)
        del members, keys, sizes
        by = np.argsort(m)
        m, k, n = m[by], k[by], n[by]
        same = m[1:] == m[:-1]
        several = np.zeros(len(m), bool)
        several[1:] = same
        several[:-1] |= same
        m, k, n = m[several], k[several], n[several]
        by = np.lexsort((k, m))
        m, k, n = m[by], k[by], n[by]
        once = np.ones(len(m), bool)
        once[1:] = (m[1:] != m[:-1]) | (k[1:] != k[:-1])
        m, k, n = m[once], k[once], n[once]
        lead = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])[: len(m)])
        each = np.diff(np.append(lead, len(m)))
        length = np.repeat(each, each)
        keep = length > 1
        least, least_n = np.repeat(k[lead], each)[keep], np.repeat(n[lead], each)[keep]
        anchor = (mix(least.view(np.uint64)) >> np.uint64(40)).astype(np.int32)
        m, k, n, length = m[keep].view(np.int64), k[keep], n[keep], length[keep].astype(np.int32)
        for a in range(0, len(m), 1 << 16):
            s = slice(a, a + (1 << 16))
            few = length[s] < CROWD
            yield pa.RecordBatch.from_arrays([*(pa.array(x[s]) for x in (m, k, n, length, anchor)), pa.array(least[s], mask=few), pa.array(least_n[s], mask=few)], names=["list", "k", "n", "length", "anchor", "center", "center_n"])

    return packed.repartition(buckets, "bucket").mapInArrow(run, "list bigint, k bigint, n int, length int, anchor int, center bigint, center_n int")


def _stars(lists: DataFrame, least: float, part: float) -> DataFrame:
    """(a, b) pairs of a class and the least one of its crowded lists that meet in T of them: candidates told without a pair being formed.

    There are no more of them than entries of lists, and the classes of a large cluster mostly hang together by them.
    """
    n, m = F.col("n"), F.col("m")
    met = lists.where("center is not null and k <> center").groupBy("k", "center").agg(F.count("*").alias("c"), F.min("n").alias("n"), F.min("center_n").alias("m"))
    t = F.ceil(least / (1 + least) * (n + m) - 1e-9) - F.floor((1 - part) * F.greatest("n", "m") + 1e-9)
    return met.where((F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9) & (F.col("c") >= F.greatest(F.lit(2), t))).select(F.col("k").alias("a"), F.col("center").alias("b"))


def _candidates(lists: DataFrame, labels: DataFrame, least: float, part: float, rows_a_task: int) -> DataFrame:
    """(a, b) pairs of classes of different labels that reach T - L of the short lists of the smaller one.

    labels: (k, label) of classes that stars hold together; any other class is alone. Pairs of one label are in
    one component anyway, where whole sets are searched, so that they needn't be formed here.
    """
    own = Window.partitionBy("k")
    half = least / (1 + least)
    size = F.min("n").over(own)  # should two classes have one key, the smaller bound holds
    # Least T of a set beside any partner: the larger one of a pair may have less of its own size.
    counted = lists.withColumns({"shared": F.count("*").over(own), "least_t": F.ceil(SHARE * half * size - 1e-9)}).where(F.col("shared") >= F.ceil((least - 1 + part) * F.col("n") - 1e-9))
    marked = (
        counted.withColumn("skip", F.when(F.col("shared") >= F.col("least_t"), F.floor(ASIDE * F.col("least_t"))).otherwise(-1).cast("int"))
        .withColumn("short", (F.col("skip") >= 0) & (F.row_number().over(own.orderBy("length", "list")) <= F.col("shared") - F.col("skip")))
        .select("anchor", "list", "k", "n", "skip", "short")
        .join(labels.hint("merge"), "k", "left")
        .withColumn("label", F.coalesce("label", "k"))
    )
    parts = max(1, -(-lists.count() // max(1, rows_a_task)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        name, k, n, skip, label = (table[c].to_numpy() for c in ("list", "k", "n", "skip", "label"))
        short = table["short"].to_numpy(zero_copy_only=False)
        by = np.lexsort((k, n, name))  # partners come later in a list
        name, k, n, skip, label, short = name[by], k[by], n[by].astype(np.int64), skip[by], label[by], short[by]
        lead = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        several = np.repeat(np.minimum.reduceat(label, lead) != np.maximum.reduceat(label, lead), np.diff(np.append(lead, len(name))))
        name, k, n, skip, label, short = name[several], k[several], n[several], skip[several], label[several], short[several]
        if not short.any():
            return
        lead = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        length = np.diff(np.append(lead, len(name)))
        number = np.repeat(np.arange(len(lead)), length)
        ids, at, local = np.unique(k, return_index=True, return_inverse=True)
        n_of, skip_of = n[at], skip[at]
        who = np.flatnonzero(short)
        # The partners of an entry are within its sizes, and of other labels: the shorter way of the two is taken.
        sized = np.searchsorted(number << 32 | n, number[who] << 32 | np.floor(n[who] / least + 1e-9).astype(np.int64), "right")
        other = np.lexsort((label, number))
        begins = np.concatenate([[True], (number[other][1:] != number[other][:-1]) | (label[other][1:] != label[other][:-1])])
        run_at = np.flatnonzero(begins)
        run_of = np.empty(len(other), np.int64)
        run_of[other] = np.cumsum(begins) - 1
        run_end = np.append(run_at[1:], len(other))
        own, first = run_of[who], lead[number[who]]
        last = first + length[number[who]]
        near = sized - who - 1 <= length[number[who]] - (run_end[own] - run_at[own])
        far = ~near
        targets = np.concatenate([np.arange(len(name)), other])
        start = np.concatenate([who[near] + 1, len(name) + first[far], len(name) + run_end[own[far]]])
        size = np.concatenate([sized[near] - who[near] - 1, run_at[own[far]] - first[far], last[far] - run_end[own[far]]])
        who = np.concatenate([who[near], who[far], who[far]])
        who, start, size = who[size > 0], start[size > 0], size[size > 0]

        def added(code: np.ndarray, count: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Sorted codes and counts, with those of further pairs."""
            more.sort()
            lead = np.flatnonzero(np.concatenate([[True], more[1:] != more[:-1]])[: len(more)])
            size, more = np.diff(np.append(lead, len(more))), more[lead]
            at = np.searchsorted(code, more)
            known = at < len(code)
            known[known] = code[at[known]] == more[known]
            count[at[known]] += size[known]
            fresh = ~known
            return np.insert(code, at[fresh], more[fresh]), np.insert(count, at[fresh], size[fresh])

        def out(code: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = code // len(ids), code % len(ids)
            t = np.ceil(half * (n_of[a] + n_of[b]) - 1e-9) - np.floor((1 - part) * n_of[b] + 1e-9)
            reach = np.maximum(1, t - skip_of[a]).astype(np.int64)
            for x in range(0, len(code), 1 << 16):
                s = slice(x, x + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(v[s]) for v in (ids[a], ids[b], count, reach)], names=["a", "b", "c", "reach"])

        total = np.cumsum(size)
        code, count, x = np.empty(0, np.int64), np.empty(0, np.int64), 0
        while x < len(who):
            y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + PAIRS, "right")))
            begin, many = start[x:y], size[x:y]
            a = np.repeat(who[x:y], many)
            b = targets[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(len(a))]
            x = y
            fits = np.flatnonzero((label[a] != label[b]) & ((n[b] > n[a]) | ((n[b] == n[a]) & (k[b] > k[a]))) & (n[a] >= n[b] * least - 1e-9))
            code, count = added(code, count, local[a[fits]] * len(ids) + local[b[fits]])
            if len(code) > 4 * PAIRS:  # as many different pairs: their counts are added up later
                yield from out(code, count)
                code, count = code[:0], count[:0]
        yield from out(code, count)

    counts = marked.repartition(parts, "anchor").mapInArrow(run, "a bigint, b bigint, c bigint, reach bigint")
    return counts.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("reach").alias("reach")).where("c >= reach").select("a", "b")


def _tiles(candidates: DataFrame, stars: DataFrame, labels: DataFrame, leads: DataFrame, members: int) -> DataFrame:
    """(doc, k, n, docs, chunk, component, tiles) for every class with a candidate; tiles: (low, high) chunks that meet with it.

    A component of more than `members` members is cut into chunks of half as many, and a tile is a pair of
    its chunks, or a chunk with itself, that some candidate pair or some label joins. So no task has to hold
    a component.
    """
    groups = components(candidates.unionByName(stars)).select(F.col("node").alias("k"), "component")
    order = Window.partitionBy("component").orderBy("label", "k")  # rows of one k end in one place
    size = F.sum("n").over(Window.partitionBy("component"))
    chunk = F.when(size <= members, 0).otherwise(F.floor((F.sum("n").over(order) - 1) / max(1, members // 2))).cast("int")
    labelled = leads.join(groups, "k").join(labels.hint("merge"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    chunks = written(labelled.select(F.col("lead").alias("doc"), "k", "n", "docs", "component", "label", chunk.alias("chunk"), (size > members).alias("cut")), "chunks")
    cut = chunks.where("cut").select("k", "component", "chunk").distinct()
    x, y = cut.select(F.col("k").alias("a"), "component", F.col("chunk").alias("x")), cut.select(F.col("k").alias("b"), F.col("chunk").alias("y"))
    of_label = chunks.where("cut").select("component", "label", "chunk").distinct()
    same = of_label.withColumnRenamed("chunk", "low").join(of_label.withColumnRenamed("chunk", "high"), ["component", "label"]).where("low <= high")
    met = candidates.join(x, "a").join(y, "b").select("component", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))
    met = met.unionByName(same.select("component", "low", "high")).distinct()
    tile = F.struct("low", "high").alias("tile")
    each = met.select("component", F.explode(F.array_distinct(F.array("low", "high"))).alias("chunk"), tile)
    of_chunk = each.groupBy("component", "chunk").agg(F.collect_list("tile").alias("tiles"))
    whole = chunks.where("not cut").withColumn("tiles", F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"))))
    return whole.drop("cut", "label").unionByName(chunks.where("cut").drop("cut", "label").join(of_chunk, ["component", "chunk"]))


def _linked(own: np.ndarray, k: np.ndarray, docs: np.ndarray, found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(doc, k, root, links) of every class of a tile: links counts the documents of its partners there, and root is the id of a class with which it hangs together."""
    links = np.zeros(len(own), np.int64)
    up, seen = list(range(len(own))), np.arange(len(own))  # seen: some class further up

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j, _ in found:
        links[i] += docs[j].sum()
        links[j] += docs[i]
        tops = {top(x) for x in (int(seen[i]), *np.unique(seen[j]).tolist())}
        low = min(tops)
        for x in tops:
            up[x] = low
        seen[i] = seen[j] = low
    root = own[[top(x) for x in seen.tolist()]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (own, k, root, links)], names=["doc", "k", "root", "links"])


def _similar(docs: DataFrame, gram: int, least: float, id_col: str, text_col: str, entries_a_task: int, members_a_task: int, linked: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc, k, k2, n) of documents, (k, k2, lead, n, docs) of classes, and what tiles find.

    That is pairs (a, b, na, nb, overlap) of classes, by their least ids; or, `linked`, the rows of _linked().
    """
    whole_ids(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").alias("text")).where("doc is not null and text is not null")
    sets = written(_sets(rows, gram), "sets")
    # Equal sets are one class.
    leads = written(sets.groupBy("k", "k2").agg(F.min("doc").alias("lead"), F.min("n").alias("n"), F.count_distinct("doc").alias("docs")), "classes")
    part = kept_part(least)
    entries = int((sets.agg(F.sum("n")).first()[0] or 0) * part)
    buckets = min(1 << 16, max(1, -(-entries // entries_a_task)))
    lists = written(_lists(_entries(rows.select("doc", "text"), gram, buckets, part), buckets), "lists")
    forget_shuffles(docs.sparkSession)
    stars = written(_stars(lists, least, part), "stars")
    labels = written(components(stars).select(F.col("node").alias("k"), F.col("component").alias("label")), "labels")
    forget_shuffles(docs.sparkSession)
    candidates = written(_candidates(lists, labels, least, part, entries_a_task // 2), "candidates")
    forget_shuffles(docs.sparkSession)
    tiled = written(_tiles(candidates, stars, labels, leads, members_a_task), "tiles")
    total = tiled.agg(F.sum(F.col("n") * F.size("tiles"))).first()[0] or 0
    parts = max(1, -(-total // members_a_task))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "k", "chunk", "component", "docs", "low", "high", "members"]
        for batch in batches:
            keys = batch.column(2).to_pylist()
            tiles = batch.column(6).to_pylist()
            at, low, high, members = [], [], [], []
            for row, s in member_sets(batch.column(1), gram):
                if set_key(s) != keys[row]:
                    continue  # another text of this id
                for x in tiles[row]:
                    at.append(row)
                    low.append(x["low"])
                    high.append(x["high"])
                    members.append(s.tobytes())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in (0, 2, 3, 4, 5)), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(members, pa.binary())], names=names)

    # The ids that are left grow with the documents: the join is a shuffle at every size, never a broadcast.
    wanted = tiled.select("doc", "k", "chunk", "component", "docs", "tiles").hint("merge")
    packed = rows.join(wanted, "doc").select("doc", "text", "k", "chunk", "component", "docs", "tiles").mapInArrow(
        pack, "doc bigint, k bigint, chunk int, component bigint, docs bigint, low int, high int, members binary"
    )
    names_ = ["a", "b", "na", "nb", "overlap"]

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        doc, k, chunk, docs_of = (table[c].to_numpy() for c in ("doc", "k", "chunk", "docs"))
        raw, at = string_bytes(table["members"])
        members, at = np.frombuffer(raw, np.uint64), at // 8
        found: list[list[np.ndarray]] = []
        rows = 0
        for group in np.split(np.arange(len(doc)), _borders(table)):
            by = group[np.lexsort((k[group], doc[group]))]
            once = np.ones(len(by), bool)  # rows that repeat a document
            once[1:] = (doc[by][1:] != doc[by][:-1]) | (k[by][1:] != k[by][:-1])
            group = by[once]
            own = doc[group]
            mine = [members[at[g] : at[g + 1]] for g in group]
            sizes = np.diff(at)[group]
            side = chunk[group] if chunk[group].min() != chunk[group].max() else None
            if linked:
                yield _linked(own, k[group], docs_of[group], search_sets(own, mine, least, side))
                continue
            for i, j, c in search_sets(own, mine, least, side):
                other = own[j] != own[i]
                j, c = j[other], c[other]
                found.append([np.full(len(j), own[i]), own[j], np.full(len(j), sizes[i], np.int32), sizes[j].astype(np.int32), c])
                rows += len(j)
                if rows >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names_)
                    found, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole tiles, some at a time
        size = 0
        for batch in batches:
            at = string_bytes(batch.column(7))[1]
            cuts = _borders(batch).tolist()
            if held and batch.num_rows and any(held[-1].column(i)[-1].as_py() != batch.column(i)[0].as_py() for i in (3, 5, 6)):
                cuts = [0, *cuts]
            a = 0
            for c in cuts:
                if size + at[c] - at[a] >= members_a_task * 2:
                    if c > a:
                        held.append(batch.slice(a, c - a))
                    if held:
                        yield from settle(held)
                    held, size, a = [], 0, c
            if batch.num_rows > a:
                held.append(batch.slice(a))
                size += int(at[-1] - at[a])
        if held:
            yield from settle(held)

    key = ("component", "low", "high")
    schema = "doc bigint, k bigint, root bigint, links bigint" if linked else "a bigint, b bigint, na int, nb int, overlap bigint"
    return sets, leads, packed.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, schema)


def _copies(sets: DataFrame, leads: DataFrame) -> DataFrame:
    """Pairs of the least document of a class with each other one."""
    return sets.select("doc", "k", "k2").join(leads, ["k", "k2"]).where("doc <> lead").select(
        F.col("lead").alias("a"), F.col("doc").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"), F.col("n").cast("bigint").alias("overlap")
    )


def jaccard_join(docs: DataFrame, *, gram: int = GRAM, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", entries_a_task: int = 1 << 19, members_a_task: int = 1 << 20) -> DataFrame:
    """(id_a, id_b, size_a, size_b, overlap, jaccard): documents of similar sets of word n-grams.

    A row for every pair of different sets with similarity `least` or more, each set represented by the
    least id that has it (a is the smaller set, then the lesser id), and a row of similarity 1 from the
    representative to every other document of its set. So groups of exact copies take as many rows as
    documents, and all pairs follow by putting copies in place of their representatives.

    No pair is missed, whatever the sizes of the sets, and similarities are exact (but that members are
    compared by hashes of BITS bits). There is no cap on partners; no task has to hold a group of similar
    documents, but one has to hold the inverted lists of its bucket, the longest of them at least.

    Texts without a word, null texts and null ids are in no pair. Texts of fewer than `gram` words have
    one member, all their words. Rows of one id count as one document with several sets: it makes no pair
    with itself, and a pair of ids has one row, that of its most similar sets. Ids must be whole numbers.
    An empty table gives no rows; other columns are unused.
    """
    sets, leads, pairs = _similar(docs, gram, least, id_col, text_col, entries_a_task, members_a_task, False)
    similarity = F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))
    every = pairs.unionByName(_copies(sets, leads)).withColumn("j", similarity).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    best = every.agg(F.max(F.struct("j", "overlap", "na", "nb", "a", "b")).alias("p")).select("p.*")
    return best.select(
        F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"), F.col("na").cast("bigint").alias("size_a"), F.col("nb").cast("bigint").alias("size_b"), "overlap",
        F.round("j", 6).alias("jaccard"),
    )


def near_classes(docs: DataFrame, *, gram: int = GRAM, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", entries_a_task: int = 1 << 19, members_a_task: int = 1 << 20) -> DataFrame:
    """(id, class_id, links): every document, its class, and with how many other documents it has similarity `least` or more.

    A class is what hangs together by such pairs, and has the name of its least id. Exact copies count as
    links, each of them. No link is missed, as in jaccard_join(); pairs are counted where they are found and
    never leave a task, so the result has as many rows as there are documents.

    Rows of one id and equal sets are one document. Rows of one id and different sets are documents of their
    own, with their own links (each other's among them), but of one class. An id without a text that has a
    word has one row, without links. Rows with a null id are left out. Ids must be whole numbers.
    """
    sets, leads, found, names = _classes(docs, gram, least, id_col, text_col, entries_a_task, members_a_task)
    links = leads.join(found.groupBy("k").agg(F.sum("links").alias("links")).hint("merge"), "k", "left")
    links = links.select("k", "k2", (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    worded = sets.select("doc", "k", "k2").distinct().join(links.hint("merge"), ["k", "k2"]).select("doc", "links")
    every = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc")).where("doc is not null").distinct()
    every = every.join(worded.hint("merge"), "doc", "left").join(names.hint("merge"), "doc", "left")
    return every.select(F.col("doc").alias(id_col), F.coalesce("component", "doc").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def _classes(docs: DataFrame, gram: int, least: float, id_col: str, text_col: str, entries_a_task: int = 1 << 19, members_a_task: int = 1 << 20) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents and classes of equal sets, the rows of _linked(), and (doc, component) of documents with a link."""
    sets, leads, found = _similar(docs, gram, least, id_col, text_col, entries_a_task, members_a_task, True)
    found = written(found, "links")
    edges = found.select(F.col("doc").alias("a"), F.col("root").alias("b")).where("a <> b").union(_copies(sets, leads).select("a", "b"))
    return sets, leads, found, components(edges).withColumnRenamed("node", "doc")


def _borders(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Where rows that are sorted by tile begin another one."""
    new = np.zeros(max(0, rows.num_rows - 1), bool)
    for name in ("component", "low", "high"):
        x = rows.column(name).to_numpy()
        new |= x[1:] != x[:-1]
    return np.flatnonzero(new) + 1


def keep_one_of_each_group(docs: DataFrame, *, gram: int = GRAM, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id is of a class of near_classes() with a lesser one.

    Of rows that repeat an id, and of those with a null id or no words, all stay.
    """
    names = _classes(docs, gram, least, id_col, text_col)[3]
    dropped = names.where("doc <> component").select(F.col("doc").alias("jaccard_dropped"))
    # As above, a shuffle at every size: the ids that go grow with the documents.
    return docs.join(dropped.hint("merge"), docs[f"`{id_col}`"] == dropped["jaccard_dropped"], "left_anti")
