"""Operator 8: benchmark decontamination by suffix arrays of the training texts.

Training documents are cut into shards, whole documents each. A shard's suffix array orders the positions
of its folded words by the words that follow, by prefix doubling on packed word codes. Every suffix of
every test item is looked up in every shard by binary search over whole suffixes. The suffixes that agree
on the least length form ranges, which name the affected documents; within the array of an affected
document, the two neighbours of a test suffix's place hold its longest match there. Common prefixes are
compared by running hashes, so that a long one costs a logarithm, and matches are checked word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.kernel import prefix_hash, run_hash, slices, string_bytes, words_of
from graphloom.llm.shared import apart, map_rows

#: Words of a shard, at least one document; about 150 bytes of memory each.
SHARD_WORDS = 1 << 19
#: Words that must agree for a document to count as affected; an item of fewer words, but WHOLE or more, must stand in it as a whole.
LEAST, WHOLE = 8, 6
#: Bytes of test text that a pass takes along; a larger benchmark takes several passes.
TEST_BYTES = 32 << 20
#: Words in a key of the suffix array, if their codes have room in it.
_PACK = 4


def _with_ends(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words with a 0 after each text, where each text begins in them)."""
    texts = len(first) - 1
    out = np.zeros(len(hashes) + texts + _PACK, np.uint64)
    begin = first + np.arange(texts + 1)
    out[np.arange(len(hashes)) + np.repeat(np.arange(texts), np.diff(first))] = hashes | np.uint64(1)
    return out, begin


def packed_keys(codes: np.ndarray, n: int, bits: int, pack: int) -> np.ndarray:
    """For each of n positions, the `pack` codes from there on in one number, so that keys compare as the codes do."""
    key = np.zeros(n, np.uint64)
    alive = np.ones(n, bool)
    for k in range(pack):
        c = codes[k : k + n]
        alive &= c > 0  # nothing counts beyond the end of a text
        key = (key << np.uint64(bits)) | np.where(alive, c, np.uint64(0))
    return key


def suffix_array(keys: np.ndarray, depth: int, bits: int, pack: int) -> np.ndarray:
    """Positions ordered by the words that follow, to at least `depth` words; equal ones in any order.

    keys: packed_keys. Doubling sorts only positions whose order is still open.
    """
    n = len(keys)
    order = np.argsort(keys)
    by = keys[order]
    new = np.ones(n, bool)
    new[1:] = by[1:] != by[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # Suffixes that end within the key have one order already: their texts are over.
    h = pack
    tied = np.zeros(n, bool)
    tied[:-1] |= ~new[1:]
    tied |= ~new
    at = np.flatnonzero(tied & ((by & np.uint64((1 << bits) - 1)) != 0))
    while len(at) and h < depth:
        who = order[at]
        ahead = np.minimum(who + h, n - 1)
        second = np.where(who + h < n, rank[ahead] + 1, 0)
        group = rank[who]
        by2 = np.lexsort((who, second, group))
        order[at] = who[by2]
        g, s = group[by2], second[by2]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        value = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[order[at]] = value
        open_ = ~fresh
        open_[:-1] |= ~fresh[1:]
        over = s == 0  # nothing follows
        at = at[open_ & ~over]
        h *= 2
    return order


@dataclass(frozen=True)
class Words:
    """Words with ends, their running hash, and how many words of its text follow each position, itself included."""

    words: np.ndarray
    sums: np.ndarray
    left: np.ndarray

    @staticmethod
    def of(words: np.ndarray) -> Words:
        n = len(words)
        end = np.flatnonzero(words == 0)
        return Words(words, prefix_hash(words), end[np.searchsorted(end, np.arange(n))] - np.arange(n))


def common(a: Words, b: Words, at: np.ndarray, probe: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """How many words agree from a's positions `at` and b's `probe` on, up to `most`."""
    high = np.minimum(a.left[at], b.left[probe])
    if most is not None:
        high = np.minimum(high, most)
    low = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_] + 1) // 2
        x, y = at[open_], probe[open_]
        same = (a.words[x] == b.words[y]) & (run_hash(a.sums, x, x + mid) == run_hash(b.sums, y, y + mid))
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)
        open_ = open_[low[open_] < high[open_]]
    return low


@dataclass(frozen=True)
class Tests:
    """All test suffixes that can match: the words of all items, and for each suffix item, start, place and words needed."""

    text: Words
    probe: np.ndarray
    item: np.ndarray
    start: np.ndarray
    need: np.ndarray
    depth: int


def prepare_tests(texts: list[str], least: int, whole: int = WHOLE) -> Tests:
    """Suffixes of at least `least` words, and whole items of fewer but `whole` or more."""
    buf, offsets = string_bytes(pa.array(texts, pa.large_string()))
    w = words_of(buf, offsets, folded=True)
    words, begin = _with_ends(w.hashes, w.first)
    counts = w.counts
    many = np.where(counts >= least, counts - least + 1, (counts >= whole).astype(np.int64))
    item = np.repeat(np.arange(len(counts)), many)
    start = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    return Tests(Words.of(words), begin[item] + start, item, start, np.minimum(counts[item], least), int(counts.max(initial=0)))


class Shard:
    """The suffix array of some training texts, with codes under which test words compare too."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, depth: int) -> None:
        words, self.begin = _with_ends(hashes, first)
        n = len(hashes) + len(first) - 1
        self.known, rank = np.unique(words, return_inverse=True)  # 0, the end, is the least
        self.text = Words.of(words)
        self.codes = 2 * rank.astype(np.uint64)
        self.bits = int(2 * len(self.known)).bit_length()
        self.pack = max(1, min(_PACK, 64 // self.bits))
        keys = packed_keys(self.codes, n, self.bits, self.pack)
        self.order = suffix_array(keys, depth, self.bits, self.pack)
        self.keys = keys[self.order]

    def codes_of(self, words: np.ndarray) -> np.ndarray:
        """Codes of test words: odd ones, in their place of the order, for words that the shard lacks."""
        at = np.searchsorted(self.known, words)
        there = self.known[np.minimum(at, len(self.known) - 1)] == words
        return np.where(there, 2 * at, 2 * at - 1).astype(np.uint64)


def _place(shard: Shard, order: np.ndarray, low: np.ndarray, high: np.ndarray, tests: Words, codes: np.ndarray, probe: np.ndarray, most: np.ndarray | None = None, after: bool = False) -> np.ndarray:
    """Binary search, for each probe, of its suffix in order[low:high], by whole suffixes or their first `most` words.

    The place before all that aren't less, or, with `after`, past all that aren't greater.
    """
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) // 2
        at, b = order[mid], probe[open_]
        limit = None if most is None else most[open_]
        n = common(shard.text, tests, at, b, limit)
        x, y = shard.codes[at + n], codes[b + n]
        up = (x <= y) if after else (x < y)
        if limit is not None:
            up = np.where(n == limit, after, up)
        low[open_] = np.where(up, mid + 1, low[open_])
        high[open_] = np.where(up, high[open_], mid)
        open_ = open_[low[open_] < high[open_]]
    return low


def _ranges(shard: Shard, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes that have a match of the words they need, low, high, codes of the test words)."""
    codes = shard.codes_of(tests.text.words)
    keys = packed_keys(codes, len(codes) - _PACK, shard.bits, shard.pack)[tests.probe]
    short = int(tests.need.min(initial=shard.pack))
    cut = np.uint64(shard.bits * (shard.pack - min(shard.pack, short)))
    low, high = np.searchsorted(shard.keys >> cut, keys >> cut, "left"), np.searchsorted(shard.keys >> cut, keys >> cut, "right")
    some = np.flatnonzero(high > low)
    low, high = (
        _place(shard, shard.order, low[some], high[some], tests.text, codes, tests.probe[some], tests.need[some], after) for after in (False, True)
    )
    full = high > low
    return some[full], low[full], high[full], codes


def affected(hashes: np.ndarray, first: np.ndarray, tests: Tests) -> np.ndarray:
    """Numbers of the texts that hold the words that some test suffix needs."""
    if not len(hashes) or not len(tests.probe):
        return np.empty(0, np.int64)
    shard = Shard(hashes, first, int(tests.need.max()))
    _, low, high, _ = _ranges(shard, tests)
    edge = np.bincount(low, minlength=len(shard.order) + 1) - np.bincount(high, minlength=len(shard.order) + 1)
    at = shard.order[np.cumsum(edge)[:-1] > 0]
    return np.unique(np.searchsorted(shard.begin, at, "right") - 1)


def search(hashes: np.ndarray, first: np.ndarray, tests: Tests) -> list[tuple[int, int, int, int, int]]:
    """(text, item, words, item_start, text_start) of the longest match of each pair that has one of the words needed.

    Among equally long ones the earliest in the item, then in the text.
    """
    if not len(hashes) or not len(tests.probe):
        return []
    shard = Shard(hashes, first, max(tests.depth, int(tests.need.max())))
    some, low, high, codes = _ranges(shard, tests)
    if not len(some):
        return []
    # Ranges of equal prefixes are equal or apart for one length, so that each is listed once: texts of a range, then suffixes of it.
    ranges, which = np.unique(np.column_stack([low, high]), axis=0, return_inverse=True)
    which = which.ravel()
    size = ranges[:, 1] - ranges[:, 0]
    at = np.repeat(ranges[:, 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    texts = len(first) - 1
    pairs = np.unique(np.repeat(np.arange(len(ranges)), size) * texts + np.searchsorted(shard.begin, shard.order[at], "right") - 1)
    r, t = pairs // texts, pairs % texts
    lead, count = np.searchsorted(r, np.arange(len(ranges))), np.bincount(r, minlength=len(ranges))
    mine = count[which]
    suffix = np.repeat(some, mine)
    text = t[np.repeat(lead[which] - (np.cumsum(mine) - mine), mine) + np.arange(len(suffix))]
    # The affected texts' own arrays, one after the other.
    hit = np.unique(text)
    owner = np.searchsorted(shard.begin, shard.order, "right") - 1
    inside = np.flatnonzero(np.isin(owner, hit))
    inside = inside[np.argsort(owner[inside], kind="stable")]
    order, owner = shard.order[inside], owner[inside]
    a, b = np.searchsorted(owner, text, "left"), np.searchsorted(owner, text, "right")
    probe = tests.probe[suffix]
    place = _place(shard, order, a, b, tests.text, codes, probe)
    longest = np.zeros(len(suffix), np.int64)
    for near, there in ((place - 1, place > a), (place, place < b)):
        k = np.flatnonzero(there)
        longest[k] = np.maximum(longest[k], common(shard.text, tests.text, order[near[k]], probe[k]))
    item, start = tests.item[suffix], tests.start[suffix]
    rank = np.lexsort((start, -longest, item, text))
    first_ = np.ones(len(rank), bool)
    first_[1:] = (text[rank][1:] != text[rank][:-1]) | (item[rank][1:] != item[rank][:-1])
    best = rank[first_]
    # Where the longest match stands first in its text: the least position of the range that shares it.
    p, n = probe[best], longest[best]
    low, high = (_place(shard, order, a[best], b[best], tests.text, codes, p, n, after) for after in (False, True))
    out = []
    for k, x, y, words in zip(best.tolist(), low.tolist(), high.tolist(), n.tolist(), strict=True):
        where = int(order[x:y].min())
        if not np.array_equal(shard.text.words[where : where + words], tests.text.words[probe[k] : probe[k] + words]):
            raise AssertionError("words differ that have one hash")
        out.append((int(text[k]), int(item[k]), words, int(start[k]), where - int(shard.begin[text[k]])))
    return out


def _test_sets(benchmark: DataFrame, least: int, item_col: str, text_col: str) -> Iterator[tuple[list, Tests]]:
    """The benchmark in sets of bounded size, ready for executors; it streams through the driver."""
    rows = benchmark.select(F.col(f"`{item_col}`"), F.col(f"`{text_col}`").alias("t")).where("t is not null").toLocalIterator(prefetchPartitions=False)
    items, texts, held = [], [], 0
    for item, text in rows:
        items.append(item)
        texts.append(text)
        held += len(text)
        if held >= TEST_BYTES:
            yield items, prepare_tests(texts, least)
            items, texts, held = [], [], 0
    if items:
        yield items, prepare_tests(texts, least)


def _shards(batches: Iterator[pa.RecordBatch], column: int, shard_words: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, word hashes, first word of each row) of successive shards; a batch is cut, never a row."""
    for batch in batches:
        buf, offsets = string_bytes(batch.column(column))
        for a, b in slices(offsets, 6 * shard_words):
            at = offsets[a : b + 1] - offsets[a]
            w = words_of(buf[offsets[a] : offsets[b]], at, folded=True)
            yield batch.slice(a, b - a), w.hashes, w.first


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (id, item, match_words, item_start, doc_start): the longest verbatim run of a test item in a document.

    A run counts from `least` folded words (letter case, punctuation and white space aside); starts are
    word numbers from 0. Of equally long runs, the earliest in the item and then in the document is
    given. Items of fewer words count if they stand in the document as a whole and have WHOLE words or
    more; shorter ones never match. The benchmark goes to executors in sets of at most TEST_BYTES, a pass
    over docs each, so its size is bounded by the number of passes alone.

    Null or empty texts, on either side, match nothing; null ids are carried along; repeated rows are
    reported as often as they occur; an empty benchmark gives no rows; other columns are unused. Result
    columns whose name is taken by an earlier one, such as the item's where both have one name, end in _.
    """
    names = apart([id_col, item_col, "match_words", "item_start", "doc_start"], [])
    item_kind = benchmark.schema[item_col].dataType
    kinds = [docs.schema[id_col].dataType, item_kind, *[T.LongType()] * 3]
    schema = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)])
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    out = None
    for items, tests in _test_sets(benchmark, least, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast((pa.array(items), tests))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, tests = sent.value
            for batch, hashes, first in _shards(batches, 1, shard_words):
                if found := search(hashes, first, tests):
                    text, item, *rest = (np.array(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), keys.take(pa.array(item)), *(pa.array(x, pa.int64()) for x in rest)], names=schema.names)

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return (docs.sparkSession.createDataFrame([], schema) if out is None else out).toDF(*names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST, shard_words: int = SHARD_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, in their columns, for which find_leaks() has no row.

    Rows are dropped where they are read: nothing is shuffled or joined.
    """
    at = docs.columns.index(text_col)
    for _, tests in _test_sets(benchmark, least, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, hashes, first in _shards(batches, at, shard_words):
                hit = np.zeros(batch.num_rows, bool)
                hit[affected(hashes, first, sent.value)] = True
                yield batch.filter(pa.array(~hit)) if hit.any() else batch

        docs = map_rows(docs, run)
    return docs
