"""Operator 3: suffix-array deduplication by merging shard Burrows-Wheeler transforms.

Every shard of documents sorts its own suffixes and keeps their transform: for each suffix, in order, the
letter before it. A letter is a run of STRIDE words. The merge never sorts suffixes again: it holds an
interleave, the shard of each suffix in merged order, and refines it. Reading the interleave in order,
each suffix sends its shard to the bucket of the letter before it; after h rounds the interleave is
right for the first h letters, and where neighbours part in round h their common prefix has h - 1
letters. Blocks that are whole after WINDOW / STRIDE rounds are repeated intervals.

Strings come together by minimiser, as in operator 5, so a merge takes place in a bounded task and the
transforms of a shard are of its strings in that task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.kernel import gram_hashes
from graphloom.llm.superkmers import RUN, TASK_WORDS, WINDOW, hot_windows, in_groups, merged_spans, shared_strings

#: Words in a letter; WINDOW is a multiple.
STRIDE = 10


def letters_of(words: np.ndarray, first: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(letters, where each string begins in them): one position for each word and one for each string's end.

    Letters are ranks from 1 of the runs of `stride` words; 0 where fewer words remain.
    """
    strings = len(first) - 1
    begin = first + np.arange(strings + 1)
    letters = np.zeros(len(words) + strings, np.int64)
    counts = np.diff(first)
    windows = np.maximum(0, counts - stride + 1)
    text = np.repeat(np.arange(strings), windows)
    within = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    if len(text):
        _, rank = np.unique(gram_hashes(words, stride)[first[text] + within], return_inverse=True)
        letters[begin[text] + within] = rank + 1
    return letters, begin


def _stable(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of small whole numbers, by sorting (key, place) as one number."""
    n = len(keys)
    if n < 2:
        return np.zeros(n, np.int64)
    bits = int(n - 1).bit_length()
    packed = (keys.astype(np.uint64) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


def shard_order(letters: np.ndarray, begin: np.ndarray, stride: int) -> np.ndarray:
    """Suffix array of one shard: positions by all letters that follow, equal suffixes by string.

    Prefix doubling over letters; only positions whose order is open are sorted again.
    """
    n = len(letters)
    order = _stable(letters)
    by = letters[order]
    new = np.ones(n, bool)
    new[1:] = by[1:] != by[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    end = np.repeat(begin[1:], np.diff(begin))
    tied = ~new
    tied[:-1] |= ~new[1:]
    at = np.flatnonzero(tied & (by > 0))
    step = stride
    while len(at):
        who = order[at]
        ahead = who + step
        second = np.where(ahead < end[who], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by2 = np.lexsort((who, second, rank[who]))
        who, second = who[by2], second[by2]
        group = rank[who]
        order[at] = who
        fresh = np.ones(len(at), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[who] = np.maximum.accumulate(np.where(fresh, at, 0))
        open_ = ~fresh
        open_[:-1] |= ~fresh[1:]
        at = at[open_ & (second > 0)]
        step *= 2
    return order


def transform(letters: np.ndarray, begin: np.ndarray, order: np.ndarray, stride: int) -> np.ndarray:
    """The letter before each suffix in order; 0 where the string has none there."""
    start = np.repeat(begin[:-1], np.diff(begin))[order]
    before = order - stride
    return np.where(before >= start, letters[np.maximum(before, 0)], 0)


def merge(transforms: list[np.ndarray], ended: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, place in the shard, common prefix with the one before) of all suffixes in merged order.

    transforms: each shard's letters before its suffixes. ended: how many suffixes of each have no whole
    letter; they come first. Common prefixes are in letters, exact below `rounds`; -1 for the first.
    Only transforms are read, never the suffixes' own words.
    """
    shards = len(transforms)
    sizes = np.array([len(t) for t in transforms])
    total = int(sizes.sum())
    base = np.cumsum(sizes) - sizes
    joined = np.concatenate(transforms) if transforms else np.empty(0, np.int64)
    shard = np.repeat(np.arange(shards), sizes)
    head = np.repeat(np.arange(shards), ended)
    prefix = np.full(total, rounds)
    prefix[:1] = -1
    block = np.zeros(total, np.int64)
    place = _places(shard, base)
    for h in range(rounds):
        before = joined[base[shard] + place]
        moved = np.flatnonzero(before > 0)
        by = moved[_stable(before[moved])]
        letter, old = before[by], block[by]
        new = np.zeros(total, bool)
        new[:1] = True
        k = len(head)
        if k < total:
            new[k] = True
            new[k + 1 :] = (letter[1:] != letter[:-1]) | (old[1:] != old[:-1])
        shard = np.concatenate([head, shard[by]])
        place = _places(shard, base)
        fresh = new & (prefix == rounds)
        prefix[fresh] = h
        block = np.cumsum(new) - 1
    return shard, place, prefix


def _places(shard: np.ndarray, base: np.ndarray) -> np.ndarray:
    """How many earlier entries have the same shard."""
    by = _stable(shard)
    out = np.empty(len(shard), np.int64)
    out[by] = np.arange(len(shard)) - base[shard[by]]
    return out


def repeated_windows(words: np.ndarray, first: np.ndarray, doc: np.ndarray, shard: np.ndarray, k: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the strings, whether two documents have it, and how many do."""
    by = np.argsort(shard, kind="stable")
    counts = np.diff(first)
    letters, begin = letters_of(words, first, stride)
    length = np.diff(begin)
    transforms, orders, ended = [], [], []
    _, lead = np.unique(shard[by], return_index=True)
    for mine in np.split(by, lead[1:]):
        size = length[mine]
        local = np.concatenate([[0], np.cumsum(size)])
        globe = np.repeat(begin[mine] - local[:-1], size) + np.arange(local[-1])
        own = letters[globe]
        order = shard_order(own, local, stride)
        transforms.append(transform(own, local, order, stride))
        orders.append(globe[order])
        ended.append(int(np.count_nonzero(own == 0)))
    which, place, prefix = merge(transforms, ended, k // stride)
    base = np.cumsum([0, *map(len, orders)])[:-1]
    at = np.concatenate(orders)[base[which] + place]
    text = np.searchsorted(begin, at, "right") - 1
    block = np.cumsum(prefix < k // stride) - 1
    whole = at - begin[text] + k <= counts[text]  # a window begins here
    at, text, block = at[whole], text[whole], block[whole]
    who = doc[text]
    pairs = np.lexsort((who, block))
    b, d = block[pairs], who[pairs]
    other = np.ones(len(pairs), bool)
    other[1:] = (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    docs = np.bincount(b[other], minlength=int(block.max(initial=-1)) + 1)
    windows = np.maximum(0, counts - k + 1)
    slot = (np.cumsum(windows) - windows)[text] + at - begin[text]
    number = np.zeros(int(windows.sum()), np.int64)
    number[slot] = docs[block]
    return number > 1, number


def repeated_intervals(docs: DataFrame, *, k: int = WINDOW, m: int = RUN, stride: int = STRIDE, task_words: int = TASK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, most_docs): parts of documents in repeated intervals of at least k words' common prefix.

    Words are runs of other than white space, numbered from 0; end_word is past the last one. most_docs
    is the most documents that share one interval of k words in the span. An interval counts if two
    documents are in it. Spans that touch or overlap are one.

    Ids must be whole numbers. Rows with a null id or text are passed over, texts of fewer than k words
    have no intervals; rows of one id count as one document. An empty table gives no rows; other columns
    are unused. A minimiser's strings must fit a task's memory.
    """
    if k % stride:
        raise ValueError("k must be a multiple of stride")
    strings = shared_strings(docs, k, m, id_col, text_col, task_words)
    found = in_groups(strings, k, lambda words, first, doc, shard: repeated_windows(words, first, doc, shard, k, stride), task_words)
    hot = hot_windows(strings, F.count_distinct("doc"))
    return merged_spans(found if hot is None else found.unionByName(hot), k, id_col, "most_docs")
