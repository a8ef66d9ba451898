"""Operator 5: substring deduplication by super-k-mers.

Consecutive windows that share a minimiser travel as one packed string to the bucket of that minimiser;
there, sorting the windows counts each exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.kernel import gram_hashes
from graphloom.llm.superkmers import RUN, TASK_WORDS, WINDOW, hot_windows, in_groups, merged_spans, shared_strings


def count_windows(words: np.ndarray, first: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the strings, whether two documents have it, and how often it occurs.

    Windows are sorted by hash, and runs of one hash are compared word by word before they count as one.
    """
    windows = np.maximum(0, np.diff(first) - k + 1)
    text = np.repeat(np.arange(len(windows)), windows)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    h = gram_hashes(words, k)[at] if len(at) else np.empty(0, np.uint64)
    order = np.argsort(h)
    if len(at) > 1:
        equal = h[order][1:] == h[order][:-1]
        pairs = np.flatnonzero(equal)
        same = np.ones(len(pairs), bool)
        x, y = at[order[pairs]], at[order[pairs + 1]]
        for i in range(k):
            same &= words[x + i] == words[y + i]
        if not same.all():  # two contents with one hash: order these exactly
            bad = np.isin(h, h[order[pairs[~same]]])
            keys = [words[at + i] for i in range(k - 1, -1, -1)]
            order = np.lexsort([*keys, np.where(bad, h, 0), h])
            equal = h[order][1:] == h[order][:-1]
            for i in range(k):
                equal &= words[at[order[1:]] + i] == words[at[order[:-1]] + i]
    else:
        equal = np.empty(0, bool)
    new = np.concatenate([[True], ~equal])[: len(at)]
    run = np.cumsum(new) - 1
    who = doc[text][order]
    lead = np.flatnonzero(new)
    mixed = (np.maximum.reduceat(who, lead) != np.minimum.reduceat(who, lead)) if len(lead) else np.empty(0, bool)
    size = np.diff(np.append(lead, len(at)))
    repeated, number = np.empty(len(at), bool), np.empty(len(at), np.int64)
    repeated[order], number[order] = mixed[run], size[run]
    return repeated, number


def repeated_spans(docs: DataFrame, *, k: int = WINDOW, m: int = RUN, task_words: int = TASK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, most_copies): the parts of documents that windows of k words cover which another document has.

    Words are runs of other than white space, numbered from 0; end_word is past the last one. most_copies
    is the highest number of occurrences, in all documents, of a window in the span. Repetitions within
    one document alone don't make a span. Spans that touch or overlap are one.

    Ids must be whole numbers. Rows with a null id or text are passed over, texts of fewer than k words
    have no windows; rows of one id count as one document, with each row's windows counted (rows alike in
    id and text too). An empty table gives no rows; other columns are unused. Minimisers whose strings are
    more than a task's `task_words` are counted window by window instead, by 128 bits of hash.
    """
    strings = shared_strings(docs, k, m, id_col, text_col, task_words)
    found = in_groups(strings, k, lambda words, first, doc, shard: count_windows(words, first, doc, k), task_words)
    hot = hot_windows(strings, F.count("*"))
    return merged_spans(found if hot is None else found.unionByName(hot), k, id_col, "most_copies")
