"""Super-k-mers of words, the common ground of operators 3 and 5.

A window is k words in a row. Its minimiser is the least hash of the runs of m words in it. Windows of
one content have one minimiser, and consecutive windows mostly share theirs: such a stretch, a super-
k-mer, is one packed string. A window that occurs in two documents has a minimiser that occurs in two,
so only super-k-mers with such minimisers travel; all others are settled by counting minimisers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.kernel import Words, gram_hashes, mix, string_bytes, word_slices
from graphloom.llm.shared import whole_ids, written

#: Words of a window, and of the runs whose least hash is its minimiser.
WINDOW, RUN = 50, 8
#: Words that a task of the second phase takes at once.
TASK_WORDS = 1 << 21
_SALT = np.uint64(0x9FB21C651E98DF25)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row; n - width + 1 of them."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def minimiser_runs(w: Words, k: int = WINDOW, m: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimiser) of each stretch of windows that share a minimiser."""
    counts = np.maximum(0, w.counts - k + 1)
    total = int(counts.sum())
    if not total:
        return (*(np.empty(0, np.int64),) * 3, np.empty(0, np.uint64))
    least = sliding_min(gram_hashes(w.hashes, m), k - m + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    value = least[w.first[text] + within]
    new = np.ones(total, bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], within[at], np.diff(np.append(at, total)), value[at]


def _minimisers(rows: DataFrame, k: int, m: int) -> DataFrame:
    """(mini, doc, row, start, windows) from (doc, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, w in word_slices(batch.column(2)):
                text, start, n, mini = minimiser_runs(w, k, m)
                if len(text):
                    at = pa.array(base + text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mini.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                        names=["mini", "doc", "row", "start", "windows"],
                    )

    return rows.mapInArrow(run, "mini bigint, doc bigint, row bigint, start int, windows int")


@dataclass(frozen=True)
class Strings:
    """Super-k-mers whose minimiser two documents have.

    packed: (mini, doc, start, shard, words), words being the bytes of the words from `start` on, with
    single blanks between, and shard the partition of documents that they come from; size: words in them.
    windows: for minimisers of too many words for a task, (h1, h2, doc, start), a row a window, named by
    two hashes of its words; None if there is no such minimiser.
    """

    packed: DataFrame
    size: int
    windows: DataFrame | None


def shared_strings(docs: DataFrame, k: int, m: int, id_col: str, text_col: str, task_words: int) -> Strings:
    """Two passes over the texts; between them travel minimisers only.

    Rows are told apart by id and text: each row's windows are its own, also where ids repeat. A minimiser
    with more than `task_words` words of strings is hot, and its windows travel one by one.
    """
    whole_ids(docs, id_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").alias("text")).where("doc is not null and text is not null")
    rows = rows.select("doc", F.xxhash64(F.length("text"), "text").alias("row"), "text")
    runs = written(_minimisers(rows, k, m), "minimisers")
    words = F.sum(F.col("windows") + (k - 1))
    shared = runs.groupBy("mini").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), (words > task_words).alias("hot")).where("a <> b").select("mini", "hot")
    wanted = written(runs.join(shared, "mini").groupBy("doc", "row").agg(F.collect_set(F.struct("start", "windows", "mini", "hot")).alias("runs")), "wanted")
    part = lambda hot: F.sum(F.expr(f"aggregate(filter(runs, r -> {hot}r.hot), 0L, (s, r) -> s + r.windows + {k - 1})"))
    size, hot = wanted.agg(part("not "), part("")).first()

    def runs_of(batch: pa.RecordBatch, hot: bool) -> Iterator[tuple[Words, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, first text, text, start, windows, minimiser) of the runs that are hot, or not."""
        runs = batch.column(2)
        border = np.asarray(runs.offsets)
        start, n, mini = (np.asarray(runs.values.field(i)) for i in range(3))
        kind = np.asarray(runs.values.field(3).cast(pa.uint8())) == hot
        for base, w in word_slices(batch.column(1)):
            low, high = border[base], border[base + len(w.counts)]
            text = np.repeat(np.arange(len(w.counts)), np.diff(border[base : base + len(w.counts) + 1]))
            mine = np.flatnonzero(kind[low:high])
            yield w, base, text[mine], start[low:high][mine], n[low:high][mine], mini[low:high][mine]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for batch in batches:
            for w, base, text, start, n, mini in runs_of(batch, False):
                at = w.first[text] + start
                a, b = w.starts[at], w.ends[at + n + (k - 2)]
                raw = w.buf.tobytes()
                strings = [b" ".join(raw[x:y].split()) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini), batch.column(0).take(pa.array(base + text)), pa.array(start, pa.int32()), pa.array(np.full(len(text), shard, np.int32)), pa.array(strings, pa.binary())],
                    names=["mini", "doc", "start", "shard", "words"],
                )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, base, text, start, n, _ in runs_of(batch, True):
                if not len(text):
                    continue
                each = np.repeat(text, n)
                begin = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(each))
                at = w.first[each] + begin
                h1, h2 = (gram_hashes(x, k)[at].view(np.int64) for x in (w.hashes, mix(w.hashes ^ _SALT)))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(0).take(pa.array(base + each)), pa.array(begin, pa.int64())], names=["h1", "h2", "doc", "start"])

    joined = rows.join(wanted, ["doc", "row"]).select("doc", "text", "runs")
    packed = joined.mapInArrow(cut, "mini bigint, doc bigint, start int, shard int, words binary")
    windows = joined.where("exists(runs, r -> r.hot)").mapInArrow(spread, "h1 bigint, h2 bigint, doc bigint, start bigint") if hot else None
    return Strings(packed, size or 0, windows)


def hot_windows(strings: Strings, number: Column) -> DataFrame | None:
    """Rows (doc, start, windows, number) for the windows of hot minimisers that two documents have; number aggregates them."""
    if strings.windows is None:
        return None
    rows = written(strings.windows, "hot")
    shared = rows.groupBy("h1", "h2").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), number.alias("number")).where("a <> b")
    return rows.join(shared, ["h1", "h2"]).select("doc", "start", F.lit(1).cast("bigint").alias("windows"), "number")


def in_groups(strings: Strings, k: int, settle: Callable[..., tuple[np.ndarray, np.ndarray]], task_words: int = TASK_WORDS) -> DataFrame:
    """Bring the strings of a minimiser together and apply settle; rows (doc, start, windows, number).

    settle(words, first, doc, shard) gets strings of whole minimisers as word hashes, and gives, for each
    window in the order of the strings, whether it repeats across documents, and a number. The rows are
    stretches of repeated windows with one number.
    """
    parts = max(1, -(-strings.size // task_words))
    grouped = strings.packed.repartition(parts, "mini").sortWithinPartitions("mini")

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        if not table.num_rows:
            return
        column = lambda n: table[n].to_numpy()
        words, counts = [], []
        for _, w in word_slices(table["words"].combine_chunks()):
            words.append(w.hashes)
            counts.append(w.counts)
        first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        repeated, number = settle(np.concatenate(words), first, column("doc"), column("shard"))
        windows = np.maximum(0, np.diff(first) - k + 1)
        text = np.repeat(np.arange(len(windows)), windows)
        within = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (repeated[1:] != repeated[:-1]) | (number[1:] != number[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(text)))
        keep = repeated[at]
        at, n = at[keep], n[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(column("doc")[text[at]]), pa.array(column("start")[text[at]].astype(np.int64) + within[at]), pa.array(n, pa.int64()), pa.array(number[at], pa.int64())],
            names=["doc", "start", "windows", "number"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            mini = batch.column(0).to_numpy()
            cuts = np.flatnonzero(mini[1:] != mini[:-1]) + 1
            bytes_at = string_bytes(batch.column(4))[1]
            a = 0
            if held and batch.num_rows and held[-1].column(0)[-1].as_py() != mini[0] and size >= 6 * task_words // 4:
                yield from flush(held)
                held, size = [], 0
            for c in cuts.tolist():
                if size + bytes_at[c] - bytes_at[a] >= 6 * task_words // 4:
                    yield from flush([*held, batch.slice(a, c - a)])
                    held, size, a = [], 0, c
            if batch.num_rows > a:
                held.append(batch.slice(a))
                size += int(bytes_at[-1] - bytes_at[a])
        if held:
            yield from flush(held)

    return grouped.mapInArrow(run, "doc bigint, start bigint, windows bigint, number bigint")


def merged_spans(stretches: DataFrame, k: int, id_col: str, number: str) -> DataFrame:
    """(id, start_word, end_word, greatest number): stretches of windows of a document, joined where they touch or overlap."""
    span = stretches.select("doc", "start", (F.col("start") + F.col("windows") + (k - 1)).alias("end"), "number")
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = span.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    island = opened.withColumn("island", F.sum("new").over(order))
    return island.groupBy("doc", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.max("number").alias(number)).select(F.col("doc").alias(id_col), "start_word", "end_word", number)

