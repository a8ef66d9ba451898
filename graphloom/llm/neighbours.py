"""Operator 6: nearest neighbours by a block matrix join with int8 tiles.

Vectors are packed into blocks, which are quantised once. A tile is a pair of blocks and serves the queries
of both: the product of their int8 codes bounds every inner product from both sides, the bounds rule out
most pairs, and what survives is computed again in float. The tiles' results are merged by heaps. With
every tile joined, the result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.shared import whole_ids, written

#: Most bytes of codes and components of a block.
BLOCK_BYTES = 32 << 20
#: Rows of a tile's product that stand in memory at once, and the columns of which a query's bar takes one value.
STRIPE, PART = 256, 32
#: Parts in which the finds of a block of queries are merged.
PARTS = 16
#: Components whose products of int8 codes sum exactly in float32: 1040 * 127**2 < 2**24.
EXACT = 1040
_FIELDS = ("ids", "data", "norm", "codes", "scale", "error")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale of each row, norm of each row's rounding error)."""
    top = np.abs(x).max(axis=1, initial=0)
    scale = np.where(top > 0, top, 1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


class Block:
    """Ids, components, norms, and the codes of the rows at length one, with their scales and errors."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, norm: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray) -> None:
        self.ids, self.data, self.norm, self.codes, self.scale, self.error = ids, data, norm, codes, scale, error

    @staticmethod
    def of(ids: np.ndarray, data: np.ndarray) -> Block:
        size = np.linalg.norm(data.astype(np.float64), axis=1)
        norm = np.where(size > 0, size, 1)
        return Block(ids, data, norm, *quantise(data / norm[:, None]))

    @staticmethod
    def unpacked(row: dict[str, pa.Scalar], dimension: int, kind: np.dtype) -> Block:
        kinds = (np.int64, kind, np.float64, np.int8, np.float64, np.float64)
        parts = [np.frombuffer(row[n].as_buffer(), k) for n, k in zip(_FIELDS, kinds, strict=True)]
        return Block(parts[0], parts[1].reshape(-1, dimension), parts[2], parts[3].reshape(-1, dimension), *parts[4:])

    def packed(self) -> dict[str, list[bytes]]:
        return {n: [np.ascontiguousarray(getattr(self, n)).tobytes()] for n in _FIELDS}

    @cached_property
    def unit(self) -> np.ndarray:
        """The rows at length one."""
        return self.data / self.norm[:, None]


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of int8 codes. They are whole numbers and exact: float32 holds sums over EXACT components."""
    out = a[:, :EXACT].astype(np.float32) @ b[:, :EXACT].astype(np.float32).T
    for c in range(EXACT, a.shape[1], EXACT):
        out = out.astype(np.float64) + a[:, c : c + EXACT].astype(np.float32) @ b[:, c : c + EXACT].astype(np.float32).T
    return out


def survivors(product: np.ndarray, q_scale: np.ndarray, x_scale: np.ndarray, q_error: np.ndarray, x_error: float, k: int, seen: np.ndarray | None = None, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, seen) of the pairs that may be among a row's k greatest inner products.

    product: of codes, -inf for pairs that don't count. q.x - q'.x' = (q - q').x + q'.(x - x'), and |x| <= 1,
    |q'| <= 1 + |q - q'|, so an inner product lies within `slack` of that of the codes; a row's bar is the
    k-th greatest lower bound, or something below it: the k-th greatest of the bests of parts of the row.
    seen: greatest products of each row so far, in units of its scale, where its pairs come piece by piece.
    """
    mid = product * x_scale.astype(product.dtype)
    slack = (q_error + (1 + q_error) * x_error) / q_scale + 1e-6 / q_scale  # in units of the row's scale; float32 rounds a product to some 1e-7
    best = np.maximum.reduceat(mid, np.arange(0, mid.shape[1], part), axis=1) if mid.shape[1] >= 2 * part else mid
    if seen is not None:
        best = np.concatenate([seen, best], axis=1)
    if best.shape[1] <= k:
        bar, seen = np.full(len(mid), -np.inf), best
    else:
        seen = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k :]
        bar = seen[:, 0] - 2 * slack
    i, j = np.nonzero((mid >= bar[:, None]) & (mid > -np.inf))
    return i, j, seen


def _ranked(q: Block, x: Block, i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, cosine) of each row's k greatest cosines among pairs; ties go to the smaller id of x."""
    exact = np.empty(len(i))
    for s in range(0, len(i), 1 << 15):
        p = slice(s, s + (1 << 15))
        exact[p] = np.round(np.einsum("ij,ij->i", q.unit[i[p]], x.unit[j[p]]), 12)
    by = np.lexsort((x.ids[j], -exact, i))
    i, j, exact = i[by], j[by], exact[by]
    keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[keep], j[keep], exact[keep]


def tile(a: Block, b: Block, k: int, own: bool = False) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nearest rows of b for each row of a, and of a for each row of b, from one product; (row, row of the other, cosine).

    own: a and b are one block; pairs of a row with itself don't count, and the second part is empty.
    """
    forth, back, seen = [], [], None
    for r in range(0, len(a.ids), STRIPE):
        rows = np.arange(r, min(r + STRIPE, len(a.ids)))
        product = code_products(a.codes[rows], b.codes)
        if own:
            product[np.arange(len(rows)), rows] = -np.inf
        i, j, _ = survivors(product, a.scale[rows], b.scale, a.error[rows], float(b.error.max(initial=0)), k)
        forth.append(_ranked(a, b, rows[i], j, k))
        if not own:
            j, i, seen = survivors(np.ascontiguousarray(product.T), b.scale, a.scale[rows], b.error, float(a.error.max()), k, seen, 8)
            back.append(_ranked(b, a, j, rows[i], k))
    join = lambda parts: tuple(np.concatenate(z) for z in zip(*parts, strict=True)) if parts else (np.empty(0, int), np.empty(0, int), np.empty(0))
    forth, back = join(forth), join(back)
    if len(back[0]):  # of several stripes: a row's best of all
        by = np.lexsort((a.ids[back[1]], -back[2], back[0]))
        back = tuple(z[by] for z in back)
        keep = np.arange(len(by)) - np.searchsorted(back[0], back[0], "left") < k
        back = tuple(z[keep] for z in back)
    return forth, back


def search(q: Block, x: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, cosine) of the nearest rows of x, whose ids are in order, for each row of q; none is its own neighbour."""
    parts = []
    for r in range(0, len(q.ids), STRIPE):
        rows = np.arange(r, min(r + STRIPE, len(q.ids)))
        product = code_products(q.codes[rows], x.codes)
        at = np.minimum(np.searchsorted(x.ids, q.ids[rows]), len(x.ids) - 1)
        itself = np.flatnonzero(x.ids[at] == q.ids[rows])
        product[itself, at[itself]] = -np.inf
        i, j, _ = survivors(product, q.scale[rows], x.scale, q.error[rows], float(x.error.max(initial=0)), k)
        parts.append(_ranked(q, x, rows[i], j, k))
    return tuple(np.concatenate(z) for z in zip(*parts, strict=True))


def nearest(vectors: DataFrame, *, k: int = 10, every: int = 1, block_bytes: int = BLOCK_BYTES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, neighbour_id, rank, cosine) of the k nearest other vectors, by cosine, of every vector whose id is divisible by `every`.

    With `every` 1, every row is a query and every pair of blocks is a tile, so the result is exact; the work grows with
    the square of the rows. Else blocks of queries meet all blocks, which is as exact. A block is sent to as many tiles as there are blocks, which are as few as
    block_bytes and the number of cores allow. Ranks are from 1; cosines are rounded to 12 decimals, and
    ties go to the smaller id.

    Rows with a null id, a null or empty vector, or a null or non-finite component are neither queries nor
    neighbours. Vectors of different lengths have no cosine: each has neighbours of its own length only.
    Repeated rows of an id count once for each length, the one of the greatest vector. A zero vector has
    cosine 0 to all. Fewer than k other vectors give fewer rows; an empty table none. Ids must be whole
    numbers. Other columns are unused.
    """
    spark = vectors.sparkSession
    whole_ids(vectors, id_col)
    kind = np.dtype(np.float32 if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else np.float64)
    sound = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{'float' if kind == np.float32 else 'double'}>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    one = sound.withColumn("d", F.size("v")).groupBy("id", "d").agg(F.max("v").alias("v"))
    sizes = {r["d"]: r["n"] for r in sound.select("id", F.size("v").alias("d")).distinct().groupBy("d").agg(F.count("*").alias("n")).collect()}
    schema = "id bigint, neighbour_id bigint, rank bigint, cosine double"
    names = [id_col, "neighbour_id", "rank", "cosine"]
    if not sizes:
        return spark.createDataFrame([], schema).toDF(*names)
    # As few blocks as memory allows, but tiles for all cores: g blocks make g (g + 1) / 2 tiles.
    least = math.ceil(math.sqrt(6 * spark.sparkContext.defaultParallelism))
    most_rows = {d: max(1, block_bytes // (d * (kind.itemsize + 1) + 32)) for d in sizes}
    blocks = {d: max(-(-n // most_rows[d]), min(least, -(-n // 512))) for d, n in sizes.items()}
    counts = F.broadcast(spark.createDataFrame(list(blocks.items()), "d int, g int"))  # a row for each length of vectors
    rows = one.join(counts, "d").withColumn("b", F.pmod(F.xxhash64("id"), "g").cast("int"))

    def gather(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, g, b = (x.as_py() for x in key)
        ids, parts = [], []
        for batch in batches:
            ids.append(batch.column("id").to_numpy())
            parts.append(batch.column("v").flatten().to_numpy().reshape(-1, d))
        i, x = np.concatenate(ids), np.concatenate(parts)
        by = np.argsort(i)
        block = Block.of(i[by].astype(np.int64), x[by].astype(kind))
        yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "g": pa.array([g], pa.int32()), "b": pa.array([b], pa.int32()), **block.packed()})

    packed = written(rows.groupBy("d", "g", "b").applyInArrow(gather, "d int, g int, b int, " + ", ".join(f"{n} binary" for n in _FIELDS)), "blocks")
    def merge(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for t in range(batch.num_rows):
                q, x = (np.frombuffer(batch.column(c)[t].as_buffer(), np.int64).tolist() for c in ("q", "x"))
                for a, b, c in zip(q, x, np.frombuffer(batch.column("c")[t].as_buffer()).tolist(), strict=True):
                    heap = heaps.setdefault(a, [])
                    if len(heap) < k:
                        heapq.heappush(heap, (c, -b))
                    elif heap[0] < (c, -b):
                        heapq.heapreplace(heap, (c, -b))
        rows = [(a, -b, n, c) for a, heap in heaps.items() for n, (c, b) in enumerate(sorted(heap, reverse=True), 1)]
        if rows:
            a, b, n, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (a, b, n)), pa.array(c, pa.float64())], names=["id", "neighbour_id", "rank", "cosine"])

    key = ("d", "i", "j")
    if every > 1:
        asked = {r["d"]: r["n"] for r in one.where(F.col("id") % every == 0).groupBy("d").agg(F.count("*").alias("n")).collect()}
        if not asked:
            return spark.createDataFrame([], schema).toDF(*names)
        groups = {d: -(-n // most_rows[d]) for d, n in asked.items()}
        some = F.broadcast(spark.createDataFrame(list(groups.items()), "d int, g int"))
        queries = one.where(F.col("id") % every == 0).join(some, "d").withColumn("b", F.pmod(F.xxhash64("id"), "g").cast("int"))
        queries = written(queries.groupBy("d", "g", "b").applyInArrow(gather, "d int, g int, b int, " + ", ".join(f"{n} binary" for n in _FIELDS)), "queries")
        series = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asking = queries.drop("g").join(counts, "d").withColumn("j", series("g")).select("d", F.col("b").alias("i"), "j", F.lit(True).alias("asks"), *_FIELDS)
        asked_of = packed.drop("g").join(some, "d").withColumn("i", series("g")).select("d", "i", F.col("b").alias("j"), F.lit(False).alias("asks"), *_FIELDS)

        def ask(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d, i, _ = (x.as_py() for x in key)
            held = {}
            for batch in batches:
                for t in range(batch.num_rows):
                    row = {n: batch.column(n)[t] for n in batch.schema.names}
                    held[row["asks"].as_py()] = Block.unpacked(row, d, kind)
            if len(held) < 2:  # a block without rows
                return
            q, x = held[True], held[False]
            r, s, c = search(q, x, k)
            for part in range(PARTS):  # merged apart
                p = r % PARTS == part
                if p.any():
                    yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "b": pa.array([i * PARTS + part], pa.int32()), "q": [q.ids[r[p]].tobytes()], "x": [x.ids[s[p]].tobytes()], "c": [c[p].tobytes()]})

        tiles = min(100_000, sum(groups[d] * blocks[d] for d in groups))
        found = asking.unionByName(asked_of).repartition(tiles, *key).groupBy(*key).applyInArrow(ask, "d int, b int, q binary, x binary, c binary")
        return found.groupBy("d", "b").applyInArrow(merge, schema).toDF(*names)
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o")
    sides = packed.select("*", other).select("d", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", *_FIELDS)
    tiles = min(100_000, sum(g * (g + 1) // 2 for g in blocks.values()))

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, i, j = (x.as_py() for x in key)
        held = {}
        for batch in batches:
            for t in range(batch.num_rows):
                row = {n: batch.column(n)[t] for n in batch.schema.names}
                held[row["b"].as_py()] = Block.unpacked(row, d, kind)
        if i not in held or j not in held:  # a block without rows
            return
        for b, q, x, (r, s, c) in zip((i, j), (held[i], held[j]), (held[j], held[i]), tile(held[i], held[j], k, i == j), strict=True):
            if len(r):
                yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "b": pa.array([b], pa.int32()), "q": [q.ids[r].tobytes()], "x": [x.ids[s].tobytes()], "c": [c.tobytes()]})

    found = sides.repartition(tiles, *key).groupBy(*key).applyInArrow(join, "d int, b int, q binary, x binary, c binary")
    return found.groupBy("d", "b").applyInArrow(merge, schema).toDF(*names)
