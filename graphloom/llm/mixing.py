"""Operator 1: mixing sources to target weights by Pfair scheduling.

Documents of a source are cut into blocks. With integer weights p_i of sum Q, block j of source i may
start at slot floor(j Q / p_i) (its release) and must have its slot before ceil((j + 1) Q / p_i) (its
deadline). Earliest deadline first over these windows always succeeds on one sequence of slots, and a
source then never departs from its target by a whole block in any prefix. The schedule repeats after Q
slots, so the driver computes one period from the weights alone; every block's slot follows from its
number by arithmetic, on executors.

Sources whose weight a period can't tell form a tail. The tail is one more task, of exactly their summed
weight W: its block j has slot floor(j / W), and the other tasks keep their order in the slots between.
Inside, document p of a source of weight w is due at (p + u) / w, with a phase u of the source; the tail
is all documents in that order, so no weight in it is rounded.
"""

from __future__ import annotations

import heapq
import zlib
from math import ceil, floor, gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import plain

#: The schedule of one period is made on the driver; more sources than this are refused, not cut.
MAX_SOURCES = 1_000_000
#: Most that rounding to units may change a weight, as a part of it; sources beyond it are the tail.
ROUNDING = 0.01
#: Numerator of the tail's share, whose denominator then has at least its precision.
TAIL_UNITS = 100_000
#: The columns that a mixture adds.
ADDED = ("mix_task", "mix_block", "mix_epoch", "mix_release", "mix_deadline", "mix_slot", "mix_rank")


def pfair_period(units: list[int]) -> list[list[int]]:
    """For each task, the slots of one period of sum(units) slots, by earliest deadline first.

    Ties of deadlines go to the task listed first.
    """
    period = sum(units)
    slots: list[list[int]] = [[] for _ in units]
    waiting = [(0, k) for k, u in enumerate(units) if u > 0]  # release of the next block
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * period // units[k]), k))
        deadline, k = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a deadline was missed")
        slots[k].append(t)
        if len(slots[k]) < units[k]:
            heapq.heappush(waiting, (len(slots[k]) * period // units[k], k))
    return slots


def tempered_shares(counts: dict[str, int], most_epochs: float) -> dict[str, float]:
    """Shares n_i (n_max / n_i)**(1/4), with the factor at most most_epochs: small sources are raised."""
    top = max(counts.values())
    return {k: n * min(most_epochs, ((top / n) ** 0.5) ** 0.5) for k, n in counts.items()}


def split_tail(shares: dict[str, float], resolution: int) -> tuple[dict[str, int], list[str]]:
    """(units of the sources that resolution can tell, sources of the tail)."""
    total = sum(shares.values())
    exact = {k: resolution * s / total for k, s in shares.items()}
    units = {k: round(x) for k, x in exact.items() if round(x) and abs(round(x) - x) <= ROUNDING * x}
    divisor = gcd(*units.values()) if units else 1
    return {k: u // divisor for k, u in units.items()}, [k for k in shares if k not in units]


def _phase(key: str) -> float:
    """Between 0 and 1, by source."""
    return (zlib.crc32(key.encode()) + 0.5) / 2**32


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    *,
    block_docs: int = 32,
    resolution: int = 10_000,
    most_epochs: float = 4.0,
    epoch_limit: int = 100,
    bucket_docs: int = 20_000,
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """Every document of the weighted sources, placed in a mixture that keeps the target weights throughout.

    weights: target by source (None as a key stands for the null source); without it, shares are
    tempered from the counts. Sources that weights leaves out, or gives nothing, aren't in the mixture.
    The mixture ends with the slot in which the last source has given all its blocks once; sources that
    are through earlier begin again (epoch 1, 2, ...), so no document of a weighted source is lost and in
    every prefix of whole slots each source holds its weight to less than one block. A source's last
    block may be short. Sources whose weight 1/resolution can't tell to ROUNDING are a task together, of
    their summed weight, named by the source if it is one and else "(tail)"; within it each has its own
    weight to about a document, so beside a tail the deviation is less than two blocks.

    A mixture in which some source's documents would come more than epoch_limit times is refused with a
    ValueError that names it: the weights don't fit the documents there are.

    Returns the columns of docs and `mix_task`, `mix_block` (number of the block in its task, over all
    epochs), `mix_epoch`, `mix_release`, `mix_deadline`, `mix_slot`, `mix_rank` (place in the block);
    columns of docs with these names are replaced. Sorting by (mix_slot, mix_rank) gives the mixture.

    Nulls: a null source is a source, null ids and texts are documents like others. Repeated rows each
    have a place; ties of the order within a source (by hash of the id, then id) are in any order. An
    empty table gives an empty mixture.
    """
    spark = docs.sparkSession
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = [at[c] for c in docs.columns if c not in ADDED]
    kept = [c for c in docs.columns if c not in ADDED]
    keyed = plain(docs).select(*sorted({*out, at[id_col]}), _key(F.col(at[source_col])).alias("mix_key"))
    id_ = at[id_col]
    found = {r["mix_key"]: r["n"] for r in keyed.groupBy("mix_key").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        shares = tempered_shares(found, most_epochs) if found else {}
    else:
        named = {"null" if k is None else f"={k}": w for k, w in weights.items()}
        shares = {k: named[k] for k in found if named.get(k, 0) > 0}
    units, tail = split_tail(shares, resolution) if shares else ({}, [])
    tasks = sorted(units)
    slots = dict(zip(tasks, pfair_period([units[k] for k in tasks]), strict=True))
    period = sum(units.values())
    blocks = {k: -(-found[k] // block_docs) for k in tasks}
    tail_share = sum(shares[k] for k in tail)
    # The tail's share of the slots is ta / tb; all of them if there is nothing else.
    ta = TAIL_UNITS if tail and tasks else 1 if tail else 0
    tb = max(ta + 1, round(ta * sum(shares.values()) / tail_share)) if tail and tasks else 1

    def slot(k: str, j: int) -> int:
        return j // units[k] * period + slots[k][j % units[k]]

    def outer(s: int) -> int:
        """Slot of the mixture for the slot s of the other tasks."""
        return s + -(-ta * (s + 1) // (tb - ta)) if ta else s

    horizon = max((outer(slot(k, blocks[k] - 1)) + 1 for k in tasks), default=0)
    if tail:
        weight = {k: shares[k] / tail_share for k in tail}
        through = max(found[k] / weight[k] for k in tail)
        due = sum(floor(through * weight[k] - _phase(k)) + 1 for k in tail)
        horizon = max(horizon, (-(-due // block_docs) - 1) * tb // ta + 1)
    tail_placed = -(-horizon * ta // tb)
    inner = horizon - tail_placed

    def placed(k: str) -> int:
        whole, rest = divmod(inner, period)
        return whole * units[k] + sum(s < rest for s in slots[k])

    epochs_of = {k: -(-placed(k) // blocks[k]) for k in tasks}
    if tail:
        until = tail_placed * block_docs + len(tail)
        epochs_of |= {k: ceil(until * weight[k] / found[k]) for k in tail}
    worst = max(epochs_of, key=lambda k: (epochs_of[k], k), default=None)
    if worst is not None and epochs_of[worst] > epoch_limit:
        raise ValueError(f"source {worst} would come {epochs_of[worst]} times, more than epoch_limit = {epoch_limit}")
    buckets = {k: max(1, -(-found[k] // bucket_docs)) for k in shares}
    plan = spark.createDataFrame(
        [(k, k, units[k], slots[k], blocks[k], placed(k), buckets[k]) for k in tasks],
        "mix_key string, mix_task string, mix_p long, mix_slots array<long>, mix_blocks long, mix_placed long, mix_buckets long",
    )
    everyone = spark.createDataFrame([(k, k, buckets[k]) for k in shares], "mix_key string, mix_task string, mix_buckets long")
    # One row a source, a slot a unit: of bounded size, so it goes to every executor. The slots join after the shuffles.
    keyed = keyed.join(F.broadcast(everyone), "mix_key")
    keyed = keyed.withColumn("mix_h", F.xxhash64(F.col(id_).cast("string"))).withColumn("mix_bucket", F.pmod("mix_h", "mix_buckets"))
    # Numbers within a task without one partition for it: count buckets, sum the counts, number within buckets.
    counts = keyed.groupBy("mix_task", "mix_bucket").agg(F.count("*").alias("mix_n"))
    before = counts.select(
        "mix_task",
        "mix_bucket",
        (F.sum("mix_n").over(Window.partitionBy("mix_task").orderBy("mix_bucket")) - F.col("mix_n")).alias("mix_before"),
    )
    within = F.row_number().over(Window.partitionBy("mix_task", "mix_bucket").orderBy("mix_h", id_))
    number = F.col("mix_before") + F.col("mix_number") - 1
    numbered = keyed.withColumn("mix_number", within).join(before, ["mix_task", "mix_bucket"]).withColumn("mix_number", number).drop("mix_key")
    main = (
        numbered.withColumn("mix_first", F.floor(F.col("mix_number") / block_docs))
        .withColumn("mix_rank", F.col("mix_number") % block_docs)
        .join(F.broadcast(plan.drop("mix_key", "mix_buckets")), "mix_task")
    )
    epochs = main.where("mix_first < mix_placed").withColumn(
        "mix_epoch", F.explode(F.expr("sequence(0L, (mix_placed - 1 - mix_first) div mix_blocks)"))
    )
    j = F.col("mix_block")

    def outwards(slot: Column) -> Column:
        if not ta:
            return slot
        return F.call_function("div", (slot + 1) * F.lit(ta) + F.lit(tb - ta - 1), F.lit(tb - ta)) + slot

    result = epochs.withColumn("mix_block", F.col("mix_first") + F.col("mix_epoch") * F.col("mix_blocks")).select(
        *out,
        F.expr("if(mix_task = 'null', null, substring(mix_task, 2))").alias("mix_task"),
        "mix_block",
        "mix_epoch",
        outwards(F.expr(f"mix_block * {period}L div mix_p")).alias("mix_release"),
        (outwards(F.expr(f"((mix_block + 1) * {period}L + mix_p - 1) div mix_p") - 1) + 1).alias("mix_deadline"),
        outwards(F.expr(f"mix_block div mix_p * {period}L") + F.get(F.col("mix_slots"), (j % F.col("mix_p")).cast("int"))).alias("mix_slot"),
        "mix_rank",
    )
    if not tail:
        return result.toDF(*kept, *ADDED)
    # Up to this time at least tail_placed blocks are due, since each source has less than one document fewer than its weight gives.
    dues = spark.createDataFrame([(k, weight[k], _phase(k), found[k]) for k in tail], "mix_task string, mix_w double, mix_u double, mix_n long")
    copies = (
        numbered.join(F.broadcast(dues), "mix_task")
        .withColumn("mix_most", F.floor((F.lit(float(until)) * F.col("mix_w") - F.col("mix_u") - F.col("mix_number")) / F.col("mix_n")))
        .where("mix_most >= 0")
        .withColumn("mix_epoch", F.explode(F.expr("sequence(0L, mix_most)")))
        .withColumn("mix_due", (F.col("mix_number") + F.col("mix_epoch") * F.col("mix_n") + F.col("mix_u")) / F.col("mix_w"))
        .withColumn("mix_part", F.floor(F.col("mix_due") / bucket_docs))
        .drop("mix_before")
    )
    parts = copies.groupBy("mix_part").agg(F.count("*").alias("mix_c"))
    earlier = parts.select("mix_part", (F.sum("mix_c").over(Window.partitionBy(F.lit(0)).orderBy("mix_part")) - F.col("mix_c")).alias("mix_before"))
    place = F.row_number().over(Window.partitionBy("mix_part").orderBy("mix_due", "mix_task", "mix_number"))
    name = F.lit(None if tail == ["null"] else tail[0][1:] if len(tail) == 1 else "(tail)").cast("string")
    rest = (
        copies.withColumn("mix_place", place.cast("long"))
        .join(earlier, "mix_part")
        .withColumn("mix_place", F.col("mix_before") + F.col("mix_place") - 1)
        .where(F.col("mix_place") < tail_placed * block_docs)
        .withColumn("mix_block", F.expr(f"mix_place div {block_docs}"))
        .select(
            *out,
            name.alias("mix_task"),
            "mix_block",
            "mix_epoch",
            F.expr(f"mix_block * {tb}L div {ta}L").alias("mix_release"),
            F.expr(f"((mix_block + 1) * {tb}L + {ta - 1}L) div {ta}L").alias("mix_deadline"),
            F.expr(f"mix_block * {tb}L div {ta}L").alias("mix_slot"),
            (F.col("mix_place") % block_docs).alias("mix_rank"),
        )
    )
    return (result.unionByName(rest) if tasks else rest).toDF(*kept, *ADDED)
