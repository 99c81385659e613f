"""Filling containers of fixed capacity by best fit, over an exact histogram of sizes.

Sizes are whole tokens, so all that best fit needs to know of documents is how
many there are of each size, and of containers how many there are of each gap.
A step takes the largest size left, lets its documents find their successor, the
smallest gap that holds them, and moves as many containers as there are
documents, or as have that gap, from that gap to what is left of it. Containers
of one gap are interchangeable whatever is in them: they queue, and those that
came first are filled first. So a step is a few numbers (Step), and the steps
grow with the sizes and gaps that occur, not with documents or containers.

What does grow stays in the cluster. Ranks of documents within their size come
from salted groups and their prefix sums. A document finds its step by its size
and rank, and so its container's place in the queue of that gap; the step that
put the container there gives its place in the queue before, and so on back to
the queue of empty containers, where the place is the container's number.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import parts_for, work_table
from .tokens import token_counts

CAPACITY = 2_048
ROWS_PER_SALT = 100_000

_OUT = "container long, place long, doc_id long, piece long, first_token long, n_tokens long"


@dataclass(frozen=True)
class Step:
    """Items of one size with ranks first.. first+n-1 go to the containers at places taken.. of gap's queue, which move to places came.. of the queue of gap - size."""

    size: int
    first: int
    n: int
    gap: int
    taken: int
    came: int


def best_fit_steps(counts: dict[int, int], capacity: int) -> tuple[list[Step], int]:
    """The steps by which all items are placed, and the number of containers.

    Largest sizes first; each item takes the tightest gap that holds it, and
    containers are opened only when no gap does, as many as its size needs.
    Items of size 0 take no room and no step.
    """
    gaps: list[int] = []  # with containers in their queue, ascending
    came: dict[int, int] = {}
    taken: dict[int, int] = {}
    steps: list[Step] = []
    opened = 0

    def arrive(gap: int, n: int) -> int:
        at = came.get(gap, 0)
        if gap > 0 and at == taken.get(gap, 0):
            insort(gaps, gap)
        came[gap] = at + n
        return at

    for size in sorted((s for s in counts if s > 0), reverse=True):
        if size > capacity:
            raise ValueError(f"an item of {size} exceeds the capacity {capacity}")
        left, rank = counts[size], 0
        while left:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                new = -(-left // (capacity // size))
                arrive(capacity, new)
                opened += new
                continue
            gap = gaps[i]
            at = taken.get(gap, 0)
            n = min(left, came[gap] - at)
            taken[gap] = at + n
            if taken[gap] == came[gap]:
                gaps.pop(i)
            steps.append(Step(size, rank, n, gap, at, arrive(gap - size, n)))
            left, rank = left - n, rank + n
    return steps, opened


class Places:
    """Looks up containers by (size, rank), for arrays of them."""

    def __init__(self, steps: list[Step], capacity: int):
        col = lambda f, by: np.array([f(x) for x in by], np.int64)
        by_rank = sorted(steps, key=lambda x: (x.size, x.first))
        by_queue = sorted(steps, key=lambda x: (x.gap - x.size, x.came))
        self.capacity = capacity
        self.bits = max([1, *(int(x).bit_length() for s in steps for x in (s.first + s.n, s.came + s.n))])
        if self.bits + int(capacity).bit_length() > 62:
            raise ValueError("too many items of one size")
        self.key, self.first = col(lambda x: (x.size << self.bits) | x.first, by_rank), col(lambda x: x.first, by_rank)
        self.gap, self.taken = col(lambda x: x.gap, by_rank), col(lambda x: x.taken, by_rank)
        self.q_key, self.q_came = col(lambda x: ((x.gap - x.size) << self.bits) | x.came, by_queue), col(lambda x: x.came, by_queue)
        self.q_gap, self.q_taken = col(lambda x: x.gap, by_queue), col(lambda x: x.taken, by_queue)

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(container, place in it) of items of some size above 0."""
        i = np.searchsorted(self.key, (size << self.bits) | rank, side="right") - 1
        gap, at = self.gap[i], self.taken[i] + rank - self.first[i]
        place = np.zeros(len(size), np.int64)
        todo = np.flatnonzero(gap < self.capacity)
        while len(todo):  # one item back in each container
            i = np.searchsorted(self.q_key, (gap[todo] << self.bits) | at[todo], side="right") - 1
            at[todo] += self.q_taken[i] - self.q_came[i]
            gap[todo] = self.q_gap[i]
            place[todo] += 1
            todo = todo[gap[todo] < self.capacity]
        return at, place


def _pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """One row per document, or per piece of a document that alone exceeds the capacity."""
    n = F.col("n_tokens")
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("long")
    cut = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    first = F.col("piece") * capacity
    return cut.select("doc_id", "piece", first.alias("first_token"), F.least(n - first, F.lit(capacity)).cast("long").alias("size"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Rows (container, place, doc_id, piece, first_token, n_tokens), one per document or piece.

    A document is cut only if it alone exceeds the capacity: into full pieces
    and a rest, and the rest is packed like any document. place counts a
    container's items from 0. Null and empty texts have no tokens and lie in
    container 0. Repeated rows are packed each; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sizes = work_table(token_counts(docs, doc_id, text, vocabulary), "token-counts")
    return pack_sizes(sizes, capacity)


def pack_sizes(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """As pack, from given (doc_id, n_tokens)."""
    spark = sizes.sparkSession
    salts = parts_for(spark, sizes.count(), ROWS_PER_SALT)
    items = _pieces(sizes, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = work_table(items.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")), "size-groups")
    counts = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    steps, _ = best_fit_steps(counts, capacity)
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("size", "salt").orderBy("doc_id", "piece")
    ranked = items.withColumn("rank", F.row_number().over(own)).join(offsets, ["size", "salt"])
    ranked = ranked.select("doc_id", "piece", "first_token", "size", (F.col("base") + F.col("rank") - 1).alias("rank"))
    places = Places(steps, capacity)
    behind = sum(1 for _ in _inside_first(steps, capacity))  # items without tokens lie behind container 0's others

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b["size"].to_numpy(), b["rank"].to_numpy()
            container, at = np.zeros(len(size), np.int64), behind + rank
            full = size > 0
            if full.any():
                container[full], at[full] = places.of(size[full], rank[full])
            yield pa.RecordBatch.from_arrays([pa.array(container), pa.array(at), b["doc_id"], b["piece"], b["first_token"], b["size"]], names=[c.split()[0] for c in _OUT.split(", ")])

    return ranked.mapInArrow(place, _OUT)


def _inside_first(steps: list[Step], capacity: int) -> Iterator[Step]:
    """The steps that put an item into container 0."""
    gap, at = capacity, 0
    while True:
        step = next((x for x in steps if x.gap == gap and x.taken <= at < x.taken + x.n), None)
        if step is None:
            return
        yield step
        gap, at = gap - step.size, step.came + at - step.taken


def packing_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, unused tokens and the share of capacity used."""
    per = packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"),
        (F.count(F.lit(1)) * capacity - F.sum("tokens")).alias("unused"), (F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("fill"), F.max("tokens").alias("fullest"),
    )
