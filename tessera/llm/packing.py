"""Filling fixed-capacity containers with items.

Method: exact-complement hashing. Only the number of items of each length matters, so the plan is made from a histogram of
at most ``capacity`` counts. A container starts with the longest item; as soon as one, two or three available lengths add
up to the gap exactly, they are taken, else the longest that fits; the combination is used as often as its lengths are
available. What cannot be completed exactly is filled by best fit. The plan is then carried out by rank on all items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _ranking
from tessera.storage import materialize


class Complements:
    """Available lengths, with an index of which sums one, two and three of them can have."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype("i8").copy()
        self._index()

    def _index(self) -> None:
        """Sums of two as a set of bits; it is rebuilt when a length runs out."""
        self.lengths = np.flatnonzero(self.left)[::-1].tolist()
        bits = sum(1 << a for a in self.lengths)
        mask, pairs = (1 << len(self.left)) - 1, 0
        for a in self.lengths:
            pairs |= bits << a & mask
        self.pairs = pairs

    def take(self, used: dict[int, int], times: int) -> None:
        for a, n in used.items():
            self.left[a] -= n * times
        if any(not self.left[a] for a in used):
            self._index()

    def exact(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """Lengths that add up to ``gap``, after those of ``used`` are taken; longer ones are preferred."""
        left = self.left[: gap + 1].copy()
        for length, n in used.items():
            if length <= gap:
                left[length] -= n
        if left[gap] > 0:
            return [gap]
        if self.pairs >> gap & 1 and (two := self._pair(left, gap)) is not None:
            return two
        for a in self.lengths:
            if 3 * a < gap:
                break  # no three this short reach the gap
            if a < gap - 1 and left[a] > 0 and self.pairs >> (gap - a) & 1:
                left[a] -= 1
                two = self._pair(left, gap - a)
                left[a] += 1
                if two is not None:
                    return [a, *two]
        return None

    @staticmethod
    def _pair(left: np.ndarray, gap: int) -> list[int] | None:
        if gap < 2:
            return None
        low = left[1 : gap // 2 + 1]
        both = (low > 0) & (left[gap - 1 : gap - gap // 2 - 1 : -1] > 0)
        if gap % 2 == 0 and low[-1] < 2:
            both[-1] = False
        at = np.flatnonzero(both)
        return [gap - int(at[0]) - 1, int(at[0]) + 1] if len(at) else None

    def longest(self, gap: int, used: dict[int, int]) -> int:
        """The longest length that fits and is still available, or 0."""
        return next((a for a in self.lengths if a <= gap and self.left[a] > used.get(a, 0)), 0)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with their number in a container, containers of that kind): every item is placed, none beyond the capacity."""
    c = Complements(counts)
    out = []
    top = capacity
    while True:
        while top and not c.left[top]:
            top -= 1
        if not top:
            return out
        used, gap = {top: 1}, capacity - top
        while gap:
            found = c.exact(gap, used)
            if found is None and not (length := c.longest(gap, used)):
                break
            for length in found or [length]:
                used[length] = used.get(length, 0) + 1
                gap -= length
        times = int(min(c.left[a] // n for a, n in used.items()))
        c.take(used, times)
        out.append((used, times))


def pack(sizes: DataFrame, capacity: int = 2048, buckets: int | None = None) -> DataFrame:
    """``id, part, start, n_tokens, container``: from ``id, n_tokens`` with positive lengths and each id once.

    An item longer than the capacity is split into parts of exactly the capacity and a rest, ``start`` being the first token of a
    part; all others are whole with part 0. Of equally long items it is settled by a hash of their id which goes where. Lengths
    that are null or not positive are left out; an empty table gives no rows. Containers are numbered from 0.
    """
    spark = sizes.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = sizes.where("id is not null and n_tokens > 0")
    # whole parts fill a container each; they are not part of the search
    parts = items.select("id", "n_tokens", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("part"))
    start = F.col("part").cast("long") * capacity
    parts = parts.select("id", "part", start.alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("int").alias("length"))
    parts = materialize(parts, "parts")
    # at most ``capacity`` counts come to the driver
    histogram = np.zeros(capacity + 1, "i8")
    for r in parts.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    first = np.cumsum(histogram) - histogram
    base, taken = 0, np.zeros(capacity + 1, "i8")
    starts, per, bases = [], [], []
    for used, times in plan(histogram, capacity):
        for length, n in used.items():
            starts.append(first[length] + taken[length])
            per.append(n)
            bases.append(base)
            taken[length] += n * times
        base += times
    order = np.argsort(starts)
    starts, per, bases = (np.array(x, "i8")[order] for x in (starts, per, bases))

    def place(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy() + first[batch.column("length").to_numpy()]
            at = np.searchsorted(starts, rank, side="right") - 1
            container = bases[at] + (rank - starts[at]) // per[at]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "part", "start", "length")] + [pa.array(container)], names=["id", "part", "start", "n_tokens", "container"])

    ranked = _ranking.with_rank(parts, ["length"], ["id", "part"], buckets).select("id", "part", "start", "length", "rank")
    return ranked.mapInArrow(place, "id long, part int, start long, n_tokens int, container long")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``n_containers, n_full, n_tokens, fill``: one row; fill is the share of all space that is used, null without containers."""
    loads = packed.groupBy("container").agg(F.sum("n_tokens").alias("load"))
    return loads.agg(F.count("*").alias("n_containers"), F.count_if(F.col("load") == capacity).alias("n_full"), F.sum("load").alias("n_tokens"), F.try_divide(F.sum("load"), F.count("*") * capacity).alias("fill"))
