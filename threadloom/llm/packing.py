"""Filling containers of fixed capacity by best-fit decreasing.

Items of one size are interchangeable, and so are containers with the same room left. So the packing is computed
exactly from the histogram of sizes, which has at most ``capacity`` rows whatever the number of items: a segment tree
over the room left finds the tightest open class of containers, whole classes are filled at once, and the result is
a list of assignments (size, ranks, containers). Items then find their container by their rank within their size,
which is counted in blocks, so that no task needs all items of a size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut

CAPACITY = 2048
#: About so many items of one size are ranked by one task.
BLOCK = 50_000


class RoomTree:
    """Segment tree over 0..capacity that finds the least room >= size of which there are containers."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, n: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, size: int) -> int | None:
        at = size + self.width
        if self.count[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over sizes 1..capacity: rows (size, first rank, last rank + 1, first container, items in each).

    The item of rank r goes to container first + (r - first rank) // items in each. Ranks of a size are from 0.
    """
    tree = RoomTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of containers (first, number)
    plan: list[tuple[int, int, int, int, int]] = []
    new = 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            open_bins.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for size in sorted(histogram, reverse=True):
        if not 1 <= size <= capacity:
            raise ValueError(f"size {size} is not within 1..{capacity}")
        rank, left = 0, histogram[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                each = capacity // size
                room, first, n = capacity, new, -(-left // each)
                new += n
            else:
                each = room // size
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            full = min(n, left // each)
            if full:
                plan.append((size, rank, rank + full * each, first, each))
                put(room - each * size, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left and left < each:  # the last items of this size share one container
                plan.append((size, rank, rank + left, first, each))
                put(room - left * size, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return plan


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(item, piece_no, first_unit, n_units, container): every item of a table in a container of fixed capacity.

    ``key`` must be unique. Ties of size are taken in the order of a hash of the key, then of the key. An item larger than the capacity is cut
    into full containers and a rest that is packed like any item (piece_no from 0, first_unit its offset). Items with
    size 0, less or null take no room: container is null and n_units 0. An empty table gives no rows. Other columns
    are ignored.
    """
    n = F.greatest(F.coalesce(df[size].cast("long"), F.lit(0)), F.lit(0))
    items = df.select(df[key].alias("item"), n.alias("n"))
    last = F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0))
    pieces = items.select("item", "n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece_no"))
    first = F.col("piece_no") * capacity
    pieces = pieces.select("item", "piece_no", first.alias("first_unit"), F.least(F.col("n") - first, F.lit(capacity)).cast("int").alias("n_units"))
    pieces = cut(pieces)
    per_size = {r["n_units"]: r["c"] for r in pieces.where("n_units > 0").groupBy("n_units").agg(F.count("*").alias("c")).collect()}  # at most `capacity` rows
    plan = plan_packing(per_size, capacity)
    blocks = max(1, -(-max(per_size.values(), default=0) // block))
    blocked = pieces.where("n_units > 0").withColumn("block", F.pmod(F.xxhash64("item", "piece_no"), F.lit(blocks)).cast("int"))
    counts = blocked.groupBy("n_units", "block").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n_units").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_units", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("n_units", "block").orderBy("item", "piece_no")
    ranked = blocked.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["n_units", "block"])
    ranked = ranked.select("item", "piece_no", "first_unit", "n_units", (F.col("r") + F.col("offset")).alias("rank"))
    placed = ranked.mapInArrow(_place(plan), _schema(ranked))
    empty = pieces.where("n_units <= 0").select("item", "piece_no", "first_unit", "n_units", F.lit(None).cast("long").alias("container"))
    return placed.unionByName(empty)


def _schema(ranked: DataFrame) -> str:
    kinds = dict(ranked.dtypes)
    return f"item {kinds['item']}, piece_no long, first_unit long, n_units int, container long"


def _place(plan: list[tuple[int, int, int, int, int]]):
    """Looks up the container of (size, rank); the plan grows with the capacity, not with the items."""
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    top = int(table[:, 2].max(initial=0)) + 1
    starts = table[:, 0] * top + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(starts, batch.column("n_units").to_numpy().astype(np.int64) * top + rank, side="right") - 1
            container = table[at, 3] + (rank - table[at, 1]) // table[at, 4]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pc.cast(batch.column("piece_no"), pa.int64()), pc.cast(batch.column("first_unit"), pa.int64()), batch.column("n_units"), pa.array(container)],
                ["item", "piece_no", "first_unit", "n_units", "container"],
            )

    return place
