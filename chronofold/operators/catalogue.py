"""Exact search in a catalogue of any size: blocks of items around pivots, and what the triangle inequality rules out.

``PIVOTS`` items are pivots. Each item belongs to its nearest pivot, and the items of a pivot are cut into rings by their
distance to it and, where many lie equally far, into parts, so that a block has about ``BLOCK_ITEMS`` items. A vector q at
distance d from the pivot of a block whose items lie between low and high from it is at least max(d - high, low - d) and
at most d + high from any of them. Blocks that cannot hold what is asked for are not looked at, and blocks all of whose
items are nearer than asked are only counted.

At scale: the pivots, and a row for each block, are what every task holds. A vector travels once to each block that may
matter; the vectors asked of one block are dealt over as many copies of it as they need (``ASKED_AT_ONCE``), and a block
answers with k items or a count for each. Bounds are widened by ``SLACK``, as distances are rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

PIVOTS = 256
BLOCK_ITEMS = 1 << 15
#: Vectors that one copy of a block is asked for, more or less.
ASKED_AT_ONCE = 1 << 14
#: Distances that are held at once.
NUMBERS_AT_ONCE = 1 << 22
SLACK = 1e-9


def matrix(column) -> np.ndarray:
    """Vectors of equal length in rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _squares(asked: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances from inner products, and what they may be wrong by in each row."""
    a, b = (asked**2).sum(1), (known**2).sum(1)
    return a[:, None] + b[None, :] - 2 * (asked @ known.T), SLACK * (a + b.max(initial=0)) + 1e-300


def closest(asked: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, distance) of the k items next to each vector, in their order; ties by number."""
    k = min(k, len(ids))
    if not k or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    near, slack = _squares(asked, known)
    most = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack
    row, place = np.nonzero(near <= most[:, None])
    far = np.sqrt(((asked[row] - known[place]) ** 2).sum(1))
    order = np.lexsort((ids[place], far, row))
    row, place, far = row[order], place[order], far[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], ids[place[first]], far[first]


def nearer(asked: np.ndarray, own: np.ndarray, far: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """For each vector how many items are nearer than far, or as near with a number smaller than that of its own item."""
    if not len(ids) or not len(asked):
        return np.zeros(len(asked), np.int64)
    near, slack = _squares(asked, known)
    limit = far**2
    count = (near < (limit - 2 * slack)[:, None]).sum(1)
    row, place = np.nonzero(np.abs(near - limit[:, None]) <= 2 * slack[:, None])
    exact = np.sqrt(((asked[row] - known[place]) ** 2).sum(1))
    before = (ids[place] != own[row]) & ((exact < far[row]) | ((exact == far[row]) & (ids[place] < own[row])))
    return count + np.bincount(row[before], minlength=len(asked))


@dataclass(frozen=True)
class Bounds:
    """The pivots and, for each block, its pivot, the least and greatest distance of its items from it, and their number."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest distance that an item of each block may have from each vector."""
        squares, slack = _squares(asked, self.pivots)
        d, room = np.sqrt(np.maximum(squares, 0))[:, self.pivot], np.sqrt(2 * slack)[:, None]  # squares are wrong by less
        return np.maximum(np.maximum(d - self.high, self.low - d) - room, 0), d + self.high + room


def _by_pivot(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.argmin(_squares(vectors, pivots)[0], axis=1)
    return place, np.sqrt(((vectors - pivots[place]) ** 2).sum(1))


@dataclass(frozen=True)
class Blocks:
    """items: item, vector, block (stored)."""

    items: DataFrame
    bounds: Bounds

    @staticmethod
    def of(items: DataFrame) -> Blocks:
        spark = items.sparkSession
        chosen = items.select("vector").orderBy(F.xxhash64("item"), "item").limit(PIVOTS).toArrow()
        pivots = matrix(chosen.column("vector"))
        held = spark.sparkContext.broadcast(pivots)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    of, far = _by_pivot(matrix(batch.column("vector")), held.value)
                    yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("vector"), pa.array(of.astype(np.int32)), pa.array(far)], names=["item", "vector", "pivot", "far"])

        placed = checkpointed(items.select(F.col("item").cast("long").alias("item"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(assign, "item long, vector array<double>, pivot int, far double"))
        rings = 64
        cuts = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("far", [i / rings for i in range(1, rings)], 1000).alias("cuts"))
        # no more rings than blocks are wanted
        few = F.least(F.lit(rings), F.ceil(F.col("n") / BLOCK_ITEMS)).cast("int")
        cuts = cuts.select("pivot", F.filter("cuts", lambda c, i: (i + 1) % F.ceil(F.lit(rings) / few) == 0).alias("cuts"))
        ringed = placed.join(F.broadcast(cuts), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("far")))).drop("cuts")
        parts = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / BLOCK_ITEMS).alias("parts"))
        dealt = ringed.join(F.broadcast(parts), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
        table = dealt.groupBy("pivot", "ring", "part").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).orderBy("pivot", "ring", "part").toArrow()
        rows = [table.column(c).to_numpy() for c in ("pivot", "ring", "part", "low", "high", "n")]
        number = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(zip(*rows[:3], strict=True))], "block int, pivot int, ring int, part long")
        numbered = dealt.join(F.broadcast(number), ["pivot", "ring", "part"]).select("block", "item", "vector")
        return Blocks(checkpointed(numbered), Bounds(pivots, rows[0], rows[3], rows[4], rows[5]))

    def _dealt(self, asks: DataFrame, work, schema: str) -> DataFrame:
        """work(asked rows, ids, known) for the rows (block, pid, pred, ...) asked of each block, over copies of the block."""
        copies = asks.groupBy("block").agg(F.ceil(F.count("*") / ASKED_AT_ONCE).cast("int").alias("copies"))
        asked = asks.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("pid"), F.col("copies")).cast("int")).drop("copies")
        known = self.items.join(copies, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "item", "vector")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, known = right.column("item").to_numpy(), matrix(right.column("vector"))
            step = max(1, NUMBERS_AT_ONCE // max(1, len(ids)))
            return pa.concat_tables([work(left.slice(a, step), ids, known) for a in range(0, max(1, left.num_rows), step)])

        return asked.groupBy("block", "copy").cogroup(known.groupBy("block", "copy")).applyInArrow(run, schema)

    def _sent(self, asks: DataFrame, choose, columns: str) -> DataFrame:
        """asks with the blocks that choose(low, high, batch, bounds) gives for them: arrays of row and block."""
        held = asks.sparkSession.sparkContext.broadcast(self.bounds)
        names = asks.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = held.value
            step = max(1, NUMBERS_AT_ONCE // max(1, len(bounds.pivot)))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    some = batch.slice(a, step)
                    row, block = choose(*bounds.of(matrix(some.column("pred"))), some, bounds)
                    out = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *out.columns], names=["block", *names])

        return asks.mapInArrow(run, f"block int, {columns}")

    def nearest(self, predictions: DataFrame, k: int) -> DataFrame:
        """(pid, item, place): first the blocks that must hold k items as near as any, then those that may hold nearer ones."""
        asked = checkpointed(predictions.groupBy("pid").agg(F.first("pred").cast("array<double>").alias("pred")))
        answer = "pid long, item long, far double"

        def work(rows: pa.Table, ids: np.ndarray, known: np.ndarray) -> pa.Table:
            row, item, far = closest(matrix(rows.column("pred")), ids, known, k)
            return pa.table([rows.column("pid").take(pa.array(row)), pa.array(item), pa.array(far)], names=["pid", "item", "far"])

        def first(low: np.ndarray, high: np.ndarray, batch: pa.RecordBatch, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(high, axis=1, kind="stable")
            before = np.cumsum(bounds.count[order], axis=1) - bounds.count[order]
            row, at = np.nonzero(before < k)
            return row, order[row, at]

        def further(low: np.ndarray, high: np.ndarray, batch: pa.RecordBatch, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
            seen = np.zeros(low.shape, bool)
            seen[first(low, high, batch, bounds)] = True
            return np.nonzero(~seen & (low <= batch.column("limit").to_numpy()[:, None]))

        place = F.row_number().over(Window.partitionBy("pid").orderBy("far", "item"))
        near = checkpointed(self._dealt(self._sent(asked, first, "pid long, pred array<double>"), work, answer))
        # with fewer than k items in all, every block has been seen
        limits = near.withColumn("place", place).filter(F.col("place") <= k).groupBy("pid").agg(F.max("far").alias("limit"))
        asks = asked.join(limits, "pid").select("pid", "pred", "limit")
        more = self._dealt(self._sent(asks, further, "pid long, pred array<double>, limit double").drop("limit"), work, answer)
        return near.unionByName(more).withColumn("place", place).filter(F.col("place") <= k).select("pid", "item", F.col("place").cast("int").alias("place"))

    def true_ranks(self, predictions: DataFrame) -> DataFrame:
        """(pid, true_item, rank): blocks that lie nearer as a whole are added, those at the true distance are looked into."""
        own = self.items.select(F.col("item").alias("true_item"), "vector")
        pairs = predictions.groupBy("pid", "true_item").agg(F.first("pred").cast("array<double>").alias("pred")).join(own, "true_item").select("pid", "true_item", "pred", "vector")

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    far = np.sqrt(((matrix(batch.column("pred")) - matrix(batch.column("vector"))) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pid", "true_item", "pred")), pa.array(far)], names=["pid", "true_item", "pred", "far"])

        columns = "pid long, true_item long, pred array<double>, far double"
        asks = checkpointed(pairs.mapInArrow(measured, columns))

        def at_distance(low: np.ndarray, high: np.ndarray, batch: pa.RecordBatch, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
            far = batch.column("far").to_numpy()[:, None]
            return np.nonzero((low <= far) & (high >= far))

        held = asks.sparkSession.sparkContext.broadcast(self.bounds)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = held.value
            step = max(1, NUMBERS_AT_ONCE // max(1, len(bounds.pivot)))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    some = batch.slice(a, step)
                    _, high = bounds.of(matrix(some.column("pred")))
                    count = ((high < some.column("far").to_numpy()[:, None]) * bounds.count).sum(1)
                    yield pa.RecordBatch.from_arrays([some.column("pid"), some.column("true_item"), pa.array(count.astype(np.int64))], names=["pid", "true_item", "before"])

        def work(rows: pa.Table, ids: np.ndarray, known: np.ndarray) -> pa.Table:
            own, far = rows.column("true_item").to_numpy(), rows.column("far").to_numpy()
            count = nearer(matrix(rows.column("pred")), own, far, ids, known) if rows.num_rows else np.zeros(0, np.int64)
            return pa.table([rows.column("pid"), rows.column("true_item"), pa.array(count.astype(np.int64))], names=["pid", "true_item", "before"])

        answer = "pid long, true_item long, before long"
        parts = asks.mapInArrow(whole, answer).unionByName(self._dealt(self._sent(asks, at_distance, columns), work, answer))
        return parts.groupBy("pid", "true_item").agg((F.sum("before") + 1).alias("rank"))
