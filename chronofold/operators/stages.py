"""Costs of temporal partitions and their grouping into pipeline stages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sum, sliced
from .shared import checkpointed
from .temporal import chunk_by_number

#: Partitions that can be grouped by cost: their costs are brought to the driver.
MOST_PARTITIONS = 1 << 20


def novelty(planned: DataFrame, entity: str) -> DataFrame:
    """(partition_id, distinct, new): entities of each partition, and those that no earlier partition has."""
    pairs = planned.select("partition_id", entity).distinct()
    first = planned.groupBy(entity).agg(F.min("partition_id").alias("first_partition"))
    return pairs.join(first, entity).groupBy("partition_id").agg(
        F.count("*").alias("distinct"), F.sum((F.col("partition_id") == F.col("first_partition")).cast("long")).alias("new")
    )


def partition_costs(planned: DataFrame, user_weight: float = 0.25, item_weight: float = 0.25, span_weight: float = 0.0) -> DataFrame:
    """One row a partition with its counts and its cost: events, entities, new entities and time span, at least 1."""
    size = planned.groupBy("split", "partition_id").agg(F.count("*").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    users = novelty(planned, "user_id").toDF("partition_id", "users", "new_users")
    items = novelty(planned, "item_id").toDF("partition_id", "items", "new_items")
    cost = (
        F.col("n")
        + user_weight * (F.col("users") + F.col("new_users"))
        + item_weight * (F.col("items") + F.col("new_items"))
        + span_weight * (F.col("end_ts") - F.col("start_ts"))
    )
    return size.join(users, "partition_id").join(items, "partition_id").withColumn("cost", F.greatest(cost, F.lit(1.0)))


def group_by_count(metadata: DataFrame, stages: int) -> DataFrame:
    """Adds stage: near-equal runs of partitions in order of time. metadata has a row a partition."""
    rows = sliced(metadata, F.col("start_ts"))
    place = running_sum(rows, ["start_ts", "partition_id"], "_n", F.lit(1))
    return place.withColumn("stage", chunk_by_number(F.col("_n") - 1, rows.count(), stages)).drop("_n", "_slice")


def balanced_cuts(costs: list[float], stages: int) -> list[int] | None:
    """Ends of contiguous groups with the least sum of squared distances from the mean cost; None if there are too few.

    Among equal sums the earliest cuts are taken, the last group's first. As costs are positive, the best start of a last
    group never moves back when its end moves on, so half of the ends leave each half of the starts to look at: n log n
    sums for each group.
    """
    n = len(costs)
    if stages < 1 or n < stages:
        return None
    prefix = np.concatenate(([0.0], np.cumsum(np.asarray(costs, float))))
    target = prefix[-1] / stages
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    starts = []
    for s in range(1, stages + 1):
        least, start = np.full(n + 1, np.inf), np.zeros(n + 1, np.int32)
        ranges = [(s, n - (stages - s), s - 1, n)]  # of ends, and of the starts that they can have
        while ranges:
            low, high, first, last = ranges.pop()
            if low <= high:
                end = (low + high) // 2
                of = slice(first, min(last, end - 1) + 1)
                sums = best[of] + (prefix[end] - prefix[of] - target) ** 2
                at = first + int(np.argmin(sums))
                least[end], start[end] = sums[at - first], at
                ranges += [(low, end - 1, first, at), (end + 1, high, at, last)]
        best = least
        starts.append(start)
    ends, at = [], n
    for start in starts[::-1]:
        ends.append(at)
        at = int(start[at])
    return ends[::-1]


def group_by_cost(costs: DataFrame, stages: int) -> DataFrame:
    """Adds stage: contiguous partitions with balanced costs.

    A row for each partition is brought to the driver, MOST_PARTITIONS at most; a plan of more partitions is refused, and
    needs larger ones. What goes back are the first partitions of the stages.
    """
    costs = checkpointed(costs)
    order = costs.select("start_ts", "partition_id", "cost").limit(MOST_PARTITIONS + 1).toPandas().sort_values(["start_ts", "partition_id"])
    if len(order) > MOST_PARTITIONS:
        raise ValueError(f"more than {MOST_PARTITIONS} partitions to group: make them larger")
    ends = balanced_cuts(order["cost"].tolist(), stages)
    if ends is None:
        return group_by_count(costs, stages)
    at = F.struct("start_ts", "partition_id")
    stage = F.lit(0)
    for row in order.iloc[ends[:-1]].itertuples():
        stage = stage + (at >= F.struct(F.lit(row.start_ts), F.lit(int(row.partition_id)))).cast("int")
    return costs.withColumn("stage", stage)


def stage_summary(staged: DataFrame) -> DataFrame:
    """One row a stage: its partitions, events, entities and cost."""
    return staged.groupBy("stage").agg(
        F.count("*").alias("partitions"), F.sum("n").alias("events"), F.sum("users").alias("users"), F.sum("items").alias("items"), F.sum("cost").alias("cost")
    )


def grouped(costs: DataFrame, stages: int, strategy: str = "cost") -> DataFrame:
    """Adds stage by a strategy: near-equal numbers of partitions (count), or balanced costs. costs: the partitions of one part."""
    if strategy not in ("count", "cost"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return group_by_count(costs, stages) if strategy == "count" else group_by_cost(costs, stages)


def with_workers(rows: DataFrame, gpus: Column, stages: Column) -> DataFrame:
    """A row for each stage of each row, with its workers: what is left is shared by the stages that are left, at least one each."""
    start = F.struct(gpus.cast("long").alias("left"), F.array().cast("array<long>").alias("out"))

    def share(state: Column, stage: Column) -> Column:
        n = F.greatest(F.floor(state["left"] / (stages - stage)), F.lit(1).cast("long"))
        return F.struct((state["left"] - n).alias("left"), F.array_append(state["out"], n).alias("out"))

    found = F.aggregate(F.sequence(F.lit(0), stages - 1), start, share, lambda state: state["out"])
    return rows.select("*", F.posexplode(found).alias("stage", "workers"))


def summary_hints(stages: DataFrame, devices: int) -> DataFrame:
    """Of each part: its stages, events and workers, whether they fit the devices, and hints. stages: split, stage, n, workers."""
    sums = stages.groupBy("split").agg(F.count("*").alias("stages"), F.sum("n").alias("events"), F.sum("workers").alias("workers"), F.max("workers").alias("most"))
    unused = F.lit(devices) - F.col("workers")
    hints = [
        F.when((F.col("split") == "train") & (F.col("most") <= 1) & (F.col("stages") > 1), "one worker a stage: no parallelism within stages"),
        F.when((F.lit(devices) > 0) & (unused > 0), F.concat(unused.cast("string"), F.lit(" devices unused"))),
    ]
    fit = F.when(F.lit(devices) > 0, F.when(unused >= 0, "fit").otherwise("oversubscribed"))
    return sums.select("split", "stages", "events", "workers", fit.alias("fit"), F.array_compact(F.array(*hints)).alias("hints"))


def worker_allocation(gpus: int, stages: int, per_worker: float) -> list[int]:
    """Workers of each stage: what is left is shared by the stages that are left, at least one each."""
    left, out = int(gpus / per_worker), []
    for s in range(stages):
        out.append(max(1, left // (stages - s)))
        left -= out[-1]
    return out
