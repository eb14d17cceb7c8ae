"""Order in time: numbering, dense ids, chronological splits and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets whose sizes are summed up in one task, in the order of the coarse buckets that they belong to.
BUCKETS_TOGETHER = 1024


def bucket_shifts(sizes: DataFrame, bucket: str, n: str, name: str, run: Column | None = None) -> DataFrame:
    """(bucket, name): the sum of n over all earlier buckets. Runs of buckets (BUCKETS_TOGETHER numbers, if no run is given)
    are summed up apart, and a row for each run is all that meets in one task."""
    within = Window.partitionBy("_run").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.withColumn("_run", F.floor(F.col(bucket) / BUCKETS_TOGETHER) if run is None else run)
    runs = runs.withColumn("_inner", F.coalesce(F.sum(n).over(within), F.lit(0)))
    runs = runs.groupBy("_run").agg(F.collect_list(F.struct(bucket, "_inner")).alias("_of"), F.sum(n).alias("_all"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_start", F.coalesce(F.sum("_all").over(before), F.lit(0))).select("_start", F.explode("_of").alias("_b"))
    return runs.select(F.col("_b")[bucket].alias(bucket), (F.col("_start") + F.col("_b")["_inner"]).alias(name))


def numbered(df: DataFrame, order: list[str], bucket: Column, name: str, run: Column | None = None) -> DataFrame:
    """Numbers rows from 0 in a total order without bringing them into one task.

    bucket must not decrease along the order, such as a minute of a timestamp; its rows are one task's work. Rows are
    numbered within their bucket and shifted by the number of rows in earlier ones. df is read twice, once for the sizes. run: of a bucket that is no number, what its neighbours share.
    """
    rows = df.withColumn("_bucket", bucket)
    shifts = bucket_shifts(rows.groupBy("_bucket").agg(F.count("*").alias("_n")), "_bucket", "_n", "_shift", run)
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return rows.withColumn("_place", place).join(shifts, "_bucket").withColumn(name, F.col("_shift") + F.col("_place")).drop("_bucket", "_place", "_shift")


def dense_ids(df: DataFrame, raw: str, line: str, name: str, lines_per_bucket: int = 1 << 16) -> DataFrame:
    """(raw, name): ids from 0 by first appearance over all lines."""
    first = df.groupBy(raw).agg(F.min(line).alias("_first"))
    return numbered(first, ["_first"], F.floor(F.col("_first") / lines_per_bucket), name).select(raw, name)


def event_sequence(df: DataFrame, ts: str = "ts", tie: str = "line_no", seconds_per_bucket: float = 60.0, name: str = "event_seq") -> DataFrame:
    """Adds the place of each event in the order of time, ties by line."""
    return numbered(df, [ts, tie], F.floor(F.col(ts) / seconds_per_bucket), name)


def first_events(df: DataFrame, n: int, ts: str = "ts", tie: str = "line_no") -> DataFrame:
    """The first n events in time. Ids must have been given before, over all events."""
    return df.orderBy(ts, tie).limit(n)


def split_bounds(n: int, train: float = 0.7, val: float = 0.1) -> tuple[int, int]:
    """Ends of the training and validation parts. Sums of ratios are binary floating point, as is the product."""
    if not (train > 0 and val >= 0 and train + val < 1):
        raise ValueError("ratios must satisfy train > 0, val >= 0, train + val < 1")
    if n < 3:
        raise ValueError("three events are needed for three parts")
    train_end = min(max(int(n * train), 1), n - 2)
    return train_end, min(max(int(n * (train + val)), train_end + 1), n - 1)


def chronological_split(df: DataFrame, n: int, train: float = 0.7, val: float = 0.1, seq: str = "event_seq") -> DataFrame:
    """Adds split: train, val or test."""
    a, b = split_bounds(n, train, val)
    return df.withColumn("split", F.when(F.col(seq) < a, "train").when(F.col(seq) < b, "val").otherwise("test"))


SPLITS = ("train", "val", "test")


def split_rank(split: str = "split") -> Column:
    return F.when(F.col(split) == "train", 0).when(F.col(split) == "val", 1).otherwise(2)


def split_starts(n: int, train: float = 0.7, val: float = 0.1) -> dict[str, tuple[int, int]]:
    """(first event, number of events) of each part."""
    a, b = split_bounds(n, train, val)
    return {"train": (0, a), "val": (a, b - a), "test": (b, n - b)}


def chunk_by_size(place: Column, size: int) -> Column:
    return F.floor(place / size).cast("int")


def chunk_by_number(place: Column, n: int | Column, chunks: int) -> Column:
    """One of near-equal chunks, larger ones first, from the place among n rows: ntile without a sort."""
    n = F.lit(n) if isinstance(n, int) else n
    small, larger = F.floor(n / chunks), n % chunks
    edge = larger * (small + 1)
    tail = larger + F.floor((place - edge) / F.greatest(small, F.lit(1)))
    return F.when(place < edge, F.floor(place / (small + 1))).otherwise(tail).cast("int")


def partition_plan(df: DataFrame, n: int, size: int | None = None, train: float = 0.7, val: float = 0.1, seq: str = "event_seq") -> DataFrame:
    """Adds split and partition_id: chunks of size events in each part, numbered on from part to part.

    size: the number of training events if None. Everything follows from the event's place, so nothing is shuffled.
    """
    starts = split_starts(n, train, val)
    size = size or max(1, starts["train"][1])
    chunk, base = None, 0
    for split in SPLITS:
        first, count = starts[split]
        here = chunk_by_size(F.col(seq) - first, size) + base
        chunk = F.when(F.col("split") == split, here) if chunk is None else chunk.when(F.col("split") == split, here)
        base += -(-count // size)
    return chronological_split(df, n, train, val, seq).withColumn("partition_id", chunk.cast("int"))


def partition_metadata(planned: DataFrame) -> DataFrame:
    """One row a partition: its part, size and time range."""
    return planned.groupBy("split", "partition_id").agg(F.count("*").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


# The settings that a run states about itself, and what they are if they are not given.
RUN_SETTINGS = {"dataset": "synthetic", "max_events": 0, "feature_dim": 8, "lr": 1e-3, "train_ratio": 0.7, "val_ratio": 0.1, "k": 10, "selection_metric": "mrr", "seed": 42}


def run_metadata(planned: DataFrame, settings: dict) -> DataFrame:
    """One row: the settings of a run and the sizes of its parts."""
    sizes = [F.sum((F.col("split") == s).cast("long")).alias(f"num_{s}_events") for s in SPLITS]
    given = {k: type(v)(settings.get(k, v)) for k, v in RUN_SETTINGS.items()}
    return planned.agg(*sizes).select(*[F.lit(v).alias(k) for k, v in given.items()], *[F.coalesce(f"num_{s}_events", F.lit(0)).alias(f"num_{s}_events") for s in SPLITS])


def worker_chunks(planned: DataFrame, workers: int, seq: str = "event_seq") -> DataFrame:
    """Adds the worker that takes each event of a partition: near-equal runs of events. Partitions are whole, so the place of
    an event follows from its number, and only the first number and the size of each partition are looked up."""
    size = planned.groupBy("partition_id").agg(F.min(seq).alias("_first"), F.count("*").alias("_n"))
    rows = planned.join(size, "partition_id")
    return rows.withColumn("worker", chunk_by_number(F.col(seq) - F.col("_first"), F.col("_n"), workers)).drop("_first", "_n")
