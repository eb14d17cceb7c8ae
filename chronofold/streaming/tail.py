"""Run logs as they grow: a tail of trace files, a progress count and the monitor's samples.

A log is a folder of files that grow; the query's checkpoint keeps the byte of each file up to which it has been read
(``growing``). A batch is written to a folder of its own number, which a repeated batch overwrites, so nothing is lost or
written twice if a run breaks off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.logs import EFFICIENCY, parse_trace
from .growing import growing_lines
from .monitor import MonitorState

#: Rows of a batch have numbers from its own range of this size.
BATCH_ROWS = 1 << 48


def _started(lines: DataFrame, each, checkpoint: str, seconds: float | None) -> StreamingQuery:
    """Runs each on every batch: until what is there has been read, or every so many seconds until it is stopped."""
    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def _numbered(batch: DataFrame, number: int) -> DataFrame:
    """(seq, value) in the order of batches, files and bytes."""
    return batch.select((F.lit(number * BATCH_ROWS) + F.monotonically_increasing_id()).alias("seq"), "value")


def tail_trace(spark: SparkSession, logs: str, out: str, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Appends the typed rows of new trace lines to the table out, partitioned by batch.

    Numbers grow from batch to batch; within a batch they follow the order of files and lines.
    """

    def each(batch: DataFrame, number: int) -> None:
        parse_trace(_numbered(batch, number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _started(growing_lines(spark, logs), each, checkpoint, seconds)


def progress(trace: DataFrame) -> DataFrame:
    """How many lines report progress, and the last of them."""
    lines = trace.filter("event in ('interaction_progress', 'partition_start', 'partition_done')")
    return lines.agg(F.count("*").alias("lines"), F.max_by(F.struct("elapsed", "phase", "trial", "stage"), "seq").alias("last"))


def monitor(spark: SparkSession, logs: str, table: str, samples: str, checkpoint: str, devices: int, seconds: float | None = None) -> StreamingQuery:
    """Tails a trace and writes one sample of all measures after each batch that completes a task. A batch reads its own rows
    and the state of the batch before (``monitor.MonitorState``), which stands beside the checkpoint."""
    state = MonitorState(spark, f"{checkpoint}-state")

    def each(batch: DataFrame, number: int) -> None:
        rows = parse_trace(_numbered(batch, number))
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if state.advance(number, spark.read.schema(rows.schema).parquet(f"{table}/batch={number}")):
            sample(state.measures(number, devices)).write.mode("overwrite").option("header", True).csv(f"{samples}/batch={number}")

    return _started(growing_lines(spark, logs), each, checkpoint, seconds)


def sample(measures: DataFrame) -> DataFrame:
    """The monitor's row, in the columns of the efficiency file."""
    row = measures.withColumns({
        "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), "wall_time": F.col("wall_s"), "avg_concurrent_gpus": F.col("avg_concurrent"),
        "gpu_util_ratio": F.col("utilisation"), "gpu_efficiency": F.col("efficiency"), "trial_throughput": F.col("throughput"), "pipeline_speedup": F.col("speedup"),
    })
    return row.select(*[F.col(name).cast(kind).alias(name) for name, kind in (c.split() for c in EFFICIENCY.split(", "))])
