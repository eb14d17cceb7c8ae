"""The monitor's measures, kept up from batch to batch.

A batch of trace rows changes a state whose size does not grow with the run: dispatches without a completion, sums for
each stage, a bit for each trial, and of the timeline what is final and the tasks that reach beyond it. The number of
running tasks at a sample is final when no task can still be added there: before the earliest dispatch that is open, and
before the last row seen. So samples behind that point are summed up and forgotten, and those after it are counted from
the tasks that touch them. The row of measures is that of ``traces.monitor_bundle`` over all tasks so far.

Rows must arrive in the order of their times; a completion counts if its key's row before it is a dispatch. The state of a
batch is a folder of its own number, made from that of the batch before; a repeated batch makes it again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces
from ..operators.running import running_sum, sliced

OPEN = "trial int, stage int, seq long, start double"
SUMS = "stage int, n long, busy double, first_start double, last_end double, first_end double, base double"
TASKS = "trial int, stage int, start double, end double"
TRIALS = "bucket long, bits binary"
LINE = "t0 double, done long, running_sum double, running_max long, seen double"
TABLES = {"open": OPEN, "sums": SUMS, "tasks": TASKS, "trials": TRIALS, "line": LINE}


@dataclass(frozen=True)
class MonitorState:
    """The tables of a batch's state under a path; batch -1: nothing yet."""

    spark: SparkSession
    path: str
    step: float = 0.5

    def read(self, batch: int, name: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/batch={batch}/{name}")

    def _write(self, batch: int, name: str, rows: DataFrame) -> DataFrame:
        columns = [F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in TABLES[name].split(", "))]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/batch={batch}/{name}")
        return self.read(batch, name)

    def advance(self, batch: int, rows: DataFrame) -> int:
        """Takes in a batch of trace rows (stored: read several times); the number of tasks that it has completed."""
        before = batch - 1
        opened = self.read(before, "open").select("trial", "stage", "seq", F.col("start").alias("elapsed"), F.lit("dispatch").alias("event"))
        known = opened.unionByName(rows.filter("event in ('dispatch', 'complete') and trial is not null and stage is not null").select(*opened.columns))
        found = self._write(batch, "found", traces.pair_sequence(known))
        last = known.groupBy("trial", "stage").agg(F.max_by(F.struct("event", "seq", "elapsed"), "seq").alias("x")).filter("x.event = 'dispatch'")
        still = self._write(batch, "open", last.select("trial", "stage", "x.seq", F.col("x.elapsed").alias("start")))
        sums = self.read(before, "sums").unionByName(stage_sums(found))
        self._write(batch, "sums", merged(sums))
        place = F.col("trial").cast("long")
        bits = found.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        self._write(batch, "trials", self.read(before, "trials").unionByName(bits).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")))
        self._timeline(batch, found.select("trial", "stage", "start", "end"), still, rows)
        return found.count()

    def _timeline(self, batch: int, found: DataFrame, still: DataFrame, rows: DataFrame) -> None:
        """Moves the final part of the timeline on."""
        line = (self.read(batch - 1, "line").collect() or [None])[0]  # one row
        tasks = self.read(batch - 1, "tasks").unionByName(found)
        seen = rows.agg(F.max("elapsed")).first()[0]
        seen = max(x for x in (seen, line["seen"] if line else None, float("-inf")) if x is not None)
        horizon = min(x for x in (still.agg(F.min("start")).first()[0], seen) if x is not None)
        t0, done, total, most = (line["t0"], line["done"], line["running_sum"], line["running_max"]) if line else (None, 0, 0.0, 0)
        if not done:  # nothing is final, so the first sample may still move
            t0 = tasks.agg(F.min("start")).first()[0]
        if t0 is not None and horizon > t0:
            upto = max(done, math.ceil((horizon - t0) / self.step))  # samples before it are final
            counts = at_samples(tasks, t0, self.step, done)
            final = counts.withColumn("until", F.least("until", F.lit(upto))).filter("sample < until")
            more, top = final.agg(F.sum(F.col("running") * (F.col("until") - F.col("sample"))), F.max("running")).first()
            done, total, most = upto, total + float(more or 0), max(most, top or 0)
            tasks = tasks.filter(F.ceil((F.col("end") - t0) / self.step) > upto)
        self._write(batch, "tasks", tasks)
        self._write(batch, "line", self.spark.createDataFrame([(t0, done, total, most, seen)], LINE))

    def measures(self, batch: int, devices: int) -> DataFrame:
        """One row: ``traces.monitor_bundle`` over all tasks up to a batch, with their number and the last end."""
        line = self.read(batch, "line").first()
        sums = self.read(batch, "sums")
        end = sums.agg(F.max("last_end")).first()[0]
        trials = self.read(batch, "trials").agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("trials"))
        if end is None:
            sampled = self.spark.createDataFrame([(None, None)], "avg_concurrent double, max_concurrent long")
        else:
            last = math.floor((end - line["t0"]) / self.step) + 1  # samples there are
            counts = at_samples(self.read(batch, "tasks"), line["t0"], self.step, line["done"]).withColumn("until", F.least("until", F.lit(last))).filter("sample < until")
            rest = counts.agg(F.coalesce(F.sum(F.col("running") * (F.col("until") - F.col("sample"))), F.lit(0)).alias("s"), F.coalesce(F.max("running"), F.lit(0)).alias("m"))
            sampled = rest.select(((F.col("s") + line["running_sum"]) / last).alias("avg_concurrent"), F.greatest("m", F.lit(line["running_max"])).alias("max_concurrent"))
        whole = sums.agg(F.sum("n").alias("num_completed_tasks"), F.max("last_end").alias("elapsed_time_s"))
        return traces.bundle_of(sampled, sums, trials, devices).join(F.broadcast(whole), F.lit(True))  # one row each


TABLES["found"] = "trial int, stage int, seq long, start double, end double"


def stage_sums(tasks: DataFrame) -> DataFrame:
    return traces.stage_sums(tasks).select(*[c.split()[0] for c in SUMS.split(", ")])


def merged(sums: DataFrame) -> DataFrame:
    """One row a stage of the sums of several sets of tasks."""
    add, low, high = ([f(c).alias(c) for c in cs] for f, cs in ((F.sum, ("n", "busy", "base")), (F.min, ("first_start", "first_end")), (F.max, ("last_end",))))
    return sums.groupBy("stage").agg(*add, *low, *high)


def at_samples(tasks: DataFrame, t0: float, step: float, done: int) -> DataFrame:
    """(sample, until, running): tasks that run at samples from done on; a number holds for samples before until."""
    at = lambda c: F.greatest(F.ceil((F.col(c) - t0) / step), F.lit(done))
    change = F.explode(F.array(F.struct(at("start").alias("sample"), F.lit(1).alias("d")), F.struct(at("end").alias("sample"), F.lit(-1).alias("d"))))
    changes = tasks.select(change.alias("c")).groupBy("c.sample").agg(F.sum("c.d").alias("d"))
    counted = running_sum(sliced(changes, F.col("sample")), ["sample"], "running", F.col("d"))
    return traces.following(counted, "sample", "until").filter("until is not null").select("sample", "until", "running")
