"""Analysis of run traces: pairing of dispatches and completions, concurrency, utilisation, throughput, speedup.

A trace has seq, elapsed, phase, event, trial, stage, total_stages, duration. Tasks have trial, stage, start, end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .running import following, running_sum, sliced
from .shared import checkpointed

KEY = ["trial", "stage"]


def pair_last(trace: DataFrame) -> DataFrame:
    """One task for each (trial, stage): its last dispatch and its last completion, later ones overwrite earlier ones."""
    known = trace.filter(F.col("trial").isNotNull() & F.col("stage").isNotNull())
    last = lambda event: F.max_by(F.when(F.col("event") == event, F.col("elapsed")), F.when(F.col("event") == event, F.col("seq")))
    return known.groupBy(*KEY).agg(last("dispatch").alias("start"), last("complete").alias("end")).filter("start is not null and end is not null")


def pair_sequence(trace: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A task for each completion that directly follows a dispatch of the same key, so repeats stay apart."""
    by = by or KEY
    known = trace.filter(F.col("event").isin("dispatch", "complete"))
    w = Window.partitionBy(*by).orderBy("seq")
    known = known.withColumn("_event", F.lag("event").over(w)).withColumn("start", F.lag("elapsed").over(w))
    return known.filter("event = 'complete' and _event = 'dispatch'").select(*by, "seq", "start", F.col("elapsed").alias("end"))


def pair_by_phase(trace: DataFrame) -> DataFrame:
    """Pairs within (phase, trial, stage), with the duration of the stage."""
    return pair_sequence(trace, ["phase", *KEY]).withColumn("stage_duration", F.col("end") - F.col("start"))


def concurrency_steps(tasks: DataFrame) -> DataFrame:
    """(t, until, running): the exact number of running tasks between neighbouring starts and ends, by a sweep line."""
    change = F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d"))))
    steps = tasks.select(change.alias("c")).groupBy("c.t").agg(F.sum("c.d").alias("d"))
    steps = sliced(steps, F.col("t"))
    steps = following(running_sum(steps, ["t"], "running", F.col("d")), "t", "until")
    return steps.filter("until is not null").select("t", "until", "running")


def exact_concurrency(tasks: DataFrame) -> DataFrame:
    """Mean (over time) and largest number of running tasks."""
    steps = concurrency_steps(tasks)
    span = F.max("until") - F.min("t")
    return steps.agg((F.sum(F.col("running") * (F.col("until") - F.col("t"))) / F.nullif(span, F.lit(0.0))).alias("mean_running"), F.max("running").alias("max_running"))


def sampled_concurrency(tasks: DataFrame, step: float) -> DataFrame:
    """(sample, running) at the first start and every step seconds to the last end; a task runs from start up to end.

    A task adds one to the first sample it covers and takes it away after the last, and a running sum fills the rest,
    so there is no join of samples with tasks.
    """
    bounds = tasks.agg(F.min("start").alias("t0"), F.max("end").alias("t1"))
    samples = bounds.select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / step))).alias("sample"))
    placed = tasks.join(F.broadcast(bounds), F.lit(True))  # one row
    at = lambda c: F.ceil((F.col(c) - F.col("t0")) / step)
    change = F.explode(F.array(F.struct(at("start").alias("sample"), F.lit(1).alias("d")), F.struct(at("end").alias("sample"), F.lit(-1).alias("d"))))
    changes = placed.select(change.alias("c")).groupBy("c.sample").agg(F.sum("c.d").alias("d"))
    rows = sliced(samples.join(changes, "sample", "left"), F.col("sample"))
    return running_sum(rows, ["sample"], "running", F.coalesce("d", F.lit(0))).select("sample", "running")


def device_efficiency(tasks: DataFrame, devices: int) -> DataFrame:
    """Busy seconds over wall seconds times devices."""
    busy, wall = F.sum(F.col("end") - F.col("start")), F.max("end") - F.min("start")
    return tasks.agg(busy.alias("busy_s"), wall.alias("wall_s"), (busy / F.nullif(wall * devices, F.lit(0.0))).alias("efficiency"))


def stage_utilisation(tasks: DataFrame) -> DataFrame:
    """Of each stage: busy seconds over the seconds from its first start to its last end."""
    busy, wall = F.sum(F.col("end") - F.col("start")), F.max("end") - F.min("start")
    return tasks.groupBy("stage").agg(F.count("*").alias("tasks"), busy.alias("busy_s"), (busy / F.nullif(wall, F.lit(0.0))).alias("utilisation"))


def trial_throughput(tasks: DataFrame) -> DataFrame:
    """Completions of the last stage a second, from the first to the last of them; 0 for fewer than two."""
    last = tasks.agg(F.max("stage").alias("stage"))
    done = tasks.join(F.broadcast(last), "stage")  # one row
    n, span = F.count("*"), F.max("end") - F.min("end")
    return done.agg(n.alias("completed"), F.when((n < 2) | (span <= 0), 0.0).otherwise(n / span).alias("throughput"))


def pipeline_speedup(tasks: DataFrame, baseline_trial: int = 0) -> DataFrame:
    """Seconds that one trial after the other would take, by the baseline trial, over those it took."""
    n = F.countDistinct("trial")
    base = F.sum(F.when(F.col("trial") == baseline_trial, F.col("end") - F.col("start")))
    took = F.max("end") - F.min("start")
    out = tasks.agg(n.alias("trials"), base.alias("baseline_s"), took.alias("actual_s"), (base * n / F.nullif(took, F.lit(0.0))).alias("speedup"))
    return out.withColumn("speedup_efficiency", F.col("speedup") / F.col("trials"))


def bottleneck(tasks: DataFrame) -> DataFrame:
    """The stage with the largest mean duration, and how many times the smallest mean that is."""
    means = tasks.groupBy("stage").agg(F.avg(F.col("end") - F.col("start")).alias("mean_s"))
    return means.agg(
        F.max_by("stage", F.struct(F.col("mean_s"), -F.col("stage"))).alias("stage"), F.max("mean_s").alias("mean_s"),
        (F.max("mean_s") / F.greatest(F.min("mean_s"), F.lit(0.001))).alias("imbalance"),
    )


def recommendations(measures: DataFrame) -> DataFrame:
    """Adds advice: messages for a low utilisation, imbalanced stages and a low speedup.

    measures: utilisation, imbalance, speedup, completed, min_stage_utilisation.
    """
    messages = [
        F.when(F.col("utilisation") < 0.3, "low utilisation").when(F.col("utilisation") < 0.6, "moderate utilisation"),
        F.when(F.col("imbalance") > 3.0, "severe imbalance").when(F.col("imbalance") > 2.0, "imbalance"),
        F.when((F.col("speedup") < 2.0) & (F.col("completed") > 5), "low speedup"),
        F.when(F.col("min_stage_utilisation") < 0.3, "idle stage"),
    ]
    return measures.withColumn("advice", F.array_compact(F.array(*messages)))


def stage_sums(tasks: DataFrame) -> DataFrame:
    """A row for each stage: what all measures but the samples need of its tasks."""
    took = F.col("end") - F.col("start")
    return tasks.groupBy("stage").agg(
        F.count("*").alias("n"), F.sum(took).alias("busy"), F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.min("end").alias("first_end"),
        F.sum(F.when(F.col("trial") == 0, took)).alias("base"),
    )


def bundle_of(sampled: DataFrame, sums: DataFrame, trials: DataFrame, devices: int) -> DataFrame:
    """One row with all measures. sampled: avg_concurrent, max_concurrent; sums: those of stages; trials: how many."""
    used = F.col("busy") / F.nullif(F.col("last_end") - F.col("first_start"), F.lit(0.0))
    means = F.col("busy") / F.col("n")
    row = sums.agg(
        F.sum("busy").alias("busy_s"), (F.max("last_end") - F.min("first_start")).alias("wall_s"), F.avg(used).alias("avg_stage_util"), F.max(used).alias("max_stage_util"), F.min(used).alias("min_stage_utilisation"),
        F.max_by(F.struct("n", (F.col("last_end") - F.col("first_end")).alias("ends")), "stage").alias("_last"), F.sum("base").alias("baseline_s"),
        F.max_by("stage", F.struct(means, -F.col("stage"))).alias("bottleneck_stage"), F.max(means).alias("mean_s"), (F.max(means) / F.greatest(F.min(means), F.lit(0.001))).alias("imbalance"),
    )
    row = row.join(F.broadcast(trials), F.lit(True))  # one row each
    n, ends, wall = F.col("_last.n"), F.col("_last.ends"), F.nullif(F.col("wall_s"), F.lit(0.0))
    row = row.withColumns({
        "efficiency": F.col("busy_s") / (wall * devices), "completed": F.coalesce(n, F.lit(0)), "throughput": F.when((F.coalesce(n, F.lit(0)) < 2) | (ends <= 0), 0.0).otherwise(n / ends),
        "actual_s": F.col("wall_s"), "speedup": F.col("baseline_s") * F.col("trials") / wall,
    }).withColumn("speedup_efficiency", F.col("speedup") / F.col("trials")).drop("_last")
    return sampled.join(F.broadcast(row), F.lit(True)).withColumn("utilisation", F.col("avg_concurrent") / devices)  # one row each


def monitor_bundle(tasks: DataFrame, devices: int, step: float = 0.5) -> DataFrame:
    """One row with all measures of a trace: those of the functions above, of one reading of the tasks but for the samples."""
    tasks = checkpointed(tasks)
    sampled = sampled_concurrency(tasks, step).agg(F.avg("running").alias("avg_concurrent"), F.max("running").alias("max_concurrent"))
    return bundle_of(sampled, stage_sums(tasks), tasks.agg(F.countDistinct("trial").alias("trials")), devices)


def summary(samples: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, min, max, mean) of some columns."""
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    flat = samples.selectExpr(f"stack({len(columns)}, {pairs}) as (metric, value)")
    return flat.groupBy("metric").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def timeline(rows: DataFrame, order: str, columns: dict[str, float | None], width: int = 30) -> DataFrame:
    """rows with a bar for each column: beside a whole, which fills the bar up, or (None) beside the column's largest value."""
    free = [c for c, whole in columns.items() if whole is None]
    if free:
        most = rows.agg(*[F.max(c).alias(f"_most_{c}") for c in free])  # one row
        rows = rows.join(F.broadcast(most), F.lit(True))
    for c, whole in columns.items():
        n = F.floor(F.col(c) / (F.lit(whole) if whole else F.col(f"_most_{c}")) * width).cast("int")
        bar = F.repeat(F.lit("█"), n)
        rows = rows.withColumn(f"{c}_bar", F.concat(bar, F.repeat(F.lit("░"), width - n)) if whole else bar)
    return rows.drop(*[f"_most_{c}" for c in free])


def progress_events(steps: DataFrame, every: int = 100) -> DataFrame:
    """The events a worker reports: the first, the last and every hundredth of its partition. steps: idx, total."""
    every = max(100, every)
    return steps.filter((F.col("idx") == 1) | (F.col("idx") % every == 0) | (F.col("idx") == F.col("total")))


def heartbeat(trace: DataFrame) -> DataFrame:
    """Of each phase: progress lines, tasks in flight and the last line's time."""
    w = Window.partitionBy("phase", *KEY).orderBy(F.col("seq").desc())
    latest = trace.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    flying = latest.groupBy("phase").agg(F.sum((F.col("event") == "dispatch").cast("long")).alias("in_flight"))
    lines = trace.groupBy("phase").agg(F.count("*").alias("lines"), F.max("elapsed").alias("last_elapsed"))
    return lines.join(flying, "phase")


def active_by_stage(trace: DataFrame) -> DataFrame:
    """Tasks that are dispatched and not complete, by stage."""
    w = Window.partitionBy("phase", *KEY).orderBy(F.col("seq").desc())
    latest = trace.withColumn("_n", F.row_number().over(w)).filter("_n = 1 and event = 'dispatch'")
    return latest.groupBy("stage").agg(F.count("*").alias("active"))


def with_bars(df: DataFrame, value: str, width: int = 20) -> DataFrame:
    """Adds a bar that shows value against the largest one."""
    most = df.agg(F.max(value).alias("_most"))  # one row
    return df.join(F.broadcast(most), F.lit(True)).withColumn("bar", scalars.bar(F.col(value), F.col("_most"), width)).drop("_most")
