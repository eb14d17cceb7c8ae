"""Run logs and result files: traces, efficiency samples, leaderboards, timings, best configurations, seeds, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running_max, sliced

EFFICIENCY = (
    "timestamp string, elapsed_time_s double, wall_time double, avg_concurrent_gpus double, gpu_util_ratio double, gpu_efficiency double, "
    "avg_stage_util double, max_stage_util double, trial_throughput double, pipeline_speedup double, speedup_efficiency double, num_completed_tasks int"
)
LEADERBOARD = (
    "rank int, phase string, eval_split string, score double, val_score double, test_score double, mrr double, recall_at_k double, "
    "params bigint, time_sec double, model string, config_json string"
)
TIMING = (
    "trial_id int, mode string, start_time_s double, end_time_s double, duration_s double, score double, mrr double, recall_at_k double, "
    "cumulative_best_score double, model string"
)


def _field(pattern: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")).cast(kind)


def parse_trace(lines: DataFrame) -> DataFrame:
    """Typed rows of trace lines (seq, value). Lines without elapsed and event are dropped, others keep nulls.

    Fields come from a generator, through which filters are not pushed down: each pattern is looked for once.
    """
    fields = F.struct(
        _field(r"elapsed=([\d.]+)s", "double").alias("elapsed"), _field(r"phase=(\w+)", "string").alias("phase"), _field(r"event=(\w+)", "string").alias("event"),
        _field(r"trial=(\d+)", "int").alias("trial"), _field(r"stage=(\d+)/\d+", "int").alias("stage"), _field(r"stage=\d+/(\d+)", "int").alias("total_stages"),
        _field(r"stage_duration_sec=([\d.]+)", "double").alias("duration"), _field(r"processed=(\d+)", "int").alias("processed"),
    )
    return lines.select("seq", F.inline(F.array(fields))).filter("elapsed is not null and event is not null")


def strict(trace: DataFrame) -> DataFrame:
    """Dispatches and completions that name a trial and a stage."""
    return trace.filter("trial is not null and stage is not null and event in ('dispatch', 'complete')")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    from .interactions import read_lines

    return parse_trace(read_lines(spark, path).withColumnRenamed("line_no", "seq"))


def format_trace(trace: DataFrame) -> DataFrame:
    """(seq, value): the line of each dispatch and completion."""
    text = lambda c: F.col(c).cast("string")
    wall = F.date_format(F.timestamp_seconds(F.col("elapsed")), "HH:mm:ss")
    stage = F.concat(F.lit(" stage="), text("stage"), F.lit("/"), text("total_stages"))
    duration = F.when(F.col("duration").isNotNull(), F.concat(F.lit(" stage_duration_sec="), F.format_string("%.2f", "duration"))).otherwise("")
    return trace.select(
        "seq",
        F.concat(F.lit("[pipeline-trace] wall="), wall, F.lit(" elapsed="), F.format_string("%.3f", "elapsed"), F.lit("s phase="), F.col("phase"), F.lit(" event="), F.col("event"),
                 F.lit(" trial="), text("trial"), F.coalesce(stage, F.lit("")), duration).alias("value"),
    )


def read_efficiency(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=EFFICIENCY)


def efficiency_numbers(samples: DataFrame) -> DataFrame:
    """Without the two columns of text and wall time; missing numbers are 0."""
    return samples.drop("timestamp", "wall_time").fillna(0)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=LEADERBOARD, escape='"')


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    """Timing rows; malformed ones are skipped."""
    return spark.read.csv(path, header=True, schema=TIMING, mode="DROPMALFORMED")


BEST = (
    "config map<string,string>, phase string, eval_split string, seed int, score double, val_score double, test_score double, mrr double, recall_at_k double, "
    "params bigint, time_sec double, seed_list array<int>, per_seed_metrics array<struct<seed:int,score:double,mrr:double,recall_at_k:double,time_sec:double>>, "
    "selected_val_score double, distribution_metadata map<string,string>"
)


def read_best(spark: SparkSession, path: str) -> DataFrame:
    """The best configuration of a run; what is missing is null."""
    return spark.read.json(path, schema=BEST, multiLine=True)


def checked_best(best: DataFrame) -> DataFrame:
    """Ends the query if configuration or metadata are missing."""
    bad = F.col("config").isNull() | F.col("distribution_metadata").isNull()
    return best.filter(F.when(bad, F.raise_error(F.lit("config and distribution_metadata must be objects")).cast("boolean")).otherwise(True))


def parse_seed_times(lines: DataFrame) -> DataFrame:
    """seed, serial_s, dp_s, pipeline_s of lines with three fields (no dp_s) or four."""
    c = F.split(F.trim("value"), r"\s*,\s*")
    n = F.size(c)
    number = lambda i: F.get(c, F.lit(i)).try_cast("double")
    rows = lines.select(
        F.get(c, F.lit(0)).try_cast("int").alias("seed"), number(1).alias("serial_s"), F.when(n >= 4, number(2)).alias("dp_s"), F.when(n >= 4, number(3)).otherwise(number(2)).alias("pipeline_s"), n.alias("n")
    )
    return rows.filter("seed is not null and n >= 3").drop("n")


def official_result(results: DataFrame) -> DataFrame:
    """results (mrr, recall_at_10, metrics, ...) with mrr and recall from the top level or, where there are none, from metrics."""
    return results.withColumns({c: F.coalesce(c, f"metrics.{c}") for c in ("mrr", "recall_at_10")}).drop("metrics")


def report_sections(lines: DataFrame) -> DataFrame:
    """(epoch, split, metric, value) of a report: a line with the epoch opens a section, lines with a value follow.

    lines: seq, value such as "epoch 3" or "val mrr 0.5".
    """
    epoch = F.nullif(F.regexp_extract("value", r"(?i)epoch\D*(\d+)", 1), F.lit("")).cast("int")
    opened = F.when(epoch.isNotNull(), F.struct("seq", epoch.alias("epoch")))  # the last one is the largest one
    lines = running_max(sliced(lines, F.col("seq")), ["seq"], "section", opened)
    pattern = r"(?i)(val|test)\w*\s+(mrr|rec@10)\D*\s([\d.]+)\s*$"
    rows = lines.select("section.epoch", *[F.lower(F.regexp_extract("value", pattern, i)).alias(n) for i, n in ((1, "split"), (2, "metric"), (3, "text"))])
    return rows.filter("text <> '' and epoch is not null").select("epoch", "split", "metric", F.col("text").cast("double").alias("value"))


def best_epoch(sections: DataFrame) -> DataFrame:
    """The test metrics of the epoch with the best validation mrr, the first of equal ones."""
    cell = lambda s, m: F.max(F.when((F.col("split") == s) & (F.col("metric") == m), F.col("value")))
    table = sections.groupBy("epoch").agg(cell("val", "mrr").alias("val_mrr"), cell("test", "mrr").alias("test_mrr"), cell("test", "rec@10").alias("test_recall"))
    best = F.max_by(F.struct("epoch", "val_mrr", "test_mrr", "test_recall"), F.struct(F.col("val_mrr"), -F.col("epoch")))
    return table.filter("val_mrr is not null").agg(best.alias("b")).select("b.*")
