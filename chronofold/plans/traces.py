"""Run traces. The lines of a trace are made from all events: even ones dispatch, odd ones complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stages, traces
from ..operators.shared import checkpointed, new_path
from ..sources import logs
from ..streaming.monitor import MonitorState
from . import base
from .base import query

_T = """
    WITH t AS (SELECT event_id AS seq, event_id * 0.5::DOUBLE AS elapsed, CASE WHEN k % 2 = 0 THEN 'train' ELSE 'eval' END AS phase,
               CASE WHEN event_id % 2 = 0 THEN 'dispatch' ELSE 'complete' END AS event, CAST(user_id AS INTEGER) AS trial, CAST(k % 3 + 1 AS INTEGER) AS stage, CASE WHEN event_id % 2 = 1 THEN value END AS duration
               FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
    l AS (SELECT *, lag(event) OVER (PARTITION BY trial, stage ORDER BY seq) AS before, lag(elapsed) OVER (PARTITION BY trial, stage ORDER BY seq) AS s FROM t),
    k AS (SELECT trial, stage, seq, s AS st, elapsed AS en FROM l WHERE event = 'complete' AND before = 'dispatch')"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, value): trace lines of all events, with a line of noise after every tenth."""
    e = base.table(spark, sf_dir, "events")
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    typed = e.select(
        n.alias("seq"), (n * F.lit(0.5)).alias("elapsed"), F.when(k % 2 == 0, "train").otherwise("eval").alias("phase"), F.when(n % 2 == 0, "dispatch").otherwise("complete").alias("event"),
        F.col("user_id").alias("trial"), (k % 3 + 1).alias("stage"), F.lit(3).alias("total_stages"), F.when(n % 2 == 1, F.col("value")).alias("duration"),
    )
    noise = e.filter(n % 10 == 0).select(n.alias("seq"), F.lit("[other] warming up elapsed_sec=3.0 total=4").alias("value"))
    return logs.format_trace(typed).unionByName(noise)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.strict(logs.parse_trace(lines(spark, sf_dir)))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.pair_sequence(trace(spark, sf_dir))


@query(_T + " SELECT seq, elapsed, phase, event, trial, stage, duration FROM t")
def trace_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.parse_trace(lines(spark, sf_dir)).select("seq", "elapsed", "phase", "event", "trial", "stage", "duration")


@query(_T + " SELECT seq, trial, stage, 3 AS total_stages FROM t WHERE event IN ('dispatch', 'complete')")
def trace_parse_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).select("seq", "trial", "stage", "total_stages")


@query(_T + ", p AS (SELECT trial, stage, arg_max(elapsed, seq) FILTER (event = 'dispatch') AS st, arg_max(elapsed, seq) FILTER (event = 'complete') AS en FROM t GROUP BY 1, 2) SELECT trial, stage, st AS start, en AS \"end\" FROM p WHERE st IS NOT NULL AND en IS NOT NULL")
def pair_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.pair_last(trace(spark, sf_dir))


@query(_T + ' SELECT trial, stage, seq, st AS start, en AS "end" FROM k')
def pair_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir)


@query(_T + """, q AS (SELECT *, lag(event) OVER w AS b2, lag(elapsed) OVER w AS s2 FROM t WINDOW w AS (PARTITION BY phase, trial, stage ORDER BY seq))
    SELECT phase, trial, stage, seq, s2 AS start, elapsed AS "end", elapsed - s2 AS stage_duration FROM q WHERE event = 'complete' AND b2 = 'dispatch'""")
def pair_phase_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.pair_by_phase(trace(spark, sf_dir))


_SAMPLES = _T + ", b AS (SELECT min(st) AS t0, max(en) AS t1 FROM k), g AS (SELECT unnest(range(0, CAST(floor((t1 - t0) / 50) AS BIGINT) + 1)) AS sample, t0 FROM b), c AS (SELECT g.sample, count(k.seq) AS running FROM g LEFT JOIN k ON st <= t0 + sample * 50 AND en > t0 + sample * 50 GROUP BY 1)"


@query(_SAMPLES + " SELECT sample, running FROM c")
def concurrency_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.sampled_concurrency(tasks(spark, sf_dir), 50.0)


_SWEEP = _T + """, d AS (SELECT x AS p, sum(y) AS y FROM (SELECT st AS x, 1 AS y FROM k UNION ALL SELECT en, -1 FROM k) GROUP BY 1),
    w AS (SELECT p, CAST(sum(y) OVER (ORDER BY p) AS BIGINT) AS running, lead(p) OVER (ORDER BY p) AS until FROM d)"""


@query(_SWEEP + " SELECT p AS t, until, running FROM w WHERE until IS NOT NULL")
def concurrency_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.concurrency_steps(tasks(spark, sf_dir))


@query(_SWEEP + " SELECT round(sum(running * (until - p)) / (max(until) - min(p)), 6) AS mean_running, max(running) AS max_running FROM w WHERE until IS NOT NULL")
def concurrency_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.exact_concurrency(tasks(spark, sf_dir)).withColumn("mean_running", F.round("mean_running", 6))


@query(_T + " SELECT sum(en - st) AS busy_s, max(en) - min(st) AS wall_s, round(sum(en - st) / ((max(en) - min(st)) * 3), 6) AS efficiency FROM k")
def gpu_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.device_efficiency(tasks(spark, sf_dir), 3).withColumn("efficiency", F.round("efficiency", 6))


@query(_T + " SELECT stage, count(*) AS tasks, sum(en - st) AS busy_s, round(sum(en - st) / (max(en) - min(st)), 6) AS utilisation FROM k GROUP BY 1")
def stage_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.stage_utilisation(tasks(spark, sf_dir)).withColumn("utilisation", F.round("utilisation", 6))


@query(_T + " SELECT count(*) AS completed, round(CASE WHEN count(*) < 2 OR max(en) <= min(en) THEN 0 ELSE count(*) / (max(en) - min(en)) END, 6) AS throughput FROM k WHERE stage = (SELECT max(stage) FROM k)")
def trial_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trial_throughput(tasks(spark, sf_dir)).withColumn("throughput", F.round("throughput", 6))


_SPEED = "SELECT count(DISTINCT trial) AS trials, sum(en - st) FILTER (trial = 0) AS baseline_s, max(en) - min(st) AS actual_s FROM k"


@query(_T + f", x AS ({_SPEED}) SELECT trials, baseline_s, actual_s, round(baseline_s * trials / actual_s, 6) AS speedup, round(baseline_s / actual_s, 6) AS speedup_efficiency FROM x")
def pipeline_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = traces.pipeline_speedup(tasks(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("speedup", "speedup_efficiency")})


_BOTTLE = ", m AS (SELECT stage, avg(en - st) AS mean_s FROM k GROUP BY 1), bn AS (SELECT (SELECT stage FROM m ORDER BY mean_s DESC, stage LIMIT 1) AS stage, max(mean_s) AS mean_s, max(mean_s) / greatest(min(mean_s), 0.001) AS imbalance FROM m)"


@query(_T + _BOTTLE + " SELECT stage, round(mean_s, 6) AS mean_s, round(imbalance, 6) AS imbalance FROM bn")
def bottleneck_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.bottleneck(tasks(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_s", "imbalance")})


_BUNDLE = (
    _SAMPLES
    + _BOTTLE
    + """, sa AS (SELECT avg(running) AS avg_concurrent, max(running) AS max_concurrent FROM c),
    su AS (SELECT avg(u) AS avg_stage_util, max(u) AS max_stage_util, min(u) AS min_u FROM (SELECT sum(en - st) / (max(en) - min(st)) AS u FROM k GROUP BY stage)),
    de AS (SELECT sum(en - st) / ((max(en) - min(st)) * 3) AS efficiency FROM k),
    tp AS (SELECT count(*) AS completed, count(*) / (max(en) - min(en)) AS throughput FROM k WHERE stage = (SELECT max(stage) FROM k)),
    sp AS (SELECT baseline_s * trials / actual_s AS speedup FROM ("""
    + _SPEED
    + "))"
)


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.monitor_bundle(tasks(spark, sf_dir), 3, 50.0)


@query(_BUNDLE + " SELECT round(avg_concurrent, 6) AS avg_concurrent, max_concurrent, round(efficiency, 6) AS efficiency, round(avg_stage_util, 6) AS avg_stage_util, round(max_stage_util, 6) AS max_stage_util, round(throughput, 6) AS throughput, round(speedup, 6) AS speedup, completed FROM sa, su, de, tp, sp")
def monitor_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle(spark, sf_dir).select("max_concurrent", "completed", *[F.round(c, 6).alias(c) for c in ("avg_concurrent", "efficiency", "avg_stage_util", "max_stage_util", "throughput", "speedup")])


@query(_BUNDLE + """ SELECT array_to_string(list_filter([CASE WHEN avg_concurrent / 3 < 0.3 THEN 'low utilisation' WHEN avg_concurrent / 3 < 0.6 THEN 'moderate utilisation' END,
    CASE WHEN imbalance > 3 THEN 'severe imbalance' WHEN imbalance > 2 THEN 'imbalance' END, CASE WHEN speedup < 2 AND completed > 5 THEN 'low speedup' END,
    CASE WHEN min_u < 0.3 THEN 'idle stage' END], lambda x: x IS NOT NULL), ', ') AS advice FROM sa, su, tp, sp, bn""")
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.recommendations(bundle(spark, sf_dir)).select(F.array_join("advice", ", ").alias("advice"))


@query("""
    WITH f AS (SELECT 'value' AS metric, value AS v FROM events UNION ALL SELECT 'user', user_id::DOUBLE FROM events UNION ALL SELECT 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events)
    SELECT metric, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean FROM f GROUP BY 1""")
def efficiency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("value", F.col("user_id").cast("double").alias("user"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    return traces.summary(e, ["value", "user", "k"]).withColumn("mean", F.round("mean", 6))


@query("""
    WITH s AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, count(*) OVER (PARTITION BY user_id) AS total FROM events)
    SELECT event_id, CAST(idx AS INTEGER) AS idx, total FROM s WHERE idx = 1 OR idx % 100 = 0 OR idx = total""")
def progress_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    steps = base.table(spark, sf_dir, "events").select("event_id", F.row_number().over(w.orderBy("event_id")).alias("idx"), F.count("*").over(w).alias("total"))
    return traces.progress_events(steps)


_LATEST = _T + ", o AS (SELECT *, row_number() OVER (PARTITION BY phase, trial, stage ORDER BY seq DESC) AS n FROM t)"


@query(_LATEST + " SELECT phase, count(*) AS lines, max(elapsed) AS last_elapsed, CAST(count(*) FILTER (n = 1 AND event = 'dispatch') AS BIGINT) AS in_flight FROM o GROUP BY 1")
def heartbeat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.heartbeat(trace(spark, sf_dir))


@query(_LATEST + " SELECT stage, count(*) AS active FROM o WHERE n = 1 AND event = 'dispatch' GROUP BY 1")
def active_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.active_by_stage(trace(spark, sf_dir))


@query("""
    WITH g AS (SELECT s_suppkey, s_suppkey % 17 AS g, s_nationkey % 5 + 1 AS n FROM supplier)
    SELECT s_suppkey, CAST(stage AS INTEGER) AS stage, CASE WHEN g < n THEN 1 ELSE g // n + CASE WHEN stage >= n - g % n THEN 1 ELSE 0 END END AS workers
    FROM (SELECT *, unnest(range(n)) AS stage FROM g)""")
def worker_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workers of the stages of each supplier: up to sixteen for one to five stages."""
    s = base.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 17).alias("g"), (F.col("s_nationkey") % 5 + 1).cast("int").alias("n"))
    return stages.with_workers(s, F.col("g"), F.col("n")).select("s_suppkey", "stage", "workers")


@query(_T + """, x AS (SELECT stage, count(*) AS n, sum(en - st) AS busy FROM k GROUP BY 1), m AS (SELECT max(busy / n) AS most FROM x)
    SELECT stage, round(busy / n, 6) AS mean_s, repeat('█', CAST(floor(busy / n / most * 30) AS INTEGER)) AS bar FROM x, m""")
def timeline_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean durations of stages beside the longest one."""
    t = tasks(spark, sf_dir).withColumn("took", F.col("end") - F.col("start"))
    return traces.timeline(t.groupBy("stage").agg(F.avg("took").alias("mean_s")), "stage", {"mean_s": None}).select("stage", F.round("mean_s", 6).alias("mean_s"), F.col("mean_s_bar").alias("bar"))


@query("""
    WITH s AS (SELECT o_orderkey AS seq, (o_orderkey % 101) / 100.0::DOUBLE AS gpu_util_ratio, o_totalprice AS pipeline_speedup FROM orders), m AS (SELECT max(pipeline_speedup) AS most FROM s)
    SELECT seq, repeat('█', CAST(floor(gpu_util_ratio * 30) AS INTEGER)) || repeat('░', 30 - CAST(floor(gpu_util_ratio * 30) AS INTEGER)) AS used, repeat('█', CAST(floor(pipeline_speedup / most * 30) AS INTEGER)) AS speedup FROM s, m""")
def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an efficiency log as bars: a share of one fills its bar up, a speedup stands beside the largest."""
    o = base.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") % 101) / 100.0).alias("gpu_util_ratio"), F.col("o_totalprice").cast("double").alias("pipeline_speedup"))
    found = traces.timeline(o, "seq", {"gpu_util_ratio": 1.0, "pipeline_speedup": None})
    return found.select("seq", F.col("gpu_util_ratio_bar").alias("used"), F.col("pipeline_speedup_bar").alias("speedup"))


_BATCHED = _T + """, z AS (SELECT count(*) AS n FROM t), b AS (SELECT unnest([0, 1, 2]) AS batch),
    kb AS (SELECT b.batch, k.* FROM k, b, z WHERE seq < (batch + 1) * n // 3),
    tt AS (SELECT batch, min(st) AS t0, max(en) AS t1, count(*) AS completed, count(DISTINCT trial) AS trials, sum(en - st) AS busy, sum(en - st) FILTER (trial = 0) AS base FROM kb GROUP BY 1),
    x AS (SELECT kb.batch, ceil((st - t0) / 50.0) AS a, ceil((en - t0) / 50.0) AS o, floor((t1 - t0) / 50.0) AS last FROM kb JOIN tt USING (batch)),
    av AS (SELECT batch, sum(least(o, last + 1) - a) / max(last + 1) AS avg_concurrent FROM x GROUP BY 1),
    ch AS (SELECT batch, pt, sum(d) AS d FROM (SELECT batch, a AS pt, 1 AS d, last FROM x UNION ALL SELECT batch, o, -1, last FROM x) WHERE pt <= last GROUP BY 1, 2),
    mx AS (SELECT batch, CAST(max(running) AS BIGINT) AS max_concurrent FROM (SELECT batch, sum(d) OVER (PARTITION BY batch ORDER BY pt) AS running FROM ch) GROUP BY 1)"""


@query(_BATCHED + " SELECT batch, completed, trials, round(busy, 6) AS busy_s, round(avg_concurrent, 6) AS avg_concurrent, max_concurrent, round(base * trials / (t1 - t0), 6) AS speedup FROM tt JOIN av USING (batch) JOIN mx USING (batch)")
def monitor_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitor's measures after each of three batches of a trace, each from its own rows and the state before."""
    held = checkpointed(trace(spark, sf_dir))
    n = base.table(spark, sf_dir, "events").count()
    state, out = MonitorState(spark, new_path(spark, "monitor"), 50.0), []
    for batch in range(3):
        state.advance(batch, held.filter((F.col("seq") >= batch * n // 3) & (F.col("seq") < (batch + 1) * n // 3)))
        m = state.measures(batch, 3).withColumn("batch", F.lit(batch))
        out.append(m.select("batch", F.col("num_completed_tasks").alias("completed"), "trials", *[F.round(c, 6).alias(c) for c in ("busy_s", "avg_concurrent")], "max_concurrent", F.round("speedup", 6).alias("speedup")))
    return out[0].unionByName(out[1]).unionByName(out[2])
