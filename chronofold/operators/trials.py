"""Search results: leaderboards, choice of the best, seeds, diversity, comparisons and convergence.

A result has trial, family, score, params, time_s and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .running import running_max, running_sum, sliced, sliced_by


def order() -> list[Column]:
    """Best first: score, then fewer parameters, then less time; the trial decides between equals."""
    return [F.col("score").desc(), F.col("params"), F.col("time_s"), F.col("trial")]


def leaderboard(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds rank from 1, within each group of by (such as the split that was scored).

    Slices follow the whole order, so a board of many equal scores is no single task.
    """
    ranked = running_sum(sliced_by(results, order()), order(), "rank", F.lit(1), by or [])
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("_slice")


def top(results: DataFrame, k: int) -> DataFrame:
    return results.orderBy(*order()).limit(k)


def family_balanced(results: DataFrame, k: int, least: int = 1) -> DataFrame:
    """k results: the best least of each family in order of its name, then the best of the rest."""
    w = Window.partitionBy("family").orderBy(*order())
    ranked = results.withColumn("_own", F.row_number().over(w)).filter(F.col("_own") <= k)
    first = F.col("_own") <= least
    picked = ranked.orderBy(~first, F.when(first, F.col("family")), *order()).limit(k)
    return picked.drop("_own")


def running_best(results: DataFrame, position: str) -> DataFrame:
    """Adds best_so_far: the largest score up to each trial, at least 0."""
    best = running_max(sliced(results, F.col(position)), [position], "best_so_far", F.col("score"))
    return best.withColumn("best_so_far", F.greatest(F.lit(0.0), "best_so_far")).drop("_slice")


def convergence(results: DataFrame, ended: str) -> DataFrame:
    return running_best(results, ended).select("trial", ended, "best_so_far")


def multi_seed(results: DataFrame, values: list[str]) -> DataFrame:
    """One row an architecture: means over seeds, the seeds and their rows in order."""
    rows = F.sort_array(F.collect_list(F.struct("seed", *values)))
    return results.groupBy("arch").agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("seeds"), rows.alias("per_seed"))


def mean_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population standard deviation, 0 for one value."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))


def top_scores(results: DataFrame, k: int = 5) -> DataFrame:
    """Mean, standard deviation and maximum of the k best scores; a score of 0 or null falls back to mrr, then to 0."""
    score = F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.nullif(F.col("mrr"), F.lit(0.0)), F.lit(0.0))
    best = results.select(score.alias("s"), "trial").orderBy(F.col("s").desc(), "trial").limit(k)
    return best.agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.max("s").alias("max"))


def field(name: str, config: str = "config_json") -> Column:
    """A field of a configuration, null for bad JSON."""
    return F.get_json_object(F.col(config), f"$.{name}")


def diversity(results: DataFrame, fields: list[str], config: str = "config_json") -> DataFrame:
    """Rows, and of each field its number of values and the sorted values."""
    found = results.select(*[field(f, config).alias(f) for f in fields])
    counts = [F.countDistinct(f).alias(f"n_{f}") for f in fields]
    return found.agg(F.count("*").alias("rows"), *counts, *[F.array_join(F.sort_array(F.collect_set(f)), ",").alias(f"set_{f}") for f in fields])


def fingerprint(fields: list[str], config: str = "config_json") -> Column:
    return F.concat_ws("|", *[F.coalesce(field(f, config), F.lit("")) for f in fields])


def best_by_fingerprint(results: DataFrame, key: str = "fingerprint") -> DataFrame:
    return results.groupBy(key).agg(F.max("score").alias("score"))


def overlap(a: DataFrame, b: DataFrame, key: str = "fingerprint", tolerance: float = 0.08) -> DataFrame:
    """Architectures in both results with the difference of their best scores."""
    x, y = best_by_fingerprint(a, key).withColumnRenamed("score", "score_a"), best_by_fingerprint(b, key).withColumnRenamed("score", "score_b")
    out = x.join(y, key).withColumn("diff", F.col("score_b") - F.col("score_a"))
    return out.withColumn("close", F.abs("diff") < tolerance)


def winner(a: Column, b: Column, a_name: str = "a", b_name: str = "b", tolerance: float = 1e-6, smaller: bool = False) -> Column:
    """Which value is better, tie within the tolerance, null where one is missing."""
    d = (b - a) if smaller else (a - b)
    return F.when(d > tolerance, a_name).when(d < -tolerance, b_name).when(d.isNotNull(), "tie")


def best_method(values: dict[str, Column], smaller: bool = False) -> Column:
    """The name of the best value that is not null; the first named wins a tie."""
    rows = F.array(*[F.when(v.isNotNull(), F.struct((v if smaller else -v).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (n, v) in enumerate(values.items())])
    return F.get(F.sort_array(F.array_compact(rows)), F.lit(0))["n"]


def win_counts(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    return df.agg(*[F.sum((F.col(column) == n).cast("long")).alias(f"wins_{n}") for n in names])


def outer_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key, with the difference where both have one."""
    x, y = a.select(key, F.col("score").alias("score_a")), b.select(key, F.col("score").alias("score_b"))
    return x.join(y, key, "full").withColumn("delta", F.col("score_b") - F.col("score_a"))


def within_noise(stats: DataFrame) -> DataFrame:
    """Adds whether two means differ by less than the larger deviation. stats: mean_a, std_a, mean_b, std_b."""
    return stats.withColumn("within_noise", F.abs(F.col("mean_a") - F.col("mean_b")) < F.greatest("std_a", "std_b", F.lit(1e-6)))


def convergence_grid(points: DataFrame, width: int = 52, height: int = 10) -> DataFrame:
    """(row, col, glyph): the cells of a chart; a cell of several series is *. points: series, x, y from 0 up."""
    most = points.agg(F.greatest(F.max("x"), F.lit(1e-9)).alias("mx"), F.greatest(F.max("y"), F.lit(1e-9)).alias("my"))
    cell = lambda v, m, n: F.least(F.floor(F.col(v) / F.col(m) * (n - 1) + 0.5), F.lit(n - 1)).cast("int")
    placed = points.join(F.broadcast(most), F.lit(True)).select("series", cell("x", "mx", width).alias("col"), (F.lit(height - 1) - cell("y", "my", height)).alias("row"))
    return placed.groupBy("row", "col").agg(F.when(F.countDistinct("series") > 1, "*").otherwise(F.min("series")).alias("glyph"))


def reward_average(rewards: DataFrame, by: str, position: str, value: str, keep: float = 0.9) -> DataFrame:
    """The moving baseline after all rewards of each group: keep * old + (1 - keep) * reward, from 0."""
    rows = F.sort_array(F.collect_list(F.struct(position, value)))
    return rewards.groupBy(by).agg(F.aggregate(rows, F.lit(0.0), lambda s, r: s * keep + (1.0 - keep) * r[value]).alias("baseline"))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value_a, value_b) where two one-row tables of run settings disagree on a key that both have."""
    flat = lambda df: df.selectExpr(f"stack({len(keys)}, " + ", ".join(f"'{k}', cast({k} as string)" for k in keys) + ") as (key, value)").filter("value is not null")
    return flat(a).withColumnRenamed("value", "value_a").join(flat(b).withColumnRenamed("value", "value_b"), "key").filter("value_a <> value_b")


def throughput(runs: DataFrame) -> DataFrame:
    """Adds trials an hour and seconds a trial. runs: n_trials, wall_s."""
    return runs.withColumn("trials_per_hour", scalars.per_hour(F.col("n_trials"), F.col("wall_s"))).withColumn("s_per_trial", scalars.ratio(F.col("wall_s"), F.col("n_trials").cast("double")))


def every_nth(df: DataFrame, position: str, step: int) -> DataFrame:
    """Rows 1, 1 + step, 1 + 2 step, ... in order."""
    return running_sum(sliced(df, F.col(position)), [position], "_n", F.lit(1)).filter(F.col("_n") % step == 1 % step).drop("_n", "_slice")


def last_rows(df: DataFrame, position: str, n: int) -> DataFrame:
    return df.orderBy(F.col(position).desc()).limit(n)
