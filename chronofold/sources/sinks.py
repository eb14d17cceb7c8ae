"""Writers of results and logs. Appends are new part files, so a task that runs again replaces its own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.trials import leaderboard
from .logs import EFFICIENCY, TIMING, format_trace


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def write_leaderboard(results: DataFrame, path: str) -> None:
    """The ranked results as CSV."""
    leaderboard(results).orderBy("rank").write.mode("overwrite").option("header", True).csv(path)


def write_best(results: DataFrame, path: str) -> None:
    """The first of the ranked results as JSON."""
    leaderboard(results).filter("rank = 1").write.mode("overwrite").json(path)


def append_timing(rows: DataFrame, path: str) -> None:
    """Timing rows with numbers rounded as they are shown."""
    rounded = {c: F.round(c, 3) for c in ("start_time_s", "end_time_s", "duration_s")} | {c: F.round(c, 6) for c in ("score", "mrr", "recall_at_k", "cumulative_best_score")}
    rows.select(*_columns(TIMING)).withColumns(rounded).write.mode("append").option("header", True).csv(path)


def append_trace(trace: DataFrame, path: str) -> None:
    format_trace(trace).select("value").write.mode("append").text(path)


def append_efficiency(samples: DataFrame, path: str) -> None:
    samples.select(*_columns(EFFICIENCY)).write.mode("append").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Any result table, such as a comparison, as JSON lines."""
    df.write.mode("overwrite").json(path)


def protocol(settings: dict) -> str:
    """The settings of a comparison as JSON text."""
    return json.dumps(settings, indent=2, sort_keys=True)


def summary_text(summary: DataFrame) -> str:
    """The lines of an efficiency summary; a row a metric, so it fits the driver."""
    rows = summary.orderBy("metric").collect()
    return "\n".join(f"{r['metric']:<24} min {r['min']:.4f}  max {r['max']:.4f}  mean {r['mean']:.4f}" for r in rows)
