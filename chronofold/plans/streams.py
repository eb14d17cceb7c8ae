"""Streaming queries, run over what is there to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import new_path as shared_path
from ..streaming import entities
from .base import query


#: A pattern, since a stream takes the name of a single file for a folder.
EVENTS = "event[s].parquet"


@query("SELECT event_id, round(epoch_us(ts) / 1e6 - coalesce(lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 3) AS gap FROM events")
def stream_user_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of users, event by event, from a stream with state."""
    path = shared_path(spark, "gaps")
    events = entities.event_stream(spark, f"{sf_dir}/{EVENTS}")
    return entities.run_to_end(entities.gaps(events), f"{path}/out", f"{path}/checkpoint").select("event_id", F.round("gap", 3).alias("gap"))


@query("""
    WITH w AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n FROM events GROUP BY 1)
    SELECT epoch_us(start) // 1000000 AS start_s, n FROM w WHERE start + INTERVAL 1 hour <= (SELECT max(ts) - INTERVAL 1 hour FROM events)""")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed."""
    path = shared_path(spark, "windows")
    events = entities.event_stream(spark, f"{sf_dir}/{EVENTS}")
    done = entities.run_to_end(entities.window_counts(events), f"{path}/out", f"{path}/checkpoint")
    return done.select(F.unix_seconds("start").alias("start_s"), "n")


@query("""
    WITH i AS (SELECT event_id, epoch_us(ts) / 1e6 AS ts, user_id * 2 AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 + 1 AS v FROM events),
    g AS (SELECT event_id, ts, u AS src, v AS dst FROM i UNION ALL SELECT event_id, ts, v, u FROM i)
    SELECT src, event_id, round(ts - coalesce(lag(ts) OVER n, 0), 3) AS gap, coalesce(array_to_string(array_agg(dst) OVER (n ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ','), '') AS neighbours,
           round(ts - lag(ts) OVER p, 3) AS pair_gap, row_number() OVER p AS weight
    FROM g WINDOW n AS (PARTITION BY src ORDER BY ts, event_id), p AS (PARTITION BY src, dst ORDER BY ts, event_id)""")
def stream_recent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours, gaps and weights as the events come in, from state with a value, a list and a map for each node."""
    path = shared_path(spark, "history")
    edges = entities.both_ways(entities.event_stream(spark, f"{sf_dir}/{EVENTS}"))
    with entities.rocks(spark):
        found = entities.run_to_end(entities.history(edges, 10), f"{path}/out", f"{path}/checkpoint")
    text = F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",")
    return found.select("src", "event_id", F.round("gap", 3).alias("gap"), text.alias("neighbours"), F.round("pair_gap", 3).alias("pair_gap"), "weight")
