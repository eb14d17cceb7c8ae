"""Result files and logs, written from the tables and read back by their sources."""

from __future__ import annotations

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.shared import new_path as shared_path
from ..sources import logs, sinks
from ..streaming import tail
from . import base
from .base import query


@query("""
    SELECT CAST(c_custkey AS INTEGER) AS rank, 'coarse' AS phase, c_acctbal AS score, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS val_score, c_custkey * 7 AS params, '{"cell": "gru", "seg, ment": "' || c_mktsegment || '"}' AS config_json
    FROM customer""")
def leaderboard_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaderboard whose last column holds quotes and commas."""
    path = shared_path(spark, "leaderboard")
    c = base.table(spark, sf_dir, "customer")
    config = F.concat(F.lit('{"cell": "gru", "seg, ment": "'), F.col("c_mktsegment"), F.lit('"}'))
    cells = {
        "rank": F.col("c_custkey"), "phase": F.lit("coarse"), "score": F.col("c_acctbal"), "val_score": F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")),
        "params": F.col("c_custkey") * 7, "config_json": config,
    }
    columns = [x.split() for x in logs.LEADERBOARD.split(", ")]
    rows = c.select(*[cells.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in columns])
    rows.write.option("header", True).option("escape", '"').csv(path)
    return logs.read_leaderboard(spark, path).select("rank", "phase", "score", "val_score", "params", "config_json")


@query("SELECT CAST(s_suppkey AS INTEGER) AS trial_id, 'serial' AS mode, round(s_acctbal / 7, 3) AS start_time_s, round(s_acctbal / 3, 3) AS end_time_s FROM supplier")
def timing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timing log in two parts, one of them with malformed rows, which are skipped."""
    path = shared_path(spark, "timing")
    s = base.table(spark, sf_dir, "supplier")
    cells = {"trial_id": F.col("s_suppkey"), "mode": F.lit("serial"), "start_time_s": F.col("s_acctbal") / 7, "end_time_s": F.col("s_acctbal") / 3}
    columns = [x.split() for x in logs.TIMING.split(", ")]
    sinks.append_timing(s.select(*[cells.get(name, F.lit(0)).cast(kind).alias(name) for name, kind in columns]), path)
    header = ",".join(name for name, _ in columns)
    spark.createDataFrame([(f"{header}\nx,serial,1,2\n7,serial,one,2,3,4,5,6,7,graph\n",)], "value string").coalesce(1).write.mode("append").text(path)
    return logs.read_timing(spark, path).select("trial_id", "mode", "start_time_s", "end_time_s")


@query("SELECT 'gru' AS cell, 'final' AS phase, max(n_nationkey)::DOUBLE AS score, CAST(NULL AS DOUBLE) AS val_score, CAST(count(*) AS BIGINT) AS params FROM nation")
def best_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A best configuration without some of its fields, which are null."""
    path = shared_path(spark, "best")
    n = base.table(spark, sf_dir, "nation").agg(F.max("n_nationkey").cast("double").alias("score"), F.count("*").alias("params"))
    config = F.create_map(F.lit("memory_cell"), F.lit("gru")).alias("config")
    n.select(config, F.lit("final").alias("phase"), "score", "params", F.create_map(F.lit("kind"), F.lit("one")).alias("distribution_metadata")).coalesce(1).write.json(path)
    return logs.checked_best(logs.read_best(spark, path)).select(F.col("config.memory_cell").alias("cell"), "phase", "score", "val_score", "params")


_LINES = "SELECT o_orderkey, o_orderkey % 7 AS trial, CASE WHEN o_orderkey % 3 = 0 THEN 'interaction_progress' WHEN o_orderkey % 3 = 1 THEN 'dispatch' ELSE 'partition_done' END AS event FROM orders"


@query(f"WITH l AS ({_LINES}) SELECT event, CAST(trial AS INTEGER) AS trial, count(*) AS n, max(o_orderkey)::DOUBLE AS last FROM l GROUP BY 1, 2")
def tailed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace log that is read as a stream, file by file, into a table."""
    path = shared_path(spark, "tail")
    o = base.table(spark, sf_dir, "orders")
    event = F.when(F.col("o_orderkey") % 3 == 0, "interaction_progress").when(F.col("o_orderkey") % 3 == 1, "dispatch").otherwise("partition_done")
    line = F.format_string("elapsed=%d.0s phase=train event=%s trial=%d stage=1/3", "o_orderkey", event, F.col("o_orderkey") % 7)
    o.select(F.explode(F.array(line, F.lit("no event here"))).alias("value")).write.text(f"{path}/log")
    tail.tail_trace(spark, f"{path}/log", f"{path}/table", f"{path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{path}/table")
    return rows.groupBy("event", "trial").agg(F.count("*").alias("n"), F.max("elapsed").alias("last"))


def _grow(lines: DataFrame, folder: str, share: float) -> None:
    """Writes a file for each part of lines (part, nth, value), as it is when a share of its bytes has been written. A task
    writes its files whole, so one that is repeated leaves the same."""

    def write(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("nth")
        data = "".join(f"{v}\n" for v in rows.column("value").to_pylist()).encode()
        system, root = FileSystem.from_uri(folder)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/{rows.column('part')[0].as_py()}.log") as f:
            f.write(data[: int(len(data) * share)])
        return pa.table({"n": pa.array([len(data)], pa.int64())})

    lines.groupBy("part").applyInArrow(write, "n long").write.format("noop").mode("overwrite").save()


@query(f"WITH l AS ({_LINES}) SELECT o_orderkey::DOUBLE AS elapsed, event, CAST(trial AS INTEGER) AS trial, 1 AS seen FROM l")
def growing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that are read three times while they grow, cut in the middle of lines: each line once, and none before its end."""
    path = shared_path(spark, "growing")
    o = base.table(spark, sf_dir, "orders")
    event = F.when(F.col("o_orderkey") % 3 == 0, "interaction_progress").when(F.col("o_orderkey") % 3 == 1, "dispatch").otherwise("partition_done")
    line = F.format_string("elapsed=%d.0s phase=train event=%s trial=%d stage=1/3", "o_orderkey", event, F.col("o_orderkey") % 7)
    lines = o.select(F.floor(F.col("o_orderkey") / 20000).alias("part"), F.col("o_orderkey").alias("nth"), line.alias("value"))
    for share in (0.3337, 0.71, 1.0):
        _grow(lines, f"{path}/log", share)
        tail.tail_trace(spark, f"{path}/log", f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/table").groupBy("elapsed", "event", "trial").agg(F.count("*").cast("int").alias("seen"))


@query(f"WITH l AS ({_LINES}) SELECT count(*) AS lines FROM l WHERE event <> 'dispatch'")
def tailed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = base.table(spark, sf_dir, "orders")
    event = F.when(F.col("o_orderkey") % 3 == 0, "interaction_progress").when(F.col("o_orderkey") % 3 == 1, "dispatch").otherwise("partition_done")
    trace = o.select(F.col("o_orderkey").alias("seq"), F.lit(1.0).alias("elapsed"), F.lit("train").alias("phase"), event.alias("event"), F.lit(1).alias("trial"), F.lit(1).alias("stage"))
    return tail.progress(trace).select("lines")


@query("""
    SELECT n_nationkey, CASE WHEN count(c_custkey) FILTER (c_custkey % 5 = 0) = 0 THEN 'N/A' ELSE printf('%.2f', CAST(sum(CASE WHEN c_custkey % 5 = 0 THEN round(c_acctbal * 100)::BIGINT END) AS DOUBLE) / 100) END AS text
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = base.table(spark, sf_dir, "nation").select("n_nationkey"), base.table(spark, sf_dir, "customer")
    some = c.filter("c_custkey % 5 = 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.sum(base.cents("c_acctbal")) / 100).alias("x"))
    return n.join(some, "n_nationkey", "left").select("n_nationkey", scalars.number_text(F.col("x"), 2).alias("text"))
