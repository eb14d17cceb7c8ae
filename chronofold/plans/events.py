"""Ingest, order, splits, partitions and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..operators import stages, temporal
from ..operators.running import running_max, sliced
from ..operators.shared import checkpointed
from ..sources import interactions
from . import base
from .base import query


@query(f"WITH {base.I} SELECT line_no, raw_uid, raw_iid, ts, value FROM i")
def interactions_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.from_events(spark, sf_dir).select("line_no", "raw_uid", "raw_iid", "ts", F.col("features")[0].alias("value"))


def _csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines with every fault a file may have, by event number."""
    e = base.table(spark, sf_dir, "events")
    n = F.col("event_id")
    value = F.when(n % 41 == 0, "nan").when(n % 43 == 0, "abc").otherwise(F.col("value").cast("string"))
    full = F.concat_ws(",", F.concat("user_id", F.when(n % 7 == 0, ".9").otherwise("")), F.get_json_object("props", "$.k"), n.cast("string"), F.lit("x"), value)
    line = F.when(n % 97 == 0, "").when(n % 89 == 0, "User_ID,item,ts,label,f").when(n % 83 == 0, "1,2,3").otherwise(full)
    return e.select(n.alias("line_no"), line.alias("value"))


_CSV = """
    WITH l AS (
        SELECT event_id AS line_no, CASE WHEN event_id % 83 = 0 THEN 'fewer than 5 columns' WHEN event_id % 41 = 0 OR event_id % 43 = 0 THEN 'not a finite number' END AS problem,
               user_id AS raw_uid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS raw_iid, CAST(event_id AS DOUBLE) AS ts, value
        FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0)"""


@query(_CSV + " SELECT line_no, raw_uid, raw_iid, ts, value AS f0 FROM l WHERE problem IS NULL")
def csv_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = interactions.quarantine(interactions.parse_lines(_csv_lines(spark, sf_dir)))
    return good.select("line_no", "raw_uid", "raw_iid", "ts", F.col("features")[0].alias("f0"))


@query(_CSV + " SELECT line_no, problem FROM l WHERE problem IS NOT NULL")
def csv_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.quarantine(interactions.parse_lines(_csv_lines(spark, sf_dir)))[1]


@query("SELECT event_id, CAST(trunc(value) AS BIGINT) AS cut, CAST(trunc(-value) AS BIGINT) AS cut_negative FROM events")
def truncating_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events")
    return e.select("event_id", scalars.whole(F.col("value").cast("string")).alias("cut"), scalars.whole((-F.col("value")).cast("string")).alias("cut_negative"))


@query("SELECT event_id, CAST(r.pos AS INTEGER) AS pos, CASE r.pos WHEN 0 THEN value WHEN 1 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM events, range(8) r(pos)")
def feature_align_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("event_id", F.array(F.col("value"), F.lit(2.0)).alias("f"))
    return e.select("event_id", F.posexplode(vectors.align(F.col("f"), 8)).alias("pos", "x"))


@query("SELECT event_id, CAST(0 AS INTEGER) AS pos, value AS x FROM events")
def feature_align_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("event_id", F.array(F.col("value"), F.lit(2.0)).alias("f"))
    return e.select("event_id", F.posexplode(vectors.align(F.col("f"), 1)).alias("pos", "x"))


@query(f"WITH {base.E} SELECT raw_uid, user_id FROM u")
def dense_user_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.dense_ids(interactions.from_events(spark, sf_dir), "raw_uid", "line_no", "user_id")


@query(f"WITH {base.E} SELECT raw_iid, item_id FROM v")
def dense_item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.dense_ids(interactions.from_events(spark, sf_dir), "raw_iid", "line_no", "item_id")


@query(f"WITH {base.E}, f AS (SELECT * FROM e ORDER BY event_seq LIMIT 700) SELECT max(user_id) + 1 AS users, max(item_id) + 1 AS items FROM f")
def universe_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: ids are given over all events, the universe is that of the first 700."""
    return interactions.universe(interactions.normalise(interactions.from_events(spark, sf_dir), base.FEATURES, 700))


@query(f"WITH {base.E} SELECT event_seq, line_no, user_id, item_id FROM e ORDER BY event_seq LIMIT 700")
def max_events_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature."""
    return interactions.normalise(interactions.from_events(spark, sf_dir), base.FEATURES, 700).select("event_seq", "line_no", "user_id", "item_id")


@query(f"WITH {base.E} SELECT event_seq, line_no, ts, user_id, item_id FROM e")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.stream(spark, sf_dir).select("event_seq", "line_no", "ts", "user_id", "item_id")


@query("""
    SELECT l_orderkey * 100 + l_linenumber AS line_no, o_custkey AS raw_uid, l_partkey AS raw_iid,
           row_number() OVER (ORDER BY o_orderdate, l_orderkey * 100 + l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS event_seq
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def order_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream with many equal times: ties are broken by line."""
    rows = interactions.from_orders(spark, sf_dir).withColumns({"q": F.col("features")[0], "x": F.col("features")[1]})
    found = temporal.numbered(rows, ["ts", "line_no", "raw_iid", "q", "x"], F.floor(F.col("ts") / 86400.0), "event_seq")
    return found.select("line_no", "raw_uid", "raw_iid", "event_seq")


@query(f"WITH {base.S} SELECT event_seq, split FROM s")
def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.planned(spark, sf_dir).select("event_seq", "split")


@query(f"WITH {base.S} SELECT split, count(*) AS n FROM s GROUP BY split")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.planned(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {base.S} SELECT event_seq, user_id, item_id FROM s WHERE split IN ('train', 'val')")
def fit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base.planned(spark, sf_dir).select("event_seq", "user_id", "item_id", "split")
    return p.filter("split = 'train'").unionByName(p.filter("split = 'val'")).drop("split")


@query(f"WITH {base.P} SELECT event_seq, partition_id FROM p WHERE split = 'val'")
def split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.planned(spark, sf_dir).filter("split = 'val'").select("event_seq", "partition_id")


@query(f"WITH {base.P} SELECT event_seq, split, partition_id FROM p")
def partitions_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.planned(spark, sf_dir).select("event_seq", "split", "partition_id")


@query(f"WITH {base.S} SELECT event_seq, CAST(ntile(7) OVER (ORDER BY event_seq) - 1 AS INTEGER) AS chunk FROM s WHERE split = 'train'")
def partitions_by_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = base.table(spark, sf_dir, "events").count()
    first, count = temporal.split_starts(n)["train"]
    train = base.planned(spark, sf_dir).filter("split = 'train'")
    return train.select("event_seq", temporal.chunk_by_number(F.col("event_seq") - first, count, 7).alias("chunk"))


@query(f"WITH {base.S} SELECT split, 0 AS partition_id, count(*) AS n FROM s WHERE split = 'train' GROUP BY split")
def single_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a size the training part is one partition."""
    return temporal.partition_metadata(base.planned(spark, sf_dir, None)).filter("split = 'train'").select("split", "partition_id", "n")


@query(f"WITH {base.P} SELECT partition_id, event_seq, CAST(ntile(3) OVER (PARTITION BY partition_id ORDER BY event_seq) - 1 AS INTEGER) AS worker FROM p")
def worker_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.worker_chunks(base.planned(spark, sf_dir), 3).select("partition_id", "event_seq", "worker")


@query(f"WITH {base.P} SELECT split, partition_id, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM p GROUP BY 1, 2")
def partition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.partition_metadata(base.planned(spark, sf_dir))


@query(f"WITH {base.COSTS} SELECT partition_id, users, new_users, items, new_items FROM k")
def partition_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = base.planned(spark, sf_dir)
    users = stages.novelty(p, "user_id").toDF("partition_id", "users", "new_users")
    return users.join(stages.novelty(p, "item_id").toDF("partition_id", "items", "new_items"), "partition_id")


@query(f"WITH {base.COSTS} SELECT partition_id, split, n, cost FROM k")
def partition_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.partition_costs(base.planned(spark, sf_dir)).select("partition_id", "split", "n", "cost")


@query(f"WITH {base.COSTS} SELECT partition_id, CAST(ntile(3) OVER (ORDER BY start_ts, partition_id) - 1 AS INTEGER) AS stage FROM k")
def stage_groups_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.group_by_count(temporal.partition_metadata(base.planned(spark, sf_dir)), 3).select("partition_id", "stage")


_CUTS = f"""WITH {base.COSTS},
    r AS (SELECT partition_id, cost, row_number() OVER (ORDER BY start_ts, partition_id) AS pos, sum(cost) OVER (ORDER BY start_ts, partition_id) AS upto FROM k),
    t AS (SELECT max(upto) AS total, max(pos) AS m FROM r),
    c AS (SELECT x.pos AS c1, y.pos AS c2, pow(x.upto - total / 3, 2) + pow(y.upto - x.upto - total / 3, 2) + pow(total - y.upto - total / 3, 2) AS bad
          FROM r x JOIN r y ON x.pos < y.pos, t WHERE y.pos < m),
    best AS (SELECT c1, c2 FROM c ORDER BY round(bad, 6), c2, c1 LIMIT 1)"""


@query(_CUTS + " SELECT partition_id, CAST(CASE WHEN pos <= c1 THEN 0 WHEN pos <= c2 THEN 1 ELSE 2 END AS INTEGER) AS stage FROM r, best")
def stage_groups_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.group_by_cost(stages.partition_costs(base.planned(spark, sf_dir)), 3).select("partition_id", "stage")


@query(f"""WITH {base.COSTS}, g AS (SELECT *, CAST(ntile(3) OVER (ORDER BY start_ts, partition_id) - 1 AS INTEGER) AS stage FROM k)
    SELECT stage, count(*) AS partitions, CAST(sum(n) AS BIGINT) AS events, CAST(sum(users) AS BIGINT) AS users, CAST(sum(items) AS BIGINT) AS items, sum(cost) AS cost FROM g GROUP BY stage""")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stage_summary(stages.group_by_count(stages.partition_costs(base.planned(spark, sf_dir)), 3))


@query(f"""WITH {base.S} SELECT 'events' AS dataset, 0 AS max_events, 8 AS feature_dim, 0.01::DOUBLE AS lr, 0.7::DOUBLE AS train_ratio, 0.1::DOUBLE AS val_ratio, 10 AS k, 'mrr' AS selection_metric, 42 AS seed,
    count(*) FILTER (split = 'train') AS num_train_events, count(*) FILTER (split = 'val') AS num_val_events, count(*) FILTER (split = 'test') AS num_test_events FROM s""")
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run states about itself and its parts."""
    return temporal.run_metadata(base.planned(spark, sf_dir), {"dataset": "events", "lr": "0.01"})


@query(f"""WITH {base.COSTS},
    g AS (SELECT *, CAST(ntile(3) OVER (PARTITION BY split ORDER BY start_ts, partition_id) - 1 AS INTEGER) AS stage FROM k WHERE split <> 'test'),
    t AS (SELECT split, stage, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1, 2), w AS (SELECT *, CASE split WHEN 'train' THEN 1 ELSE 2 END AS workers FROM t),
    su AS (SELECT split, count(*) AS stages, CAST(sum(n) AS BIGINT) AS events, CAST(sum(workers) AS BIGINT) AS workers, max(workers) AS most FROM w GROUP BY 1)
    SELECT split, stages, events, workers, CASE WHEN workers <= 5 THEN 'fit' ELSE 'oversubscribed' END AS fit,
           array_to_string(list_filter([CASE WHEN split = 'train' AND most <= 1 AND stages > 1 THEN 'one worker a stage: no parallelism within stages' END, CASE WHEN workers < 5 THEN (5 - workers) || ' devices unused' END], lambda x: x IS NOT NULL), '; ') AS hints FROM su""")
def stage_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of training and validation by number of partitions, and hints for five devices."""
    costs = checkpointed(stages.partition_costs(base.planned(spark, sf_dir)))
    parts = [stages.grouped(costs.filter(F.col("split") == s), 3, "count").withColumn("workers", F.lit(w)) for s, w in (("train", 1), ("val", 2))]
    rows = parts[0].unionByName(parts[1]).groupBy("split", "stage").agg(F.sum("n").alias("n"), F.max("workers").alias("workers"))
    return stages.summary_hints(rows, 5).withColumn("hints", F.array_join("hints", "; "))


@query("SELECT DISTINCT user_id AS partition_id, CAST(42 + (user_id % 3) * 100000 + user_id AS BIGINT) AS seed FROM events")
def epoch_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events").select("user_id").distinct()
    return e.select(F.col("user_id").alias("partition_id"), scalars.epoch_seed(42, F.col("user_id") % 3, F.col("user_id")).alias("seed"))


@query("""
    WITH t AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS ts, max(epoch_us(ts) / 1e6) OVER (ORDER BY event_id) - 3600 AS mark FROM events)
    SELECT event_id, ts < mark AS late FROM t""")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events arrive an hour or more behind the latest before them: what a watermark would drop."""
    e = interactions.from_events(spark, sf_dir)
    rows = running_max(sliced(e, F.col("line_no")), ["line_no"], "_latest", F.col("ts"))
    mark = F.col("_latest") - 3600
    return rows.select(F.col("line_no").alias("event_id"), (F.col("ts") < mark).alias("late"))
