"""Result files and reports, made from the tables and read by the parsers of run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..search import space
from ..sources import logs
from . import base
from .base import query


@query("""
    SELECT CAST(s_suppkey AS INTEGER) AS seed, s_acctbal AS serial_s, CASE WHEN s_suppkey % 3 > 0 THEN 2.5::DOUBLE END AS dp_s, CASE WHEN s_suppkey % 3 > 0 THEN 7.0::DOUBLE ELSE 2.5::DOUBLE END AS pipeline_s
    FROM supplier""")
def seed_times_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three or four fields."""
    s = base.table(spark, sf_dir, "supplier")
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string"), F.lit(" 2.5"), F.when(F.col("s_suppkey") % 3 > 0, "7"))
    return logs.parse_seed_times(s.select(line.alias("value")))


_SECTIONS = """
    WITH p AS (SELECT o_custkey AS epoch, o_orderkey, round(o_totalprice * 100)::BIGINT % 10000 AS v FROM orders),
    m AS (SELECT epoch, max(v)::DOUBLE AS val_mrr, min(v)::DOUBLE AS test_mrr, count(*)::DOUBLE AS test_recall FROM p GROUP BY 1)"""


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with a section for each customer: its largest, smallest and number of orders stand for metrics."""
    o = base.table(spark, sf_dir, "orders")
    m = o.groupBy("o_custkey").agg(F.max(base.cents("o_totalprice") % 10000).alias("a"), F.min(base.cents("o_totalprice") % 10000).alias("b"), F.count("*").alias("c"))
    parts = [F.concat(F.lit("=== epoch "), F.col("o_custkey").cast("string"))] + [F.concat(F.lit(t), F.col(c).cast("string")) for t, c in (("val mrr ", "a"), ("test mrr ", "b"), ("test rec@10 ", "c"))] + [F.lit("done")]
    rows = m.select("o_custkey", F.posexplode(F.array(*parts)).alias("pos", "value"))
    return rows.select((F.col("o_custkey") * 10 + F.col("pos")).alias("seq"), "value")


@query(_SECTIONS + " SELECT CAST(epoch AS INTEGER) AS epoch, 'val' AS split, 'mrr' AS metric, val_mrr AS value FROM m UNION ALL SELECT epoch, 'test', 'mrr', test_mrr FROM m UNION ALL SELECT epoch, 'test', 'rec@10', test_recall FROM m")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.report_sections(report_lines(spark, sf_dir))


@query(_SECTIONS + " SELECT CAST(epoch AS INTEGER) AS epoch, val_mrr, test_mrr, test_recall FROM m ORDER BY val_mrr DESC, epoch LIMIT 1")
def report_sections_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.best_epoch(logs.report_sections(report_lines(spark, sf_dir)))


@query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0.25::DOUBLE WHEN s_suppkey % 3 = 1 THEN s_acctbal END AS mrr, CASE WHEN s_suppkey % 3 = 1 THEN 0.5::DOUBLE END AS recall_at_10 FROM supplier""")
def official_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics at the top level, below metrics, or nowhere."""
    n, bal = F.col("s_suppkey") % 3, F.col("s_acctbal").cast("string")
    text = F.when(n == 0, F.lit('{"mrr": 0.25}')).when(n == 1, F.concat(F.lit('{"metrics": {"mrr": '), bal, F.lit(', "recall_at_10": 0.5}}'))).otherwise(F.lit("{}"))
    parsed = F.from_json(text, "mrr double, recall_at_10 double, metrics struct<mrr: double, recall_at_10: double>")
    return logs.official_result(base.table(spark, sf_dir, "supplier").select("s_suppkey", parsed.alias("r")).select("s_suppkey", "r.*"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 1 WHEN s_suppkey % 4 = 1 THEN 1 ELSE CAST(s_suppkey % 4 AS INTEGER) END AS devices FROM supplier")
def visible_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey") % 4
    text = F.when(n == 0, F.lit(None).cast("string")).when(n == 1, " 0 ,, ").when(n == 2, "0,1").otherwise("0, 1,2 ")
    return base.table(spark, sf_dir, "supplier").select("s_suppkey", scalars.visible_devices(text).alias("devices"))


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS flag FROM supplier")
def switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey") % 5
    text = F.when(n == 0, "ON").when(n == 1, " yes ").when(n == 2, "off").when(n == 3, "maybe")
    return base.table(spark, sf_dir, "supplier").select("s_suppkey", scalars.switched_on(text, True).alias("flag"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE '5-LOW' END AS chosen FROM orders")
def choose_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "orders").select("o_orderkey", scalars.choose(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], "5-LOW").alias("chosen"))


_DRAWN = """
    WITH c AS (SELECT o_orderkey, o_custkey, (['recurrent', 'graph'])[o_orderkey % 2 + 1] AS model, (['agg', 'peer'])[o_orderkey // 2 % 2 + 1] AS message_mode,
          (['mean', 'sum', 'attn', 'none'])[o_orderkey // 4 % 4 + 1] AS event_agg, (['rnn', 'gru', 'lstm', 'add'])[o_orderkey // 16 % 4 + 1] AS memory_cell FROM orders),
    s AS (SELECT o_orderkey, o_custkey, model, CASE WHEN model = 'recurrent' THEN 'peer' ELSE message_mode END AS message_mode,
          CASE WHEN model = 'recurrent' OR message_mode = 'peer' THEN 'none' ELSE event_agg END AS event_agg, CASE WHEN model = 'recurrent' AND memory_cell = 'add' THEN 'gru' ELSE memory_cell END AS memory_cell FROM c)"""


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_custkey, model, message_mode, event_agg, memory_cell): every order stands for the configuration of its number."""
    o = base.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", *space.decoded(F.col("o_orderkey"), space.MINI))


@query(_DRAWN + " SELECT o_orderkey, model, message_mode, event_agg, memory_cell FROM c")
def space_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(spark, sf_dir).drop("o_custkey")


@query(_DRAWN + " SELECT model, message_mode, event_agg, memory_cell, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM s GROUP BY ALL")
def sanitised_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each canonical configuration is drawn, and by how many customers."""
    found = space.sanitised(drawn(spark, sf_dir))
    return found.groupBy("model", "message_mode", "event_agg", "memory_cell").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query(_DRAWN + " SELECT o_custkey, count(*) AS trials, count(DISTINCT (model, message_mode, event_agg, memory_cell)) AS architectures FROM s GROUP BY 1")
def signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different architectures among the trials of each customer."""
    d = drawn(spark, sf_dir)
    signed = space.with_signature(space.sanitised(d.drop("o_orderkey")).withColumn("_of", F.col("o_custkey")).drop("o_custkey").withColumnRenamed("_of", "zz_of"))
    return signed.groupBy(F.col("zz_of").alias("o_custkey")).agg(F.count("*").alias("trials"), F.countDistinct("signature").alias("architectures"))


@query("""
    WITH n AS (SELECT (SELECT count(*) FROM customer) AS u, (SELECT count(*) FROM part) AS i),
    c AS (SELECT o_orderkey, ([32, 64, 128])[o_orderkey % 3 + 1] AS d, o_custkey % 2 AS s, ([1, 3, 4])[o_custkey % 3 + 1] AS g FROM orders)
    SELECT o_orderkey, CAST(2 * d + s * (u + i) * d + 2 * g * d * ((2 * d + 2 * d * s + 4 + 2) + d + 2) + 2 * d + (d + s * d) * d + d + d * d + d AS BIGINT) AS params FROM c, n""")
def param_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of the recurrent model that each order stands for, over all customers and parts."""
    users, items = (base.table(spark, sf_dir, t).count() for t in ("customer", "part"))
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    o = base.table(spark, sf_dir, "orders")
    c = o.select("o_orderkey", pick((32, 64, 128), F.col("o_orderkey") % 3).alias("d"), (F.col("o_custkey") % 2).alias("s"), pick(("rnn", "gru", "lstm"), F.col("o_custkey") % 3).alias("cell"))
    return c.select("o_orderkey", space.recurrent_params(F.col("d"), F.col("s"), F.col("cell"), users, items, 4).alias("params"))


@query("""
    WITH s AS (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END, 0) AS elapsed_time_s, coalesce(CASE WHEN o_orderkey % 7 > 0 THEN o_custkey::DOUBLE END, 0) AS gpu_util_ratio, o_custkey AS run FROM orders)
    SELECT run, count(*) AS n, min(elapsed_time_s) AS low, max(elapsed_time_s) AS high, round(avg(gpu_util_ratio), 6) AS util FROM s GROUP BY 1""")
def efficiency_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with holes: missing numbers are 0; then mean, least and most of each run."""
    o = base.table(spark, sf_dir, "orders")
    s = o.select(F.lit("t").alias("timestamp"), F.lit(1.0).alias("wall_time"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice")).alias("elapsed_time_s"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey").cast("double")).alias("gpu_util_ratio"), F.col("o_custkey").alias("run"))
    return logs.efficiency_numbers(s).groupBy("run").agg(F.count("*").alias("n"), F.min("elapsed_time_s").alias("low"), F.max("elapsed_time_s").alias("high"), F.round(F.avg("gpu_util_ratio"), 6).alias("util"))


@query("SELECT o_orderkey, round(o_totalprice / 7, 3) AS shown FROM orders")
def rounding_at_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 7, 3).alias("shown"))


@query("""
    WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events), h AS (SELECT user_id, CAST(floor(t / 3600) AS BIGINT) AS hour, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT hour, CAST(sum(n) AS BIGINT) AS events, count(*) AS users, max(n) AS busiest FROM h GROUP BY 1""")
def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and users of each hour, in two levels of aggregation."""
    e = base.table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).alias("hour"))
    per_user = e.groupBy("user_id", "hour").agg(F.count("*").alias("n"))
    return per_user.groupBy("hour").agg(F.sum("n").alias("events"), F.count("*").alias("users"), F.max("n").alias("busiest"))


@query("""
    WITH t AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT before, event_type, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY 1, 2""")
def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kind of event follows which, by user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = base.table(spark, sf_dir, "events").select("event_type", F.lag("event_type").over(w).alias("before"))
    return e.filter("before is not null").groupBy("before", "event_type").agg(F.count("*").alias("n"))
