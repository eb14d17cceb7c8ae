"""The registry of queries, and the streams that most of them start from."""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal
from ..sources import interactions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PARTITION_SIZE, FEATURES, K = 500, 8, 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL for the same result if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = dedent(sql).strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a normalised stream: event_seq, line_no, ts, user_id, item_id, features."""
    return interactions.normalise(interactions.from_events(spark, sf_dir), FEATURES)


def planned(spark: SparkSession, sf_dir: str, size: int | None = PARTITION_SIZE) -> DataFrame:
    """The stream with its split and partitions."""
    n = table(spark, sf_dir, "events").count()
    return temporal.partition_plan(stream(spark, sf_dir), n, size)


def cents(column: str) -> F.Column:
    """Money or rates of two digits as whole numbers, whose sums do not depend on their order."""
    return F.round(F.col(column) * 100).cast("bigint")


#: The same streams in SQL.
I = """
i AS (SELECT event_id AS line_no, user_id AS raw_uid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS raw_iid, epoch_us(ts) / 1e6 AS ts, value FROM events)"""
E = (
    I
    + """,
u AS (SELECT raw_uid, row_number() OVER (ORDER BY min(line_no)) - 1 AS user_id FROM i GROUP BY raw_uid),
v AS (SELECT raw_iid, row_number() OVER (ORDER BY min(line_no)) - 1 AS item_id FROM i GROUP BY raw_iid),
e AS (SELECT row_number() OVER (ORDER BY ts, line_no) - 1 AS event_seq, line_no, ts, user_id, item_id, value FROM i JOIN u USING (raw_uid) JOIN v USING (raw_iid))"""
)
S = (
    E
    + """,
n1 AS (SELECT count(*) AS n FROM e),
n2 AS (SELECT n, least(greatest(CAST(floor(n * 0.7::DOUBLE) AS BIGINT), 1), n - 2) AS a FROM n1),
n3 AS (SELECT n, a, least(greatest(CAST(floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) AS BIGINT), a + 1), n - 1) AS b FROM n2),
s AS (SELECT e.*, a, b, CASE WHEN event_seq < a THEN 'train' WHEN event_seq < b THEN 'val' ELSE 'test' END AS split FROM e, n3)"""
)
P = (
    S
    + """,
p AS (SELECT *, CAST(CASE split WHEN 'train' THEN event_seq // 500 WHEN 'val' THEN (a + 499) // 500 + (event_seq - a) // 500
      ELSE (a + 499) // 500 + (b - a + 499) // 500 + (event_seq - b) // 500 END AS INTEGER) AS partition_id FROM s)"""
)
#: Partition costs.
COSTS = (
    P
    + """,
fu AS (SELECT user_id, min(partition_id) AS fp FROM p GROUP BY 1), fi AS (SELECT item_id, min(partition_id) AS fp FROM p GROUP BY 1),
nu AS (SELECT partition_id, count(*) AS users, count(*) FILTER (fp = partition_id) AS new_users FROM (SELECT DISTINCT partition_id, user_id FROM p) JOIN fu USING (user_id) GROUP BY 1),
ni AS (SELECT partition_id, count(*) AS items, count(*) FILTER (fp = partition_id) AS new_items FROM (SELECT DISTINCT partition_id, item_id FROM p) JOIN fi USING (item_id) GROUP BY 1),
sz AS (SELECT split, partition_id, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM p GROUP BY 1, 2),
k AS (SELECT split, partition_id, n, start_ts, end_ts, users, new_users, items, new_items, greatest(n + 0.25::DOUBLE * (users + new_users) + 0.25::DOUBLE * (items + new_items), 1.0::DOUBLE) AS cost
      FROM sz JOIN nu USING (partition_id) JOIN ni USING (partition_id))"""
)
