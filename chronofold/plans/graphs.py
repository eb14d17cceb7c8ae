"""Temporal-graph features and vector expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..operators import distributed, graph
from . import base
from .base import query

#: Dimensions of the vectors that neighbours send.
DIMS = 4
#: Doubled edges; items follow the users.
G = (
    base.E
    + """,
z AS (SELECT max(user_id) + 1 AS nu FROM e),
g AS (SELECT user_id AS src, item_id + nu AS dst, ts, event_seq FROM e, z UNION ALL SELECT item_id + nu, user_id, ts, event_seq FROM e, z)"""
)
#: The history of pairs.
H = G + ", h AS (SELECT *, lag(ts) OVER w AS last_time, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS weight FROM g WINDOW w AS (PARTITION BY src, dst ORDER BY event_seq))"
#: Recent neighbours.
R = G + ", r AS (SELECT src, event_seq, ts, array_agg(dst) OVER (PARTITION BY src ORDER BY event_seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ns FROM g)"
#: The item vectors of four dimensions, by number of the item; users have those of other rows.
V = ", t AS (SELECT vec_id AS node, CAST(embedding[1:4] AS DOUBLE[]) AS vec FROM embeddings)"
#: A message for each neighbour with its decayed weight.
M = (
    R
    + V
    + """,
f AS (SELECT src, event_seq, ts, unnest(ns) AS dst FROM r WHERE ns IS NOT NULL),
q AS (SELECT f.src, f.dst, f.event_seq, max(g.ts) AS last_time FROM (SELECT DISTINCT src, dst, event_seq FROM f) f JOIN g ON f.src = g.src AND f.dst = g.dst AND g.event_seq < f.event_seq GROUP BY 1, 2, 3),
m AS (SELECT f.src, f.event_seq, f.dst, exp(-greatest((f.ts - last_time) / 86400.0, 0)) AS w, vec FROM f JOIN q USING (src, dst, event_seq) JOIN t ON t.node = f.dst)"""
)


def users_of(events: DataFrame) -> int:
    return events.agg(F.max("user_id") + 1).first()[0]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = base.stream(spark, sf_dir)
    return graph.doubled_edges(events, users_of(events))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("node"), F.slice(vectors.wide(F.col("embedding")), 1, DIMS).alias("vector"))


@query(f"WITH {G} SELECT src, dst, ts, event_seq FROM g")
def edges_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query(f"WITH {R} SELECT src, event_seq, coalesce(array_to_string(ns, ','), '') AS neighbours FROM r")
def recent_k_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.recent_neighbours(edges(spark, sf_dir), base.K)
    return found.select("src", "event_seq", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query(f"WITH {R} SELECT src, event_seq, CAST(coalesce(len(ns), 0) AS INTEGER) AS degree FROM r")
def recent_k_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.recent_neighbours(edges(spark, sf_dir), base.K).select("src", "event_seq", F.size("neighbours").alias("degree"))


@query(f"WITH {H} SELECT src, dst, event_seq, last_time FROM h")
def edge_last_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_edge_history(edges(spark, sf_dir)).select("src", "dst", "event_seq", "last_time")


@query(f"WITH {H} SELECT src, dst, event_seq, weight FROM h")
def edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_edge_history(edges(spark, sf_dir)).select("src", "dst", "event_seq", "weight")


@query(f"WITH {base.E} SELECT event_seq, round(ts - coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY event_seq), 0), 3) AS gap FROM e")
def user_time_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.time_gap(base.stream(spark, sf_dir), "user_id", "gap").select("event_seq", F.round("gap", 3).alias("gap"))


@query(f"WITH {base.E} SELECT event_seq, round(ts - coalesce(lag(ts) OVER (PARTITION BY item_id ORDER BY event_seq), 0), 3) AS gap FROM e")
def item_time_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.time_gap(base.stream(spark, sf_dir), "item_id", "gap").select("event_seq", F.round("gap", 3).alias("gap"))


@query(f"WITH {base.E} SELECT event_seq, round(ln(1 + greatest(ts - coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY event_seq), 0), 0)), 6) AS log_gap FROM e")
def log_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.time_gap(base.stream(spark, sf_dir), "user_id", "gap")
    return found.select("event_seq", F.round(scalars.log_gap(F.col("gap")), 6).alias("log_gap"))


@query(f"""WITH {base.E}, m AS (SELECT max(ts) AS t FROM e)
    SELECT user_id, round(max(t) - max(ts), 3) AS gap FROM e, m GROUP BY user_id""")
def query_time_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap of every user at the time of the last event."""
    events = base.stream(spark, sf_dir)
    last = events.agg(F.max("ts").alias("query_ts"))
    asks = events.select("user_id").distinct().join(F.broadcast(last), F.lit(True)).withColumn("query_id", F.col("user_id"))
    return graph.query_gap(events, asks, "user_id", "query_ts", "gap").select("user_id", F.round("gap", 3).alias("gap"))


def _decayed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    gap = (F.col("ts") - F.col("last_time")) / 86400.0
    found = graph.with_edge_history(edges(spark, sf_dir)).filter("last_time is not null")
    return found.select("src", "dst", "event_seq", F.round(scalars.time_decay(gap, kind), 6).alias("decay"))


@query(f"WITH {H} SELECT src, dst, event_seq, round(exp(-greatest((ts - last_time) / 86400.0, 0)), 6) AS decay FROM h WHERE last_time IS NOT NULL")
def time_decay_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decayed(spark, sf_dir, "exp")


@query(f"WITH {H} SELECT src, dst, event_seq, round(1 / (1 + greatest((ts - last_time) / 86400.0, 0)), 6) AS decay FROM h WHERE last_time IS NOT NULL")
def time_decay_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decayed(spark, sf_dir, "inverse")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbour_messages(graph.recent_edges(edges(spark, sf_dir), base.K), item_vectors(spark, sf_dir), "exp")


_FLAT = "x AS (SELECT src, event_seq, w, unnest(vec) AS y, unnest(range(4)) AS dim FROM m)"


@query(f"WITH {M}, {_FLAT} SELECT src, event_seq, CAST(dim AS INTEGER) AS dim, round(sum(w * y), 6) AS x FROM x GROUP BY 1, 2, 3")
def neigh_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.aggregate_sum(messages(spark, sf_dir), DIMS).withColumn("x", F.round("x", 6))


@query(f"WITH {M}, {_FLAT} SELECT src, event_seq, CAST(dim AS INTEGER) AS dim, round(sum(w * y) / greatest(sum(w), 1e-8), 6) AS x FROM x GROUP BY 1, 2, 3")
def neigh_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.aggregate_mean(messages(spark, sf_dir), DIMS).withColumn("x", F.round("x", 6))


@query(f"""WITH {M},
    sc AS (SELECT m.*, list_dot_product(m.vec, c.vec) + ln(w + 1e-8) AS score FROM m JOIN t c ON c.node = m.src),
    sm AS (SELECT *, exp(score - max(score) OVER (PARTITION BY src, event_seq)) AS raw FROM sc),
    sh AS (SELECT *, raw / sum(raw) OVER (PARTITION BY src, event_seq) AS share FROM sm),
    x AS (SELECT src, event_seq, share, unnest(vec) AS y, unnest(range(4)) AS dim FROM sh)
    SELECT src, event_seq, CAST(dim AS INTEGER) AS dim, round(sum(share * y), 6) AS x FROM x GROUP BY 1, 2, 3""")
def neigh_attn_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = item_vectors(spark, sf_dir).toDF("src", "center")
    return graph.aggregate_attention(messages(spark, sf_dir), centers, DIMS).withColumn("x", F.round("x", 6))


# A small attention network: four hidden units over [center, neighbour, |center - neighbour|], with set weights.
ATTENTION_HIDDEN = [[round(0.1 * ((7 * i + 3 * j) % 11 - 5), 1) for j in range(12)] for i in range(4)]
ATTENTION_BIAS, ATTENTION_OUT = [0.1, -0.2, 0.3, 0.0], [0.5, -0.4, 0.3, 0.2]
_UNITS = " + ".join(
    f"{o} * greatest(list_dot_product(z, {h}::DOUBLE[]) + {b}, 0)" for o, h, b in zip(ATTENTION_OUT, ATTENTION_HIDDEN, ATTENTION_BIAS, strict=True)
)


@query(f"""WITH {M},
    sc AS (SELECT m.*, list_concat(list_concat(c.vec, m.vec), list_transform(range(1, 5), lambda i: abs(c.vec[i] - m.vec[i]))) AS z FROM m JOIN t c ON c.node = m.src),
    s2 AS (SELECT *, {_UNITS} + 0.05 + ln(w + 1e-8) AS score FROM sc),
    sm AS (SELECT *, exp(score - max(score) OVER (PARTITION BY src, event_seq)) AS raw FROM s2),
    sh AS (SELECT *, raw / sum(raw) OVER (PARTITION BY src, event_seq) AS share FROM sm),
    x AS (SELECT src, event_seq, share, unnest(vec) AS y, unnest(range(4)) AS dim FROM sh)
    SELECT src, event_seq, CAST(dim AS INTEGER) AS dim, round(sum(share * y), 6) AS x FROM x GROUP BY 1, 2, 3""")
def neigh_attn_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = item_vectors(spark, sf_dir).toDF("src", "center")
    score = vectors.attention_network(F.col("center"), F.col("vector"), ATTENTION_HIDDEN, ATTENTION_BIAS, ATTENTION_OUT, 0.05)
    return graph.aggregate_attention(messages(spark, sf_dir), centers, DIMS, score).withColumn("x", F.round("x", 6))


#: exp(-t^2) is summed up by Simpson's rule: erf(x) = 2 / sqrt(pi) times its integral from 0 to x.
_GELU = "0.5 * x * (1 + sign(x) * least(1, 2 / sqrt(pi()) * (least(abs(x), 8.5) / sqrt(2)) / 384 * list_sum(list_transform(range(129), lambda i: (CASE WHEN i IN (0, 128) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(i / 128.0::DOUBLE * least(abs(x), 8.5) / sqrt(2), 2))))))"


@query(f"WITH {M}, {_FLAT}, s AS (SELECT src, event_seq, dim, sum(w * y) AS x FROM x GROUP BY 1, 2, 3) SELECT src, event_seq, CAST(dim AS INTEGER) AS dim, round({_GELU}, 5) AS x FROM s")
def agg_gelu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.aggregate_sum(messages(spark, sf_dir), DIMS).withColumn("x", F.round(scalars.activation(F.col("x"), "gelu"), 5))


@query(f"""WITH {M}, {_FLAT}, y AS (SELECT src, event_seq, dim, sum(w * y) AS s FROM x GROUP BY 1, 2, 3)
    SELECT g.src, g.event_seq, CAST(d.dim AS INTEGER) AS dim, round(coalesce(s, 0), 6) AS x FROM g CROSS JOIN range(4) d(dim) LEFT JOIN y ON y.src = g.src AND y.event_seq = g.event_seq AND y.dim = d.dim""")
def neigh_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.zeros_where_none(graph.aggregate_sum(messages(spark, sf_dir), DIMS), edges(spark, sf_dir), DIMS).withColumn("x", F.round("x", 6))


@query(f"WITH {M}, {_FLAT} SELECT src, event_seq, CAST(dim AS INTEGER) AS dim, round(greatest(sum(w * y), 0), 6) AS x FROM x GROUP BY 1, 2, 3")
def agg_relu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.aggregate_sum(messages(spark, sf_dir), DIMS).withColumn("x", F.round(scalars.activation(F.col("x"), "relu"), 6))


@query(f"WITH {M}, {_FLAT} SELECT src, event_seq, CAST(dim AS INTEGER) AS dim, round(tanh(sum(w * y)), 6) AS x FROM x GROUP BY 1, 2, 3")
def agg_tanh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.aggregate_sum(messages(spark, sf_dir), DIMS).withColumn("x", F.round(scalars.activation(F.col("x"), "tanh"), 6))


_E64 = "WITH w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(_E64 + ", n AS (SELECT vec_id, sqrt(list_dot_product(v, v)) AS len, unnest(v) AS y, unnest(range(64)) AS dim FROM w) SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(y / greatest(len, 1e-12), 6) AS x FROM n")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "embeddings").withColumn("v", vectors.wide(F.col("embedding"))).withColumn("len", F.greatest(vectors.norm("v"), F.lit(1e-12)))
    return e.select("vec_id", F.posexplode("v").alias("dim", "y"), "len").select("vec_id", "dim", F.round(F.col("y") / F.col("len"), 6).alias("x"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the one seven places on."""
    e = base.table(spark, sf_dir, "embeddings").select("vec_id", vectors.wide(F.col("embedding")).alias("v"))
    n = e.count()
    other = e.select(F.pmod(F.col("vec_id") - 7, F.lit(n)).alias("vec_id"), F.col("v").alias("o"))
    return e.join(other, "vec_id")


_PAIR = _E64 + ", p AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM w a JOIN w b ON b.vec_id = (a.vec_id + 7) % (SELECT count(*) FROM w))"


@query(_PAIR + " SELECT vec_id, round(list_distance(x, y), 6) AS dist FROM p")
def l2_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", F.round(vectors.l2_distance("v", "o"), 6).alias("dist"))


@query(_PAIR + " SELECT vec_id, round(list_dot_product(x, y), 6) AS dot FROM p")
def dot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", F.round(vectors.dot("v", "o"), 6).alias("dot"))


@query(_PAIR + " SELECT round(avg(list_distance(x, y) * list_distance(x, y)), 6) AS loss FROM p")
def l2_regression_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).agg(F.round(F.avg(vectors.squared_distance("v", "o")), 6).alias("loss"))


@query(_E64 + """, k AS (SELECT count(*) AS n FROM w), j AS (SELECT unnest(range(1, 6)) AS j),
    s AS (SELECT a.vec_id, list_dot_product(a.v, b.v) AS pos, list_dot_product(a.v, c.v) AS neg FROM w a, j, k JOIN w b ON b.vec_id = (a.vec_id + 7) % n JOIN w c ON c.vec_id = (a.vec_id + j.j * 13) % n)
    SELECT vec_id, round(avg(ln(1 + exp(neg - pos))), 6) AS loss FROM s GROUP BY vec_id""")
def bpr_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "embeddings").select("vec_id", vectors.wide(F.col("embedding")).alias("v"))
    n = e.count()
    at = lambda shift: F.pmod(F.col("vec_id") + shift, F.lit(n))
    asks = e.select("vec_id", "v", at(F.lit(7)).alias("b"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("j")).withColumn("c", at(F.col("j") * 13))
    pos, neg = e.toDF("b", "vb"), e.toDF("c", "vc")
    loss = scalars.bpr_loss(vectors.dot("v", "vb"), vectors.dot("v", "vc"))
    return asks.join(pos, "b").join(neg, "c").groupBy("vec_id").agg(F.round(F.avg(loss), 6).alias("loss"))


@query(_PAIR + ", f AS (SELECT vec_id, unnest(x) AS a, unnest(y) AS b, unnest(range(64)) AS dim FROM p) SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(a * (1 + b * 0.5::DOUBLE), 6) AS x FROM f")
def time_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pairs(spark, sf_dir).select("vec_id", F.posexplode(vectors.project_in_time("v", "o", F.lit(0.5))).alias("dim", "x"))
    return found.withColumn("x", F.round("x", 6))


@query("""
    SELECT l_returnflag AS param, l_linenumber % 3 AS idx, round(CAST(sum(round(l_tax * 100)::BIGINT * round(l_quantity)::BIGINT) AS DOUBLE) / CAST(sum(round(l_quantity)::BIGINT) AS DOUBLE), 6) AS value
    FROM lineitem GROUP BY 1, 2""")
def weighted_gradient_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("param"), (F.col("l_linenumber") % 3).alias("idx"), base.cents("l_tax").alias("value"), F.round("l_quantity").cast("bigint").alias("n"))
    return distributed.weighted_mean(rows).withColumn("value", F.round("value", 6))


@query("""
    WITH r AS (SELECT user_id, epoch_us(ts) / 1e6 AS last_time, event_id % 3 AS worker, value, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch_us(ts) / 1e6 / 86400) DESC, event_id % 3, event_id) AS n FROM events)
    SELECT user_id, max(day) AS day, min(worker) AS worker FROM (
        SELECT user_id, CAST(floor(last_time / 86400) AS BIGINT) AS day, worker, max(CAST(floor(last_time / 86400) AS BIGINT)) OVER (PARTITION BY user_id) AS newest FROM r) WHERE day = newest GROUP BY user_id""")
def state_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base.table(spark, sf_dir, "events")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400)
    states = e.select("user_id", day.alias("last_time"), (F.col("event_id") % 3).alias("worker"))
    return distributed.merge_latest(states, ["user_id"]).select("user_id", F.col("last_time").alias("day"), "worker")
