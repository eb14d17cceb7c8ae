"""The temporal graph of users and items as edge tables and windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars, vectors
from . import history
from .history import SLICE_EVENTS


def doubled_edges(events: DataFrame, users: int) -> DataFrame:
    """(src, dst, ts, event_seq) in both directions; items follow the users in one space of nodes."""
    item = (F.col("item_id") + users).cast("long")
    user = F.col("user_id").cast("long")
    ends = F.explode(F.array(F.struct(user.alias("src"), item.alias("dst")), F.struct(item.alias("src"), user.alias("dst"))))
    return events.select(ends.alias("e"), "ts", "event_seq").select("e.src", "e.dst", "ts", "event_seq")


def _step(size: int) -> Column:
    """Events in a row, as many as a slice of a history has."""
    return F.floor(F.col("event_seq") / size)


def recent_neighbours(edges: DataFrame, k: int, size: int = SLICE_EVENTS) -> DataFrame:
    """Adds the last k neighbours of src before each event, oldest first, repeats kept. size: of the slices that a busy node's
    events are cut into."""
    return history.last_entries(edges, ["src"], "event_seq", _step(size), F.col("dst"), k, "neighbours", size)


def recent_edges(edges: DataFrame, k: int, size: int = SLICE_EVENTS) -> DataFrame:
    """Adds the last k edges of src before each event as (dst, ts), oldest first."""
    return history.last_entries(edges, ["src"], "event_seq", _step(size), F.struct("dst", "ts"), k, "recent", size)


def with_edge_history(edges: DataFrame, size: int = SLICE_EVENTS) -> DataFrame:
    """Adds last_time (of the same ordered pair, null for none) and weight (its events so far)."""
    return history.previous(edges, ["src", "dst"], "event_seq", _step(size), F.col("ts"), "last_time", "weight", size)


def time_gap(events: DataFrame, entity: str, name: str, initial: float = 0.0, size: int = SLICE_EVENTS) -> DataFrame:
    """Adds the time since the entity's previous event; its state starts at initial."""
    found = history.previous(events, [entity], "event_seq", _step(size), F.col("ts"), "_before", size=size)
    return found.withColumn(name, F.col("ts") - F.coalesce("_before", F.lit(initial))).drop("_before")


def query_gap(events: DataFrame, states: DataFrame, entity: str, query_ts: str, name: str, size: int = SLICE_EVENTS, seconds: float = 60.0) -> DataFrame:
    """Time from an entity's last event at or before the query, an as-of join by union and window. What an entity has in so
    many seconds is not cut."""
    marks = events.select(entity, F.col("ts").alias("_t"), F.lit(0).alias("_kind"), F.col("ts").alias("_seen"), F.lit(None).cast("long").alias("query_id"))
    asks = states.select(entity, F.col(query_ts).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_seen"), F.col("query_id").cast("long"))
    both = history.latest(marks.unionByName(asks), [entity], ["_t", "_kind"], F.floor(F.col("_t") / seconds), F.col("_seen"), "_last", size)
    return both.filter("_kind = 1").select("query_id", entity, (F.col("_t") - F.coalesce("_last", F.lit(0.0))).alias(name))


def neighbour_messages(recent: DataFrame, table: DataFrame, decay: str, day: float = 86400.0) -> DataFrame:
    """One row for each event and neighbour: its vector and decayed weight.

    recent: src, event_seq, ts, recent. table: node, vector. The gap is the one of the pair, so repeats of a neighbour
    share the newest one; as the newest edge of a pair is among the last ones if any of its edges is, the history of the
    pair is not looked up.
    """
    newest = lambda e: F.array_max(F.transform(F.filter("recent", lambda o: o["dst"] == e["dst"]), lambda o: o["ts"]))
    each = F.transform("recent", lambda e: F.struct(e["dst"].alias("dst"), newest(e).alias("last_time")))
    flat = recent.select("src", "event_seq", "ts", F.posexplode(each).alias("pos", "e")).select("src", "event_seq", "ts", "pos", "e.dst", "e.last_time")
    out = flat.join(table.withColumnRenamed("node", "dst"), "dst")
    return out.withColumn("weight", scalars.time_decay((F.col("ts") - F.col("last_time")) / day, decay))


def _by_position(messages: DataFrame, share: Column, dims: int, also: Column | None = None) -> DataFrame:
    """(src, event_seq, dim, x): sums of share times vector, each divided by ``also`` (an aggregate) if there is one.
    The sums of all positions are taken together, so a message is one row until the end."""
    sums = messages.groupBy("src", "event_seq").agg(*[F.sum(share * F.get("vector", i)).alias(f"_{i}") for i in range(dims)], (F.lit(1.0) if also is None else also).alias("_by"))
    return sums.select("src", "event_seq", F.posexplode(F.array(*[F.col(f"_{i}") / F.col("_by") for i in range(dims)])).alias("dim", "x"))


def aggregate_sum(messages: DataFrame, dims: int) -> DataFrame:
    """(src, event_seq, dim, x): weighted sum of neighbour vectors."""
    return _by_position(messages, F.col("weight"), dims)


def aggregate_mean(messages: DataFrame, dims: int) -> DataFrame:
    """Weighted sum over the sum of weights, at least 1e-8."""
    return _by_position(messages, F.col("weight"), dims, F.greatest(F.sum("weight"), F.lit(1e-8)))


def attention_scores(messages: DataFrame, centers: DataFrame, score: Column | None = None) -> DataFrame:
    """Adds score: that of the neighbour's vector (``vector``) against the centre's (``center``), a dot product if none is
    given, plus the logarithm of the decay. centers: src, center."""
    score = vectors.dot(F.col("vector"), F.col("center")) if score is None else score
    return messages.join(centers, "src").withColumn("score", score + F.log(F.col("weight") + 1e-8))


def aggregate_attention(messages: DataFrame, centers: DataFrame, dims: int, score: Column | None = None) -> DataFrame:
    """Sum of neighbour vectors by the softmax of their attention scores."""
    scored = attention_scores(messages, centers, score)
    event = Window.partitionBy("src", "event_seq")
    raw = F.exp(F.col("score") - F.max("score").over(event))
    return _by_position(scored.withColumn("raw", raw), F.col("raw"), dims, F.sum("raw"))


def zeros_where_none(aggregated: DataFrame, events: DataFrame, dims: int) -> DataFrame:
    """Every (src, event_seq) of events with all positions, zero where it had no neighbours."""
    full = events.select("src", "event_seq", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim"))
    return full.join(aggregated, ["src", "event_seq", "dim"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
