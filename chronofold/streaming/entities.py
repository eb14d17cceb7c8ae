"""Features of entities as events arrive, with state kept by Spark, and windows that close behind a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    """Files of the event table as a stream: event_id, user_id, item_id, event_time, ts (seconds)."""
    stream = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, props string").option("maxFilesPerTrigger", files_at_once).parquet(path)
    at = F.col("ts").cast("timestamp")
    item = F.get_json_object("props", "$.k").cast("long").alias("item_id")
    return stream.select("event_id", "user_id", item, at.alias("event_time"), (F.unix_micros(at) / F.lit(1e6)).alias("ts"))


def gaps(events: DataFrame) -> DataFrame:
    """(event_id, user_id, ts, gap): seconds since the user's event before, by time and id; since 0 for the first.

    The state of a user is the time of the latest event, so it does not grow. Events of one batch are put in order;
    one that is late across batches counts from the latest time and has a gap below 0. A batch holds a bounded number
    of files, hence so do the events of one user in it.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        before = rows["ts"].shift(1)
        before.iloc[0] = last
        state.update((max(last, float(rows["ts"].iloc[-1])),))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "ts": rows["ts"], "gap": rows["ts"] - before})

    slim = events.select("event_id", "user_id", "ts")
    return slim.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, ts double, gap double", "last double", "append", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, n): events of each window, given out once the watermark has passed it; later events are dropped."""
    return events.withWatermark("event_time", delay).groupBy(F.window("event_time", width).alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")


HISTORY = "event_id long, dst long, ts double, gap double, neighbours array<long>, pair_gap double, weight long"


class History(StatefulProcessor):
    """What a node remembers: its last time (a value), its last k neighbours (a list) and, for each neighbour, how often and
    when they met (a map). An event is answered from what was there before it and then takes part in it. What a node or a
    pair remembers is dropped ``expiry_ms`` after it has last changed, if that is given."""

    def __init__(self, k: int, expiry_ms: int | None = None):
        self.k, self.expiry_ms = k, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts double", self.expiry_ms)
        self.near = handle.getListState("near", "dst long", self.expiry_ms)
        self.pairs = handle.getMapState("pairs", "dst long", "n long, ts double", self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = self.last.get()
        last = float(held[0]) if held is not None else 0.0
        near = [int(r[0]) for r in self.near.get()]
        met = {d: self.pairs.getValue((d,)) for d in map(int, every["dst"].unique())}
        pairs = {d: (int(v[0]), float(v[1])) for d, v in met.items() if v is not None}
        out = []
        for event, dst, ts in zip(every["event_id"].tolist(), every["dst"].tolist(), every["ts"].tolist(), strict=True):
            n, before = pairs.get(dst, (0, None))
            out.append((key[0], event, dst, ts, ts - last, list(near), None if before is None else ts - before, n + 1))
            near, last, pairs[dst] = [*near, dst][-self.k :], ts, (n + 1, ts)
        self.last.update((last,))
        self.near.put([(d,) for d in near])
        for d in met:
            self.pairs.updateValue((d,), pairs[d])
        yield pd.DataFrame(out, columns=["src", *[c.split()[0] for c in HISTORY.split(", ")]])

    def close(self) -> None:
        pass


def both_ways(events: DataFrame) -> DataFrame:
    """(src, dst, ts, event_id) of a stream of events with user_id and item_id; users have even numbers, items odd ones."""
    user, item = F.col("user_id") * 2, F.col("item_id") * 2 + 1
    ends = F.explode(F.array(F.struct(user.alias("src"), item.alias("dst")), F.struct(item.alias("src"), user.alias("dst"))))
    return events.select(ends.alias("e"), "ts", "event_id").select("e.src", "e.dst", "ts", "event_id")


def history(edges: DataFrame, k: int, expiry_ms: int | None = None) -> DataFrame:
    """src with ``HISTORY`` for each event of a stream of edges: the time since the node's last event (since 0 for the first), its
    last k neighbours, oldest first, the time since the pair's last event and how many events it has had.

    Nodes are dealt over tasks by Spark, and the state of a node is the k neighbours and one entry for each node it has
    met. Events of a batch are put in order; one that is late across batches follows those that have come. A batch holds a
    bounded number of files, hence so do the events of one node in it.
    """
    mode = "ProcessingTime" if expiry_ms else "None"
    return edges.groupBy("src").transformWithStateInPandas(History(k, expiry_ms), f"src long, {HISTORY}", "append", mode)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which keeps it on disk and is what several states of one key need, for the queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Reads all that is there, appends it to the Parquet table out, and returns the table."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
