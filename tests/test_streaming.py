"""Streams in several batches against the same work in one."""

import numpy as np

from pyspark.sql import functions as F

from chronofold.operators import traces
from chronofold.sources.logs import read_efficiency
from chronofold.streaming import entities, growing, tail
from chronofold.streaming.monitor import MonitorState


def test_gaps_keep_state_between_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    for i, part in enumerate(np.array_split(np.arange(len(events)), 4)):
        rows = spark.createDataFrame(events.iloc[part][["event_id", "ts", "user_id", "props"]], "event_id long, ts timestamp_ntz, user_id long, props string")
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = entities.gaps(entities.event_stream(spark, f"{tmp_path}/in/*", files_at_once=1))
        out = entities.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = {r["event_id"]: r["gap"] for r in out.collect()}
    seconds = events["ts"].astype("datetime64[us]").astype("int64") / 1e6
    before = seconds.groupby(events["user_id"]).shift(1).fillna(0)
    assert len(got) == len(events)
    assert all(abs(got[i] - g) < 1e-6 for i, g in zip(events["event_id"], seconds - before))


def test_history_over_batches_is_that_of_one(spark, sf_dir, tmp_path):
    """State carried over four batches, with several events of one node in each, against plain windows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values(["ts", "event_id"])[:300]
    for i, part in enumerate(np.array_split(np.arange(len(events)), 4)):
        rows = spark.createDataFrame(events.iloc[part][["event_id", "ts", "user_id", "props"]], "event_id long, ts timestamp_ntz, user_id long, props string")
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        if i in (1, 3):  # two batches each; the second time from the checkpoint
            edges = entities.both_ways(entities.event_stream(spark, f"{tmp_path}/in/*", files_at_once=1))
            with entities.rocks(spark):
                out = entities.run_to_end(entities.history(edges, 3), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    near, last, pairs, want = {}, {}, {}, {}
    for e in events.itertuples():
        u, v, ts = e.user_id * 2, int(e.props.split(":")[1].strip(" }")) * 2 + 1, e.ts.to_datetime64().astype("datetime64[us]").astype("int64") / 1e6
        for src, dst in ((u, v), (v, u)):
            n, before = pairs.get((src, dst), (0, None))
            want[src, e.event_id] = (dst, round(ts - last.get(src, 0.0), 3), near.get(src, []), None if before is None else round(ts - before, 3), n + 1)
            near[src], last[src], pairs[src, dst] = [*near.get(src, []), dst][-3:], ts, (n + 1, ts)
    got = {(r["src"], r["event_id"]): (r["dst"], round(r["gap"], 3), r["neighbours"], None if r["pair_gap"] is None else round(r["pair_gap"], 3), r["weight"]) for r in out.collect()}
    assert got == want and spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


LINE = "[pipeline-trace] wall=00:00:00 elapsed={}s phase=train event={} trial={} stage={}/2"


def test_tail_reads_each_file_once(spark, tmp_path):
    logs, table = tmp_path / "logs", f"{tmp_path}/table"
    logs.mkdir()
    seen = []
    for n, lines in enumerate([[LINE.format("1.0", "dispatch", 0, 0), "noise"], [LINE.format("3.0", "complete", 0, 0), LINE.format("3.5", "dispatch", 1, 0)]]):
        (logs / f"{n}.log").write_text("\n".join(lines) + "\n")
        tail.tail_trace(spark, str(logs), table, f"{tmp_path}/c").awaitTermination()
        seen.append(spark.read.parquet(table).count())
    assert seen == [1, 3]
    rows = spark.read.parquet(table).orderBy("seq").collect()
    assert [r["event"] for r in rows] == ["dispatch", "complete", "dispatch"]
    assert tail.progress(spark.read.parquet(table)).first()["lines"] == 0


def test_monitor_writes_samples(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("\n".join(LINE.format(*x) for x in [("0.0", "dispatch", 0, 0), ("2.0", "complete", 0, 0), ("2.0", "dispatch", 1, 0), ("4.0", "complete", 1, 0)]) + "\n")
    tail.monitor(spark, str(logs), f"{tmp_path}/t", f"{tmp_path}/s", f"{tmp_path}/c", devices=2).awaitTermination()
    rows = read_efficiency(spark, f"{tmp_path}/s/batch=*").collect()
    assert len(rows) == 1 and rows[0]["num_completed_tasks"] == 2 and rows[0]["gpu_efficiency"] == 0.5


def test_a_line_waits_for_its_end(spark, tmp_path):
    """A file that grows in the middle of lines, a second file, one that is written anew, and a start from the checkpoint."""
    logs, table = tmp_path / "logs", f"{tmp_path}/table"
    logs.mkdir()
    text = "".join(LINE.format(f"{i}.5", "dispatch", i, 0) + "\n" for i in range(40))
    seen = []
    for upto in (10, 700, 701, 1500, len(text)):
        (logs / "a.log").write_text(text[:upto])
        if upto > 1000:
            (logs / "b.log").write_text(text[: upto // 2])
        tail.tail_trace(spark, str(logs), table, f"{tmp_path}/c").awaitTermination()
        seen.append(spark.read.schema("seq long, elapsed double, trial int").parquet(f"{table}/batch=*").count() if any(tmp_path.glob("table/*")) else 0)
        assert seen[-1] == text[:upto].count("\n") + (text[: upto // 2].count("\n") if upto > 1000 else 0)
    (logs / "b.log").write_text("new start\n" + LINE.format("99.0", "complete", 0, 0) + "\n")
    tail.tail_trace(spark, str(logs), table, f"{tmp_path}/c").awaitTermination()
    rows = spark.read.parquet(table).orderBy("seq").collect()
    assert len(rows) == seen[-1] + 1 and rows[-1]["elapsed"] == 99.0


def test_pieces_of_a_file_share_its_lines(tmp_path):
    """Wherever a file is cut, each line belongs to one piece, with its own byte."""
    data = "é\n\nlong line here\r\nx\nlast one".encode()
    (tmp_path / "f").write_bytes(data)
    reader = growing.GrowingReader(str(tmp_path), 8 << 20)
    (name, end), = reader.latestOffset().items()
    assert data[:end].endswith(b"x\n") and reader.latestOffset() == {name: end}
    want = [(0, "é"), (3, ""), (4, "long line here"), (20, "x")]
    for size in range(1, len(data) + 1):
        pieces = growing.GrowingReader(str(tmp_path), size).partitions({}, {name: end})
        assert [(a, v) for p in pieces for b in reader.read(p) for a, v in zip(b.column("byte").to_pylist(), b.column("value").to_pylist())] == want
    assert [p.start for p in reader.partitions({name: 4}, {name: end})] == [4] and [p.start for p in reader.partitions({name: end + 5}, {name: end})] == [0]


def trace_rows(seed=3):
    """Tasks of four stages that overlap, a dispatch that is given twice and one that is never completed."""
    rnd = np.random.default_rng(seed)
    rows, t = [], 0.0
    for trial in range(12):
        for stage in range(3):
            t += float(rnd.exponential(0.7))
            rows.append((t, "dispatch", trial, stage))
            rows.append((t + float(rnd.exponential(2.0)) + 0.1, "complete", trial, stage))
    rows += [(5.05, "dispatch", 3, 9), (7.0, "dispatch", 3, 9), (9.3, "complete", 3, 9), (t - 0.01, "dispatch", 77, 0)]
    return [(n, *r) for n, r in enumerate(sorted(rows))]


def test_the_monitor_keeps_up(spark, tmp_path):
    """After every batch its measures are those of all tasks so far, and what it reads does not grow."""
    rows, schema = trace_rows(), "seq long, elapsed double, event string, trial int, stage int"
    state, sizes, step = MonitorState(spark, f"{tmp_path}/state"), [], 13
    columns = ["busy_s", "wall_s", "avg_stage_util", "max_stage_util", "min_stage_utilisation", "trials", "baseline_s", "bottleneck_stage", "imbalance", "efficiency", "completed", "throughput", "speedup", "avg_concurrent", "max_concurrent", "utilisation"]
    for n, a in enumerate(range(0, len(rows), step)):
        state.advance(n, spark.createDataFrame(rows[a : a + step], schema))
        tasks = traces.pair_sequence(spark.createDataFrame(rows[: a + step], schema))
        want, got = traces.monitor_bundle(tasks, 4).select(*columns).first(), state.measures(n, 4).select(*columns).first()
        for c in columns:
            assert got[c] == want[c] or abs(got[c] - want[c]) < 1e-9, (n, c, got[c], want[c])
        sizes.append(state.read(n, "tasks").count() + state.read(n, "open").count())
    assert state.read(n, "line").first()["done"] > 20 and max(sizes) < 25
    again = state.measures(2, 4).first()
    state.advance(2, spark.createDataFrame(rows[2 * step : 3 * step], schema))  # a batch that is repeated
    assert state.measures(2, 4).first() == again
    assert state.measures(n, 4).agg(F.count("*")).first()[0] == 1
