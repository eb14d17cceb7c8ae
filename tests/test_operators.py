"""Operators on small tables with known results."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronofold.functions import scalars, vectors
from chronofold.operators import catalogue, distributed, graph, history, ranking, running, stages, temporal, traces, trials
from chronofold.sources import interactions, logs

TINY = ["0,0,1.0,0,0.1,0.2,0.3", "1,1,2.0,0,0.0,0.5,0.1", "0,1,3.0,0,0.2,0.1,0.0", "1,0,4.0,0,0.4,0.2,0.2", "2,1,5.0,0,0.3,0.3,0.3", "2,0,6.0,0,0.1,0.4,0.2"]


def tiny(spark, tmp_path, lines=None):
    path = tmp_path / "tiny.csv"
    path.write_text("\n".join(lines or TINY) + "\n")
    return interactions.read_interactions(spark, str(path), 3)


def test_tiny_stream(spark, tmp_path):
    e = tiny(spark, tmp_path)
    assert interactions.universe(e).first()[:] == (3, 2)
    p = temporal.partition_plan(e, 6, 2)
    meta = {r["partition_id"]: (r["split"], r["start_ts"], r["end_ts"]) for r in temporal.partition_metadata(p).collect()}
    assert meta == {0: ("train", 1, 2), 1: ("train", 3, 4), 2: ("val", 5, 5), 3: ("test", 6, 6)}
    costs = {r["partition_id"]: r["cost"] for r in stages.partition_costs(p).collect()}
    assert (costs[0], costs[1]) == (4.0, 3.0)


def test_recent_neighbours_of_tiny_stream(spark, tmp_path):
    rows = graph.recent_neighbours(graph.doubled_edges(tiny(spark, tmp_path), 3), 2).collect()
    users = {r["event_seq"]: r["neighbours"] for r in rows if r["src"] < 3}
    items = {r["event_seq"]: r["neighbours"] for r in rows if r["src"] >= 3}
    assert [users[i] for i in range(6)] == [[], [], [3], [4], [], [4]]
    assert [items[i] for i in range(6)] == [[], [], [1], [0], [1, 0], [0, 1]]


def test_faulty_lines(spark, tmp_path):
    lines = ["", "User_ID,item,t,l,f", *TINY[:3], "3.9,-3.9,7,x,1", "user,b,c,d,e"]
    e = tiny(spark, tmp_path, lines)
    assert e.count() == 4
    bad = {"1,2,3,4": "fewer", "a,1,1,0,1": "finite", "1,1,nan,0,1": "finite", "1,1,1,0,inf": "finite", "1,1,1e309,0,1": "finite"}
    for line, word in bad.items():
        with pytest.raises(Exception, match=f"line 7: .*{word}"):
            tiny(spark, tmp_path, [*TINY, line]).collect()
    parsed = interactions.parse_lines(spark.createDataFrame([(1, "3.9,-3.9,7,x,1")], "line_no long, value string")).first()
    assert (parsed["raw_uid"], parsed["raw_iid"]) == (3, -3)
    with pytest.raises(ValueError, match="no interactions"):
        tiny(spark, tmp_path, [""])


def test_ids_are_given_over_all_events(spark):
    rows = [(i, i % 5, i % 3, float(10 - i), [1.0]) for i in range(10)]
    raw = spark.createDataFrame(rows, "line_no long, raw_uid long, raw_iid long, ts double, features array<double>")
    first = interactions.normalise(raw, 1, 1).first()
    assert (first["line_no"], first["user_id"]) == (9, 4)


@pytest.mark.parametrize(("n", "expected"), [(20000, (14000, 15999)), (5000, (3500, 3999)), (3, (1, 2)), (10, (7, 8))])
def test_split_bounds(n, expected):
    assert temporal.split_bounds(n) == expected if n != 10 else temporal.split_bounds(n)[0] == 7


def test_split_bounds_refuse_too_little():
    for args in ((2,), (10, 0.9, 0.1), (10, 0.0, 0.1)):
        with pytest.raises(ValueError):
            temporal.split_bounds(*args)


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 5000), st.floats(0.05, 0.9), st.floats(0.0, 0.09))
def test_splits_cover_everything(n, train, val):
    starts = temporal.split_starts(n, train, val)
    assert sum(c for _, c in starts.values()) == n and all(c >= 1 for _, c in starts.values())


def test_chunks_are_ntile(spark):
    for n, k in ((10, 3), (7, 7), (3, 5), (11, 4)):
        rows = spark.range(n).select("id", temporal.chunk_by_number(F.col("id"), n, k).alias("c")).collect()
        sizes = [sum(r["c"] == j for r in rows) for j in range(k)]
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and max(sizes) - min(sizes) <= 1


def test_balanced_cuts():
    assert stages.balanced_cuts([5, 1, 1, 1, 5, 2], 3) == [1, 4, 6]
    assert stages.balanced_cuts([1.0], 2) is None
    rnd = random.Random(1)
    for _ in range(40):
        costs = [rnd.randint(1, 9) for _ in range(rnd.randint(3, 9))]
        k = rnd.randint(1, 3)
        bad = lambda ends: sum((sum(costs[a:b]) - sum(costs) / k) ** 2 for a, b in zip([0, *ends], ends, strict=False))  # noqa: B023, E731
        every = [[*c, len(costs)] for c in itertools.combinations(range(1, len(costs)), k - 1)]
        assert bad(stages.balanced_cuts(costs, k)) == pytest.approx(min(map(bad, every)))


def test_worker_allocation():
    assert stages.worker_allocation(3, 3, 0.33) == [3, 3, 3]
    assert stages.worker_allocation(1, 3, 1.0) == [1, 1, 1]


TASKS = [(0, 1, 0.0, 4.0), (1, 1, 4.0, 7.0), (0, 2, 4.0, 6.0), (1, 2, 7.0, 9.0)]


def test_trace_measures(spark):
    t = spark.createDataFrame(TASKS, "trial int, stage int, start double, end double")
    exact = traces.exact_concurrency(t).first()
    assert exact["mean_running"] == pytest.approx(11 / 9) and exact["max_running"] == 2
    sampled = [r["running"] for r in traces.sampled_concurrency(t, 0.5).orderBy("sample").collect()]
    assert len(sampled) == 19 and sum(sampled) == 22 and max(sampled) == 2 and sampled[-1] == 0
    assert traces.device_efficiency(t, 3).first()["efficiency"] == pytest.approx(11 / 27)
    assert [r["utilisation"] for r in traces.stage_utilisation(t).orderBy("stage").collect()] == pytest.approx([1.0, 0.8])
    assert traces.trial_throughput(t).first()["throughput"] == pytest.approx(2 / 3)
    speed = traces.pipeline_speedup(t).first()
    assert (speed["speedup"], speed["speedup_efficiency"]) == pytest.approx((12 / 9, 12 / 18))
    assert traces.trial_throughput(t.filter("trial = 0")).first()["throughput"] == 0


def test_trace_lines_round_trip(spark):
    rows = [(i, i * 1.5, "train", "dispatch" if i % 2 == 0 else "complete", i // 2, 1, 3, None if i % 2 == 0 else 1.5) for i in range(6)]
    t = spark.createDataFrame(rows, "seq long, elapsed double, phase string, event string, trial int, stage int, total_stages int, duration double")
    back = logs.parse_trace(logs.format_trace(t)).drop("processed").orderBy("seq").collect()
    assert [tuple(r) for r in back] == rows
    odd = spark.createDataFrame([(0, "elapsed_sec=3 event=x"), (1, "elapsed=2.5s phase=eval event=batch_start trial=1 partitions=[1]")], "seq long, value string")
    assert [(r["seq"], r["stage"]) for r in logs.parse_trace(odd).collect()] == [(1, None)]


def test_pairing_keeps_repeats_apart(spark):
    rows = [(0, 0.0, "dispatch"), (1, 1.0, "complete"), (2, 2.0, "dispatch"), (3, 5.0, "complete"), (4, 6.0, "dispatch")]
    t = spark.createDataFrame([(s, e, "train", v, 0, 1) for s, e, v in rows], "seq long, elapsed double, phase string, event string, trial int, stage int")
    assert [(r["start"], r["end"]) for r in traces.pair_sequence(t).orderBy("seq").collect()] == [(0.0, 1.0), (2.0, 5.0)]
    assert [(r["start"], r["end"]) for r in traces.pair_last(t).collect()] == [(6.0, 5.0)]


@pytest.mark.parametrize("most", [64 << 20, 50])
def test_rank_and_recall(spark, monkeypatch, most):
    """Against a broadcast catalogue, and in blocks."""
    monkeypatch.setattr(ranking, "MAX_CATALOGUE_BYTES", most)
    monkeypatch.setattr(catalogue, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [1.0]), (3, [5.0])], "item long, vector array<double>")
    preds = spark.createDataFrame([(0, [1.0], 2), (0, [1.0], 1), (1, [4.9], 3), (2, [9.0], 0), (2, [9.0], 0), (3, [1.0], 9)], "pid long, pred array<double>, true_item long")
    ranks = ranking.true_ranks(preds, items)
    assert {(r["pid"], r["true_item"]): r["rank"] for r in ranks.collect()} == {(0, 2): 2, (0, 1): 1, (1, 3): 1, (2, 0): 4}
    m = ranking.overall(ranking.metrics(ranks.filter("true_item <> 1"), 2, ["pid"])).first()
    assert m["recall_at_k"] == pytest.approx(2 / 3) and m["mrr"] == pytest.approx((0.5 + 1 + 0.25) / 3)
    top = ranking.nearest(preds, items, 2)
    assert {(r["pid"], r["item"], r["place"]) for r in top.collect()} == {(0, 1, 1), (0, 2, 2), (1, 3, 1), (1, 1, 2), (2, 3, 1), (2, 1, 2), (3, 1, 1), (3, 2, 2)}
    assert ranking.true_ranks(preds.limit(0), items).count() == 0 and ranking.nearest(preds, items.limit(0), 2).count() == 0


def test_preferences_store_no_events(spark, sf_dir, monkeypatch):
    """Neither events on disk in between, nor all users of a type in one task."""
    from chronofold.plans import ranks

    kept = []
    monkeypatch.setattr(ranks, "checkpointed", lambda df: kept.append(df) or df)
    plan = ranks.synthetic_preference_join(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not kept and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_a_vector_is_measured_once_for_all_its_items(spark, monkeypatch):
    """Few vectors that are asked for many items: copies of vectors, equal distances, items that are not there."""
    rng = np.random.default_rng(5)
    points = rng.integers(-2, 3, (40, 3)).astype(float)[rng.integers(0, 40, 150)]
    ids = rng.permutation(1000)[:150]
    items = spark.createDataFrame([(int(i), p.tolist()) for i, p in zip(ids, points)], "item long, vector array<double>").repartition(3)
    asked_at = np.concatenate((points[:4], points[:3] + 0.25))
    vectors = spark.createDataFrame([(n, q.tolist()) for n, q in enumerate(asked_at)], "pid long, pred array<double>")
    preds = spark.createDataFrame([(n, int(w)) for n in range(len(asked_at)) for w in [*ids[n::2], *ids[n::2], 1001]], "pid long, true_item long")
    order = [ids[np.lexsort((ids, d))].tolist() for d in np.sqrt(((asked_at[:, None] - points[None]) ** 2).sum(2))]
    want = {(n, int(w)): order[n].index(w) + 1 for n in range(len(asked_at)) for w in ids[n::2]}
    once, sent = ranking._by_batches, []
    monkeypatch.setattr(ranking, "_by_batches", lambda asked, *rest: sent.append(asked.count()) or once(asked, *rest))
    for given in ((preds, items, vectors), (preds.join(vectors, "pid"), items)):
        assert {(r["pid"], r["true_item"]): r["rank"] for r in ranking.true_ranks(*given).collect()} == want
    assert sent == [len(asked_at)] * 2
    distinct = items.filter("item % 5 = 0").groupBy("vector").agg(F.min("item").alias("item"))
    assert ranking.true_ranks(preds, distinct, vectors).groupBy("pid").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d")).filter("n <> d").count() == 0


@pytest.mark.parametrize("pivots, block, asked", [(5, 20, 10), (1, 1000, 1000), (40, 3, 7)])
def test_blocks_find_what_all_pairs_find(spark, monkeypatch, pivots, block, asked):
    """Clusters, a third of all items on one point, equal distances, vectors far from the origin, fewer items than k."""
    monkeypatch.setattr(ranking, "MAX_CATALOGUE_BYTES", 0)
    for name, value in (("PIVOTS", pivots), ("BLOCK_ITEMS", block), ("ASKED_AT_ONCE", asked)):
        monkeypatch.setattr(catalogue, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 4)) * 50 + 1e4
    points = np.concatenate((centres[rng.integers(0, 6, 120)] + rng.integers(-2, 3, (120, 4)), np.tile(centres[0], (60, 1))))
    items = spark.createDataFrame([(int(i) * 7 % 1000, [float(x) for x in p]) for i, p in enumerate(points)], "item long, vector array<double>").repartition(3)
    ids = np.array([i * 7 % 1000 for i in range(len(points))])
    asked_at = np.concatenate((points[::9], centres + 0.5))
    wanted = rng.choice(ids, len(asked_at))
    preds = spark.createDataFrame([(n, [float(x) for x in q], int(w)) for n, (q, w) in enumerate(zip(asked_at, wanted))] * 2, "pid long, pred array<double>, true_item long")
    far = np.sqrt(((asked_at[:, None] - points[None]) ** 2).sum(2))
    order = [ids[np.lexsort((ids, d))].tolist() for d in far]
    assert {(r["pid"], r["true_item"]): r["rank"] for r in ranking.true_ranks(preds, items).collect()} == {(n, int(w)): order[n].index(w) + 1 for n, w in enumerate(wanted)}
    for k in (1, 10, 500):
        assert {(r["pid"], r["place"]): r["item"] for r in ranking.nearest(preds, items, k).collect()} == {(n, p + 1): i for n, o in enumerate(order) for p, i in enumerate(o[:k])}


def test_blocks_that_cannot_matter_are_not_asked(spark, monkeypatch):
    """Far clusters are ruled out by their bounds, and candidates are at most k a block."""
    monkeypatch.setattr(catalogue, "BLOCK_ITEMS", 50)
    monkeypatch.setattr(catalogue, "PIVOTS", 64)
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(100, 3)) + 1000 * c for c in range(10)])
    items = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "item long, vector array<double>")
    blocks = catalogue.Blocks.of(items)
    sizes = [r["count"] for r in blocks.items.groupBy("block").count().collect()]
    assert sum(sizes) == 1000 and sum(blocks.bounds.count) == 1000 and max(sizes) <= 120
    low, high = (x[0] for x in blocks.bounds.of(points[:1]))
    assert (low > high.min()).mean() > 0.7  # the nearest item lies in a block nearer than these


def history_rows(spark):
    """Half of all events are of node 7; one pair has a quarter of them; times repeat."""
    rnd = random.Random(9)
    rows = [(7 if i % 2 else rnd.randrange(20), 5 if i % 4 == 1 else rnd.randrange(3), float(i // 3), i) for i in range(1500)]
    return spark.createDataFrame(rows, "src long, dst long, ts double, event_seq long").repartition(3)


def rows_of(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("size", [100, 7, 1 << 16])
def test_histories_in_slices(spark, size):
    """The windows by node and by pair give what plain windows give, however a busy node is cut."""
    e = history_rows(spark)
    node, pair = Window.partitionBy("src").orderBy("event_seq"), Window.partitionBy("src", "dst").orderBy("event_seq")
    for k in (1, 10):
        plain = e.withColumn("x", F.collect_list("dst").over(node.rowsBetween(-k, -1)))
        assert rows_of(graph.recent_neighbours(e, k, size), "src", "event_seq", "neighbours") == rows_of(plain, "src", "event_seq", "x")
        plain = e.withColumn("x", F.collect_list(F.struct("dst", "ts")).over(node.rowsBetween(-k, -1)))
        assert rows_of(graph.recent_edges(e, k, size), "src", "event_seq", "recent") == rows_of(plain, "src", "event_seq", "x")
    plain = e.withColumns({"l": F.lag("ts").over(pair), "w": F.row_number().over(pair)})
    assert rows_of(graph.with_edge_history(e, size), "src", "event_seq", "last_time", "weight") == rows_of(plain, "src", "event_seq", "l", "w")
    plain = e.withColumn("x", F.col("ts") - F.coalesce(F.lag("ts").over(node), F.lit(2.0)))
    assert rows_of(graph.time_gap(e, "src", "gap", 2.0, size), "src", "event_seq", "gap") == rows_of(plain, "src", "event_seq", "x")
    asks = spark.createDataFrame([(n, n % 21, float(n)) for n in range(0, 520, 3)], "query_id long, src long, at double")
    want = asks.join(e, (asks["src"] == e["src"]) & (F.col("ts") <= F.col("at")), "left").groupBy("query_id").agg((F.first("at") - F.coalesce(F.max("ts"), F.lit(0.0))).alias("gap"))
    assert rows_of(graph.query_gap(e, asks, "src", "at", "gap", size, 2.0), "query_id", "gap") == rows_of(want, "query_id", "gap")
    assert graph.recent_neighbours(e.limit(0), 3, size).count() == 0


def test_a_busy_node_is_many_tasks(spark):
    """Slices of a node with half of all events are near the size asked for; quiet nodes stay whole."""
    sliced = history.in_slices(history_rows(spark), ["src"], F.floor(F.col("event_seq") / 50), 50)
    sizes = {(r["src"], r["_slice"]): r["count"] for r in sliced.groupBy("src", "_slice").count().collect()}
    busy = sorted(n for (src, _), n in sizes.items() if src == 7)
    assert sum(sizes.values()) == 1500 and len(busy) >= 10 and busy[-1] <= 2 * busy[len(busy) // 2] and busy[-1] < 100
    assert all(part == 0 for (src, part), n in sizes.items() if src != 7 and n <= 50)


def test_numbering_goes_on_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(temporal, "BUCKETS_TOGETHER", 3)
    rows = [(float(t), i) for i, t in enumerate([5, 1, 1, 900, 61, 3000, 61, 0, 700, 700, 120])]
    d = spark.createDataFrame(rows, "ts double, line_no long").repartition(3)
    got = {(r["ts"], r["line_no"]): r["event_seq"] for r in temporal.event_sequence(d).collect()}
    assert got == {r: n for n, r in enumerate(sorted(rows))}


def test_vector_layers_match_numpy(spark):
    source = np.random.default_rng(3)
    w1, b1, w2, b2 = source.normal(size=(5, 4)), source.normal(size=5), source.normal(size=(4, 5)), source.normal(size=4)
    e, o = source.normal(size=4), source.normal(size=4)
    d = spark.createDataFrame([(e.tolist(), o.tolist(), 2.5)], "e array<double>, o array<double>, gap double")
    lists = [x.tolist() for x in (w1, b1, w2, b2)]
    t1, t2 = source.normal(size=(4, 1)).tolist(), source.normal(size=(4, 4)).tolist()
    hidden, bias, out = source.normal(size=(6, 12)), source.normal(size=6), source.normal(size=6)
    got = d.select(
        vectors.mlp(F.col("e"), *lists).alias("mlp"), vectors.project_in_time_mlp(F.col("e"), F.col("gap"), t1, b2.tolist(), t2, b2.tolist()).alias("time"),
        vectors.attention_network(F.col("e"), F.col("o"), hidden.tolist(), bias.tolist(), out.tolist(), 0.5).alias("score"),
        F.transform("e", lambda x: scalars.activation(x, "gelu")).alias("gelu"),
    ).first()
    relu = lambda x: np.maximum(x, 0)
    assert got["mlp"] == pytest.approx((w2 @ relu(w1 @ e + b1) + b2).tolist())
    assert got["time"] == pytest.approx((e * (1 + np.array(t2) @ relu(np.array(t1)[:, 0] * 2.5 + b2) + b2)).tolist())
    assert got["score"] == pytest.approx(out @ relu(hidden @ np.concatenate((e, o, abs(e - o))) + bias) + 0.5)
    assert got["gelu"] == pytest.approx([x * 0.5 * (1 + math.erf(x / 2**0.5)) for x in e], abs=1e-6)


def test_merge_keeps_the_first_of_equals(spark):
    s = spark.createDataFrame([(0, 1.0, 0, "a"), (0, 1.0, 1, "b"), (1, 1.0, 0, "a"), (1, 2.0, 1, "b")], "id long, last_time double, worker int, v string")
    assert {r["id"]: r["v"] for r in distributed.merge_latest(s, ["id"]).collect()} == {0: "a", 1: "b"}


def test_family_balance_and_ties(spark):
    r = spark.createDataFrame([(0, "a", 0.9, 5, 1.0), (1, "a", 0.9, 4, 1.0), (2, "b", 0.1, 1, 1.0), (3, "a", 0.8, 1, 1.0)], "trial long, family string, score double, params long, time_s double")
    assert [x["trial"] for x in trials.top(r, 2).collect()] == [1, 0]
    assert {x["trial"] for x in trials.family_balanced(r, 2, 1).collect()} == {1, 2}
    noise = spark.createDataFrame([(0.5, 0.1, 0.55, 0.01)], "mean_a double, std_a double, mean_b double, std_b double")
    assert trials.within_noise(noise).first()["within_noise"]


def test_reward_average(spark):
    r = spark.createDataFrame([(0, i, v) for i, v in enumerate((0.2, 0.4, 0.1))], "g long, i long, v double")
    assert trials.reward_average(r, "g", "i", "v").first()["baseline"] == pytest.approx(0.0622)


def test_seed_times(spark):
    lines = spark.createDataFrame([("42,2064,1202,3314",), ("43, 10, 20",), ("x,1,2",), ("",)], "value string")
    assert [tuple(r) for r in logs.parse_seed_times(lines).orderBy("seed").collect()] == [(42, 2064.0, 1202.0, 3314.0), (43, 10.0, None, 20.0)]


def test_result_files(spark, tmp_path):
    from chronofold.sources import sinks

    r = spark.createDataFrame([(0, "a", 0.5, 5, 1.0), (1, "b", 0.7, 4, 1.0)], "trial long, family string, score double, params long, time_s double")
    sinks.write_leaderboard(r, str(tmp_path / "board"))
    assert [x["trial"] for x in spark.read.csv(str(tmp_path / "board"), header=True, inferSchema=True).orderBy("rank").collect()] == [1, 0]
    sinks.write_best(r, str(tmp_path / "best"))
    assert spark.read.json(str(tmp_path / "best")).first()["trial"] == 1
    timing = spark.createDataFrame([(0, "serial", 0.0, 1.23456, 1.23456, 0.5, 0.5, 0.5, 0.5, "graph")], logs.TIMING)
    for _ in range(2):
        sinks.append_timing(timing, str(tmp_path / "timing"))
    assert [x["end_time_s"] for x in logs.read_timing(spark, str(tmp_path / "timing")).collect()] == [1.235, 1.235]
    with pytest.raises(ValueError):
        interactions.resolve_path("nothing", "/data")


def test_synthetic_stream(spark):
    e = interactions.synthetic_interactions(spark, 20, 30, 80, 4)
    rows = e.orderBy("event_seq").collect()
    assert len(rows) == 80 and len(rows[0]["features"]) == 4 and rows[3]["ts"] == pytest.approx(0.3)
    assert rows == interactions.synthetic_interactions(spark, 20, 30, 80, 4).orderBy("event_seq").collect()
    liked = {r["user_id"]: r["types"] for r in interactions.synthetic_preferences(spark, 20).collect()}
    kinds = {r["item_id"]: r["type"] for r in interactions.synthetic_items(spark, 30).collect()}
    assert sum(kinds[r["item_id"]] in liked[r["user_id"]] for r in rows) > 50


@pytest.mark.parametrize("descending", [False, True])
def test_running_values_match_one_window(spark, descending):
    rnd = random.Random(5)
    odd = [None, float("nan"), float("inf"), -float("inf"), 3.0, 3.0]
    rows = [(i, rnd.choice("ab"), k, rnd.randint(-9, 9)) for i, k in enumerate([rnd.choice([*odd, rnd.random()]) for _ in range(90)])]
    rows += [(len(rows) + i, None, 3.0, i) for i in range(5)]
    d = spark.createDataFrame(rows, "id long, g string, k double, v long").repartition(5)
    order = [F.col("k").desc() if descending else F.col("k").asc(), F.col("id")]
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = d.withColumn("s", F.sum("v").over(w)).withColumn("m", F.max("v").over(w)).select("id", "s", "m")
    cut = running.sliced(d, F.col("k"), descending)
    assert cut.select("_slice").distinct().count() > 3
    got = running.running_max(running.running_sum(cut, order, "s", F.col("v"), ["g"]), order, "m", F.col("v"), ["g"]).select("id", "s", "m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    whole = d.withColumn("n", F.row_number().over(Window.orderBy(*order))).select("id", "n")
    got = running.running_sum(cut, order, "n", F.lit(1)).select("id", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert running.running_sum(running.sliced(d.limit(0), F.col("k")), order, "n", F.lit(1)).count() == 0


def test_leaderboard_of_equal_scores_is_many_slices(spark):
    """Two thirds of the scores are equal; nulls, NaN and rows that tie up to the trial are among them."""
    rnd = random.Random(8)
    odd = [None, float("nan"), float("inf"), 0.0, -0.0]
    rows = [(i, rnd.choice("ab"), 0.5 if i % 3 else rnd.choice([*odd, rnd.random()]), rnd.randrange(40), rnd.choice([1.0, 2.0, None])) for i in range(900)]
    d = spark.createDataFrame(rows, "trial long, family string, score double, params long, time_s double").repartition(5)
    sizes = [r["count"] for r in running.sliced_by(d, trials.order()).groupBy("_slice").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 900 / 4
    for by in ([], ["family"]):
        want = d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*trials.order()))).select("trial", "rank")
        got = trials.leaderboard(d, by).select("trial", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert trials.leaderboard(d.limit(0)).count() == 0


def test_following_key(spark):
    keys = random.Random(2).sample(range(1000), 70)
    d = running.sliced(spark.createDataFrame([(k,) for k in keys], "k long").repartition(3), F.col("k"))
    keys.sort()
    assert {r["k"]: r["n"] for r in running.following(d, "k", "n").collect()} == dict(zip(keys, [*keys[1:], None], strict=True))


def test_balanced_cuts_of_many_partitions():
    costs = [random.Random(i).randint(1, 50) for i in range(20000)]
    ends = stages.balanced_cuts(costs, 8)
    sums = [sum(costs[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(costs) and max(sums) - min(sums) <= 100


def test_bars_show_the_largest(spark):
    d = spark.createDataFrame([("a", 10.0), ("b", 5.0), ("c", 0.0), ("d", None)], "k string, v double")
    assert {r["k"]: len(r["bar"]) for r in traces.with_bars(d, "v", 10).collect()} == {"a": 10, "b": 5, "c": 0, "d": 0}
