"""Search results. Pseudo-trials come from line items: a part and return flag is a trial of the flag's family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import trials
from . import base
from .base import query

_T = """
    WITH t0 AS (
        SELECT l_partkey, l_returnflag AS family, CAST(sum(round(l_discount * 100)::BIGINT) AS DOUBLE) / (count(*) * 100) AS score, CAST(sum(l_quantity) AS BIGINT) AS params,
               CAST(sum(round(l_tax * 100)::BIGINT) AS DOUBLE) / (count(*) * 100) AS time_s, min(l_linenumber) AS first_line
        FROM lineitem GROUP BY 1, 2),
    t AS (SELECT l_partkey * 3 + CASE family WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS trial, l_partkey, family, score, params, time_s, first_line,
          CASE WHEN l_partkey % 2 = 0 THEN 'val' ELSE 'test' END AS eval_split FROM t0)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*") * 100
    rows = base.table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("family")).agg(
        (F.sum(base.cents("l_discount")).cast("double") / n).alias("score"), F.sum("l_quantity").cast("bigint").alias("params"), (F.sum(base.cents("l_tax")).cast("double") / n).alias("time_s"), F.min("l_linenumber").alias("first_line")
    )
    number = F.when(F.col("family") == "A", 0).when(F.col("family") == "N", 1).otherwise(2)
    return rows.withColumn("trial", F.col("l_partkey") * 3 + number).withColumn("eval_split", F.when(F.col("l_partkey") % 2 == 0, "val").otherwise("test"))


_ORDER = "score DESC, params, time_s, trial"


@query(_T + f" SELECT trial, eval_split, CAST(row_number() OVER (PARTITION BY eval_split ORDER BY {_ORDER}) AS INTEGER) AS rank FROM t")
def leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within the split that was scored, so scores of different splits are never compared."""
    return trials.leaderboard(results(spark, sf_dir), ["eval_split"]).select("trial", "eval_split", "rank")


@query(_T + f" SELECT trial, CAST(row_number() OVER (PARTITION BY family ORDER BY {_ORDER}) AS INTEGER) AS rank FROM t")
def leaderboard_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.leaderboard(results(spark, sf_dir), ["family"]).select("trial", "rank")


@query(_T + f" SELECT trial, score, params FROM t ORDER BY {_ORDER} LIMIT 20")
def leaderboard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature."""
    return trials.top(results(spark, sf_dir), 20).select("trial", "score", "params")


@query(_T + f", o AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_ORDER}) AS own FROM t) SELECT trial, family FROM o ORDER BY own > 2, CASE WHEN own <= 2 THEN family END, {_ORDER} LIMIT 10")
def family_balanced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature."""
    return trials.family_balanced(results(spark, sf_dir), 10, 2).select("trial", "family")


@query(_T + " SELECT trial, greatest(0.0::DOUBLE, max(score) OVER (ORDER BY trial)) AS best_so_far FROM t")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.running_best(results(spark, sf_dir), "trial").select("trial", "best_so_far")


@query(_T + ", s AS (SELECT trial, params * 100000000 + trial AS ended, score FROM t) SELECT trial, ended, greatest(0.0::DOUBLE, max(score) OVER (ORDER BY ended)) AS best_so_far FROM s")
def convergence_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.convergence(results(spark, sf_dir).withColumn("ended", F.col("params") * 100000000 + F.col("trial")), "ended")


@query(_T + " SELECT family || first_line AS arch, count(*) AS seeds, round(avg(score), 6) AS score, round(avg(time_s), 6) AS time_s, string_agg(trial, ',' ORDER BY trial) AS trials FROM t GROUP BY 1")
def multi_seed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumns({"arch": F.concat("family", F.col("first_line").cast("string")), "seed": F.col("trial")})
    out = trials.multi_seed(rows, ["score", "time_s"])
    listed = F.array_join(F.transform("per_seed", lambda r: r["seed"].cast("string")), ",")
    return out.select("arch", "seeds", F.round("score", 6).alias("score"), F.round("time_s", 6).alias("time_s"), listed.alias("trials"))


@query("SELECT p_brand, round(avg(p_retailprice), 4) AS mean, round(coalesce(stddev_pop(p_retailprice), 0), 4) AS std, count(*) AS n FROM part GROUP BY 1")
def mean_std_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trials.mean_std(base.table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice")
    return out.select("p_brand", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query(_T + ", b AS (SELECT coalesce(nullif(score, 0), nullif(time_s, 0), 0) AS s, trial FROM t ORDER BY s DESC, trial LIMIT 5) SELECT round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(max(s), 6) AS max FROM b")
def top5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trials.top_scores(results(spark, sf_dir).withColumn("mrr", F.col("time_s")), 5)
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "max")])


@query("""
    WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    b AS (SELECT o_custkey, n, 0.0::DOUBLE * 0.9::DOUBLE + (1.0::DOUBLE - 0.9::DOUBLE) * r AS v FROM o WHERE n = 1
          UNION ALL SELECT o.o_custkey, o.n, b.v * 0.9::DOUBLE + (1.0::DOUBLE - 0.9::DOUBLE) * r FROM b JOIN o ON o.o_custkey = b.o_custkey AND o.n = b.n + 1)
    SELECT o_custkey, round(arg_max(v, n), 3) AS baseline FROM b GROUP BY o_custkey""")
def reward_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trials.reward_average(base.table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")
    return out.select("o_custkey", F.round("baseline", 3).alias("baseline"))


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with a configuration made from their part, one in eleven of them broken."""
    p = base.table(spark, sf_dir, "part")
    text = F.to_json(F.struct(F.col("p_type").alias("model"), F.concat(F.lit("h"), F.col("p_size") % 4).alias("agg"), F.col("p_brand").alias("cell"), (F.col("p_size") % 3).cast("string").alias("time_proj")))
    bad = F.col("p_partkey") % 11 == 0
    return p.select(F.col("p_partkey").alias("trial"), F.when(bad, "{broken").otherwise(text).alias("config_json"), (base.cents("p_retailprice") % 1000).cast("double").alias("score"), "p_partkey")


_CONF = """
    WITH c AS (SELECT p_partkey AS trial, (round(p_retailprice * 100)::BIGINT % 1000)::DOUBLE AS score, p_partkey,
        CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS model, CASE WHEN p_partkey % 11 <> 0 THEN 'h' || (p_size % 4) END AS agg,
        CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS cell, CASE WHEN p_partkey % 11 <> 0 THEN (p_size % 3)::VARCHAR END AS time_proj FROM part)"""


@query(_CONF + """ SELECT count(*) AS rows, count(DISTINCT model) AS n_model, count(DISTINCT agg) AS n_agg, count(DISTINCT cell) AS n_cell, count(DISTINCT time_proj) AS n_time_proj,
    string_agg(DISTINCT model, ',' ORDER BY model) AS set_model, string_agg(DISTINCT agg, ',' ORDER BY agg) AS set_agg,
    string_agg(DISTINCT cell, ',' ORDER BY cell) AS set_cell, string_agg(DISTINCT time_proj, ',' ORDER BY time_proj) AS set_time_proj FROM c""")
def arch_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.diversity(configs(spark, sf_dir), ["model", "agg", "cell", "time_proj"])


_FP = _CONF + ", f AS (SELECT *, coalesce(model, '') || '|' || coalesce(agg, '') || '|' || coalesce(cell, '') AS fingerprint FROM c), a AS (SELECT fingerprint, max(score) AS sa FROM f WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT fingerprint, max(score) AS sb FROM f WHERE p_partkey % 2 = 1 GROUP BY 1)"


def _boards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = configs(spark, sf_dir).withColumn("fingerprint", trials.fingerprint(["model", "agg", "cell"]))
    return c.filter("p_partkey % 2 = 0"), c.filter("p_partkey % 2 = 1")


@query(_FP + " SELECT fingerprint, sa AS score_a, sb AS score_b, sb - sa AS diff, abs(sb - sa) < 100 AS close FROM a JOIN b USING (fingerprint)")
def fingerprint_best_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _boards(spark, sf_dir)
    return trials.overlap(a, b, tolerance=100.0)


@query(_FP + " SELECT count(*) AS common FROM (SELECT fingerprint FROM a INTERSECT SELECT fingerprint FROM b)")
def fingerprint_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _boards(spark, sf_dir)
    return a.select("fingerprint").intersect(b.select("fingerprint")).agg(F.count("*").alias("common"))


@query(_FP + " SELECT abs(sb - sa) < 100 AS close, count(*) AS n, round(avg(sb - sa), 6) AS mean_diff FROM a JOIN b USING (fingerprint) GROUP BY 1")
def fingerprint_mean_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _boards(spark, sf_dir)
    return trials.overlap(a, b, tolerance=100.0).groupBy("close").agg(F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("mean_diff"))


_THREE = _T + ", w AS (SELECT l_partkey, max(score) FILTER (family = 'A') AS a, max(score) FILTER (family = 'N') AS n, max(score) FILTER (family = 'R') AS r FROM t GROUP BY 1)"


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of the three families of a part: the seeds of three methods."""
    return results(spark, sf_dir).groupBy("l_partkey").pivot("family", ["A", "N", "R"]).agg(F.max("score")).toDF("l_partkey", "a", "n", "r")


_WIN = "CASE WHEN a - n > 1e-6 THEN 'a' WHEN a - n < -1e-6 THEN 'n' WHEN a - n IS NOT NULL THEN 'tie' END"


@query(_THREE + f" SELECT l_partkey, {_WIN} AS winner FROM w")
def pairwise_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return three(spark, sf_dir).select("l_partkey", trials.winner(F.col("a"), F.col("n"), "a", "n").alias("winner"))


@query(_THREE + f", x AS (SELECT {_WIN} AS winner FROM w) SELECT count(*) FILTER (winner = 'a') AS wins_a, count(*) FILTER (winner = 'n') AS wins_n, count(*) FILTER (winner = 'tie') AS wins_tie FROM x")
def win_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = three(spark, sf_dir).select(trials.winner(F.col("a"), F.col("n"), "a", "n").alias("winner"))
    return trials.win_counts(found, "winner", ["a", "n", "tie"])


@query(_THREE + """ SELECT l_partkey, CASE WHEN greatest(a, n, r) IS NULL THEN NULL WHEN a = greatest(a, n, r) THEN 'a' WHEN n = greatest(a, n, r) THEN 'n' ELSE 'r' END AS best FROM w""")
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = three(spark, sf_dir)
    return t.select("l_partkey", trials.best_method({"a": F.col("a"), "n": F.col("n"), "r": F.col("r")}).alias("best"))


@query(_THREE + " SELECT count(*) AS seeds, round(avg(a), 6) AS mean_a, round(stddev_pop(a), 6) AS std_a, round(avg(n), 6) AS mean_b, round(stddev_pop(n), 6) AS std_b, abs(avg(a) - avg(n)) < greatest(stddev_pop(a), stddev_pop(n), 1e-6) AS within_noise FROM w")
def within_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = three(spark, sf_dir).agg(F.count("*").alias("seeds"), F.avg("a").alias("mean_a"), F.stddev_pop("a").alias("std_a"), F.avg("n").alias("mean_b"), F.stddev_pop("n").alias("std_b"))
    return trials.within_noise(s).select("seeds", *[F.round(c, 6).alias(c) for c in ("mean_a", "std_a", "mean_b", "std_b")], "within_noise")


_RUNS = "WITH r AS (SELECT o_custkey, count(*) AS n_trials, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100 AS wall_s FROM orders GROUP BY 1)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_trials"), (F.sum(base.cents("o_totalprice")).cast("double") / 100).alias("wall_s"))


@query(_RUNS + " SELECT o_custkey, n_trials * 3600.0::DOUBLE / nullif(wall_s, 0) AS trials_per_hour, wall_s / n_trials AS s_per_trial FROM r")
def throughput_tph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.throughput(runs(spark, sf_dir)).select("o_custkey", "trials_per_hour", "s_per_trial")


@query(_RUNS + " SELECT round(avg(wall_s) FILTER (o_custkey % 2 = 0) / avg(wall_s) FILTER (o_custkey % 2 = 1), 6) AS speedup FROM r")
def speedup_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda rest: F.avg(F.when(F.col("o_custkey") % 2 == rest, F.col("wall_s")))
    return runs(spark, sf_dir).agg(F.round(scalars.ratio(mean(0), mean(1)), 6).alias("speedup"))


@query(_THREE + " SELECT l_partkey, round((n - a) * 100.0 / nullif(a, 0), 6) AS delta FROM w WHERE a IS NOT NULL AND n IS NOT NULL")
def pct_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = three(spark, sf_dir).filter("a is not null and n is not null")
    return t.select("l_partkey", F.round(scalars.percent_delta(F.col("n"), F.col("a")), 6).alias("delta"))


@query(_T + ", a AS (SELECT l_partkey, score FROM t WHERE family = 'A' AND l_partkey % 3 < 2), n AS (SELECT l_partkey, score FROM t WHERE family = 'N' AND l_partkey % 3 > 0) SELECT l_partkey, a.score AS score_a, n.score AS score_b, round(n.score - a.score, 9) AS delta FROM a FULL JOIN n USING (l_partkey)")
def trial_outer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    out = trials.outer_compare(r.filter("family = 'A' and l_partkey % 3 < 2"), r.filter("family = 'N' and l_partkey % 3 > 0"), "l_partkey")
    return out.withColumn("delta", F.round("delta", 9))


@query("""
    WITH p AS (SELECT o_orderstatus AS series, (o_orderdate::DATE - DATE '1992-01-01')::DOUBLE AS x, max(round(o_totalprice * 100)::BIGINT)::DOUBLE AS y FROM orders GROUP BY 1, 2),
    m AS (SELECT greatest(max(x), 1e-9) AS mx, greatest(max(y), 1e-9) AS my FROM p),
    c AS (SELECT series, CAST(least(floor(x / mx * 51 + 0.5), 51) AS INTEGER) AS col, CAST(9 - least(floor(y / my * 9 + 0.5), 9) AS INTEGER) AS row FROM p, m)
    SELECT row, col, CASE WHEN count(DISTINCT series) > 1 THEN '*' ELSE min(series) END AS glyph FROM c GROUP BY row, col""")
def convergence_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    o = base.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("series"), x.alias("x")).agg(F.max(base.cents("o_totalprice")).cast("double").alias("y"))
    return trials.convergence_grid(o)


@query("""
    WITH a AS (SELECT 'size' AS key, p_size::VARCHAR AS v, p_partkey FROM part UNION ALL SELECT 'brand', p_brand, p_partkey FROM part UNION ALL SELECT 'type', p_type, p_partkey FROM part)
    SELECT x.key, x.v AS value_a, y.v AS value_b FROM a x JOIN a y USING (key) WHERE x.p_partkey = 0 AND y.p_partkey = 1 AND x.v <> y.v""")
def metadata_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of two runs that disagree."""
    p = base.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    return trials.mismatches(p.filter("p_partkey = 0"), p.filter("p_partkey = 1"), ["size", "brand", "type"])


@query(_T + ", o AS (SELECT *, row_number() OVER (ORDER BY trial) AS n FROM t) SELECT trial FROM o WHERE n % 7 = 1")
def downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.every_nth(results(spark, sf_dir), "trial", 7).select("trial")


@query(_T + " SELECT trial, score FROM t ORDER BY trial DESC LIMIT 12")
def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature."""
    return trials.last_rows(results(spark, sf_dir), "trial", 12).select("trial", "score")


@query(_T + """, p AS (SELECT trial, family, score, 'coarse' AS phase FROM t WHERE params % 3 = 0 UNION ALL SELECT trial, family, score, 'rerank' FROM t WHERE params % 3 = 1 UNION ALL SELECT trial, family, score, 'final' FROM t WHERE params % 3 = 2)
    SELECT phase, family, count(*) AS n, max(score) AS best FROM p GROUP BY 1, 2""")
def phase_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of all phases in one table."""
    r = results(spark, sf_dir)
    parts = [r.filter(F.col("params") % 3 == i).select("trial", "family", "score", F.lit(p).alias("phase")) for i, p in enumerate(("coarse", "rerank", "final"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("phase", "family").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query(_THREE + " SELECT l_partkey, round(n - a, 9) AS delta_score FROM w WHERE a IS NOT NULL AND n IS NOT NULL")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched against baseline, by seed."""
    r = results(spark, sf_dir).select("l_partkey", "family", "score")
    searched, baseline = r.filter("family = 'N'").select("l_partkey", F.col("score").alias("s")), r.filter("family = 'A'").select("l_partkey", F.col("score").alias("b"))
    return searched.join(baseline, "l_partkey").select("l_partkey", F.round(F.col("s") - F.col("b"), 9).alias("delta_score"))


@query("""
    WITH s AS (SELECT s_suppkey AS seed, s_acctbal FROM supplier), t AS (SELECT c_custkey AS seed, round(c_acctbal * 100)::BIGINT AS serial_c FROM customer WHERE c_custkey % 2 = 0)
    SELECT seed, serial_c FROM s LEFT JOIN t USING (seed)""")
def seed_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds with their times, null where a run has none."""
    s = base.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seed"))
    t = base.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("seed"), base.cents("c_acctbal").alias("serial_c"))
    return s.join(t, "seed", "left")


@query("SELECT o_orderpriority, count(*) AS n, repeat('█', CAST(floor(count(*)::DOUBLE / max(count(*)) OVER () * 20 + 1e-9) AS INTEGER)) AS bar FROM orders GROUP BY 1")
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = base.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return n.withColumn("bar", scalars.bar(F.col("n").cast("double"), F.max("n").over(Window.partitionBy()).cast("double"), 20))
