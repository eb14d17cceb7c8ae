"""Interaction streams: from text lines, from event tables, and made up."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..operators.temporal import dense_ids, event_sequence, first_events, numbered

HEADER_WORDS = ("user", "user_id")
#: Named data sets that may be asked for; they are looked up in the data folder and never fetched.
KNOWN = ("mooc", "wikipedia", "reddit", "lastfm", "public_csv")


def resolve_path(name: str, folder: str, local: str = "") -> str:
    """The file of a named data set: the local path if given, else folder/name.csv."""
    if name not in KNOWN:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(KNOWN)}")
    if name == "public_csv" and not local:
        raise ValueError("public_csv needs a local path")
    path = local or os.path.join(folder, f"{name}.csv")
    return path


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of a file or folder, numbered from 1 in the order of files and splits."""
    text = spark.read.text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = text.select("value", place.alias("_split"), F.monotonically_increasing_id().alias("_row"))
    return numbered(rows, ["_row"], F.col("_split"), "line_no", run=F.col("_bucket.file")).select((F.col("line_no") + 1).alias("line_no"), "value")


def parse_lines(lines: DataFrame) -> DataFrame:
    """One row for each line that is neither blank nor a header: line_no, raw_uid, raw_iid, ts, features, problem.

    A line is user, item, time, an ignored label, and one or more features. problem says what is wrong, or is null.
    """
    cells = F.split(F.col("value"), ",")
    rows = lines.filter(F.trim("value") != "").withColumn("c", cells).filter(~F.lower(F.trim(F.col("c")[0])).isin(*HEADER_WORDS))
    features = F.transform(F.slice("c", 5, 1 << 20), scalars.finite)
    short = F.size("c") < 5
    uid, iid, ts = (F.when(~short, f(F.get("c", F.lit(i)))) for i, f in ((0, scalars.whole), (1, scalars.whole), (2, scalars.finite)))
    bad = uid.isNull() | iid.isNull() | ts.isNull() | F.exists(features, lambda x: x.isNull())
    problem = F.when(short, "fewer than 5 columns").when(bad, "not a finite number")
    return rows.select("line_no", uid.alias("raw_uid"), iid.alias("raw_iid"), ts.alias("ts"), F.when(~short, features).alias("features"), problem.alias("problem"))


def checked(parsed: DataFrame) -> DataFrame:
    """The parsed rows; a row with a problem ends the query with its line number."""
    stop = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("problem")))
    good = F.when(F.col("problem").isNotNull(), stop.cast("boolean")).otherwise(True)
    return parsed.filter(good).drop("problem")


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a problem."""
    return parsed.filter("problem is null").drop("problem"), parsed.filter("problem is not null").select("line_no", "problem")


def normalise(raw: DataFrame, feature_dim: int, max_events: int = 0) -> DataFrame:
    """Dense ids by first appearance over all rows, then order of time, then the first max_events."""
    if feature_dim <= 0:
        raise ValueError("feature_dim must be positive")
    users = dense_ids(raw, "raw_uid", "line_no", "user_id")
    items = dense_ids(raw, "raw_iid", "line_no", "item_id")
    rows = raw.join(users, "raw_uid").join(items, "raw_iid")
    if max_events:
        rows = first_events(rows, max_events)
    rows = event_sequence(rows)
    return rows.select("event_seq", "line_no", "ts", "user_id", "item_id", vectors.align(F.col("features"), feature_dim).alias("features"))


def read_interactions(spark: SparkSession, path: str, feature_dim: int, max_events: int = 0) -> DataFrame:
    """A file of interactions as a normalised stream; wrong lines and empty files are errors."""
    found = normalise(checked(parse_lines(read_lines(spark, path))), feature_dim, max_events)
    if found.isEmpty():
        raise ValueError(f"no interactions in {path}")
    return found


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as raw interactions: line_no, raw_uid, raw_iid, ts (seconds), features."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    item = F.get_json_object("props", "$.k").cast("bigint")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return events.select(F.col("event_id").alias("line_no"), F.col("user_id").alias("raw_uid"), item.alias("raw_iid"), seconds.alias("ts"), F.array(F.col("value")).alias("features"))


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts as a second stream, with many equal times."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6)
    features = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return both.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_no"), F.col("o_custkey").alias("raw_uid"), F.col("l_partkey").alias("raw_iid"), day.alias("ts"), features.alias("features"))


def universe(events: DataFrame) -> DataFrame:
    """(users, items): the largest id in use plus one."""
    return events.agg((F.max("user_id") + 1).alias("users"), (F.max("item_id") + 1).alias("items"))


def synthetic_items(spark: SparkSession, items: int, types: int = 10, seed: int = 42) -> DataFrame:
    """(item_id, type)."""
    return spark.range(items).select(F.col("id").alias("item_id"), F.pmod(F.xxhash64(F.lit(seed), F.lit("type"), "id"), F.lit(types)).cast("int").alias("type"))


def synthetic_preferences(spark: SparkSession, users: int, types: int = 10, seed: int = 42) -> DataFrame:
    """(user_id, types): two or three preferred types, the first in a hashed order of all of them."""
    ranked = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(types - 1)), lambda t: F.struct(F.xxhash64(F.lit(seed), F.col("id"), t).alias("h"), t.alias("t"))))
    n = F.pmod(F.xxhash64(F.lit(seed), F.lit("n"), "id"), F.lit(2)).cast("int") + 2
    return spark.range(users).select(F.col("id").alias("user_id"), F.transform(F.slice(ranked, F.lit(1), n), lambda x: x["t"]).alias("types"))


def synthetic_interactions(spark: SparkSession, users: int = 500, items: int = 1000, interactions: int = 3000, feature_dim: int = 8, seed: int = 42) -> DataFrame:
    """A stream in which four in five events pick an item of a preferred type. Every draw is a hash of its event, so
    the stream is the same on any cluster; items of a type are numbered, and a draw is a number among them."""
    draw = lambda *what: F.xxhash64(F.lit(seed), *[F.lit(w) if isinstance(w, str) else w for w in what])
    unit = lambda h: (F.pmod(h, F.lit(1 << 30)) + 0.5) / float(1 << 30)
    typed = synthetic_items(spark, items, seed=seed)
    number = F.row_number().over(Window.partitionBy("type").orderBy("item_id")) - 1
    listed = typed.withColumn("place", number)
    sizes = typed.groupBy("type").agg(F.count("*").alias("size"))
    events = spark.range(interactions).select(F.col("id").alias("event_seq"), (F.col("id") * 0.1).alias("ts"), F.pmod(draw("user", F.col("id")), F.lit(users)).alias("user_id"))
    events = events.join(synthetic_preferences(spark, users, seed=seed), "user_id")
    liked = F.element_at("types", (F.pmod(draw("which", F.col("event_seq")), F.size("types").cast("long")) + 1).cast("int"))
    any_type = F.pmod(draw("any", F.col("event_seq")), F.lit(10)).cast("int")
    events = events.withColumn("type", F.when(unit(draw("driven", F.col("event_seq"))) < 0.8, liked).otherwise(any_type)).join(F.broadcast(sizes), "type")  # ten rows
    events = events.withColumn("place", F.pmod(draw("item", F.col("event_seq")), F.col("size"))).join(listed, ["type", "place"])
    normal = F.transform(
        F.sequence(F.lit(0), F.lit(feature_dim - 1)),
        lambda d: F.sqrt(-2.0 * F.log(unit(F.xxhash64(F.lit(seed), F.col("event_seq"), d, F.lit("r"))))) * F.cos(2.0 * 3.141592653589793 * unit(F.xxhash64(F.lit(seed), F.col("event_seq"), d, F.lit("a")))),
    )
    return events.select("event_seq", "ts", "user_id", "item_id", normal.alias("features"))
