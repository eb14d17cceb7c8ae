"""Histories of keys of which one may hold a third of all events: windows by key in time slices with a carried edge.

A key with more events than ``SLICE_EVENTS`` is cut into slices along its order, each of at least so many events and of
at most as many more as one step of the order has. What a window needs of earlier slices is a row for each slice (its
last k entries, its sum), put together in the order of slices, and handed to the next one. So a popular key is as many
tasks as it has slices, and only these rows meet in one task. Other keys have one slice and nothing is carried.

The rows are read for the sizes, for the edges and for the result; they are checkpointed, so what they come from is
worked out once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

#: Events of a key that one slice has at least; also the events of a step of the order of events.
SLICE_EVENTS = 1 << 16


def in_slices(rows: DataFrame, by: list[str], step: Column, size: int) -> DataFrame:
    """Adds _slice and _cut (whether the key has several): slices of size rows of a key or a little more. step must not
    decrease along the order of a key's rows; the rows of a step stay together."""
    held = checkpointed(rows.withColumn("_step", step))
    earlier = Window.partitionBy(*by).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = held.groupBy(*by, "_step").agg(F.count("*").alias("_n"))
    steps = steps.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    cuts = steps.filter(F.col("_all") > size).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_step").alias("_at"), F.floor(F.col("_before") / size).alias("_slice"))
    out = held.join(cuts, _same(by) & (F.col("_step") == F.col("_at")), "left").drop("_step", "_at", *[f"_by{i}" for i in range(len(by))])
    return out.withColumns({"_cut": F.col("_slice").isNotNull(), "_slice": F.coalesce("_slice", F.lit(0))})


def _same(by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])


def _handed_on(sliced: DataFrame, edges: DataFrame, by: list[str], name: str, before: Column) -> DataFrame:
    """sliced with before, an expression over the edges of earlier slices of the key (by, _slice, ...), null for none."""
    table = edges.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_slice").alias("_of"), before.alias(name))
    return sliced.join(table, _same(by) & (F.col("_slice") == F.col("_of")), "left").drop("_of", *[f"_by{i}" for i in range(len(by))])


def _last(array: Column, k: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - k, F.lit(0)) + 1, k)


def last_entries(rows: DataFrame, by: list[str], order: str, step: Column, entry: Column, k: int, name: str, size: int = SLICE_EVENTS) -> DataFrame:
    """Adds the entries of the last k rows of the key before each row, oldest first. order tells the rows of a key apart."""
    sliced = in_slices(rows.withColumn("_entry", entry), by, step, size)
    own = Window.partitionBy(*by, "_slice")
    late = sliced.filter("_cut").withColumn("_place", F.row_number().over(own.orderBy(F.desc(order)))).filter(F.col("_place") <= k)
    edges = late.groupBy(*by, "_slice").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "_entry"))), lambda x: x["_entry"]).alias("_edge"))
    # a slice has an entry or more, so the last k lie in the k slices before
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(-k, -1)
    out = _handed_on(sliced, edges, by, "_carried", _last(F.flatten(F.collect_list("_edge").over(earlier)), k))
    here = F.collect_list("_entry").over(own.orderBy(order).rowsBetween(-k, -1))
    out = out.withColumn("_here", here)
    full = F.when(F.col("_carried").isNull() | (F.size("_here") == k), F.col("_here")).otherwise(_last(F.concat("_carried", "_here"), k))
    return out.withColumn(name, full).drop("_entry", "_slice", "_cut", "_carried", "_here")


def previous(rows: DataFrame, by: list[str], order: str, step: Column, value: Column, name: str, count: str | None = None, size: int = SLICE_EVENTS) -> DataFrame:
    """Adds the value of the key's row before each row, null for the first; count: also the number of its rows so far."""
    sliced = in_slices(rows.withColumn("_value", value), by, step, size)
    edges = sliced.filter("_cut").groupBy(*by, "_slice").agg(F.max_by(F.struct(F.col("_value").alias("value")), order).alias("_edge"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_slice")
    carried = F.struct(F.lag("_edge").over(earlier).alias("edge"), F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("n"))
    out = _handed_on(sliced, edges, by, "_carried", carried)
    own = Window.partitionBy(*by, "_slice").orderBy(order)
    out = out.withColumns({"_nth": F.row_number().over(own), "_lag": F.lag("_value").over(own)})
    out = out.withColumn(name, F.when(F.col("_nth") > 1, F.col("_lag")).otherwise(F.col("_carried.edge.value")))
    if count:
        out = out.withColumn(count, F.col("_nth") + F.coalesce(F.col("_carried.n"), F.lit(0)))
    return out.drop("_value", "_slice", "_cut", "_carried", "_nth", "_lag")


def latest(rows: DataFrame, by: list[str], order: list[str], step: Column, value: Column, name: str, size: int = SLICE_EVENTS) -> DataFrame:
    """Adds the last value of the key's rows up to each row that is not null, its own among them."""
    sliced = in_slices(rows.withColumn("_value", value), by, step, size)
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order)))
    edges = sliced.filter("_cut").groupBy(*by, "_slice").agg(last.alias("_edge"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    out = _handed_on(sliced, edges, by, "_carried", F.last("_edge", ignorenulls=True).over(earlier))
    own = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(own), F.col("_carried")))
    return out.drop("_value", "_slice", "_cut", "_carried")
