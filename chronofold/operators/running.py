"""Running values over a whole table that never meets in one task.

A table is cut into slices of a number, as many as a shuffle has partitions, at quantiles that are counted first (an
action). A slice is one task's work; what earlier slices add up to is a row for each slice. As the rows are read for the
quantiles, the sums of slices and the result, they are checkpointed, and what they come from is worked out once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed


def sliced(df: DataFrame, key: Column, descending: bool = False) -> DataFrame:
    """Adds _slice, which never decreases along key: nulls first and NaN last, the other way round if descending.

    Rows of equal key share a slice, so a key should tell most rows apart; sliced_by takes further columns.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(df.withColumn("_key", key.cast("double")))
    cuts = rows.approxQuantile("_key", [i / slices for i in range(1, slices)], 0.25 / slices) if slices > 1 else []
    cuts = [c for c in sorted(set(cuts)) if abs(c) != float("inf")]
    if cuts:
        rows = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_key", outputCol="_slice", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("_slice", F.when(F.isnan("_key"), 1).otherwise(0))
    place = F.when(F.col("_key").isNull(), -1).otherwise(F.col("_slice")).cast("int")
    return rows.withColumn("_slice", -place if descending else place).drop("_key")


def sliced_by(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Adds _slice, which never decreases along a whole order, so rows that tie in its first columns are many slices too.

    Spark's range partitioning draws the bounds from a sample; the rows are checkpointed, so each keeps its slice. Only
    rows that are equal in every column of the order share one.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()))


def running(
    rows: DataFrame, order: Sequence[Column | str], name: str, value: Column, fold: Callable[..., Column], join: Callable[[Column, Column], Column], by: Sequence[str] = ()
) -> DataFrame:
    """Adds fold (an aggregate such as F.max) of value over all rows up to each one, within each group of by.

    rows have _slice, along which order never decreases. join puts the folds of two stretches together; that of earlier
    slices, its first argument, is null for none.
    """
    here = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    totals = rows.groupBy(*by, "_slice").agg(fold(value).alias("_total"))
    keys = [*by, "_slice"]
    before = totals.withColumn("_before", fold(F.col("_total")).over(earlier)).select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(keys)], "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at{i}")) for i, c in enumerate(keys)])
    out = rows.withColumn("_here", fold(value).over(here)).join(before, same)
    return out.withColumn(name, join(F.col("_before"), F.col("_here"))).drop("_before", "_here", *[f"_at{i}" for i in range(len(keys))])


def running_sum(rows: DataFrame, order: Sequence[Column | str], name: str, value: Column, by: Sequence[str] = ()) -> DataFrame:
    return running(rows, order, name, value, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b, by)


def running_max(rows: DataFrame, order: Sequence[Column | str], name: str, value: Column, by: Sequence[str] = ()) -> DataFrame:
    return running(rows, order, name, value, F.max, lambda a, b: F.greatest(a, b), by)


def following(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the next larger key of a table in which keys are distinct; null for the last. rows have _slice."""
    firsts = rows.groupBy("_slice").agg(F.min(key).alias("_first"))
    after = firsts.select("_slice", F.lead("_first").over(Window.orderBy("_slice")).alias("_after"))  # a row for each slice
    inside = F.lead(key).over(Window.partitionBy("_slice").orderBy(key))
    return rows.withColumn("_inside", inside).join(after, "_slice").withColumn(name, F.coalesce("_inside", "_after")).drop("_inside", "_after")
