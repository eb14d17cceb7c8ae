"""What several operators share: stored tables, bounded id filters and small Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null id sorts after every other id; operators work with this number and give null back.
NULL_ID = 2**63 - 1

#: Bits of a filter for each key as long as it stays small (16 MB), at least so many beyond that, and the most bits of
#: one (128 MB). What would need more is joined by its hash instead.
FILTER_BITS_PER_KEY, SMALL_FILTER_BITS, LEAST_BITS_PER_KEY, FILTER_BITS = 64, 2**27, 16, 2**30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="chronofold-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Removes the files of tables made by stored() once nothing reads them any more."""
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(parent)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_back(column: Column) -> Column:
    return F.when(column != NULL_ID, column)


def bits_for(keys: int) -> int | None:
    """The size of a filter of so many keys: a power of two, a bucket of 2**15 at least. None: too many to broadcast."""
    wanted = max(min(FILTER_BITS_PER_KEY * keys, SMALL_FILTER_BITS), LEAST_BITS_PER_KEY * keys)
    bits = 1 << max(15, (wanted - 1).bit_length())
    return bits if bits <= FILTER_BITS else None


@dataclass(frozen=True)
class KeyFilter:
    """Hashes of keys: bits of a bitmap in buckets of 4 KB, or (bits is None) the distinct hashes themselves."""

    table: DataFrame
    bits: int | None


def key_filter(keys: DataFrame, key: str) -> KeyFilter:
    """A filter of one column without false negatives. Its keys are counted first: a bitmap that would pass FILTER_BITS is
    not built."""
    hashes = stored(keys.select(F.xxhash64(key).alias("_hash")), "filter-keys")
    bits = bits_for(hashes.count())
    if bits is None:
        return KeyFilter(hashes.distinct(), None)
    place = F.pmod("_hash", F.lit(bits)) + 1
    held = hashes.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    return KeyFilter(held, bits)


def with_maybe(df: DataFrame, key: Column, held: KeyFilter, flag: str = "_maybe") -> DataFrame:
    """Adds a flag that is true for every key of the filter and for few others (one in 16 to 64).

    A bitmap is broadcast, FILTER_BITS at most, and no row moves. Beyond that rows are joined with the distinct hashes
    on both sides' eight bytes, so they are shuffled once, whole.
    """
    if held.bits is None:
        there = held.table.withColumn(flag, F.lit(True))
        return df.withColumn("_hash", F.xxhash64(key)).join(there, "_hash", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_hash")
    place = F.pmod(F.xxhash64(key), F.lit(held.bits)) + 1
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return (
        df.withColumn("_bucket", F.bitmap_bucket_number(place))
        .withColumn("_at", F.bitmap_bit_position(place))
        .join(F.broadcast(held.table), "_bucket", "left")
        .withColumn(flag, F.coalesce(F.call_function("shiftright", byte, (F.col("_at") % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False)))
        .drop("_bucket", "_at", "_bits")
    )


def by_place(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named by their places, so that no name clashes, and the new names of some of them."""
    plain = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns)])
    return plain, [f"_{df.columns.index(c)}" for c in columns]


def bit_table(rows, bits: int) -> np.ndarray:
    """The buckets of a bitmap table, put together for tasks that look bits up in numpy."""
    out = np.zeros(bits // 8, np.uint8)
    for bucket, data in rows:
        at = (bucket - 1) * 4096
        out[at : at + 4096] = np.frombuffer(data, np.uint8)[: len(out) - at]
    return out


def binary_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column without nulls, without copying its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends
