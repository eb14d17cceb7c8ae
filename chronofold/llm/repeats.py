"""Where windows may repeat: the common first half of the two substring operators.

1. Every document gives its anchors; anchors that occur at least twice go into a bitmap sized by their number, 128 MB
   at most. Beyond that it fills up and lets more contexts through, which costs shuffling and changes no result.
2. A second scan keeps the windows whose anchor is in the bitmap and cuts them into contexts: the symbols of a run of
   windows with one anchor. Equal windows lie in contexts of one anchor, so an anchor is all that has to be brought
   together, and a context that many documents share is one row with a count.
3. What is found to repeat comes back as ranges of documents and is cut out in a last scan; only documents with ranges
   (found by a filter whose size is checked) are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bit_table, bits_for, id_of, key_filter, partitions, stored, with_maybe
from .windows import Bytes, Words, grams, runs, sliding_min, window_anchors

#: Bytes of text that are looked at together.
CHUNK_BYTES = 1 << 20
#: Distinct contexts of one anchor that a task compares; windows of further ones are counted one by one.
HOT_CONTEXTS = 1500
#: Bytes of distinct contexts that one shard of anchors holds, more or less; no shard grows with the input.
SHARD_BYTES = 1 << 20


@dataclass(frozen=True)
class Windows:
    """kind: word or byte; window and gram in symbols."""

    kind: str
    window: int
    gram: int

    @property
    def longest_run(self) -> int:
        return self.window - self.gram + 1

    def of(self, texts: list[bytes]) -> Words | Bytes:
        return Words(texts) if self.kind == "word" else Bytes(texts)

    def anchors(self, symbols: Words | Bytes) -> tuple[np.ndarray, np.ndarray]:
        return window_anchors(symbols.hashes, symbols.doc, self.window, self.gram, self.kind)

    def selected(self, symbols: Words | Bytes) -> np.ndarray:
        """The hashes of all grams that are the anchor of a window, one for each place where such a gram stands."""
        anchors, inside = self.anchors(symbols)
        if not len(anchors):
            return anchors
        edge = np.zeros(self.longest_run - 1, np.uint64)
        around = np.concatenate((edge, np.where(inside, anchors, np.uint64(0)), edge))
        found = grams(symbols.hashes, self.gram, self.kind)
        return found[~sliding_min(~around, self.longest_run) == found]  # the largest anchor of the windows around it


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): rows that agree in id and text are treated alike, others that share an id are kept apart by h."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_of(id_col).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Ids, hashes and texts, about CHUNK_BYTES at a time."""
    for batch in batches:
        ids, hashes, column = batch.column("id").to_pylist(), batch.column("h").to_pylist(), batch.column("text")
        start, size = 0, 0
        lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else []
        for i, n in enumerate(lengths):
            size += int(n)
            if size >= CHUNK_BYTES or i == len(column) - 1:
                yield ids[start : i + 1], hashes[start : i + 1], column[start : i + 1].to_pylist()
                start, size = i + 1, 0


def repeated_anchors(rows: DataFrame, spec: Windows) -> DataFrame:
    """(anchor, n) of the anchors that occur at least twice; n counts places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in chunks(batches):
            values, counts = np.unique(spec.selected(spec.of(texts)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["anchor", "n"])

    found = rows.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return found.filter("n > 1")


def anchor_bits(anchors: DataFrame):
    """The bitmap of anchors as a broadcast array, FILTER_BITS at most, so it may pass through the driver. anchors should
    be stored: they are counted first."""
    bits = bits_for(anchors.count()) or FILTER_BITS
    place = F.pmod(F.col("anchor"), F.lit(bits)) + 1
    found = anchors.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    return anchors.sparkSession.sparkContext.broadcast(bit_table(found.collect(), bits))


def _contexts(spec: Windows, bits: np.ndarray, texts: list[bytes]):
    """The symbols of some texts, and the first window, last window and anchor of each context."""
    symbols = spec.of(texts)
    anchors, inside = spec.anchors(symbols)
    at = (anchors & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    wanted = inside & ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
    first, last = runs(anchors, wanted, symbols.doc[: len(anchors)], spec.longest_run)
    return symbols, first, last, anchors[first].view(np.int64)


def distinct_contexts(rows: DataFrame, spec: Windows, bits) -> DataFrame:
    """(anchor, context, n): every distinct context and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in chunks(batches):
            symbols, first, last, anchors = _contexts(spec, bits.value, texts)
            counts: dict[tuple[int, bytes], int] = {}
            for anchor, a, b in zip(anchors.tolist(), first.tolist(), last.tolist(), strict=True):
                key = anchor, symbols.text(a, b + spec.window - 1)
                counts[key] = counts.get(key, 0) + 1
            columns = [pa.array([k[0] for k in counts], pa.int64()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "context", "n"])

    return rows.mapInArrow(run, "anchor long, context binary, n long").groupBy("anchor", "context").agg(F.sum("n").alias("n"))


def occurrences(rows: DataFrame, spec: Windows, bits, key: Callable[[bytes], bytes]) -> DataFrame:
    """(id, h, first, anchor, context) of every context of every document; context is key(context), first its symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, texts in chunks(batches):
            symbols, first, last, anchors = _contexts(spec, bits.value, texts)
            doc = symbols.doc[first]
            found = [key(symbols.text(a, b + spec.window - 1)) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            columns = [
                pa.array(np.array(ids, np.int64)[doc]), pa.array(np.array(hashes, np.int64)[doc]), pa.array((first - symbols.first[doc]).astype(np.int64)),
                pa.array(anchors), pa.array(found, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "first", "anchor", "context"])

    return rows.mapInArrow(run, "id long, h long, first long, anchor long, context binary")


def shards_for(contexts: DataFrame) -> int:
    """How many shards the contexts need. contexts should be stored."""
    size = contexts.agg(F.coalesce(F.sum(F.octet_length("context")), F.lit(0))).first()[0]
    return max(partitions(contexts.sparkSession), -(-size // SHARD_BYTES))


def dealt(rows: DataFrame, shards: int, *keys: str) -> DataFrame:
    """Rows by shard, over partitions that hold two shards or so: as many as the bytes need."""
    return rows.repartition(max(partitions(rows.sparkSession), shards // 2), *keys)


def split_hot(contexts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Contexts of anchors with a bounded number of them, and the others if there are any."""
    hot = stored(contexts.groupBy("anchor").count().filter(F.col("count") > HOT_CONTEXTS).select("anchor"), "hot-anchors")
    if hot.isEmpty():
        return contexts, None
    return contexts.join(hot, "anchor", "left_anti"), contexts.join(hot, "anchor", "left_semi")


def cut_out(rows: DataFrame, ranges: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """cut(text, ranges) for every document. ranges: (id, h, a, b), symbols a to b - 1 go. ranges should be stored."""
    lists = ranges.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("cuts"))
    marked = with_maybe(rows.withColumn("_key", F.xxhash64("id", "h")), F.col("_key"), key_filter(ranges.withColumn("_key", F.xxhash64("id", "h")), "_key"))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    safe = marked.filter("not _maybe").select("id", "text", none.alias("cuts"))
    doubt = marked.filter("_maybe").join(lists, ["id", "h"], "left").select("id", "text", F.coalesce("cuts", none).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("cuts")
            starts = column.offsets.to_numpy()
            a, b = (column.values.field(i).to_numpy() for i in range(2))
            texts = batch.column("text")
            out = [cut(texts[i].as_py(), a[starts[i] : starts[i + 1]], b[starts[i] : starts[i + 1]]) for i in range(len(texts))]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = ["id", *(c.split()[0] for c in schema.split(", "))]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]
    return safe.unionByName(doubt).mapInArrow(run, "id long, " + schema)


def gone(length: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of length symbols lie in a range."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, a, 1)
    np.add.at(steps, b, -1)
    return np.cumsum(steps[:-1]) > 0
