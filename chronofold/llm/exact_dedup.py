"""Exact deduplication with a log-structured merge index.

Each task keeps a memtable of digests and flushes it as sorted runs, one per shard, each with a Bloom filter.
Compaction streams the runs of a shard into levels that double: two runs are merged, a digest that the other one's
filter does not know passes through, the others are compared, and the smallest identifier stays. A row whose digest is
taken is a hit; every hit is compared byte for byte with the text of the row that stays, so a collision of digests
cannot remove a text.

At scale: a memtable holds a digest once, however often it occurs, so a group of copies shrinks to one row for each
run before any shuffle. Shards are as many as the rows need, ``SHARD_DIGESTS`` each, and a task holds one at a time. Only
texts of groups with more than one row are moved for the comparison, found by a filter whose size is checked; the row
that stays is repeated over salts in proportion to its group. Joins of hot digests are inner sort-merge joins with one
row a key on the index side, which adaptive execution can split.

Edge cases: a null text counts as empty; null ids sort last and come back as null; of repeated rows (same id, same
text) one is kept; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, binary_column, by_place, drop_stored, id_back, id_of, key_filter, partitions, stored, with_maybe

SPACE = r"[\x20\x09-\x0D]+"
#: Entries of a memtable before it is flushed, and rows that a shard of the index stands for.
MEMTABLE_ROWS, SHARD_DIGESTS = 1 << 17, 1 << 18
#: Bits of a run's filter for each digest, and the probes of one digest.
FILTER_BITS_PER_KEY, FILTER_PROBES = 10, 4
#: Members of a group that are compared with one repetition of the row that stays.
COPIES_PER_SALT = 256


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _probes(words: np.ndarray, bits: int) -> np.ndarray:
    """Places of each digest in a filter: (n, probes). words: (n, 4) 64-bit parts of the digests."""
    step = (words[:, 1] | np.uint64(1))[:, None] * np.arange(1, FILTER_PROBES + 1, dtype=np.uint64)
    return (words[:, 0][:, None] + step) % np.uint64(bits)


def _filter_of(words: np.ndarray) -> bytes:
    bits = max(64, len(words) * FILTER_BITS_PER_KEY // 8 * 8 + 8)
    flags = np.zeros(bits, bool)
    flags[_probes(words, bits).ravel()] = True
    return np.packbits(flags).tobytes()


def _in_filter(words: np.ndarray, data: bytes) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(data, np.uint8)).view(bool)
    return flags[_probes(words, len(flags))].all(1)


def _merged(words: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
    """Sorted by digest, one entry each: the smallest id and the sum of the sizes."""
    order = np.lexsort((ids, *words.T[::-1]))
    words, ids, sizes = words[order], ids[order], sizes[order]
    first = np.r_[True, (words[1:] != words[:-1]).any(1)] if len(words) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return words[at], ids[at], (np.add.reduceat(sizes, at) if len(at) else sizes)


def _joined(parts):
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _words(column: pa.Array) -> np.ndarray:
    """Digests of one length, padded to 32 bytes, as big-endian 64-bit parts."""
    raw, ends = binary_column(column)
    padded = np.zeros((len(column), 32), np.uint8)
    if len(column):
        length = int(ends[1] - ends[0])
        padded[:, :length] = raw[ends[0] : ends[-1]].reshape(-1, length)
    return padded.view(">u8").astype(np.uint64)


RUN_ARROW = pa.schema([("shard", pa.int64()), ("digests", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("filter", pa.binary())])
RUN_SCHEMA = "shard long, digests binary, ids binary, sizes binary, filter binary"
INDEX_SCHEMA = "key binary, keep_id long, group_size long"


def _memtables(shards: int, memtable_rows: int):
    """Tasks that turn (id, key) rows into sorted runs with filters, one of each shard for every full memtable."""

    def flush(parts) -> Iterator[pa.RecordBatch]:
        words, ids, sizes = _merged(*_joined(parts))
        shard = (words[:, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]).tolist()
        cuts = list(zip(edges[:-1], edges[1:], strict=True))
        digests = words.astype(">u8")
        columns = [[x[a:b].tobytes() for a, b in cuts] for x in (digests, ids, sizes)]
        filters = [_filter_of(words[a:b]) for a, b in cuts]
        yield pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]].astype(np.int64)), *(pa.array(c, pa.binary()) for c in (*columns, filters))], schema=RUN_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy().astype(np.int64)
            table.append(_merged(_words(batch.column("key")), ids, np.ones(len(ids), np.int64)))
            held += len(table[-1][0])
            if held >= memtable_rows:
                yield from flush(table)
                table, held = [], 0
        if held:
            yield from flush(table)

    return run


class MergeIndex:
    """The runs of one shard, larger ones below: a run that is at least half as large as the one below it is compacted
    with it, so a digest is merged as often as the shard doubles, and levels are as few as its logarithm."""

    def __init__(self):
        self.levels: list[tuple[tuple[np.ndarray, np.ndarray, np.ndarray], bytes]] = []

    def add(self, run: tuple[np.ndarray, np.ndarray, np.ndarray], known: bytes) -> None:
        while self.levels and 2 * len(run[0]) >= len(self.levels[-1][0][0]):
            below, of_below = self.levels.pop()
            run = self._compacted(below, of_below, run, known)
            known = _filter_of(run[0])
        self.levels.append((run, known))

    @staticmethod
    def _compacted(a, of_a: bytes, b, of_b: bytes):
        """Two runs as one, in order: only digests that the other run's filter knows can be in both and are compared."""
        met_a, met_b = _in_filter(a[0], of_b), _in_filter(b[0], of_a)
        both = _merged(*_joined([tuple(x[met_a] for x in a), tuple(x[met_b] for x in b)]))
        words, ids, sizes = _joined([tuple(x[~met_a] for x in a), tuple(x[~met_b] for x in b), both])
        order = np.argsort(words[:, 0], kind="stable")  # equal first parts are rare and need no order of their own
        return words[order], ids[order], sizes[order]

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        while len(self.levels) > 1:
            (b, of_b), (a, of_a) = self.levels.pop(), self.levels.pop()
            run = self._compacted(a, of_a, b, of_b)
            self.levels.append((run, _filter_of(run[0])))
        return self.levels[0][0]


def _compact(length: int):
    """Tasks over runs in the order of their shards: each shard is compacted as its runs stream by."""

    def rows_of(found) -> pa.RecordBatch:
        words, ids, sizes = found
        raw = np.ascontiguousarray(words.astype(">u8").view(np.uint8).reshape(-1, 32)[:, :length])
        keys = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((np.arange(len(ids) + 1) * length).astype(np.int32)), pa.py_buffer(raw)])
        return pa.RecordBatch.from_arrays([keys, pa.array(ids), pa.array(sizes)], names=["key", "keep_id", "group_size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, MergeIndex()
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            columns = [binary_column(batch.column(c)) for c in ("digests", "ids", "sizes")]
            filters = batch.column("filter")
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if shard is not None and shards[a] != shard:
                    yield rows_of(index.whole())
                    index = MergeIndex()
                shard = shards[a]
                words, ids, sizes = (np.frombuffer(raw[ends[a] : ends[b]], kind) for (raw, ends), kind in zip(columns, (">u8", np.int64, np.int64), strict=True))
                found = words.reshape(-1, 4).astype(np.uint64), ids, sizes
                if b - a == 1:
                    index.add(found, filters[a].as_py())
                else:  # runs that arrive together are one run: a memtable that is flushed again
                    found = _merged(*found)
                    index.add(found, _filter_of(found[0]))
        if shard is not None:
            yield rows_of(index.whole())

    return run


def build_index(digests: DataFrame, key_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(id, key) rows to the compacted index: one row a key with the smallest id and the number of rows.

    digests should be stored: its rows are counted, so that a shard holds SHARD_DIGESTS at most.
    """
    spark = digests.sparkSession
    shards = max(partitions(spark), -(-digests.count() // SHARD_DIGESTS))
    runs = digests.select("id", "key").mapInArrow(_memtables(shards, memtable_rows), RUN_SCHEMA)
    return runs.repartition(partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(_compact(key_bytes), INDEX_SCHEMA)


def verify_hits(docs: DataFrame, digests: DataFrame, index: DataFrame, id_col: str, text_col: str, key_bytes: int) -> DataFrame:
    """(key) of each hit whose text is not that of the row that stays."""
    spark = docs.sparkSession
    shared = index.filter("group_size > 1")
    members = digests.join(shared, "key").select("id")
    texts = docs.select(id_of(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = with_maybe(texts, F.col("id"), key_filter(members, "id")).filter("_maybe").drop("_maybe")
    texts = texts.withColumn("text", normalised(F.col("text")))
    texts = texts.withColumn("key", F.substring(F.unhex(F.sha2("text", 256)), 1, key_bytes))
    texts = stored(texts.join(shared, "key"), "exact-hits")
    salts = F.ceil(F.col("group_size") / COPIES_PER_SALT).cast("int")
    keepers = texts.filter("id = keep_id").groupBy("key").agg(F.min("text").alias("kept_text"), F.max(salts).alias("salts"))
    keepers = keepers.select("key", "kept_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hits = texts.withColumn("salt", F.pmod(F.xxhash64("id", "text"), salts.cast("long")).cast("int"))
    apart = stored(hits.join(keepers, ["key", "salt"]).filter("text <> kept_text").select("key"), "exact-collisions")
    drop_stored(texts)
    return apart


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = 32) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    key_bytes: how many bytes of the SHA-256 digest the index uses; fewer only in tests, to force collisions.
    """
    digests = docs.select(id_of(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"))
    digests = stored(digests.withColumn("key", F.substring("sha", 1, key_bytes)), "exact-digests")
    index = stored(build_index(digests, key_bytes), "exact-index")
    checked = verify_hits(docs, digests, index, id_col, text_col, key_bytes)
    groups = index
    if not checked.isEmpty():  # texts that only share a digest are grouped by their bytes instead
        apart = digests.join(checked.distinct(), "key", "left_semi")
        own = apart.groupBy("key", "sha").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        groups = index.join(own, "key", "left_anti").select("key", F.lit(None).cast("binary").alias("sha"), "keep_id", "group_size").unionByName(own)
        digests = digests.join(own.select("key").distinct().withColumn("apart", F.lit(True)), "key", "left")
        digests = digests.withColumn("of", F.when(F.col("apart"), F.col("sha")).otherwise(F.lit(b"")))
        groups = groups.select("key", F.coalesce("sha", F.lit(b"")).alias("of"), "keep_id", "group_size")
        rows = digests.join(groups, ["key", "of"])
    else:
        rows = digests.join(groups, "key")
    first = rows.filter("id = keep_id").groupBy("key", "sha", "id", "keep_id", "group_size").count()
    again = F.explode(F.sequence(F.lit(1), F.col("count"))).alias("nth")  # repeated rows: the first one stays
    both = first.select("id", "keep_id", "group_size", "sha", again).unionByName(
        rows.filter("id <> keep_id").select("id", "keep_id", "group_size", "sha", F.lit(0).cast("long").alias("nth"))
    )
    return both.select(
        id_back(F.col("id")).alias("doc_id"),
        id_back(F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("nth") == 1).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns. Rows that share an id and a text are told apart by their
    other columns, of which the smallest stay."""
    found = stored(exact_dedup(docs, id_col, text_col), "exact-found")
    gone = found.filter(~F.col("kept")).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text_sha256")
    plain, (own_id, own_text) = by_place(docs, id_col, text_col)
    marked = with_maybe(plain, id_of(own_id), key_filter(gone, "id"))
    safe = marked.filter("not _maybe").drop("_maybe")
    doubt = marked.filter("_maybe").drop("_maybe")
    row = F.struct(*plain.columns)
    doubt = doubt.select(row.alias("row"), id_of(own_id).alias("id"), F.sha2(normalised(F.col(own_text)), 256).alias("text_sha256"))
    stays = found.filter("kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text_sha256")
    doubt = doubt.join(stays, ["id", "text_sha256"], "left_semi").groupBy("id", "text_sha256").agg(F.min("row").alias("row"))
    return safe.unionByName(doubt.select("row.*")).toDF(*docs.columns)
