"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

A bin is filled greedily, largest fitting piece first. Then its smallest piece is taken out again if two unpacked
pieces fill the widened gap more tightly than it does. Documents longer than the capacity are cut into full pieces and
a last one; full pieces are sequences by themselves.

At scale: only lengths and checksums are moved, never texts or ids. Pieces are dealt at random over groups of about
``GROUP_PIECES``, each packed by one task from counts of its lengths; a group leaves one bin partly empty, so the cost
of splitting is under one bin in two thousand. No length, source or document can make a group larger.

Edge cases: a null or empty text is the end id alone; repeated rows are packed once each; null ids stay null; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import public_path, word_encoder

GROUP_PIECES = 10_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
#: Texts that are encoded at a time, in characters of UTF-8.
CHUNK_BYTES = 1 << 22


def text_chunks(batch: pa.RecordBatch, id_col: int, text_col: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts of a batch, a bounded number of bytes at a time."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(id_col).to_pylist(), batch.column(text_col).cast(pa.binary()), strict=True):
        t = t.as_py() or b""
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def cut(docs: DataFrame, capacity: int, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(public_path(vocabulary))
        end = np.array([end_id], "<u4")
        for batch in batches:
            for ids, texts in text_chunks(batch, 0, 1):
                rows = []
                for i, found in zip(ids, encoder.ids(texts), strict=True):
                    found = np.append(found, end)
                    for piece, start in enumerate(range(0, len(found), capacity)):
                        part = found[start : start + capacity]
                        rows.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECE_ARROW, strict=True)], schema=PIECE_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE_SCHEMA)


def best_two_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the order given. All lengths are from 1 to capacity."""
    of: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        of.setdefault(n, []).append(i)
    left = sorted(of)  # lengths that some unpacked piece has
    place = [(0, 0)] * len(lengths)
    number = 0

    def take(at: int) -> int:
        n = left[at]
        items = of[n]
        i = items.pop()
        if not items:
            del left[at]
        return i

    while left:
        held, gap = [], capacity
        while (at := bisect_right(left, gap) - 1) >= 0:
            gap -= left[at]
            held.append(take(at))
        if gap and left and len(held) > 1:
            smallest = lengths[held[-1]]
            pair = _tightest_pair(left, of, gap + smallest)
            if pair and sum(pair) > smallest:
                back = held.pop()
                for n in pair:
                    held.append(take(bisect_right(left, n) - 1))
                if smallest not in of or not of[smallest]:
                    left.insert(bisect_right(left, smallest), smallest)
                of.setdefault(smallest, []).append(back)
        offset = 0
        for i in held:
            place[i] = (number, offset)
            offset += lengths[i]
        number += 1
    return place


def _tightest_pair(left: list[int], of: dict[int, list[int]], room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum that fits."""
    known = np.array(left[: bisect_right(left, room - 1)], np.int64)
    if not len(known):
        return None
    other = np.searchsorted(known, room - known, "right") - 1
    alone = np.array([len(of[n]) < 2 for n in known.tolist()])
    other = np.where((other == np.arange(len(known))) & alone, other - 1, other)
    sums = np.where(other >= 0, known + known[other], -1)
    best = int(sums.argmax())
    return (int(known[best]), int(known[other[best]])) if sums[best] >= 0 else None


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a length. Reads its input twice: give it a stored table."""
    number = F.monotonically_increasing_id()
    full = pieces.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - number).withColumn("offset", F.lit(0).cast("long"))
    loose = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-loose.count() // GROUP_PIECES))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def run(group: pa.Table) -> pa.Table:
        place = np.array(best_two_fit(group.column("length").to_pylist(), capacity), np.int64).reshape(-1, 2)
        base = group.column("_group")[0].as_py() << 32
        return group.drop_columns("_group").append_column("sequence_id", pa.array(place[:, 0] + base)).append_column("offset", pa.array(place[:, 1]))

    dealt = loose.withColumn("_group", F.pmod(F.xxhash64(number), F.lit(groups)))
    return full.unionByName(dealt.groupBy("_group").applyInArrow(run, schema))


def best_fit_packing(
    docs: DataFrame, capacity: int = 4096, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(cut(docs, capacity, vocabulary, end_id, id_col, text_col), "pieces"), capacity)
