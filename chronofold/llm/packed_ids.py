"""Token ids as packed matrices: best-fit-decreasing packing with a segment tree over capacities.

Each task encodes its documents, cuts the overlong ones into pieces without loss, and packs a bounded window of pieces
at a time: longest first, each into the fullest sequence that still has room. A segment tree over the room that is left
finds it. A row of the output is a row of the id matrix, padded to the capacity, with the cumulative lengths of its
segments and the positions, which start again with each segment.

At scale: ids never leave the task that made them, so there is no shuffle; a window leaves one sequence partly empty.
A task holds ``WINDOW_TOKENS`` ids and the sequences made of them.

Edge cases: a null or empty text is the end id alone; null ids stay null; repeated rows are packed once each; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best_fit_packing import text_chunks
from .common import stored
from .tokens import public_path

WINDOW_TOKENS = 1 << 22


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    """The encoding of a file of ranks, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class RoomTree:
    """Which sequences have how much room, as a segment tree of counts over rooms 0 to capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.counts[at] += n
            at >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.held[room].append(sequence)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, sequence) of the least room that is at least length."""
        counts, at = self.counts, length + self.size
        while not counts[at]:
            while at & 1:  # a right child: what is larger lies above
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at *= 2
            if not counts[at]:
                at += 1
        room = at - self.size
        self._add(room, -1)
        return room, self.held[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The pieces of each sequence."""
    tree, out = RoomTree(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found = capacity, len(out)
            out.append([])
        room, sequence = found
        out[sequence].append(i)
        tree.put(room - n, sequence)
    return out


PACKED = "sequence_id long, id_bytes int, input_ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, pieces array<int>, starts array<long>"
PACKED_ARROW = pa.schema([
    ("sequence_id", pa.int64()), ("id_bytes", pa.int32()), ("input_ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())),
])


def pack_ids(
    docs: DataFrame, capacity: int = 4096, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 50256, pad_id: int = 50256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows of the id matrix. Ids and positions are little-endian, 16 bits wide where all ids of the vocabulary fit, else
    32, as ``id_bytes`` says."""

    def window(pieces: list[tuple], base: int, made: int, width: str) -> Iterator[pa.RecordBatch]:
        bins = best_fit_decreasing(np.array([len(p[3]) for p in pieces]), capacity)
        for a in range(0, len(bins), 256):
            rows = []
            for k, members in enumerate(bins[a : a + 256], made + a):
                parts = [pieces[i] for i in members]
                lengths = [len(p[3]) for p in parts]
                used = sum(lengths)
                ids = np.full(capacity, pad_id, width)
                ids[:used] = np.concatenate([p[3] for p in parts])
                positions = np.zeros(capacity, width)
                positions[:used] = np.concatenate([np.arange(n) for n in lengths])
                cumulative = np.concatenate(([0], np.cumsum(lengths))).tolist()
                rows.append((base + k, ids.itemsize, ids.tobytes(), used, cumulative, positions.tobytes(), [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PACKED_ARROW, strict=True)], schema=PACKED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(public_path(vocabulary))
        width = "<u2" if max(encoding.max_token_value, end_id, pad_id, capacity) < 1 << 16 else "<u4"
        base, made = TaskContext.get().partitionId() << 36, 0
        pieces, held = [], 0
        for batch in batches:
            for ids, texts in text_chunks(batch, 0, 1):
                for i, text in zip(ids, texts, strict=True):
                    found = np.array([*encoding.encode_ordinary(text.decode()), end_id], width)
                    for piece, start in enumerate(range(0, len(found), capacity)):
                        pieces.append((i, piece, start, found[start : start + capacity]))
                    held += len(found)
                if held >= WINDOW_TOKENS:
                    for out in window(pieces, base, made, width):
                        made += out.num_rows
                        yield out
                    pieces, held = [], 0
        if pieces:
            yield from window(pieces, base, made, width)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PACKED)


SEGMENT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, positions_ok boolean"


def read_packed(packed: DataFrame) -> DataFrame:
    """The segments of stored matrices: doc_id, piece, start, length, ids_crc32 (of 32-bit ids), sequence_id, offset, positions_ok."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                width = f"<u{r['id_bytes']}"
                ids, positions = np.frombuffer(r["input_ids"], width), np.frombuffer(r["position_ids"], width)
                edges = r["cu_seqlens"]
                for doc, piece, start, a, b in zip(r["doc_ids"], r["pieces"], r["starts"], edges, edges[1:], strict=False):
                    crc = zlib.crc32(ids[a:b].astype("<u4").tobytes())
                    rows.append((doc, piece, start, b - a, crc, r["sequence_id"], a, bool((positions[a:b] == np.arange(b - a)).all())))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
            names = [c.split()[0] for c in SEGMENT.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return packed.mapInArrow(run, SEGMENT)


def pack_and_read(docs: DataFrame) -> DataFrame:
    """Packs all documents, writes the matrices and returns the segments that can be read back."""
    return read_packed(stored(pack_ids(docs), "packed-ids"))
