"""Substring deduplication by a logarithmic family of suffix arrays.

Every byte in a string of ``width`` bytes that occurs twice or more goes. Contexts that may hold such strings come from
``repeats``; contexts of one anchor meet in one shard. There they arrive in batches. A batch gets a suffix array of the
starts of its strings, by rank doubling. It is merge-scanned against the array of every level that is full: each of its
strings is looked up there, strings that agree in all ``width`` bytes are marked in both, and the two arrays become the
array of the next level without being sorted again. So levels double, and a string is merged as often as the number of
batches doubles. At the end the levels that are left are merged from the smallest on, so every two strings have met.
Orders compare bytes; no hash decides whether strings agree.

At scale: shards are as many as the measured bytes of contexts need, ``SHARD_BYTES`` each, and copies of a context are
one row with a count (all its bytes repeat). A shard holds a bounded number of contexts of each anchor. The contexts of
a more common anchor are divided by the offset at which their strings hold it and by the bytes that these strings must
share, again and again, and the pieces go through suffix arrays like other contexts.
Ranges come back to documents over a join with one row a context, which adaptive execution can split.

Edge cases: a null text is empty; texts shorter than a string lose nothing; rows that repeat an id and a text are
documents of their own, so their strings repeat; null ids come back as null; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, stored
from .repeats import Windows, anchor_bits, cut_out, dealt, distinct_contexts, gone, keyed, occurrences, repeated_anchors, shards_for, split_hot
from .windows import grams

GRAM = 64
#: Batches that the contexts of a shard make, so that its levels are merged however large it is, and the least bytes of one.
BATCHES, LEAST_BATCH_BYTES = 16, 1 << 12
MARKS = "context binary, cuts array<struct<a:bigint,b:bigint>>"
MARKS_ARROW = pa.schema([("context", pa.binary()), ("cuts", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])


def name_of(context: bytes) -> bytes:
    """The digest of a context and its anchor's place, by which its ranges find their way back."""
    return hashlib.blake2b(context, digest_size=16).digest()


def _ranked(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = np.cumsum(np.r_[False, keys[order[1:]] != keys[order[:-1]]], dtype=np.int32)
    return ranks


def words_at(data: np.ndarray, size: int) -> np.ndarray:
    """The size bytes (8 at most) from every place of data as one number; behind its end stand zeros. A view: a number
    is put together where it is looked up."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), ">u8" if size == 8 else f">u{size}", padded.data, strides=(1,)) if size in (1, 2, 4, 8) else _odd_words(padded, size)


def _odd_words(padded: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(padded) - 8, np.uint64)
    for i in range(size):
        out = out << np.uint64(8) | padded[i : i + len(out)]
    return out


def suffix_array(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in the order of the width bytes that follow, and whether each agrees in all of them with the one before.

    All strings must end within data, which is far shorter than 2**31 bytes.
    """
    size = min(8, width)
    ranks = _ranked(words_at(data, size).astype(np.uint64))
    many = np.int64(len(data) + 1)
    while 2 * size <= width:
        keys = ranks * many
        keys[: len(data) - size] += ranks[size:]
        ranks = _ranked(keys)
        size *= 2
    keys = ranks[starts] * many + ranks[starts + width - size]
    order = np.argsort(keys, kind="stable")
    return starts[order], np.r_[False, keys[order[1:]] == keys[order[:-1]]] if len(starts) else np.zeros(0, bool)


class SuffixFamily:
    """Suffix arrays over the contexts of a shard, each level twice as large as the one before it.

    A level is the starts of its strings in order, one start for each distinct string. ``found`` flags, for every byte
    of the contexts, whether the string that starts there occurs again.
    """

    def __init__(self, contexts: list[bytes], width: int):
        self.data = np.frombuffer(b"".join(contexts), np.uint8)
        self.edges = np.cumsum([0, *map(len, contexts)])
        self.width, self.size = width, min(8, width)
        self.words = words_at(self.data, self.size)
        self.found = np.zeros(len(self.data), bool)
        self.levels: list[np.ndarray | None] = []
        self.merges = 0

    def add(self, first: int, last: int) -> None:
        """Contexts first to last - 1: their own suffix array, merged with every level that is full."""
        batch = self._sorted(first, last)
        for level, held in enumerate(self.levels):
            if held is None:
                self.levels[level] = batch
                return
            batch = self._merged(held, batch)
            self.levels[level] = None
        self.levels.append(batch)

    def finish(self) -> None:
        """Merges the levels that are left, the smallest first, so every two strings have been in one merge."""
        batch = None
        for held in self.levels:
            if held is not None:
                batch = held if batch is None else self._merged(held, batch)
        self.levels = [] if batch is None else [batch]

    def _sorted(self, first: int, last: int) -> np.ndarray:
        base = self.edges[first]
        lengths = np.diff(self.edges[first : last + 1])
        counts = np.maximum(0, lengths - self.width + 1)
        shift = self.edges[first:last] - base - (np.cumsum(counts) - counts)
        starts = np.repeat(shift, counts) + np.arange(counts.sum())
        order, same = suffix_array(self.data[base : self.edges[last]], starts, self.width)
        hit = same | np.r_[same[1:], False] if len(same) else same
        self.found[base + order[hit]] = True
        return base + order[~same]

    def _merged(self, held: np.ndarray, batch: np.ndarray) -> np.ndarray:
        """Both arrays as one, in order. A string of both is marked in both; it stays once."""
        self.merges += 1
        at, low_end = (np.searchsorted(self._first(held), self._first(batch), side) for side in ("left", "right"))
        open_ = np.flatnonzero(at < low_end)  # strings whose first word is in held: their place is searched for
        low, high = at[open_], low_end[open_]
        while len(busy := np.flatnonzero(low < high)):
            middle = (low[busy] + high[busy]) // 2
            less = self._compared(held[middle], batch[open_[busy]]) < 0
            low[busy] = np.where(less, middle + 1, low[busy])
            high[busy] = np.where(less, high[busy], middle)
        at[open_] = low
        again = open_[low < low_end[open_]]
        again = again[self._compared(held[at[again]], batch[again]) == 0]
        self.found[batch[again]] = True
        self.found[held[at[again]]] = True
        new = np.ones(len(batch), bool)
        new[again] = False
        places = at[new] + np.arange(int(new.sum()))
        out = np.empty(len(held) + len(places), np.int64)
        own = np.ones(len(out), bool)
        own[places] = False
        out[places], out[own] = batch[new], held
        return out

    def _first(self, starts: np.ndarray) -> np.ndarray:
        return self.words[starts].astype(np.uint64)

    def _compared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each two strings, word by word as long as they agree."""
        out = np.zeros(len(a), np.int8)
        left = np.arange(len(a))
        for k in (*range(0, self.width - self.size, self.size), self.width - self.size):
            x, y = self._first(a[left] + k), self._first(b[left] + k)
            apart = x != y
            out[left[apart]] = np.where(x[apart] < y[apart], -1, 1)
            left = left[~apart]
            if not len(left):
                break
        return out


def family_of(contexts: list[bytes], width: int) -> SuffixFamily:
    """The family of a shard's contexts, added batch by batch and merged."""
    family = SuffixFamily(contexts, width)
    wanted = max(LEAST_BATCH_BYTES, len(family.data) // BATCHES)
    first, size = 0, 0
    for i, c in enumerate(contexts):
        size += len(c)
        if size >= wanted or i == len(contexts) - 1:
            family.add(first, i + 1)
            first, size = i + 1, 0
    family.finish()
    return family


def repeated_ranges(contexts: list[bytes], counts: list[int], width: int) -> list[list[tuple[int, int]]]:
    """Of each distinct context, the ranges of bytes that lie in repeated strings."""
    family = family_of(contexts, width)
    out = []
    for i, n in enumerate(counts):
        a, b = family.edges[i : i + 2].tolist()
        if n > 1:  # the context as a whole occurs again
            out.append([(0, b - a)])
            continue
        on = family.found[a:b]
        edges = np.flatnonzero(np.diff(np.r_[False, on, False])).reshape(-1, 2)
        out.append([(x, y + width - 1) for x, y in edges.tolist()])
    return out


def _marks(names: list[bytes], ranges: list[list[tuple[int, int]]]) -> pa.Table:
    rows = [(k, [{"a": a, "b": b} for a, b in r]) for k, r in zip(names, ranges, strict=True) if r]
    return pa.table([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], MARKS_ARROW[1].type)], schema=MARKS_ARROW)


CONTEXT = "anchor long, context binary, n long, at int, low int, high int"
LINK = "parent binary, child binary, shift long, " + CONTEXT
CONTEXT_ARROW = [("anchor", pa.int64()), ("context", pa.binary()), ("n", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]
LINK_ARROW = pa.schema([("parent", pa.binary()), ("child", pa.binary()), ("shift", pa.int64()), *CONTEXT_ARROW])
#: Parts that a range of offsets is divided into where an anchor is too common.
PARTS = 8


def _aligned(context: bytes, anchor: int, width: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(place of the anchor, first start, last start): the strings of a context by the first anchor that each holds."""
    hashes = grams(np.frombuffer(context, np.uint8), gram, "byte").view(np.int64)
    before, last = -1, len(context) - width
    for at in np.flatnonzero(hashes == anchor).tolist():
        if before + 1 <= min(at, last):
            yield at, max(before + 1, at - (width - gram)), min(at, last)
        before = at


def divided(hot: DataFrame, width: int, gram: int) -> DataFrame:
    """Pieces of contexts whose anchor is too common: (parent, child, shift) and the child as a context of its own.

    Equal strings hold the anchor at the same offset, so a range of offsets can be looked at by itself, and the bytes
    that all strings of the range have in common must agree: their hash is the child's anchor. A range is divided again
    and again, down to a single offset, where a child is one string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, context, n, at, low, high in zip(*(batch.column(c).to_pylist() for c, _ in CONTEXT_ARROW), strict=True):
                parent = name_of(context + at.to_bytes(4, "little", signed=True))
                places = _aligned(context, anchor, width, gram) if at < 0 else [(at, at - high + 1, at - low)]
                for place, first, last in places:
                    step = -(-(high - low) // PARTS)
                    for a in range(low, high, step):
                        b = min(a + step, high)  # strings that start from place - b + 1 to place - a
                        one, two = max(0, first, place - b + 1), min(last, place - a, len(context) - width)
                        if one > two:
                            continue
                        core = context[place - a : place - b + 1 + width]
                        key = int.from_bytes(hashlib.blake2b(core + b"%d %d %d" % (anchor, a, b), digest_size=8).digest(), "little", signed=True)
                        child = context[one : two + width]
                        rows.append((parent, name_of(child + (place - one).to_bytes(4, "little", signed=True)), one, key, child, n, place - one, a, b))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LINK_ARROW, strict=True)], schema=LINK_ARROW)

    return hot.select("anchor", "context", "n", "at", "low", "high").mapInArrow(run, LINK)


def marked_contexts(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """(context, cuts): the digest of each context with repeated strings, and their ranges.

    contexts (stored): anchor, context, n, at (the anchor's place, -1 if it is to be found), low and high (offsets it stands for).
    """

    def find(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("anchor", "ascending"), ("context", "ascending")])
        anchors, texts, counts, places = (rows.column(c).to_pylist() for c in ("anchor", "context", "n", "at"))
        alone = [(i == 0 or anchors[i - 1] != a) and (i + 1 == len(anchors) or anchors[i + 1] != a) for i, a in enumerate(anchors)]
        name = [name_of(t + p.to_bytes(4, "little", signed=True)) for t, p in zip(texts, places, strict=True)]
        sure = [i for i, x in enumerate(alone) if x and counts[i] > 1]
        names, ranges = [name[i] for i in sure], [[(0, len(texts[i]))] for i in sure]
        # contexts that share an anchor; one that is alone may still repeat a string within itself, but not a piece
        rest = [i for i, x in enumerate(alone) if not x or (counts[i] == 1 and places[i] < 0)]
        if rest:
            names += [name[i] for i in rest]
            ranges += repeated_ranges([texts[i] for i in rest], [counts[i] for i in rest], width)
        return _marks(names, ranges)

    few, hot = split_hot(contexts)
    shards = shards_for(contexts)
    out = dealt(few.withColumn("shard", F.pmod("anchor", F.lit(shards))), shards, "shard").groupBy("shard").applyInArrow(find, MARKS)
    if hot is not None:
        links = stored(divided(hot, width, gram), "divided")
        keys = ["anchor", "context", "at", "low", "high"]
        pieces = stored(links.groupBy(*keys).agg(F.sum("n").alias("n")), "pieces")
        below = marked_contexts(pieces, width, gram).withColumnRenamed("context", "child")
        cuts = links.select("parent", "child", "shift").join(below, "child").select("parent", "shift", F.explode("cuts").alias("c"))
        moved = F.struct((F.col("shift") + F.col("c.a")).alias("a"), (F.col("shift") + F.col("c.b")).alias("b"))
        out = out.unionByName(cuts.groupBy(F.col("parent").alias("context")).agg(F.collect_set(moved).alias("cuts")))
    return stored(out, "marks")


def suffix_dedup(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spec = Windows("byte", width, min(GRAM, width))
    rows = keyed(docs, id_col, text_col)
    bits = anchor_bits(stored(repeated_anchors(rows, spec), "anchors"))
    found = distinct_contexts(rows, spec, bits).withColumns({"at": F.lit(-1), "low": F.lit(0), "high": F.lit(width - spec.gram + 1)})
    marks = marked_contexts(stored(found, "contexts"), width, spec.gram)
    places = occurrences(rows, spec, bits, lambda c: name_of(c + b"\xff\xff\xff\xff")).drop("anchor").join(marks, "context")
    cuts = places.select("id", "h", "first", F.explode("cuts").alias("c"))
    ranges = stored(cuts.select("id", "h", (F.col("first") + F.col("c.a")).alias("a"), (F.col("first") + F.col("c.b")).alias("b")), "ranges")

    def cut(text: bytes, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, str]:
        if not len(a):
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        off = gone(len(text), a, b)
        kept = np.frombuffer(text, np.uint8)[~off]
        return len(text), int(off.sum()), int((off & ~np.r_[False, off[:-1]]).sum()), hashlib.sha256(kept.tobytes()).hexdigest()

    out = cut_out(rows, ranges, cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(id_back(F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
