"""Substring deduplication by repeated-phrase automata.

Windows of words that occur twice or more go, every occurrence of them. Contexts that may hold such windows come from
``repeats``. In each shard of anchors the recurring windows are confirmed by their words and joined to passages; the
passages of a shard are compiled to an Aho-Corasick automaton over words, and every document's contexts are streamed
past the automata of the shards that their anchors name, which locates every occurrence. Words of a document whose
anchor occurs nowhere else lie in no recurring window, so they are not moved.

At scale: shards are as many as the measured bytes of contexts need, ``SHARD_BYTES`` each. Passages are confirmed on
distinct contexts with counts, so a passage that a third of all documents shares is one row. An anchor with too many
distinct contexts is taken apart: its windows are counted one by one, and those that recur are dealt over shards of
their own, as are the windows of the documents that hold it. For locating, a shard that many places name is salted:
its automaton is built once for every ``GROUP_PLACES`` of them, so no group grows with the input.

Edge cases: a null text is empty; documents shorter than a window lose nothing; rows that repeat an id and a text are
documents of their own, so their windows repeat; null ids come back as null; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, id_back, stored
from .repeats import Windows, anchor_bits, cut_out, dealt, distinct_contexts, gone, keyed, occurrences, repeated_anchors, shards_for, split_hot

GRAM = 12
#: Contexts of documents that are streamed past one copy of an automaton, more or less.
GROUP_PLACES = 1 << 14
#: Contexts whose ranges a task remembers.
CONTEXTS_HELD = 1 << 13


def _windows(context: bytes, width: int) -> list[bytes]:
    """The windows of a context, joined by single blanks."""
    words = context.split(b" ")
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return [context[starts[i] : ends[i + width - 1] - 1] for i in range(len(words) - width + 1)]


def recurring_passages(contexts: list[bytes], counts: list[int], width: int) -> list[bytes]:
    """The longest runs of recurring windows in the contexts of one anchor."""
    if len(contexts) == 1 and counts[0] > 1:
        return contexts
    windows = [_windows(c, width) for c in contexts]
    seen: dict[bytes, int] = {}
    for ws, n in zip(windows, counts, strict=True):
        for w in ws:
            seen[w] = seen.get(w, 0) + n
    out = []
    for context, ws in zip(contexts, windows, strict=True):
        on = np.array([seen[w] > 1 for w in ws], bool)
        words = None
        for a, b in np.flatnonzero(np.diff(np.r_[False, on, False])).reshape(-1, 2).tolist():
            words = words or context.split(b" ")
            out.append(b" ".join(words[a : b + width - 1]))
    return out


class WordAutomaton:
    """An Aho-Corasick automaton over words. A word is two code points, a high and a low one, so that there are enough of
    them for any number of words and no node has very many children."""

    LOW, FIRST_LOW, FIRST_HIGH = 1024, 0x100, 0x500

    def __init__(self, passages: list[bytes]):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for p in passages:
            words = p.split(b" ")
            self.automaton.add_word("".join([self._letters(w) for w in words]), len(words))
        self.automaton.make_automaton()

    def _letters(self, word: bytes) -> str:
        found = self.letters.get(word)
        if found is None:
            found = self.letters[word] = self.code(len(self.letters))
        return found

    @classmethod
    def code(cls, n: int) -> str:
        """The two code points of the n-th word."""
        high = cls.FIRST_HIGH + n // cls.LOW
        return chr(high if high < 0xD800 else high + 0x800) + chr(cls.FIRST_LOW + n % cls.LOW)

    def covered(self, context: bytes) -> list[tuple[int, int]]:
        """The ranges of words of a context that passages cover."""
        text = "".join(map(self.letters.get, context.split(b" "), repeat("\x01\x01")))
        steps = [0] * (len(text) // 2 + 1)
        for end, n in self.automaton.iter(text):
            steps[end // 2 + 1 - n] += 1
            steps[end // 2 + 1] -= 1
        on = np.cumsum(steps) > 0
        return [tuple(r) for r in np.flatnonzero(np.diff(np.r_[False, on])).reshape(-1, 2).tolist()]


def _exploded(width: int, columns: dict[str, pa.DataType], only: str | None = None):
    """Tasks that replace a context (where the flag ``only`` is set, if one is named) by its windows, and move ``first``
    along with them. columns: those that are carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("context").to_pylist()
            flags = batch.column(only).to_pylist() if only else repeat(True)
            found = [_windows(t, width) if f else [t] for t, f in zip(texts, flags)]
            counts = np.array([len(f) for f in found], np.int64)
            at = np.repeat(np.arange(len(texts)), counts)
            step = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            out = [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[at] + (step if c == "first" else 0), t) if t == pa.int64() else batch.column(c).take(pa.array(at)) for c, t in columns.items()]
            yield pa.RecordBatch.from_arrays([*out, pa.array([w for f in found for w in f], pa.binary())], names=[*columns, "context"])

    return run


@dataclass(frozen=True)
class Shards:
    """Where contexts go: by their anchor, or, if it is one of too many contexts, window by window."""

    by_anchor: int
    by_window: int
    hot: DataFrame | None

    @property
    def of_anchor(self) -> F.Column:
        return F.pmod("anchor", F.lit(self.by_anchor)).cast("long")

    @property
    def of_window(self) -> F.Column:
        return F.lit(self.by_anchor).cast("long") + F.pmod(F.xxhash64("context"), F.lit(self.by_window))


def confirmed(contexts: DataFrame, width: int) -> tuple[DataFrame, Shards, DataFrame]:
    """(shard, passage): the recurring passages, each once a shard; the shards; and (shard, n), the places that name a
    hot shard. contexts should be stored."""
    few, hot = split_hot(contexts)
    shards = shards_for(contexts)

    def confirm(rows: pa.Table) -> pa.Table:
        by: dict[int, tuple[list[bytes], list[int]]] = {}
        for anchor, context, n in zip(*(rows.column(c).to_pylist() for c in ("anchor", "context", "n")), strict=True):
            held = by.setdefault(anchor, ([], []))
            held[0].append(context)
            held[1].append(n)
        shard = rows.column("shard")[0].as_py()
        found = list({p for held in by.values() for p in recurring_passages(*held, width)})
        return pa.table({"shard": pa.array([shard] * len(found), pa.int64()), "passage": pa.array(found, pa.binary())})

    places = Shards(shards, 0, None)
    out = dealt(few.withColumn("shard", places.of_anchor), shards, "shard").groupBy("shard").applyInArrow(confirm, "shard long, passage binary")
    load = few.groupBy(places.of_anchor.alias("shard")).agg(F.sum("n").alias("n"))
    if hot is not None:
        counted = hot.mapInArrow(_exploded(width, {"n": pa.int64()}), "n long, context binary").groupBy("context").agg(F.sum("n").alias("n"))
        counted = stored(counted.filter("n > 1"), "hot-windows")
        places = Shards(shards, shards_for(counted), stored(hot.select("anchor").distinct(), "hot"))
        counted = counted.withColumn("shard", places.of_window)
        out = out.unionByName(counted.select("shard", F.col("context").alias("passage")))
        load = load.unionByName(counted.groupBy("shard").agg(F.sum("n").alias("n")))
    return stored(out, "passages"), places, stored(load.filter(F.col("n") > GROUP_PLACES), "loaded-shards")


def located(found: DataFrame, passages: DataFrame, places: Shards, load: DataFrame, width: int) -> DataFrame:
    """(id, h, a, b): the words of documents that passages cover. A shard that more than GROUP_PLACES places name is
    salted: its passages are compiled once for every GROUP_PLACES of them."""
    shard = places.of_anchor
    if places.hot is not None:
        flagged = found.join(places.hot.withColumn("is_hot", F.lit(True)), "anchor", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
        carried = {"id": pa.int64(), "h": pa.int64(), "first": pa.int64(), "anchor": pa.int64(), "is_hot": pa.bool_()}
        found = flagged.mapInArrow(_exploded(width, carried, "is_hot"), "id long, h long, first long, anchor long, is_hot boolean, context binary")
        shard = F.when(F.col("is_hot"), places.of_window).otherwise(shard)
    salts = load.select("shard", F.ceil(F.col("n") / GROUP_PLACES).alias("salts"))
    one = F.coalesce("salts", F.lit(1))
    found = found.withColumn("shard", shard).select("id", "h", "first", "context", "shard").join(salts, "shard", "left")
    found = found.withColumn("salt", F.pmod(F.xxhash64("id", "h", "first"), one)).drop("salts")
    spread = passages.join(salts, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("salts")

    def stream(rows: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if rows.num_rows and held.num_rows:
            automaton, known = WordAutomaton(held.column("passage").to_pylist()), {}
            for i, h, first, context in zip(*(rows.column(c).to_pylist() for c in ("id", "h", "first", "context")), strict=True):
                if context not in known:
                    if len(known) == CONTEXTS_HELD:
                        known.clear()
                    known[context] = automaton.covered(context)
                out += [(i, h, first + a, first + b) for a, b in known[context]]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["id", "h", "a", "b"])

    keys, n = ("shard", "salt"), places.by_anchor + places.by_window
    return dealt(found, n, *keys).groupBy(*keys).cogroup(dealt(spread, n, *keys).groupBy(*keys)).applyInArrow(stream, "id long, h long, a long, b long")


def phrase_dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256."""
    spec = Windows("word", width, min(GRAM, width))
    rows = keyed(docs, id_col, text_col)
    bits = anchor_bits(stored(repeated_anchors(rows, spec), "anchors"))
    contexts = stored(distinct_contexts(rows, spec, bits), "contexts")
    passages, places, load = confirmed(contexts, width)
    drop_stored(contexts)
    ranges = stored(located(occurrences(rows, spec, bits, bytes), passages, places, load, width), "ranges")

    def cut(text: bytes, a: np.ndarray, b: np.ndarray) -> tuple[int, int, str]:
        words = text.split()
        off = gone(len(words), a, b) if len(a) else None
        kept = words if off is None else [w for w, g in zip(words, off.tolist(), strict=True) if not g]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    out = cut_out(rows, ranges, cut, "n_words long, n_removed long, kept_sha256 string")
    return out.select(id_back(F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
