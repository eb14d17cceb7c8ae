"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND by every passage.

Items are indexed whole, whatever their length; items of a like length (up to 64 words, 256, 1,024 and
so on) share indexes. Documents are cut into passages for each of these lengths, three times as long at a stride of one
length. So any 2 x length + 1 words lie whole in one of them: every item with at least 65, 257, 1,025, ... further words,
before or between its question and answer or inside them. Passages depend on the length of an item alone, and so what
is found does not depend on which other items there are. A passage is a query: items whose BM25 score reaches their
threshold are retrieved, and then the shingles of the item's question and of its answer are looked for in the passage.
A document leaks an item if at least ``OVERLAP`` of the shingles of both parts are in one passage.

The threshold of an item is what a passage with that overlap must score at least: its score with itself, less the
impacts of the terms that may be missing. So retrieval loses nothing that verification would accept. Impacts are
divided by the threshold of their item, so every item is retrieved from 1 on. Document frequencies and the mean length
are those of the whole benchmark, counted by Spark, so a score does not depend on which items share an index. Block-max
WAND: a passage is dropped if its terms' largest impacts do not reach 1; the blocks of items whose own largest impacts
reach 1 are found for many passages together; in these, cursors on the postings move from pivot to pivot.

At scale: no shuffle of documents. An index has a bounded number of items and words; indexes are broadcast as long as
their measured size is at most ``INDEX_BYTES``, and further ones take further passes over the documents. An item that is
larger than that by itself has an index of its own, as large as the item.

Edge cases: null or empty texts match nothing; items without words are ignored; items that share an id are searched
apart and reported once for a document; items with a null id are searched like others, reported once with a null item_id,
and their documents dropped; a part with fewer words than a shingle is one shingle; repeated documents give a row each;
empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SHINGLE, OVERLAP = 5, 0.8
K1, B = 1.2, 0.75
#: Items of one index, and words of them unless a single item has more.
ITEMS_AT_ONCE, WORDS_AT_ONCE = 2048, 1 << 18
#: Bytes of the indexes that are broadcast for one pass over the documents.
INDEX_BYTES = 64 << 20
#: Items of a block.
BLOCK = 8
#: Bounds of blocks that are added up together.
BOUNDS_AT_ONCE = 1 << 22
#: Passages that are looked at together, in words.
BATCH_WORDS = 1 << 20

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.?!])\s+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: its last sentence answers; a single sentence is cut at three quarters."""
    sentences = [w for s in SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) > 1:
        return list(chain.from_iterable(sentences[:-1])), sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - max(1, len(words) // 4) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def distinct_shingles(part: np.ndarray) -> int:
    return len(shingles(part.tolist()))


def length_of(words: int) -> int:
    """The length up to which an item counts: 64 words, 256, 1,024 and so on. Items of one length share indexes."""
    return 64 << 2 * (max(0, (words - 1).bit_length() - 5) // 2)


def shingles(ids: list[int], width: int = SHINGLE) -> set[tuple[int, ...]]:
    if not ids:
        return set()
    return {tuple(ids[i : i + width]) for i in range(max(1, len(ids) - width + 1))}


@dataclass(frozen=True)
class Item:
    """A test item: its id, the words of both parts, and how many items of the benchmark hold each of its distinct words."""

    item: int | None
    question: list[str]
    answer: list[str]
    holders: dict[str, int]


def counted_items(items: list[tuple[int | None, str | None]]) -> list[Item]:
    """Items of a list that is the whole benchmark; items without words are left out."""
    parts = [(i, *parts_of(t or "")) for i, t in items]
    holders = Counter(w for _, q, a in parts for w in {*q, *a})
    return [Item(i, q, a, {w: holders[w] for w in {*q, *a}}) for i, q, a in parts if q or a]


class ItemIndex:
    """A BM25 inverted index of some items: for each term its postings in the order of items, its largest impact in every
    block of items that has it, and its largest impact of all.

    n and mean_words: number and mean length of the items of the whole benchmark, so that scores do not depend on which
    items share an index.
    """

    def __init__(self, items: list[Item], n: int, mean_words: float):
        self.items = [x.item for x in items]
        self.terms: dict[str, int] = {}
        coded = [tuple(np.array([self.terms.setdefault(w, len(self.terms)) for w in part], np.int32) for part in (x.question, x.answer)) for x in items]
        self.parts, self.known = coded, {}
        self.step = length_of(max((len(q) + len(a) for q, a in coded), default=1))
        self.width = 3 * self.step
        words = list(self.terms)
        of_term, of_item, impacts = [], [], []
        for i, (x, (q, a)) in enumerate(zip(items, coded, strict=True)):
            terms, tf = np.unique(np.concatenate((q, a)), return_counts=True)
            holders = np.array([x.holders[words[t]] for t in terms.tolist()], float)
            idf = np.log(1 + (n - holders + 0.5) / (holders + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (len(q) + len(a)) / mean_words))
            missing = sum(int(distinct_shingles(part) * (1 - OVERLAP) + 1e-9) for part in (q, a))
            threshold = np.sort(impact)[: max(1, len(impact) - missing)].sum()
            of_term.append(terms)
            of_item.append(np.full(len(terms), i, np.int32))
            impacts.append((impact / threshold * (1 + 1e-5)).astype(np.float32))
        term, self.item, self.impact = (np.concatenate(x) if items else np.zeros(0, np.int32) for x in (of_term, of_item, impacts))
        order = np.lexsort((self.item, term))
        term, self.item, self.impact = term[order], self.item[order], self.impact[order]
        v = len(self.terms)
        self.first = np.searchsorted(term, np.arange(v + 1))
        block = self.item // BLOCK
        heads = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.block, self.block_most = block[heads], np.maximum.reduceat(self.impact, heads) if len(heads) else self.impact
        self.block_first = np.append(np.searchsorted(term[heads], np.arange(v + 1)), len(heads))  # the last term: words that no item has
        self.most = np.append(np.maximum.reduceat(self.impact, self.first[:-1]) if v else self.impact, np.float32(0))
        self.blocks = max(1, -(-len(items) // BLOCK))

    @property
    def size(self) -> int:
        """Bytes, more or less: arrays, and a string and a dictionary entry for each term."""
        arrays = (self.item, self.impact, self.first, self.block, self.block_most, self.block_first, self.most, *chain.from_iterable(self.parts))
        return sum(x.nbytes for x in arrays) + sum(len(w) + 150 for w in self.terms) + 250 * len(self.items)

    def passages(self, ids: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Term ids of each passage in rows, the text each is of and its place in it. ids: the term ids of each text. Texts
        shorter than a passage are one, among others of like length, so that little is filled up."""
        v = len(self.terms)
        groups: dict[int, list[int]] = {}
        for i, found in enumerate(ids):
            groups.setdefault(min(self.width, 1 << max(6, (len(found) - 1).bit_length())), []).append(i)
        for width, some in groups.items():
            rows, of, nth = [], [], []
            for i in some:
                n = max(1, -(-(len(ids[i]) - width + self.step) // self.step))
                padded = np.full((n - 1) * self.step + width, v, np.int32)
                padded[: len(ids[i])] = ids[i]
                rows.append(np.lib.stride_tricks.sliding_window_view(padded, width)[:: self.step])
                of.append(np.full(n, i))
                nth.append(np.arange(n))
            yield np.concatenate(rows), np.concatenate(of), np.concatenate(nth)

    def search(self, texts: list[str]) -> list[dict[int, tuple[float, float, float]]]:
        """Of each text, the items it leaks: score against the threshold, overlap of question and of answer."""
        found: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        if not self.items or not texts:
            return found
        words = map(words_of, texts)
        ids = [np.fromiter(map(self.terms.get, w, repeat(len(self.terms))), np.int32, len(w)) for w in words]
        for rows, of, nth in self.passages(ids):
            rows = np.sort(rows, axis=1)
            rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = len(self.terms)
            hopeful = np.flatnonzero(self.most[rows].sum(1) >= 1)
            step = max(1, BOUNDS_AT_ONCE // (rows.shape[1] * self.blocks))
            for a in range(0, len(hopeful), step):
                some = hopeful[a : a + step]
                for p, blocks in self._reached(rows[some]):
                    p = int(some[p])
                    terms = rows[p][rows[p] < len(self.terms)].tolist()
                    text, start = int(of[p]), int(nth[p]) * self.step
                    passage = ids[text][start : start + self.width]
                    for i, score in self.wand(terms, blocks):
                        self._verify(i, score, passage, found[text])
        return found

    def _reached(self, rows: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(row, blocks) of the rows of terms whose largest impacts in some block add up to 1."""
        place, at = np.nonzero(rows < len(self.terms))
        terms = rows[place, at]
        first, count = self.block_first[terms], self.block_first[terms + 1] - self.block_first[terms]
        entry = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        cell = np.repeat(place, count) * self.blocks + self.block[entry]
        bounds = np.bincount(cell, self.block_most[entry], minlength=len(rows) * self.blocks)
        reached = np.flatnonzero(bounds >= 1)
        for p in np.unique(reached // self.blocks).tolist():
            yield p, (reached[reached // self.blocks == p] % self.blocks).tolist()

    def wand(self, terms: list[int], blocks: list[int]) -> Iterator[tuple[int, float]]:
        """(item, score) of the items in some blocks that score 1 or more with distinct terms, by block-max WAND.

        Cursors skip to the next block that can reach 1. Within it they stand in the order of their items; the pivot is
        the first item at which the block's largest impacts of the cursors up to it reach 1. Cursors before it skip to
        it, and only a pivot that all of them have reached is scored.
        """
        cursors = [(int(self.first[t]), int(self.first[t + 1]), int(self.block_first[t]), int(self.block_first[t + 1])) for t in terms]
        for b in blocks:
            live = []  # [item, place, end, largest impact] of each term that the block has
            for first, end, low, high in cursors:
                k = low + int(np.searchsorted(self.block[low:high], b))
                if k < high and self.block[k] == b:
                    at = first + int(np.searchsorted(self.item[first:end], b * BLOCK))
                    live.append([int(self.item[at]), at, end, float(self.block_most[k])])
            while True:
                live.sort(key=itemgetter(0))
                bound, pivot = 0.0, None
                for c in live:
                    bound += c[3]
                    if bound >= 1:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                if live[0][0] == pivot:
                    here = [c for c in live if c[0] == pivot]
                    score = sum(float(self.impact[c[1]]) for c in here)
                    if score >= 1:
                        yield pivot, score
                    moved, target = here, pivot + 1
                else:
                    moved, target = [c for c in live if c[0] < pivot], pivot
                for c in moved:
                    c[1] += int(np.searchsorted(self.item[c[1] : min(c[2], c[1] + BLOCK)], target))
                    c[0] = int(self.item[c[1]]) if c[1] < c[2] else (b + 1) * BLOCK
                live = [c for c in live if c[0] < (b + 1) * BLOCK]

    def _shingles(self, i: int) -> list[set[tuple[int, ...]]]:
        if i not in self.known:
            self.known[i] = [shingles(part.tolist()) for part in self.parts[i]]
        return self.known[i]

    def _verify(self, i: int, score: float, passage: np.ndarray, found: dict) -> None:
        words = passage.tolist()

        def share(part: set) -> float:
            if not part:
                return 1.0
            width = len(next(iter(part)))
            return len(part & {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}) / len(part)

        q, a = map(share, self._shingles(i))
        if q >= OVERLAP and a >= OVERLAP:
            item = self.items[i]
            found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, q, a))


def prepared(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int, float]:
    """(words, item, question, answer, counts) of each item with words, the shortest first; their number and mean length.
    counts: how many items hold each distinct word of question and answer, in the order in which they occur."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [parts_of(t or "") for t in batch.column("text").to_pylist()]
            columns = [batch.column("item"), *(pa.array([p[k] for p in parts], pa.list_(pa.string())) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "question", "answer"])

    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    items = rows.mapInArrow(split, "item long, question array<string>, answer array<string>")
    items = items.withColumns({"nth": F.monotonically_increasing_id(), "words": F.size("question") + F.size("answer")}).filter("words > 0")
    items = stored(items, "items")
    n, mean = items.agg(F.count("*"), F.avg("words")).first()
    terms = items.select("nth", F.posexplode(F.array_distinct(F.concat("question", "answer"))).alias("at", "term"))
    holders = terms.groupBy("term").agg(F.count("*").alias("holders"))
    counts = F.transform(F.sort_array(F.collect_list(F.struct("at", "holders"))), lambda x: x["holders"]).alias("counts")
    counted = items.join(terms.join(holders, "term").groupBy("nth").agg(counts), "nth").orderBy("words", "nth")
    return stored(counted.select("words", "nth", "item", "question", "answer", "counts"), "counted-items"), n, mean


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[ItemIndex]:
    counted, n, mean = prepared(benchmark, item_col, text_col)
    some: list[Item] = []
    words, of = 0, None
    for r in counted.orderBy("words", "nth").toLocalIterator():
        if some and (length_of(r["words"]) != of or len(some) == ITEMS_AT_ONCE or words + r["words"] > WORDS_AT_ONCE):
            yield ItemIndex(some, n, mean)
            some, words = [], 0
        distinct = dict.fromkeys([*r["question"], *r["answer"]])
        some.append(Item(r["item"], r["question"], r["answer"], dict(zip(distinct, r["counts"], strict=True))))
        words, of = words + r["words"], length_of(r["words"])
    if some:
        yield ItemIndex(some, n, mean)


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[ItemIndex]]:
    """The indexes that one pass over the documents searches: INDEX_BYTES together, or a single one."""
    held: list[ItemIndex] = []
    for index in _indexes(benchmark, item_col, text_col):
        if held and sum(x.size for x in held) + index.size > INDEX_BYTES:
            yield held
            held = []
        held.append(index)
    if held:
        yield held


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of signs, at least one text each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= 4 * BATCH_WORDS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _found(indexes: list[ItemIndex], texts: list[str]) -> list[dict[int, tuple[float, float, float]]]:
    out: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
    for index in indexes:
        for a, b in _batches(texts):
            for hits, more in zip(out[a:b], index.search(texts[a:b]), strict=True):
                hits |= {i: max(v, hits.get(i, v)) for i, v in more.items()}
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item it leaks: doc_id, item_id, score, question_overlap, answer_overlap."""
    kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
    names = ["item_id", "score", "question_overlap", "answer_overlap"]
    hit = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))
    found = "found array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("found", F.lit(None).cast(found[6:]))
    passes = _passes(benchmark, item_col, item_text)
    indexes = next(passes, [])
    while indexes:
        held, indexes = docs.sparkSession.sparkContext.broadcast(indexes), next(passes, [])

        # what a document leaks goes with it from pass to pass, its text up to the last
        def run(batches: Iterator[pa.RecordBatch], held=held, last=not indexes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                every = _found(held.value, [t or "" for t in batch.column("text").to_pylist()])
                for hits, before in zip(every, batch.column("found").to_pylist(), strict=True):
                    for x in before or ():
                        i, *v = (x[name] for name in names)
                        hits[i] = max(hits.get(i, tuple(v)), tuple(v))
                out = pa.array([[dict(zip(names, (i, *v), strict=True)) for i, v in hits.items()] for hits in every], hit)
                columns = [batch.column("doc_id"), out] if last else [batch.column("doc_id"), batch.column("text"), out]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "found"] if last else ["doc_id", "text", "found"])

        rows = rows.mapInArrow(run, f"doc_id long, {'' if not indexes else 'text string, '}{found}")
    return rows.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that leak no item, with their own columns and without a shuffle."""
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text_col)
    for indexes in _passes(benchmark, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = _found(held.value, [t or "" for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        plain = plain.mapInArrow(run, plain.schema)
    return plain.toDF(*docs.columns)
