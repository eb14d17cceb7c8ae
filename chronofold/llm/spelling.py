"""Spelling variant grouping: words one edit apart, found by automata in compact tries.

Words are counted by Spark. The vocabulary is cut into shards by range; a task turns each into a compact trie: three
arrays with a place for every node, in the order of levels, so that the children of a node stand side by side. Tries are
broadcast, and every word's Levenshtein automaton of distance one is intersected with every shard depth-first: the states
without an edit follow one path, each node beside it is entered with the one edit spent, and from there the rest of the
word must follow. Accepted nodes are the word's neighbours; they are reduced to their number and the best of them, first
in the task and then by word. Forms lead to ever more frequent words, so the last one is found by jumping: a round
doubles the steps, and as counts at least double with each step, there are at most six rounds.

At scale: a trie has at most ``SHARD_BYTES`` letters (or a single word), ``BROADCAST_BYTES`` of tries are broadcast for
one pass over the vocabulary, and further ones take further passes. Words are dealt in tasks of ``WORDS_AT_ONCE``. A very
frequent word is counted before it is shuffled; a form with very many variants is one row that they are joined with.

Edge cases: null and empty texts have no words; a null id counts as the empty string; rows that repeat an id count again;
words of any length are whole; ties take the first word in the order of code points; an empty table, or one without
words, gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, partitions, stored

SHORTEST, LEAST = 5, 3
#: One run in so many loses a code point.
DAMAGED = 97
#: Letters of the words of one trie.
SHARD_BYTES = 1 << 20
#: Bytes of the tries that are broadcast for one pass over the vocabulary.
BROADCAST_BYTES = 64 << 20
#: Words of one task of a pass.
WORDS_AT_ONCE = 1 << 13

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Trie:
    """Nodes in the order of levels; node 0 is the root. labels: the letter that leads to each (all letters of words are
    below U+0100, so it is a byte); the children of node i are the nodes first[i] to first[i + 1] - 1; count: how often
    the word that ends at a node occurs, 0 for none."""

    labels: bytes
    first: memoryview
    count: memoryview

    @staticmethod
    def parts(words: list[bytes], counts: list[int]) -> tuple[bytes, bytes, bytes]:
        """labels, first and count of the trie of some distinct words."""
        order = sorted(range(len(words)), key=words.__getitem__)
        n = np.array([counts[i] for i in order], np.int64)
        data = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        length = np.array([len(words[i]) for i in order], np.int64)
        offset = np.cumsum(length) - length
        node = np.zeros(len(words), np.int64)  # where each word stands
        live = np.arange(len(words))
        labels, held, parents = [np.zeros(1, np.uint8)], [np.zeros(1, np.int64)], []
        total, depth = 1, 0
        while len(live := live[length[live] > depth]):
            letter, above = data[offset[live] + depth], node[live]
            new = np.r_[True, (letter[1:] != letter[:-1]) | (above[1:] != above[:-1])]
            node[live] = total + np.cumsum(new) - 1
            labels.append(letter[new])
            parents.append(above[new])
            ends = live[length[live] == depth + 1]
            here = np.zeros(int(new.sum()), np.int64)
            here[node[ends] - total] = n[ends]
            held.append(here)
            total, depth = total + len(here), depth + 1
        children = np.bincount(np.concatenate(parents), minlength=total) if parents else np.zeros(1, np.int64)
        first = np.concatenate(([1], 1 + np.cumsum(children))).astype(np.int32)
        return np.concatenate(labels).tobytes(), first.tobytes(), np.concatenate(held).tobytes()

    @staticmethod
    def of(labels: bytes, first: bytes, count: bytes) -> Trie:
        return Trie(labels, memoryview(first).cast("i"), memoryview(count).cast("q"))

    def _follow(self, node: int, word: bytes, i: int) -> int:
        """The node that the letters of word from i on lead to, -1 for none."""
        labels, first = self.labels, self.first
        for k in range(i, len(word)):
            node = labels.find(word[k], first[node], first[node + 1])
            if node < 0:
                return -1
        return node

    def neighbours(self, word: bytes) -> dict[bytes, int]:
        """The words of the trie exactly one inserted, deleted or replaced letter away from word, and their counts."""
        labels, first, count, follow = self.labels, self.first, self.count, self._follow
        found: dict[bytes, int] = {}
        node, end = 0, len(word)
        for i in range(end + 1):  # node is where the first i letters lead
            # of a run of equal letters the first one goes, and one more is put in behind it
            if i < end and (i == 0 or word[i] != word[i - 1]) and (at := follow(node, word, i + 1)) > 0 and count[at]:
                found[word[:i] + word[i + 1 :]] = count[at]
            low, high = first[node], first[node + 1]
            own, after = (word[i] if i < end else -1), (word[i + 1] if i + 1 < end else -1)
            for child in range(low, high):
                a, b = first[child], first[child + 1]
                # the child's letter is inserted before letter i, which must come next
                if own < 0:
                    if count[child]:
                        found[word + labels[child : child + 1]] = count[child]
                    continue
                if labels[child] == own:
                    continue
                if a < b and (at := labels.find(own, a, b)) >= 0 and (at := follow(at, word, i + 1)) >= 0 and count[at]:
                    found[word[:i] + labels[child : child + 1] + word[i:]] = count[at]
                # or it stands in the place of letter i
                if after < 0:
                    at = child
                elif a == b or (at := labels.find(after, a, b)) < 0 or (at := follow(at, word, i + 2)) < 0:
                    continue
                if count[at]:
                    found[word[:i] + labels[child : child + 1] + word[i + 1 :]] = count[at]
            if i < end and (node := labels.find(own, low, high)) < 0:
                break
        return found


def damaged(word: Column, doc: Column) -> Column:
    """The word, or what is left of it where the checksum of id and word says so."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): words of at least SHORTEST code points that occur at least LEAST times. Runs that are shorter before any
    damage are left out at once."""
    text = F.translate(F.col(text_col), _UPPER, _LOWER)
    run = F.explode(F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))).alias("run")
    words = docs.select(F.col(id_col).alias("doc"), run).select(damaged(F.col("run"), F.col("doc")).alias("word"))
    counted = words.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST)


def tries(words: DataFrame, letters: int) -> DataFrame:
    """(labels, first, count): the words in compact tries. words (stored): word, n; letters: how many they have together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in Trie.parts(some, counts)], names=["labels", "first", "count"])

        some: list[bytes] = []
        counts: list[int] = []
        size = 0
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                some.append(word.encode("latin-1"))
                counts.append(n)
                size += len(word)
                if size >= SHARD_BYTES:
                    yield made()
                    some, counts, size = [], [], 0
        if some:
            yield made()

    shards = max(1, -(-letters // SHARD_BYTES))
    ranges = words.repartitionByRange(shards, "word").coalesce(shards)
    return stored(ranges.mapInArrow(run, "labels binary, first binary, count binary"), "tries")


def _passes(shards: DataFrame) -> Iterator[list[tuple[bytes, bytes, bytes]]]:
    """The tries of one pass over the words: BROADCAST_BYTES together, or a single one."""
    held: list[tuple[bytes, bytes, bytes]] = []
    size = 0
    for r in shards.toLocalIterator():
        trie = bytes(r["labels"]), bytes(r["first"]), bytes(r["count"])
        more = sum(map(len, trie))
        if held and size + more > BROADCAST_BYTES:
            yield held
            held, size = [], 0
        held.append(trie)
        size += more
    if held:
        yield held


def neighbours(words: DataFrame, shards: DataFrame, tasks: int) -> DataFrame:
    """(word, n_near, near, near_n): how many words are near each word that has any, and the most frequent of them."""
    spark = words.sparkSession
    schema = "word string, n_near long, near string, near_n long"
    found = spark.createDataFrame([], schema)
    dealt = words.select("word").repartition(tasks)
    for some in _passes(shards):
        held = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            some = [Trie.of(*x) for x in held.value]
            for batch in batches:
                rows = []
                for word in batch.column("word").to_pylist():
                    near: dict[bytes, int] = {}
                    for trie in some:
                        near |= trie.neighbours(word.encode("latin-1"))
                    if near:
                        best = min(near, key=lambda w: (-near[w], w))
                        rows.append((word, len(near), best.decode("latin-1"), near[best]))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "near", "near_n"])

        found = found.unionByName(dealt.mapInArrow(run, schema))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.near", (-F.col("best.less")).alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links of words end. links (word, form), at most one of a word, must not form circles."""
    held = stored(links.select("word", F.col("form").alias("root")), "links")
    while True:
        beyond = held.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = stored(held.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "links")
        drop_stored(held)
        if further.filter("moved").isEmpty():
            return further.select("word", "root")
        held = further


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stored(vocabulary(docs, id_col, text_col), "vocabulary")
    count, letters = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    tasks = max(partitions(docs.sparkSession), -(-count // WORDS_AT_ONCE))
    near = words.join(neighbours(words, tries(words, letters), tasks), "word", "left")
    better = F.col("near_n") >= 2 * F.col("n")
    forms = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("near")).alias("form"), F.when(better, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(forms.filter("form is not null"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
