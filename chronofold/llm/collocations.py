"""Phrase collocation mining: n-grams as rows, counted by language, scored against the counts of their parts.

Every phrase of 1 to ``max_n`` words becomes a row and is counted by language; a candidate is joined with the counts of
the two parts of every cut, scored in decimal arithmetic, dropped if a one-word extension has most of its occurrences
(an anti join), and ranked in a window.

A phrase cannot occur more often than a phrase inside it. So hashes of n-grams are counted length by length first, without
those of which the first or last n - 1 words are rarer than ``least``; what is counted as text afterwards, by language, are
the n-grams whose hash is frequent enough. Others can neither be a candidate nor a part or an extension of one. Frequent
hashes are looked up in a bitmap, 128 MB at most, which lets some others through and none out; counts are taken on the
phrases themselves. By the same argument a longer candidate with a share of another's occurrences implies an extension of
one word with at least that share.

At scale: one scan of the documents for words, one for the hashes of each length and one for phrases; rare n-grams, nearly
all, are shuffled as 16 bytes and never as text. The rows of a megabyte of text are counted before they are shuffled, so a
very frequent phrase sends one row for each; languages are ranked in slices of which each gives its first rows only.

Edge cases: a null text is empty; a null language is ``und`` (as is the language of that name); rows that repeat an id
count again; texts without words give no rows; a language without candidates gives no rows; an empty table gives an
empty result; phrases never cross the end of a piece or document; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored
from .repeats import anchor_bits
from .windows import mixed, spans_hash, sums

UNKNOWN = "und"
LEAST, SHARE, FIRST = 30, 80, 2000
#: Bytes of text whose rows are counted together before they are shuffled.
CHUNK_BYTES = 1 << 20
#: Phrases whose bytes are gathered together.
PHRASES_AT_ONCE = 1 << 14

_ENDS = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b" \t"
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER + _ENDS + _BLANKS, _UPPER.lower() + b" " * (len(_ENDS) + len(_BLANKS)))
_IS_END = np.isin(np.arange(256), np.frombuffer(_ENDS, np.uint8))


@lru_cache(1 << 12)
def language_hash(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


class Pieces:
    """The words of some texts: where each lies in the canonical text (lower case, single blanks) and in which piece."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined.translate(_LOWER), np.uint8)
        blank = raw == 32
        keep = ~(blank & np.r_[True, blank[:-1]])
        edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
        place = np.cumsum(keep) - keep
        self.starts, self.ends = place[edge[::2]], place[edge[1::2]]
        self.piece = np.cumsum(_IS_END[np.frombuffer(joined, np.uint8)])[edge[::2]]
        self.canon = raw[keep]
        self.running = sums(self.canon, "byte")

    def firsts(self, n: int) -> np.ndarray:
        """The first word of every phrase of n words within a piece."""
        last = len(self.starts) - n + 1
        return np.flatnonzero(self.piece[: max(0, last)] == self.piece[n - 1 :][: max(0, last)])

    def hashes(self, first: np.ndarray, n: int, lang: np.uint64) -> np.ndarray:
        return mixed(spans_hash(self.running, self.starts[first], self.ends[first + n - 1], "byte") ^ lang)

    def phrases(self, first: np.ndarray, n: int) -> pa.ChunkedArray:
        """The phrases from some words on, put together PHRASES_AT_ONCE at a time."""
        chunks = []
        for k in range(0, len(first), PHRASES_AT_ONCE):
            some = first[k : k + PHRASES_AT_ONCE]
            a, b = self.starts[some], self.ends[some + n - 1]
            offsets = np.concatenate(([0], np.cumsum(b - a)))
            data = self.canon[np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])]
            chunks.append(pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]))
        return pa.chunked_array(chunks, pa.large_binary())


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, CHUNK_BYTES or a single one at a time."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= CHUNK_BYTES or sum(size.values()) >= 4 * CHUNK_BYTES:
                largest = max(size, key=size.get)
                yield largest, held.pop(largest)
                del size[largest]
    yield from held.items()


def _among(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def counted_hashes(rows: DataFrame, n: int, held, least: int) -> DataFrame:
    """(anchor): the hashes of language and phrase of n words that occur at least so often. rows: lang, text (binary).

    held: a broadcast bitmap of such hashes of n - 1 words; a phrase with others in it leads to no row. Hashes that
    clash add up, so no phrase that is frequent enough is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_language(batches):
            words, code = Pieces(texts), language_hash(lang)
            first = words.firsts(n)
            if len(first):
                there = _among(words.hashes(np.arange(len(words.starts) - n + 2), n - 1, code), held.value)
                values, counts = np.unique(words.hashes(first[there[first] & there[first + 1]], n, code), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["anchor", "a"])

    found = rows.mapInArrow(run, "anchor long, a long").groupBy("anchor").agg(F.sum("a").alias("a"))
    return found.filter(F.col("a") >= least).select("anchor")


def counted(rows: DataFrame, lengths: list[int], held=None) -> DataFrame:
    """(lang, phrase, a): phrases of these numbers of words and their occurrences. rows: lang, text (binary).

    held: a broadcast bitmap of the hashes of the phrases that are wanted; most others lead to no row. None: all are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_language(batches):
            words = Pieces(texts)
            for n in lengths:
                first = words.firsts(n)
                if held is not None:
                    first = first[_among(words.hashes(first, n, language_hash(lang)), held.value)]
                if len(first):
                    found = words.phrases(first, n).value_counts()
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), found.field("values").cast(pa.binary()), found.field("counts")], names=["lang", "phrase", "a"])

    found = rows.mapInArrow(run, "lang string, phrase binary, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    return found.select("lang", F.col("phrase").cast("string").alias("phrase"), "a")


def word_hashes(words: DataFrame) -> DataFrame:
    """(anchor): the hashes of language and word of a stored table of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            phrases = [p.encode() for p in batch.column("phrase").to_pylist()]
            langs = np.array([language_hash(x) for x in batch.column("lang").to_pylist()], np.uint64)
            ends = np.cumsum([len(p) for p in phrases])
            running = sums(np.frombuffer(b"".join(phrases), np.uint8), "byte")
            hashes = mixed(spans_hash(running, np.r_[0, ends[:-1]], ends, "byte") ^ langs)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["anchor"])

    return words.select("lang", "phrase").mapInArrow(run, "anchor long")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) by the cut of the lowest score. counts: lang, phrase, a of all parts."""
    words = F.size(F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), words - 1))).withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    both = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return both.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def extensions(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the occurrences of the most frequent candidate that has one word more."""
    parts = F.array(F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))
    return candidates.select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def collocations(docs: DataFrame, max_n: int = 4, least: int = LEAST, share: int = SHARE, first: int = FIRST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    rows = docs.select(lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    words = stored(counted(rows, [1]), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    often = words.filter(F.col("a") >= least)
    hashes, bits = [], anchor_bits(stored(word_hashes(often), "word-hashes"))
    for n in range(2, max_n + 1):
        hashes.append(stored(counted_hashes(rows, n, bits, least), f"phrase-hashes-{n}"))
        bits = anchor_bits(hashes[-1])
    bits = anchor_bits(reduce(DataFrame.unionByName, hashes))
    candidates = stored(counted(rows, list(range(2, max_n + 1)), bits).filter(F.col("a") >= least), "phrases")
    kept = scored(candidates, often.unionByName(candidates))
    if max_n > 2:
        longer = extensions(candidates.filter(F.size(F.split("phrase", " ")) > 2))
        covers = longer.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "longer")
        inside = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase"))
        exact = lambda c: F.col(c).cast("decimal(19, 0)")
        kept = kept.join(covers, inside & (exact("longer") * 100 >= exact("a") * share), "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    slices = kept.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))))
    slices = slices.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).filter(F.col("_place") <= first)
    ranked = slices.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
