"""SimHash near-duplicates with a Gray-order hierarchical index.

The upper nodes of the index are shared masked bit patterns: a node is (mask, pattern), all fingerprints with pattern
under mask. The 64 bits are divided in four; two fingerprints that differ in three bits or fewer agree in at least one
quarter, so they meet below one of its four nodes, with no difference so far. A node with too many members gets four
children for each of its masks, that fix a quarter of the free bits as well, and so on.

Below a node its members are sorted by Gray rank, and neighbours are grouped, eight to a group, eight groups to an upper
group, up to the node. The bits that all members of a group share are its masked pattern. Two groups of a node are
compared from the top down: differences in the bits that both have fixed add up on the way, bits that an upper group
has fixed are not counted again, and two groups go, with all that is below them, once their differences pass the limit.

At scale: exact copies are one fingerprint before anything is compared; a fingerprint is sent to 4 nodes, to 4 times as
many only where a node is crowded. A task looks at a bounded number of pairs of groups at a time and emits a spanning
forest of what it links, never all pairs. Joins with the list of crowded nodes are left to Spark, which broadcasts it
only where its size allows.

Edge cases: a text without words (null, empty) has fingerprint zero, linked like any other; fewer words than a shingle
are one shingle; null ids sort last and come back as null; repeated rows give one row each; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, by_place, id_back, id_of, key_filter, partitions, stored, with_maybe
from .components import components

SEED = 42
#: Members of a node from which it is divided, and how often: below the last level 20 bits are free, so a node has
#: 2**20 members at most.
NODE_MEMBERS, LEVELS = 4096, 4
#: Neighbours in Gray order that share an upper group.
FAN = 8
#: Pairs of groups that are looked at together.
PAIRS_AT_ONCE = 1 << 14
ALL = (1 << 64) - 1


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a text in UTF-8, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    at = starts.tolist()
    pairs = zip(at, at[width:], strict=False) if len(words) > width else [(0, at[-1])]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[a : b - 1], SEED) for a, b in pairs], "<u8")
    bits = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        bits += np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(id_of(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def quarters(free: int) -> list[int]:
    """The set bits of free, divided into four masks."""
    bits = [i for i in range(64) if free >> i & 1]
    step = -(-len(bits) // 4)
    return [sum(1 << i for i in bits[a : a + step]) for a in range(0, len(bits), step)]


class GrayTree:
    """Fingerprints of some nodes in Gray order, in groups of ``FAN`` neighbours, those in groups of as many, and so on
    up to one group a node. What all members of a group share is its masked pattern: fixed bits, and their values."""

    def __init__(self, fps: np.ndarray, node: np.ndarray):
        """node: ascending numbers; within a node fingerprints are in Gray order."""
        self.fixed = [np.full(len(fps), ALL, np.uint64)]
        self.values = [fps]
        self.first: list[np.ndarray] = []  # of each group of a level, its first member one level below
        while len(node) and (node[1:] == node[:-1]).any():
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            within = np.arange(len(node)) - np.repeat(starts, np.diff(np.r_[starts, len(node)]))
            at = np.flatnonzero(within % FAN == 0)
            every = np.bitwise_and.reduceat(self.values[-1], at)
            some = np.bitwise_or.reduceat(self.values[-1] | ~self.fixed[-1], at)
            every &= np.bitwise_and.reduceat(self.fixed[-1], at)
            self.fixed.append(np.bitwise_and.reduceat(self.fixed[-1], at) & (every | ~some))
            self.values.append(every & self.fixed[-1])
            self.first.append(np.r_[at, len(node)])
            node = node[at]

    def close_pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i < j, of members of one node within limit bits, some thousand at a time.

        From the top down: the differences of two groups are those that their upper groups have already, and those in
        the bits that only they themselves have fixed; pairs of groups are dropped as soon as they exceed the limit.
        """
        top = len(self.first)
        roots = np.arange(len(self.values[top]))
        open_ = [(top, roots, roots, self.fixed[top], np.zeros(len(roots), np.int64))]
        while open_:
            level, a, b, known, apart = open_.pop()
            if level == 0:
                yield a, b
                continue
            if len(a) > PAIRS_AT_ONCE:
                open_ += [(level, *(x[k : k + PAIRS_AT_ONCE] for x in (a, b, known, apart))) for k in range(0, len(a), PAIRS_AT_ONCE)]
                continue
            first = self.first[level - 1]
            wide = first[a + 1] - first[a]
            count = wide * (first[b + 1] - first[b])
            of = np.repeat(np.arange(len(a)), count)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            i, j = first[a][of] + nth % wide[of], first[b][of] + nth // wide[of]
            keep = (i < j) | ((i == j) & (level > 1))
            i, j, of = i[keep], j[keep], of[keep]
            both = self.fixed[level - 1][i] & self.fixed[level - 1][j]
            new = (self.values[level - 1][i] ^ self.values[level - 1][j]) & both & ~known[of]
            total = apart[of] + np.bitwise_count(new)
            near = total <= limit
            if near.any():
                open_.append((level - 1, i[near], j[near], both[near], total[near]))


def hook(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Joins the sets of p and q, pair by pair; root points at the smallest place of each set."""
    while len(p):
        x, y = root[p], root[q]
        p, q = x[x != y], y[x != y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def forest(fps: np.ndarray, node: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, first member) that join what is close within each node, as few as can be."""
    root = np.arange(len(fps))
    for p, q in GrayTree(fps, node).close_pairs(limit):
        hook(root, p, q)
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _compare(limit: int):
    """Tasks over rows (mask, pattern, fp), all rows of a node together and in order."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("mask", "pattern")])
            held.append((keys, batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)))
            if len(keys) and (keys[-1] != held[0][0][0]).any():  # the last node may go on in the next batch
                keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.flatnonzero((keys != keys[-1]).any(1))[-1] + 1
                yield keys[:cut], fps[:cut]
                held = [(keys[cut:], fps[cut:])]
        if sum(len(fps) for _, fps in held):
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in nodes(batches):
            node = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(1)])
            several = np.bincount(node)[node] > 1
            node, fps = node[several], fps[several]
            order = np.lexsort((gray_rank(fps), node))
            a, b = (x.view(np.int64) for x in forest(fps[order], node[order], limit))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def close_links(fps: DataFrame, limit: int = 3) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that join all within limit bits of each other.

    fps should be a stored table. limit: 3 or less, so that one quarter of the bits agrees.
    """
    if limit > 3:
        raise ValueError("four nodes find differences of up to three bits")
    node = ["mask", "pattern"]
    rows = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    ready, masks = [], [0]
    for level in range(LEVELS):
        below = {m: [m | q for q in quarters(ALL & ~m)] for m in masks}
        masks = [m for children in below.values() for m in children]
        child = F.element_at(F.create_map(*[x for m, c in below.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in c]))]), F.col("mask"))
        rows = rows.select("fp", F.explode(child).alias("mask")).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        if level == LEVELS - 1:
            ready.append(rows)
            break
        crowded = stored(rows.groupBy(node).count().filter(F.col("count") > NODE_MEMBERS).select(node), "crowded")
        if crowded.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(crowded, node, "left_anti"))
        rows = stored(rows.join(crowded, node, "left_semi").select("mask", "fp"), "next-level")
    every = reduce(DataFrame.unionByName, [r.select(*node, "fp") for r in ready])
    dealt = every.repartition(partitions(fps.sparkSession), *node).sortWithinPartitions(*node)
    return dealt.mapInArrow(_compare(limit), "a long, b long")


def simhash_dedup(docs: DataFrame, width: int = 3, limit: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id."""
    found = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = stored(found.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    labels = components(close_links(classes.select("fp"), limit))
    linked = classes.join(labels.withColumnRenamed("node", "fp"), "fp").select("fp", "label", "first_id")
    smallest = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = stored(linked.join(smallest, "label").select("fp", "component_id"), "linked")
    of = classes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return found.join(of, "fp").select(
        id_back(F.col("id")).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        id_back(F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, width: int = 3, limit: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of their component, with their own columns. Rows that share this id are all
    in the component; of them the one with the smallest columns stays."""
    found = stored(simhash_dedup(docs, width, limit, id_col, text_col), "simhash-found")
    ids = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.coalesce("component_id", F.lit(NULL_ID)).alias("first_id"))
    counted = ids.groupBy("id").agg(F.min("first_id").alias("first_id"), F.max("first_id").alias("last_id"), F.count("*").alias("n"))
    counted = stored(counted, "simhash-counted")
    doubt = counted.filter("id <> first_id or n > 1")
    plain, (own_id,) = by_place(docs, id_col)
    marked = with_maybe(plain, id_of(own_id), key_filter(doubt, "id"))
    safe = marked.filter("not _maybe").drop("_maybe")
    rows = marked.filter("_maybe").select(F.struct(*plain.columns).alias("row"), id_of(own_id).alias("id"))
    stays = rows.join(counted.filter("id = first_id").select("id"), "id", "left_semi")
    return safe.unionByName(stays.groupBy("id").agg(F.min("row").alias("row")).select("row.*")).toDF(*docs.columns)
