import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronofold.llm import common, exact_dedup, repeats, simhash_dedup, suffix_dedup
from chronofold.llm import phrase_dedup as phrase_dedup_module
from chronofold.llm.components import components
from chronofold.llm.phrase_dedup import WordAutomaton, phrase_dedup, recurring_passages
from chronofold.llm.suffix_dedup import SuffixFamily, suffix_array

from . import brute


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def texts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d, [tuple(r) for r in d.collect()]


def test_exact(spark, sf_dir):
    for d, rows in ((docs(spark, brute.ODD_TEXTS), brute.ODD_TEXTS), texts(spark, sf_dir)):
        brute.same(exact_dedup.exact_dedup(d), brute.exact(rows))


def test_exact_survives_collisions(spark):
    """With one byte of the digest most hits are collisions: the bytes decide."""
    rows = [(i, f"text {i % 300}") for i in range(900)]
    brute.same(exact_dedup.exact_dedup(docs(spark, rows), key_bytes=1), brute.exact(rows))


def test_exact_flushes_many_runs(spark):
    rows = [(i, f"text {i % 40}") for i in range(400)]
    digests = docs(spark, rows).selectExpr("doc_id as id", "unhex(sha2(text, 256)) as key")
    index = exact_dedup.build_index(digests, memtable_rows=16)
    assert {(r["keep_id"], r["group_size"]) for r in index.collect()} == {(i, 10) for i in range(40)}


def test_keep_first_keeps_other_columns(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "w", 2), (2, "a  b", "y", 3), (3, "c", None, None), (None, "c", "n", 4), (4, None, "e", 5), (5, "", "e", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, id string, key long")
    assert sorted(tuple(r) for r in exact_dedup.keep_first(d).select("doc_id", "id").collect()) == [(1, "w"), (3, None), (4, "e")]
    assert exact_dedup.keep_first(d).columns == d.columns
    assert exact_dedup.keep_first(d.limit(0)).count() == 0


def test_simhash(spark, sf_dir):
    for d, rows in ((docs(spark, brute.ODD_TEXTS), brute.ODD_TEXTS), texts(spark, sf_dir)):
        brute.same(simhash_dedup.simhash_dedup(d), brute.simhash(rows))


@pytest.mark.parametrize("members", [4, 32, 1024])
def test_close_links_find_every_component(spark, monkeypatch, members):
    """A dense cluster, scattered pairs, and pairs that differ in one bit of three quarters, at every depth."""
    monkeypatch.setattr(simhash_dedup, "NODE_MEMBERS", members)
    rnd = random.Random(4)
    center = rnd.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(60)}
    fps |= {f ^ (1 << 3 | 1 << 20 | 1 << 40) for f in list(fps)[:20]}
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash_dedup.close_links(table)
    labels = {r["node"] % (1 << 64): r["label"] % (1 << 64) for r in components(links).collect()}
    expected = brute.linked(fps)
    groups = {}
    for f in fps:
        groups.setdefault(labels.get(f, f), set()).add(f)
    want = {}
    for f in fps:
        want.setdefault(expected[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_keep_one(spark):
    base = " ".join(map(str, range(2000)))
    rows = [(5, base, "p"), (3, base + " x", "q"), (3, base + " x", "o"), (9, "other words here", "r"), (7, None, "s"), (8, "", "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted(tuple(r) for r in simhash_dedup.keep_one(d).select("doc_id", "fp").collect()) == [(3, "o"), (7, "s"), (9, "r")]


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash_dedup.keep_one])
def test_other_columns_with_the_names_of_the_filter(spark, keep):
    rows = [(1, "a b c d", 1, "p", b"x", True), (2, "a b c d", 2, "q", b"y", False), (3, "other words here now", 3, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _bucket long, _at string, _bits binary, _maybe boolean")
    out = keep(d)
    assert out.columns == d.columns and sorted((tuple(r) for r in out.collect()), key=str) == [rows[0], rows[2]]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_of_links_that_turn_round(spark):
    """Links whose direction differs from one evaluation to the next, as it may on several executors."""

    def turned(batches):
        for batch in batches:
            rows = [random.SystemRandom().sample([r["a"], r["b"]], 2) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    links = spark.createDataFrame([(i, i + 1000) for i in range(200)], "a long, b long").mapInArrow(turned, "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i + far: i for i in range(200) for far in (0, 1000)}


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_gray_tree_finds_every_component_of_every_node(batch, monkeypatch):
    """Nodes of one to 700 members, dense and scattered, in batches that cut them anywhere."""
    monkeypatch.setattr(simhash_dedup, "PAIRS_AT_ONCE", 50)
    rnd = random.Random(batch)
    rows, want = [], set()
    for pattern, (size, spread) in enumerate([(1, 64), (2, 3), (9, 4), (64, 12), (700, 20), (65, 64), (300, 9)]):
        base = rnd.getrandbits(64)
        fps = sorted({base ^ sum(1 << b for b in rnd.sample(range(spread), rnd.randint(0, min(5, spread)))) for _ in range(size)})
        rows += [(7, pattern, f - (1 << 64) if f >> 63 else f) for f in fps]
        labels = brute.linked(fps)
        want |= {frozenset(f for f in fps if labels[f] == k) for k in set(labels.values())}
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + batch])], names=["mask", "pattern", "fp"]) for i in range(0, len(rows), batch)]
    links = [(r["a"] % 2**64, r["b"] % 2**64) for out in simhash_dedup._compare(3)(iter(batches)) for r in out.to_pylist()]
    sets = {f % 2**64: {f % 2**64} for _, _, f in rows}
    for a, b in links:
        if sets[a] is not sets[b]:
            sets[a] |= sets[b]
            for f in sets[b]:
                sets[f] = sets[a]
    assert {frozenset(x) for x in sets.values()} == want


def test_gray_tree_adds_up_what_direct_comparison_gives():
    rnd = np.random.default_rng(3)
    fps = rnd.integers(0, 2**12, 300).astype(np.uint64)
    fps = np.unique(fps)
    fps = fps[np.argsort(simhash_dedup.gray_rank(fps))]
    found = {(int(i), int(j)) for p, q in simhash_dedup.GrayTree(fps, np.zeros(len(fps), int)).close_pairs(2) for i, j in zip(p, q)}
    assert found == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}


@pytest.mark.parametrize("size", [20, 60])
def test_links_do_not_depend_on_the_order_of_rows(size):
    rnd = random.Random(7)
    center = rnd.getrandbits(63)
    fps = sorted({center ^ 1 << b for b in range(size)})
    found = set()
    for _ in range(5):
        rnd.shuffle(fps)
        columns = {"mask": [1] * size, "pattern": [1] * size, "fp": fps}
        batch = pa.RecordBatch.from_pydict(columns)
        links = [tuple(r.values()) for out in simhash_dedup._compare(3)(iter([batch])) for r in out.to_pylist()]
        assert all(a < b for a, b in links)
        found.add(tuple(sorted(links)))
    assert len(found) == 1


def test_word_codes_are_distinct_beyond_a_million_words():
    places = [*range(3000), *range(1_100_000, 1_103_000), 60_000_000, 200_000_000]
    codes = {WordAutomaton.code(n) for n in places}
    assert len(codes) == len(places) and all(len(c) == 2 for c in codes)


def test_filters_beyond_their_size_are_joins_with_equal_rows(spark, monkeypatch):
    rows = [(i, f"text {i % 70}") for i in range(200)] + [(None, None), (7, "text 0")]
    wanted = brute.exact(rows)
    brute.same(exact_dedup.exact_dedup(docs(spark, rows)), wanted)
    monkeypatch.setattr(common, "FILTER_BITS", 1)
    assert common.bits_for(10) is None
    brute.same(exact_dedup.exact_dedup(docs(spark, rows)), wanted)
    assert exact_dedup.keep_first(docs(spark, rows)).count() == 71


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, simhash_dedup.simhash_dedup, phrase_dedup, suffix_dedup.suffix_dedup])
def test_empty_tables_and_clashing_columns(spark, run):
    names = "_bucket long, _at string, _bits binary, _hash long, text string, anchor long, context string, id string, h string, key string, fp long, n long, doc_id long"
    rows = [(1, "a", b"b", 2, " ".join(["w"] * 80), 3, "c", "i", "h", "k", 4, 5, 9), (1, "a", b"b", 2, None, 3, "c", "i", "h", "k", 4, 5, None)]
    plain = spark.createDataFrame([(r[12], r[4]) for r in rows], "doc_id long, text string")
    both = spark.createDataFrame(rows, names)
    assert sorted(map(str, run(both).collect())) == sorted(map(str, run(plain).collect()))
    assert run(both.limit(0)).count() == 0


def more_rows():
    rnd = random.Random(5)
    rows = list(brute.ODD_TEXTS)
    rows += [(20 + i, " ".join(rnd.choice(["a", "bb"]) for _ in range(60))) for i in range(20)]
    rows += [(50 + i, "".join(rnd.choice(["ab", "c", "é\n"]) for _ in range(rnd.choice([10, 300, 900]))) + ("PASS" + "qwé" * 150 if i % 2 else "") + str(i)) for i in range(20)]
    rows += [(80 + i, f"{i} " * 5 + " ".join(map(str, range(1000, 1120))) + f" {i}" * 30) for i in range(30)]
    return rows


@pytest.mark.parametrize("hot,places", [(1, 3), (1500, 3), (1500, 1 << 14)])
def test_phrases(spark, sf_dir, monkeypatch, hot, places):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(phrase_dedup_module, "GROUP_PLACES", places)
    for d, rows in ((docs(spark, more_rows()), more_rows()), texts(spark, sf_dir)):
        brute.same(phrase_dedup(d), brute.phrases(rows))
    assert phrase_dedup(docs(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 1500])
def test_strings(spark, sf_dir, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    for d, rows in ((docs(spark, more_rows()), more_rows()), texts(spark, sf_dir)):
        brute.same(suffix_dedup.suffix_dedup(d), brute.strings(rows))
    assert suffix_dedup.suffix_dedup(docs(spark, [(1, "a")]).limit(0)).count() == 0


def test_shards_of_a_run_merge_levels(spark, sf_dir):
    """The contexts of the whole table, in the shards of the query: levels are merged many times in each large one."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    rows = repeats.keyed(spark.read.parquet(f"{larger}/documents.parquet"), "doc_id", "text")
    spec = repeats.Windows("byte", 400, suffix_dedup.GRAM)
    found = common.stored(repeats.distinct_contexts(rows, spec, repeats.anchor_bits(common.stored(repeats.repeated_anchors(rows, spec), "anchors"))), "contexts")
    shards = repeats.shards_for(found)

    def count(part: pa.Table) -> pa.Table:
        contexts = part.column("context").to_pylist()
        return pa.table({"bytes": [sum(map(len, contexts))], "merges": [suffix_dedup.family_of(contexts, 400).merges]})

    merged = found.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInArrow(count, "bytes long, merges long").collect()
    large = [r["merges"] for r in merged if r["bytes"] >= 16 * suffix_dedup.LEAST_BATCH_BYTES]
    assert large and min(large) >= 10 and sum(r["merges"] for r in merged) >= 40


def test_suffix_array_is_sorted():
    source = np.random.default_rng(1)
    data = source.integers(97, 99, 500).astype(np.uint8)
    for width in (1, 5, 8, 13, 64):
        starts, same = suffix_array(data, np.arange(500 - width + 1), width)
        strings = [data[s : s + width].tobytes() for s in starts.tolist()]
        assert strings == sorted(strings)
        assert same.tolist() == [i > 0 and strings[i] == strings[i - 1] for i in range(len(strings))]


def test_suffix_levels_double_and_are_merged_not_rebuilt(monkeypatch):
    built = []
    plain = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda data, starts, width: built.append(len(starts)) or plain(data, starts, width))
    contexts = [b"%08d" % (i * 7919 % 1000) for i in range(7)]
    family = SuffixFamily(contexts, 8)
    for i in range(7):
        family.add(i, i + 1)
    assert [len(x) if x is not None else 0 for x in family.levels] == [1, 2, 4]
    family.finish()
    assert built == [1] * 7  # each batch was sorted once, levels came from merging
    assert [contexts[i // 8] for i in family.levels[0].tolist()] == sorted(contexts)
    assert not family.found.any()


@pytest.mark.parametrize("width", [3, 8, 13, 40])
def test_suffix_family_finds_what_a_dictionary_finds(width):
    source = np.random.default_rng(width)
    contexts = [source.integers(97, 99, int(n)).astype(np.uint8).tobytes() for n in source.integers(1, 90, 40)]
    contexts += [contexts[3] + b"x", b"y" + contexts[3], b"z" * 60]
    family = SuffixFamily(contexts, width)
    for i in range(0, len(contexts), 3):
        family.add(i, min(i + 3, len(contexts)))
    family.finish()
    strings = [(i, c[j : j + width]) for i, c in zip(family.edges.tolist(), contexts) for j in range(len(c) - width + 1)]
    seen = {}
    for i, c in zip(family.edges.tolist(), contexts):
        for j in range(len(c) - width + 1):
            seen.setdefault(c[j : j + width], []).append(i + j)
    assert set(np.flatnonzero(family.found).tolist()) == {p for places in seen.values() if len(places) > 1 for p in places}
    assert len(family.levels[0]) == len(seen) <= len(strings)


def test_passages_and_automaton():
    a, b = " ".join(map(str, range(40))).encode(), " ".join(map(str, range(5, 45))).encode()
    found = recurring_passages([a, b], [1, 1], 35)
    assert found == [" ".join(map(str, range(5, 40))).encode()] * 2
    automaton = WordAutomaton(found)
    assert automaton.covered(a) == [(5, 40)] and automaton.covered(b) == [(0, 35)] and automaton.covered(b"1 2 3") == []
