import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.llm import best_fit_packing, chat, decontaminate, packed_ids, quality, registry, tokens, warc
from chronofold.llm.tokens import WordEncoder, public_path, tokenizer, word_encoder

from ..compare import assert_same
from . import brute


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), duck, registry.oracle_sql()[name])


def test_held_out_accuracy(spark, sf_dir):
    """Fitted on four fifths of the ratings, checked on the rest."""
    d, labels = documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(d, labels, fold=0)
    held = quality.graded(labels).filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    rows = quality.score(d, model).join(held, "doc_id").select("grade", "keep", "expected_grade").collect()
    kept = {g: np.mean([r["keep"] for r in rows if r["grade"] == g]) for g in range(3)}
    assert kept[2] > 0.9 and kept[0] < 0.35
    assert np.mean([r["expected_grade"] for r in rows if r["grade"] == 2]) > np.mean([r["expected_grade"] for r in rows if r["grade"] == 0]) + 0.5
    assert model.thresholds[0] < model.thresholds[1]


def test_held_out_toxic_documents_go(spark):
    d, labels = documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(d, labels, fold=1)
    held = quality.graded(labels).filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 1)
    rows = quality.score(d.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").select("grade", "keep").collect()
    kept = {g: np.mean([r["keep"] for r in rows if r["grade"] == g]) for g in range(3)}
    assert kept[0] < 0.15 and kept[1] < 0.35 and kept[2] > 0.93


def test_a_small_table_gives_a_model(spark, sf_dir):
    model = quality.train(documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert (model.weights != 0).sum() > 20


def ordinal_case(n=120, v=12):
    source = np.random.default_rng(5)
    x = source.random((n, v)) < 0.3
    grades = np.digitize(x @ source.normal(size=v) + source.logistic(size=n) * 0.3, [-0.3, 0.4])
    return [np.flatnonzero(r) for r in x], grades, np.full(n, 1 / n)


def test_slopes_are_those_of_the_loss():
    _, grades, share = ordinal_case()
    source = np.random.default_rng(6)
    scores, cut = source.normal(size=len(grades)), np.array([-0.4, 0.2])
    _, d_score, d_cut = quality.loss_and_slopes(scores, cut, grades, share)
    for k in range(0, len(scores), 11):
        step = np.zeros(len(scores))
        step[k] = 1e-5
        up, down = (quality.loss_and_slopes(scores + s, cut, grades, share)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - d_score[k]) < 1e-7
    for k in range(2):
        up, down = (quality.loss_and_slopes(scores, cut + s * np.eye(2)[k], grades, share)[0] for s in (1e-5, -1e-5))
        assert abs((up - down) / 2e-5 - d_cut[k]) < 1e-7


def test_fit_reaches_what_a_plain_optimiser_reaches():
    """Against many small proximal steps without any acceleration."""
    rows, grades, _ = ordinal_case()
    share = 1 / np.bincount(grades, minlength=3)[grades]
    share /= share.sum()
    x = np.array([[i in set(r.tolist()) for i in range(12)] for r in rows], float)
    held = quality.PENALTY * np.sqrt((share**2) @ x) + quality.BASE_PENALTY * share.max()

    def objective(w, t):
        return quality.loss_and_slopes(x @ w, np.array([t[0], np.log(t[1] - t[0])]), grades, share)[0] + (held * np.abs(w)).sum()

    w, cut = np.zeros(12), np.array([-0.7, 0.3])
    for _ in range(20_000):
        _, d_score, d_cut = quality.loss_and_slopes(x @ w, cut, grades, share)
        moved = w - 0.1 * (d_score @ x)
        w, cut = np.sign(moved) * np.maximum(0, np.abs(moved) - 0.1 * held), cut - 0.1 * d_cut
    model = quality.fit(rows, grades, epochs=2000)
    assert objective(model.weights[:12].astype(float), model.thresholds) <= objective(w, [cut[0], cut[0] + np.exp(cut[1])]) + 1e-5
    assert not model.weights[12:].any() and (model.weights[:12] != 0).any()


def test_quality_of_a_very_long_text_and_of_ties(spark):
    rows = [(1, "word " * 400_000), (2, "same text"), (3, "same text"), (4, "bad stuff"), (5, "bad stuff"), (5, "bad stuff")]
    labels = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (4, 0, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality.quality_classifier(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(out) == 6 and len({r["quality_score"] for r in out if r["doc_id"] in (2, 3)}) == 1
    assert len({(r["quality_score"], r["keep"]) for r in out if r["doc_id"] == 5}) == 1


def test_quality_edges(spark, sf_dir):
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 0), (None, 1, 1), (2, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["grade"] for r in quality.graded(labels).collect()} == {1: 0, 2: 1, 3: 2}
    rows = [(1, None), (2, ""), (None, "some words"), (3, "same"), (3, "same")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.quality_classifier(d, labels.limit(0))
    assert out.count() == 5 and out.filter("keep").count() == 5
    fitted = quality.quality_classifier(d, labels)
    assert fitted.count() == 5 and not any(r["keep"] for r in fitted.filter("doc_id < 3").collect())
    extra = spark.createDataFrame([(1, "good words", "clash")], "doc_id long, text string, keep string")
    assert quality.keep_good(extra, labels.limit(0)).columns == extra.columns
    assert quality.quality_classifier(d.limit(0), labels).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_two_fit_places_everything(lengths):
    place = best_fit_packing.best_two_fit(lengths, 64)
    bins = {}
    for n, (b, offset) in zip(lengths, place, strict=True):
        bins.setdefault(b, []).append((offset, n))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    assert sorted(bins) == list(range(len(bins)))


def test_best_two_fit_replaces_the_smallest():
    """Greedy filling takes 6 + 3 and leaves a gap of one; two pieces of two fill the widened gap."""
    place = best_fit_packing.best_two_fit([6, 3, 2, 2], 10)
    assert place[0][0] == place[2][0] == place[3][0] != place[1][0]


def check_packed(rows, texts, encode, capacity):
    """rows: (doc_id, piece, start, length, crc, sequence, offset). texts: doc_id -> text."""
    bins, docs = {}, {}
    for doc, piece, start, length, crc, sequence, offset in rows:
        bins.setdefault(sequence, []).append((offset, length))
        docs.setdefault(doc, []).append((piece, start, length, crc))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, pieces in docs.items():
        ids = encode(texts[doc] or "")
        assert [p[:3] for p in sorted(pieces)] == [(k, a, len(ids[a : a + capacity])) for k, a in enumerate(range(0, len(ids), capacity))]
        assert [p[3] for p in sorted(pieces)] == [zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes()) for a in range(0, len(ids), capacity)]
    assert set(docs) == set(texts)
    total = sum(r[3] for r in rows)
    assert len(bins) <= 1.02 * total / capacity + 8


def test_packing(spark, sf_dir):
    t = tokenizer(public_path("word_bpe_49k.json"))
    odd = [r for r in brute.ODD_TEXTS if r[0] not in (6, 7)]
    for d in (documents(spark, sf_dir), spark.createDataFrame(odd, "doc_id long, text string")):
        rows = [tuple(r)[:7] for r in best_fit_packing.best_fit_packing(d).collect()]
        texts = {r["doc_id"]: r["text"] for r in d.collect()}
        check_packed(rows, texts, lambda x: [*t.encode(x, add_special_tokens=False).ids, 1], 4096)
    assert best_fit_packing.best_fit_packing(documents(spark, sf_dir).limit(0)).count() == 0


def test_word_encoder_matches_the_tokenizer():
    e = word_encoder(public_path("word_bpe_49k.json"))
    odd = ["İstanbul <|endoftext|>x it's 3.14 don't ²x a_b ***", "", "   ", "é  x y éa", "ΑΣ ΣΑΣ. 日本語 テスト!!", "x<|startoftext|>", "A.B.C ...", "\x01 \x85 a\x1cb"]
    for text, ids in zip(odd, e.ids([o.encode() for o in odd]), strict=True):
        assert e.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_words_are_learned_once_whatever_their_case_and_marks():
    e = WordEncoder(public_path("word_bpe_49k.json"))
    texts = ["Then then, THEN. then! x", ", then", "T\u0308 T. <|ENDOFTEXT|> Then,", "AT&T's, X'S. 'S a.B,c?! É, é. 3.D", "KÅ* \u212a\u0301\u212b"]
    for text, ids in zip(texts, e.ids([t.encode() for t in texts[:2]]) + e.ids([t.encode() for t in texts[2:]]), strict=True):
        assert e.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()
    e = WordEncoder(public_path("word_bpe_49k.json"))
    e.ids([t.encode() for t in texts[:2]])
    assert sorted(e.numbers) == [b"!", b",", b".", b"then", b"x"]


def test_words_that_come_up_again_are_kept(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_HELD", 8)
    e = WordEncoder(public_path("word_bpe_49k.json"))
    for text in ("often often seldom always always always " + "rare ".join("abcdefgh"), "new", "often newer", "always other " * 9, "word " * 3):
        assert e.tokenizer.encode(text, add_special_tokens=False).ids == e.ids([text.encode()])[0].tolist()
        assert b"always" in e.numbers
    assert b"often" in e.numbers and b"seldom" not in e.numbers


def test_packed_ids(spark, sf_dir):
    enc = packed_ids.rank_encoding(public_path("byte_bpe_50k.tiktoken"))
    d = documents(spark, sf_dir)
    rows = packed_ids.pack_and_read(d).collect()
    assert all(r["positions_ok"] for r in rows)
    check_packed([tuple(r)[:7] for r in rows], {r["doc_id"]: r["text"] for r in d.collect()}, lambda x: [*enc.encode_ordinary(x), 50256], 4096)
    assert packed_ids.pack_and_read(d.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (None, "é", "y"), (1, None, "z")], "doc_id long, text string, pieces string")
    assert sorted((r["length"] for r in packed_ids.pack_and_read(odd).collect())) == [1, 1, 2]


def test_ids_are_as_wide_as_the_vocabulary_needs(spark):
    """An end id beyond 16 bits, and a very long text."""
    d = spark.createDataFrame([(1, "some words"), (2, "word " * 9000), (2, None)], "doc_id long, text string")
    for end, size in ((50256, 2), (70_000, 4)):
        packed = packed_ids.pack_ids(d, end_id=end)
        assert {r["id_bytes"] for r in packed.collect()} == {size}
        rows = packed_ids.read_packed(packed).collect()
        assert all(r["positions_ok"] for r in rows) and max(r["piece"] for r in rows) >= 2


def test_room_tree_is_best_fit():
    rnd = random.Random(3)
    for capacity in (1, 7, 16, 33):
        tree, rooms = packed_ids.RoomTree(capacity), []
        for i in range(200):
            if rooms and rnd.random() < 0.5:
                n = rnd.randint(0, capacity)
                fits = [r for r in rooms if r >= n]
                got = tree.take(n)
                assert (got is None) == (not fits) and (not fits or got[0] == min(fits))
                if got:
                    rooms.remove(got[0])
            else:
                rooms.append(rnd.randint(0, capacity))
                tree.put(rooms[-1], i)


ITEMS = [(1, "What is the tall grey tower by the old harbour called? It is called the lantern of the north sea today."), (2, "Name one thing. Blue."), (3, "single sentence without any end at all here"), (4, None), (5, "")]


def test_leaks(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    item = ITEMS[0][1]
    cut = item.replace("harbour", "market")
    rows = [(1, f"{filler} {item.upper()} {filler}"), (2, filler), (3, item[:60]), (4, f"{filler} {cut}"), (5, None), (6, ""), (7, ITEMS[2][1]), (7, ITEMS[2][1]), (8, f"{filler} name one thing blue {filler}")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, bench).collect())
    assert got == [(1, 1), (7, 3), (7, 3), (8, 2)]
    extra = d.withColumn("_0", F.lit("clash"))
    kept = decontaminate.drop_leaks(extra, bench)
    assert kept.columns == extra.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6]
    assert decontaminate.find_leaks(d, bench.limit(0)).count() == 0 and decontaminate.find_leaks(d.limit(0), bench).count() == 0


def test_items_without_id_leak(spark):
    items = [(None, ITEMS[0][1]), (None, ITEMS[2][1]), (2, ITEMS[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, f"before {ITEMS[0][1]} between {ITEMS[2][1]} after"), (2, "nothing of it"), (3, ITEMS[1][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, bench).collect()} == {(1, None), (3, 2)}
    assert [r["doc_id"] for r in decontaminate.drop_leaks(d, bench).collect()] == [2]


def whole_index(items):
    items = decontaminate.counted_items(items)
    return decontaminate.ItemIndex(items, len(items), np.mean([len(x.question) + len(x.answer) for x in items]))


@pytest.mark.parametrize("further", [5, 30, 40])
def test_longest_item_with_words_between(further):
    """At every offset, an item of the longest length with words between question and answer."""
    question, answer = (" ".join(f"{c}{i}" for i in range(20)) for c in "qa")
    index = whole_index([(1, f"{question}? {answer}."), (2, "Short one? Yes.")])
    copy = f"{question} {' '.join(['between'] * further)} {answer}"
    texts = [" ".join([*["w"] * offset, copy, *["w"] * after]) for offset in range(85) for after in (0, 100)]
    assert [set(hits) for hits in index.search(texts)] == [{1}] * len(texts)


@pytest.mark.parametrize("at_once", [3, 2048])
def test_leaks_do_not_depend_on_other_items(spark, monkeypatch, at_once):
    """An item of 20 words whose question and answer stand 60 words apart, alone, beside a longer one, and among 2,101 others."""
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", at_once)
    few = 40 if at_once == 3 else 2100  # more than an index takes
    item = (1, " ".join(f"q{i}" for i in range(12)) + "? " + " ".join(f"a{i}" for i in range(8)) + ".")
    longer = (2, " ".join(f"l{i}" for i in range(59)) + "? yes.")
    others = [(10 + n, " ".join(f"o{n}x{i}" for i in range(12)) + "? " + " ".join(f"p{n}x{i}" for i in range(8)) + ".") for n in range(few)]
    parts = [x.strip("?.") for x in item[1].split("? ")]
    rows = [(n, " ".join(["w"] * n + [parts[0]] + ["between"] * 60 + [parts[1]] + ["w"] * 70)) for n in range(0, 200, 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for items in ([item], [item, longer], [item, longer, *others]):
        got = decontaminate.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(n, 1) for n, _ in rows]
        assert all(r["question_overlap"] == r["answer_overlap"] == 1 for r in got)


def test_an_id_is_reported_once(spark, monkeypatch):
    """Items of one id, and of none, in passes of their own; ties between items; repeated documents give a row each."""
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1)
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 1)
    bench = spark.createDataFrame([(1, ITEMS[0][1]), (1, ITEMS[1][1]), (None, ITEMS[2][1]), (None, ITEMS[0][1]), (4, ITEMS[0][1])], "item_id long, text string")
    every = " and ".join(t for _, t in ITEMS[:3])
    d = spark.createDataFrame([(1, every), (1, every), (2, ITEMS[2][1]), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, None), (1, 4)] * 2 + [(2, None)], key=str)


def leak_cases(spark, sf_dir):
    """Real items and documents, items with changed words, and items of 480 to 3000 words, whole and in part."""
    rnd = random.Random(2)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][:40]
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()][:80]
    for n, (_, t) in enumerate(items[:20]):
        words = t.split(" ")
        for _ in range(n % 4):
            words[rnd.randrange(len(words))] = "zzz"
        rows.append((10_000 + n, "intro words " * 20 + " ".join(words)))
    for n, size in enumerate((480, 700, 1500, 3000)):
        long = " ".join(f"v{rnd.randrange(200)}" for _ in range(size))
        items.append((500 + n, f"{long}. The answer is blue."))
        around = " ".join(f"u{i}" for i in range(90))
        rows += [(20_000 + n, f"{around} {long} the answer is blue {around}"), (21_000 + n, f"{around} {' '.join(long.split()[:512])}"), (22_000 + n, f"{long} {around}")]
    return rows, [*items, (None, "Nobody knows this one? It has no number at all."), (7, None), (8, "?!")]


@pytest.mark.parametrize("at_once", [3, 2048])
def test_leaks_match_every_shingle_of_every_passage(spark, sf_dir, monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", at_once)
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 40_000 if at_once == 3 else 1 << 26)
    rows, items = leak_cases(spark, sf_dir)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    want = brute.leaks(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert {(20_000 + n, 500 + n) for n in range(4)} <= want and not {(21_001, 501), (22_001, 501)} & want
    scores = {(r["doc_id"], r["item_id"]): round(r["score"], 4) for r in got}
    plain = whole_index(items).search([t or "" for _, t in rows])
    for (doc, _), hits in zip(rows, plain):
        for item in hits.keys() & {i for i, t in items if t and len(t) < 300}:
            assert scores[doc, item] >= 1  # the score of an item does not depend on the other items of its index


def test_scores_do_not_depend_on_the_index(spark, sf_dir):
    rows, items = leak_cases(spark, sf_dir)
    every = decontaminate.counted_items(items[:40])
    mean = np.mean([len(x.question) + len(x.answer) for x in every])
    text = [f"{t} and more words" for _, t in items[:40]]
    whole = decontaminate.ItemIndex(every, len(every), mean).search(text)
    for n in (1, 7):
        parts = [decontaminate.ItemIndex(every[i : i + n], len(every), mean).search(text) for i in range(0, 40, n)]
        for k, hits in enumerate(whole):
            joined = {i: v for p in parts for i, v in p[k].items()}
            assert joined.keys() == hits.keys() and all(abs(joined[i][0] - hits[i][0]) < 1e-4 for i in hits)


def test_wand_scores_what_adding_all_postings_up_scores():
    rnd = random.Random(6)
    items = decontaminate.counted_items([(i, " ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(2, 12)))) for i in range(100)])
    index = decontaminate.ItemIndex(items, 100, 7.0)
    for _ in range(50):
        terms = rnd.sample(range(len(index.terms)), 15)
        scores = np.zeros(100)
        for t in terms:
            for k in range(index.first[t], index.first[t + 1]):
                scores[index.item[k]] += index.impact[k]
        row = np.array([terms], np.int32)
        got = {i: round(s, 4) for _, blocks in index._reached(row) for i, s in index.wand(terms, blocks)}
        assert got == {i: round(float(s), 4) for i, s in enumerate(scores) if s >= 1}


def test_chat_round_trip(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 1, "assistant", control), (1, 0, "user", control), (2, 0, "assistant", " \n lead"), (2, 1, "assistant", ""), (2, 2, "assistant", r"<\|x|> <| \\<\\|"), (3, 0, None, None),
        (None, 0, "user", "é日本🙂"), (None, 1, "assistant", "🙂é <|endoftext|>"), (4, 0, "us<|er", "x"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss_mask", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.chat_round_trip(turns).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.chat_round_trip(turns.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("<\\|imx", max_size=12))
def test_escapes_are_undone(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


PAGES = [
    (1, "u", "a"), (2, "u\r\nX: 1", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"), (3, None, None), (4, "x", ""), (5, "x", "a"), (5, "y", "a"), (None, "z", "q"),
    (6, "x", "é\r\n\r\nWARC/1.0\r\nfoo"), (7, "x", "é\r\n\r\nWARC/1.0\r\nfoo"), (8, "x", "y" * 300_000 + "WARC/1.0\r\n" + "z" * 300_000),
]


@pytest.mark.parametrize("split", ["128m", "20k"])
def test_warc(spark, sf_dir, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        brute.same(warc.warc_round_trip(spark.createDataFrame(PAGES, "page_id long, url string, html string")), brute.warc(PAGES))
        pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
        brute.same(warc.warc_round_trip(pages), brute.warc([(r["page_id"], r["url"], r["html"]) for r in pages.collect()]))
        assert warc.warc_round_trip(pages.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    "rows",
    [
        [(None, "u1", "A"), (None, "u2", "A"), (None, "u3", "B"), (None, "u4", "B")],
        [(5, "u1", "A"), (3, "u2", "A"), (5, "u3", "B"), (4, "u4", "B")],
        [(5, "u1", "A"), (5, "u1", "A"), (5, None, "A"), (5, "u2", "A"), (3, "u3", "A"), (5, "u4", None), (5, "u5", ""), (None, "u6", "")],
    ],
)
def test_warc_page_of_several_payloads(spark, tmp_path, rows):
    """A page id, or none, that is the largest of two groups of equal payloads: both are written, and every url."""
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    brute.same(warc.warc_round_trip(pages), brute.warc(rows))
    warc.write_warc(pages, str(tmp_path / "out"))
    written = b"".join(f.read_bytes() for f in (tmp_path / "out").glob("part-*"))
    urls = [line[len(b"WARC-Target-URI: ") :].decode() for line in written.split(b"\r\n") if line.startswith(b"WARC-Target-URI: ")]
    assert sorted(urls) == sorted(u or "" for _, u, _ in rows)
