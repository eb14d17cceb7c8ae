"""Whole queries against plain versions, and odd rows that the larger tests leave out."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from chronofold.llm import best_fit_packing, chat, quality, warc
from chronofold.llm.tokens import public_path, tokenizer

from . import brute


def plain_shape(word):
    out = ""
    for run in re.findall(r"[A-Z]+|[^\W\d_A-Z]+|\d+|\s+|[\W_]+", word):
        out += "A" if run[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else "0" if run[0].isdigit() else "a" if run[0].isalpha() else run[:3]
    return out[:8]


def plain_features(text):
    """The names of all features of a text, hashed one by one."""
    words = [w.decode("utf-8", "replace") for w in text.encode().split()]
    if not words:
        return set()
    names, n = set(), len(words)
    for w in words:
        core = w.strip(".,;:!?\"'()[]{}*#$%&-_+=<>/\\|~`@^").lower()
        names |= {f"s {plain_shape(w)}", f"w {core}"} | {f"p {core[:k]}" for k in (4, 5, 6) if len(core) > k}
    shapes = collections.Counter(xxhash.xxh64_intdigest(f"s {plain_shape(w)}".encode(), 7) % 2**18 for w in words)
    names |= {f"share {s} {10 * c // n}" for s, c in shapes.items()}
    names |= {f"again {10 * sum(a == b for a, b in zip(words, words[1:])) // n}", f"distinct {10 * len(set(words)) // n} of {n.bit_length()}"}
    return {xxhash.xxh64_intdigest(x.encode(), 7) % 2**18 for x in names}


def test_scores_are_those_of_named_features(spark, sf_dir):
    """Every row of the query from features that are named and added up one by one."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(d, labels)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in quality.quality_classifier(d, labels).collect():
        text = texts[r["doc_id"]] or ""
        score = sum(float(model.weights[b]) for b in plain_features(text))
        tails = [1 / (1 + np.exp(-(score - t))) for t in model.thresholds]
        got = (r["quality_score"], r["expected_grade"], r["p_not_toxic"], r["p_good"])
        assert got == pytest.approx((score, sum(tails), *tails), abs=1e-4)
        assert r["keep"] == (bool(text.strip()) and r["p_good"] >= quality.KEEP_FROM)


def test_packing_of_repeated_rows_and_null_ids(spark):
    rows = [(7, "the same text " * 9), (7, "the same text " * 9), (7, "another"), (None, "no id"), (None, None), (6, " ".join(map(str, range(9000)))), (6, " ".join(map(str, range(9000))))]
    d = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "doc_id long, text string, length long, sequence_id string, _group int").repartition(2)
    t = tokenizer(public_path("word_bpe_49k.json"))
    want, bins = collections.Counter(), collections.defaultdict(list)
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())] += 1
    out = best_fit_packing.best_fit_packing(d).collect()
    assert collections.Counter(tuple(r)[:5] for r in out) == want and max(r["piece"] for r in out) >= 2
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_turns_that_tie_and_a_very_long_conversation(spark):
    """Equal turns go by role and text; thousands of turns are one conversation."""
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a")]
    rows += [(2, n, "assistant" if n % 2 else "user", f"turn {n} <|im_end|>") for n in range(4000)]
    got = {r["conv_id"]: r for r in chat.chat_round_trip(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    for conv in (1, 2):
        mine = sorted(r[1:] for r in rows if r[0] == conv)
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        said = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_pages_with_other_columns(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (None, "u", "WARC/1.0\r\n\r\n" * 50)]
    d = spark.createDataFrame([(*r, 9, "clash", 1) for r in rows], "page_id long, url string, html string, payload_bytes long, first string, page int")
    brute.same(warc.warc_round_trip(d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), brute.warc(rows))
