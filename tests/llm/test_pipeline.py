"""The pipeline against plain versions of its stages."""

import re
from collections import Counter

import corpus_pipeline
from chronofold.llm import quality
from chronofold.llm.tokens import public_path, tokenizer

from . import brute
from .test_text import check_packed


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_run_matches_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    tail = lambda t: model.tails(quality.np.array([model.score(quality.features(t.encode(), model.weights))]))[0, 1]
    left = {i: t for i, t in rows.items() if t.strip() and tail(t) >= quality.KEEP_FROM}
    left = {r[0]: left[r[0]] for r in brute.exact(list(left.items())) if r[3]}
    left = {i: left[i] for i, _, first in brute.simhash(list(left.items())) if i == first}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {i for i, _ in brute.leaks(list(left.items()), items)}
    left = {i: t for i, t in left.items() if i not in leaked}
    t = tokenizer(public_path("word_bpe_49k.json"))
    out = [tuple(r)[:7] for r in corpus_pipeline.run(spark, sf_dir).collect()]
    check_packed(out, left, lambda x: [*t.encode(x, add_special_tokens=False).ids, 1], 4096)


def test_run_on_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, repeated rows, clashing columns: every stage keeps what its rules say."""
    names = "doc_id long, text string, lang string, source string, n_chars long, keep string, _bucket long, id string, fp string, n long, sequence_id string"
    plain = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()[:30]]
    odd = [*plain, plain[0], (None, "nothing but these words here"), (None, None), (903, None), (904, ""), (905, " ")]
    rows = [(i, t, None, None, None, "x", 1, None, "y", None, "z") for i, t in odd]
    folder = str(tmp_path)
    spark.createDataFrame(rows, names).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    left = {}  # without ratings the classifier keeps everything
    for i, t in odd:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        left[key] = min(left.get(key, (i, t)), (i, t), key=lambda r: brute.last_null(r[0]))
    near = list(left.values())
    near = [r for r, (i, _, first) in zip(near, brute.simhash(near)) if i == first]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {i for i, _ in brute.leaks(near, items)}
    stays = Counter(i for i, _ in near if i not in leaked)
    assert stays[None] == 1 and stays[903] == 1 and not stays[904] and not stays[905] and sum(stays.values()) > 20
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect() if r["piece"] == 0) == stays


def test_stages_keep_columns_and_stand_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0
