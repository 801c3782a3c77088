"""The pipeline against its stages done by hand."""

import pandas as pd

import corpus_pipeline
from ostinata.llm import bpe, minhash_dedup, mixing, quality_crf, toxicity_ssk

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_whole_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    d = docs.toPandas()
    field, machine = quality_crf.train(spark, sf), toxicity_ssk.train(spark, sf)
    want = d[field.quality(d.text.tolist()) >= field.threshold]
    good = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert good.columns == COLUMNS and set(good.toPandas().doc_id) == set(want.doc_id)
    want = want[[machine.score(*c) < 0.5 for c in machine.counts(want.text.tolist())]] if machine else want
    clean = corpus_pipeline.STAGES[1][1](spark, good, sf)
    assert set(clean.toPandas().doc_id) == set(want.doc_id)
    once = corpus_pipeline.STAGES[2][1](spark, clean, sf)
    kept = {r["doc_id"] for r in minhash_dedup.groups(spark.createDataFrame(want[COLUMNS])).where("keep").collect()}
    assert {r["doc_id"] for r in once.collect()} == kept
    mixed = corpus_pipeline.STAGES[3][1](spark, once, sf)
    assert mixed.columns == COLUMNS
    blocks = mixed.toPandas()
    assert set(blocks.doc_id) <= kept and (blocks.n_chars == blocks.text.str.len()).all()
    e = bpe.encoder(bpe.ranks())
    ids = corpus_pipeline.STAGES[4][1](spark, mixed, sf).toPandas()
    assert sorted(map(tuple, ids.ids)) == sorted(tuple(e.encode_ordinary(t)) for t in blocks.text)


def test_run_ends_with_the_encoded_blocks(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "source", "ids", "n_tokens"]
    total = out.count()
    assert total > 0 and out.where("n_tokens > 0").count() == total


def test_stages_on_empty_and_null_documents(spark, sf):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, "", "en", "s", 0)], schema)
    for frame in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, frame, sf).count()
    assert corpus_pipeline.drop_toxic(spark, rows, sf).count() == 3


def test_stages_on_odd_documents(spark, sf):
    """Repeated rows, very long texts, ties and further columns with clashing names go through every stage."""
    long = " ".join(f"word{i % 977} other{i % 613}." for i in range(40_000))
    rows = [(1, "A fine line of text, all in all.", "en", "s", 0), (1, "A fine line of text, all in all.", "en", "s", 0), (2, long, "en", "s", 0), (3, long, None, None, 0), (None, "No id, but text it has.", "fr", "t", 0), (4, "数据科学是一个跨学科的领域。" * 40, "zh", "t", 0)]
    docs = spark.createDataFrame([(*r, "x", "y", 1.0, "z") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string, group_id string, score double, ids string")
    assert corpus_pipeline.drop_toxic(spark, docs, sf).count() == 6
    once = corpus_pipeline.drop_copies(spark, docs, sf)
    assert once.columns == COLUMNS and sorted(r["doc_id"] or 0 for r in once.collect()) == [0, 1, 2, 4]
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == COLUMNS and mixed.count() > 300
    ids = corpus_pipeline.encode(spark, docs, sf)
    assert ids.count() == 6 and ids.columns == ["doc_id", "source", "ids", "n_tokens"]
    assert corpus_pipeline.keep_good(spark, docs, sf).columns == COLUMNS
