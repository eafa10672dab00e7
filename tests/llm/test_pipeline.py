"""The pipeline's stages against what they must keep."""

from __future__ import annotations

import corpus_pipeline
from quernstone.llm import langid, pii


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    first = corpus_pipeline.identified(spark, docs, sf)
    assert first.columns == names and first.count() >= 0.99 * docs.count()
    second = corpus_pipeline.deduplicated(spark, docs, sf)
    kept = second.count()
    assert second.columns == names and kept == second.select("doc_id").distinct().count() < docs.count()
    third = corpus_pipeline.redacted(spark, docs, sf)
    assert third.columns == names and all(pii.base_spans(r["text"]) == [] for r in third.select("text").collect())
    fourth = corpus_pipeline.mixed(spark, docs, sf)
    assert fourth.columns == names and fourth.count() > 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_rejects_text_without_letters(spark):
    rows = [(1, "12 34", "en", "s", 5), (2, "the of and with that this which", "en", "s", 5)] + [(i, "und der die das nicht mit auf", "de", "s", 5) for i in range(3, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert 1 not in {r["doc_id"] for r in corpus_pipeline.identified(spark, df, "").collect()}
    assert not langid.has_letter("12 34")


def test_repeated_and_null_ids_lose_no_document(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(7, words(0)), (7, words(1)), (7, words(1)), (None, words(2)), (None, words(3)), (None, words(3) + " end"), (1, words(1) + " end"), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.deduplicated(spark, docs, "").collect()]
    assert len(left) == 5 and {(7, words(0)), (None, words(2)), (1, words(1) + " end"), (8, "")} <= set(left)
    assert len({words(3), words(3) + " end"} & {t for _, t in left}) == 1
