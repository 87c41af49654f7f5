"""The language stage rejects what has no letter and nothing else."""

from __future__ import annotations

import corpus_pipeline as P


def test_short_clean_texts_stay(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")  # the smaller tables lose none to a least score
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in P.keep_languages(spark, docs, sf).select("doc_id").collect()}
    assert {4616, 8352} <= kept
    assert kept == {r.doc_id for r in docs.select("doc_id", "text").collect() if any(c.isalpha() for c in r.text or "")}


def test_other_languages_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    others = ["今日はとても良い天気です", "今天天气很好", "Сегодня хорошая погода", "ऐ", "Ω", "x", "1 + 2 = 3", "。。。", None]
    more = spark.createDataFrame([(10_000_000 + i, t, None, "s", len(t or "")) for i, t in enumerate(others)], docs.schema)
    kept = [r.text for r in P.keep_languages(spark, docs.union(more), sf).where("doc_id >= 10000000").orderBy("doc_id").collect()]
    assert kept == others[:6]
