from __future__ import annotations

import zlib

import numpy as np
import pytest

from pagelake.llm import language_id as L
from pagelake.llm import queries


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    lang = dict(docs.itertuples(index=False))
    got = {r.doc_id: r for r in queries.op4_language_id(spark, sf).collect()}
    assert got.keys() == lang.keys() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == lang[i] for i in held) >= 0.97 * len(held)


def plain_vector(text):
    base = np.random.default_rng(L.SEED).integers(0, 2, (L.SYMBOLS, L.DIM), dtype=np.int8) * 2 - 1
    held = [0]
    for c in text.lower():
        s = 1 + ord(c) % (L.SYMBOLS - 1) if c.isalpha() else 0
        if s or held[-1]:
            held.append(s)
    held += [0] if held[-1] else []
    return sum((np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]).astype(float) for a, b, c in zip(held, held[1:], held[2:], strict=False))


def test_predictions_by_brute_force(spark):
    rows = [(0, "the cat and the hat", "en"), (1, "the dog and a log", "en"), (2, "le chat et le chapeau", "fr"), (3, "le chien et la forêt", "fr"), (4, "der Hund und die Katze", None), (7, "l'été", "fr")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    langs, matrix = L.prototypes(df)
    assert langs == ["en", "fr"]
    sums = {x: sum(plain_vector(t) for _, t, y in rows if y == x) for x in langs}
    for k, x in enumerate(langs):
        assert np.allclose(matrix[k], sums[x] / np.linalg.norm(sums[x]), atol=1e-5)
    for r, (_, text, _) in zip(L.identify(df, langs, matrix, keep=["doc_id"]).orderBy("doc_id").collect(), rows, strict=True):
        v = plain_vector(text)
        cosines = [v @ sums[x] / np.linalg.norm(v) / np.linalg.norm(sums[x]) for x in langs]
        assert r.lang_pred == langs[int(np.argmax(cosines))] and abs(r.score - max(0, max(cosines))) < 1e-4


def test_edges(spark):
    texts = [None, "", "123 !!", "x", "日本", "the cat" * 30_000, "the cat", "the cat"]
    df = spark.createDataFrame([(i, t, "en", 0.5) for i, t in enumerate(texts)] + [(None, "the", "en", 0.5)], "doc_id int, text string, lang string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.language_id(df).collect()}
    assert [got[i][0] for i in range(8)] == ["und", "und", "und", "en", "en", "en", "en", "en"] and got[0][1] == got[2][1] == 0.0
    assert L.language_id(df.where("false")).collect() == []
    assert all(r.lang_pred == "und" for r in L.language_id(df.withColumn("lang", df.lang.substr(9, 1)).na.replace("", None, ["lang"])).collect())


def test_many_trigrams_in_one_text(monkeypatch):
    monkeypatch.setattr(L, "MOST_VECTORS", 40)
    bound = L.Vectors(64)
    keys, counts = L.trigrams("abcdefghijklmnopqrstuvwxyz" * 2 + "zyxwvutsrqponmlkjihgfedcba")
    whole = bound.bundle(keys, counts)
    monkeypatch.setattr(L, "MOST_VECTORS", 4000)
    assert np.array_equal(whole, L.Vectors(64).bundle(keys, counts)) and len(keys) > 40


def test_one_job_collects_the_prototypes(spark):
    df = spark.range(300, numPartitions=12).selectExpr("id as doc_id", "concat('words of a text ', id) as text", "concat('l', id % 3) as lang")
    plan = []
    real = type(df).toLocalIterator
    type(df).toLocalIterator = lambda *a, **k: plan.append(1) or real(*a, **k)
    try:
        langs, matrix = L.prototypes(df)
    finally:
        type(df).toLocalIterator = real
    assert langs == ["l0", "l1", "l2"] and matrix.shape == (3, L.DIM) and not plan


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2)
    df = spark.range(3).selectExpr("id as doc_id", "'text' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError, match="more than 2 languages"):
        L.prototypes(df)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, "the cat and the hat", "en", 1, 2, 3) for i in range(9)], "`a.b` int, text string, lang string, held_out int, _text int, lang_pred int")
    got = L.language_id(df, id_col="a.b")
    assert got.columns == ["a.b", "held_out", "lang_pred", "score"] and {r.lang_pred for r in got.collect()} == {"en"}
