from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from pagelake.llm import fingerprints as P
from pagelake.llm import queries


def parts(text):
    """Sentences, by walking the characters."""
    out, at = [], 0
    for i, c in enumerate(text):
        before = text[max(0, i - 3) : i].rstrip("\"'»’”)]") if c == " " else ""
        if c == "\n" or before and before[-1] in ".!?…" and min(i, 3) - len(before) <= 2:
            out.append(text[at:i])
            at = i
    return {x.strip(" \n") for x in [*out, text[at:]] if x.strip(" \n")}


def jaccard(a, b):
    a, b = parts(a), parts(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(docs, got):
    """docs: (doc_id, text) in the order of ids, descending; got: rows by id."""
    prints = {}
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()), i
        assert abs(r.near_edited - jaccard(text, edited)) < 1e-9 and abs(r.near_next - jaccard(text, following)) < 1e-9, i
        for t, p in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(frozenset(parts(t)), p) == p and len(p) == 224
    return prints


def test_query(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy(F.col("doc_id").desc()).collect()]
    prints = check(docs, {r.doc_id: r for r in queries.op6_fingerprints(spark, sf).collect()})
    assert len(set(prints.values())) == len(prints)


def test_edges_over_many_blocks(spark):
    texts = [None, "", "\n\n", "one", "one\ntwo", "x" * 5000, "\n".join(f"line {i}" for i in range(900)), "é😀\n" * 7, "same", "same"] * 3
    rows = [(i * 7 % 31, t, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keys string")
    base = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [r.text for r in sorted(base.collect(), key=lambda r: -r.doc_id)]
    for block in (1, 4, 1000):
        got = sorted(P.next_of(base, "doc_id", ["text"], block_rows=block).collect(), key=lambda r: -r.doc_id)
        assert [r.next_text for r in got] == [*order[1:], order[0]]
    check([(i, t or "") for i, t, _ in sorted(rows, reverse=True, key=lambda r: r[0])], {r.doc_id: r for r in P.fingerprints(df).collect()})
    assert P.fingerprints(df.where("false")).collect() == []
    lone = P.fingerprints(df.where("doc_id = 0")).first()
    assert lone.near_next == 1.0


def test_repeated_and_null_ids(spark):
    rows = [(None, "a"), (None, "b"), (None, "a"), (3, "c"), (3, "c"), (3, "d"), (1, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    for block in (1, 3, 1000):
        got = P.next_of(df, "doc_id", ["text", "h"], block_rows=block).collect()
        assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got if r.doc_id) == sorted((False, i, t) for i, t in rows if i)
        key = lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h)
        ordered = sorted(got, key=key)
        assert sorted((r.text, r.next_text) for r in got) == sorted((a.text, b.text) for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True))
    h = {r.text: r.h for r in df.collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))]
    want = sorted((t, hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest(), jaccard(t, n)) for t, n in zip(order, [*order[1:], order[0]], strict=True))
    got = P.fingerprints(df.drop("h")).collect()
    text = {hashlib.sha256(t.encode()).hexdigest(): t for t in "abcde"}
    assert sorted((text[r.edited_sha256], r.edited_sha256, r.near_next) for r in got) == want


def test_many_repeated_rows_are_combined(spark):
    df = spark.range(3000).selectExpr("if(id % 10 = 0, id, 7L) as doc_id", "if(id % 10 = 0, concat('row ', id), 'the same') as text")
    once = P.once_each(df.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("h")))
    assert once.count() == 301 and once.agg({"n": "sum"}).first()[0] == 3000
    got = P.fingerprints(df).collect()
    assert len(got) == 3000 and sum(r.near_next == 1.0 for r in got if r.doc_id == 7) == 2699


@pytest.mark.parametrize("cells", [{}, {"least_cells": 4, "cells_each": 0}])
def test_differences_are_recovered(spark, cells):
    """Any two sets: the digests peeled out are the symmetric difference, side by side. Also where the first tables are far too small."""
    rows = [(list(range(a)), list(range(b, c))) for a, b, c in ((0, 0, 0), (5, 0, 5), (30, 1, 33), (3, 100, 104), (400, 200, 900), (2000, 5, 2001), (1, 0, 0))]
    df = spark.createDataFrame([(i, "x", a, b) for i, (a, b) in enumerate(rows)], "rid long, w string, a array<long>, b array<long>")
    df = df.select("rid", "w", *(F.expr(f"transform({x}, i -> xxhash64(i))").alias(x) for x in "ab"))
    got = {r.rid: r for r in P.differences(df, **cells).collect()}
    for r in df.collect():
        d = got[r.rid]
        assert set(d.plus) == set(r.a) - set(r.b) and set(d.minus) == set(r.b) - set(r.a) and len(d.plus) + len(d.minus) == len(set(r.a) ^ set(r.b))
    cells = df.select("rid", "a", "b", F.expr(P.sketch("a")).alias("ac"), F.expr(P.sketch("b")).alias("bc")).select("a", "b", P.first_try("ac", "bc").alias("d")).collect()
    assert all(r.d is None or r.d == len(set(r.a) ^ set(r.b)) for r in cells) and [r.d is not None for r in cells[:2]] == [True, True]
    larger = df.select("a", "b", P.larger_try("sort_array(a)", "sort_array(b)").alias("x")).select("a", "b", "x.*").collect()
    assert all(r.d == len(set(r.a) ^ set(r.b)) and r.d < 2 * r.m for r in larger)
    assert sorted({r.m for r in larger}) == [48, 192, 3072, 12288] or all(r.m in (48, 192, 768, 3072, 12288) for r in larger)


def test_sketches_grow_until_they_peel(spark, sf):
    """Most edited pairs need few cells; sizes are those of the series, and a pair's size isn't far beyond what it needs."""
    rows = P.fingerprints(spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")).collect()
    sizes = [12 * 4**p for p in range(P.ROW_SIZES + 1)]
    assert {r.cells_edited for r in rows} | {r.cells_next for r in rows} <= set(sizes)
    assert sum(r.cells_edited <= 768 for r in rows) > 0.9 * len(rows)
    assert len({r.cells_next for r in rows}) >= 4


def test_stuck_pairs_move_on(spark, monkeypatch):
    """With a guess that is always too small, every size is tried in turn; what no row's sketch tells goes to the joins."""
    texts = [(k, "\n".join(f"line {k} {i}" for i in range(40 * k))) for k in range(1, 6)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted((r.doc_id, r.near_edited, r.near_next) for r in P.fingerprints(df).collect())
    monkeypatch.setattr(P, "guess", lambda a, b: "0D")
    assert sorted((r.doc_id, r.near_edited, r.near_next) for r in P.fingerprints(df).collect()) == want
    monkeypatch.setattr(P, "ROW_SIZES", 1)
    rows = P.fingerprints(df).collect()
    assert sorted((r.doc_id, r.near_edited, r.near_next) for r in rows) == want and max(r.cells_next for r in rows) > 48


def test_time_grows_as_the_paragraphs(spark):
    """Two documents that share nothing: twice the paragraphs take about twice the time."""
    took = {}
    for n in (4000, 4000, 8000, 16_000):
        text = lambda k: "\n".join(f"paragraph {k} {i}" for i in range(n))  # noqa: B023, E731
        df = spark.createDataFrame([(1, text(1)), (2, text(2))], "doc_id long, text string")
        began = time.perf_counter()
        rows = P.fingerprints(df).collect()
        took[n] = time.perf_counter() - began
        assert [r.near_next for r in rows] == [0.0, 0.0]
    assert took[16_000] < 3 * took[8000] and took[16_000] < 5 * took[4000]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b. c d", 2, 3, 4, 5)], "`a.b` long, text string, id int, h int, n int, keys int")
    assert P.fingerprints(df, id_col="a.b").columns[0] == "a.b" and P.fingerprints(df, id_col="a.b").first().near_next == 1.0
