"""Texts are cut at every sentence end, by a reference that walks the characters and shares no pattern with the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.llm import fingerprints as P
from pagelake.llm import queries


def sentences(text):
    out, at = [], 0
    for i, c in enumerate(text):
        before = text[:i].rstrip("\"'»’”)]")[-1:] if c == " " else ""
        if c == "\n" or before and before in ".!?…" and i - len(text[:i].rstrip("\"'»’”)]")) <= 2:
            out.append(text[at:i])
            at = i
    return {x.strip(" \n") for x in [*out, text[at:]] if x.strip(" \n")}


def jaccard(a, b):
    a, b = sentences(a), sentences(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_every_sentence_end(spark):
    texts = {
        "One ends. Two ends! Three bids? Four fell.  Five": ["One ends.", "Two ends!", "Three bids?", "Four fell.", "Five"],
        'He said "Stop." Then (he left.) It\'s 3.5 or a.b': ['He said "Stop."', "Then (he left.)", "It's 3.5 or a.b"],
        "今日は。明日！「そう。」次": ["今日は。", "明日！", "「そう。」", "次"],
        "यह है। वह\nline. \n\n": ["यह है।", "वह", "line."],
    }
    df = spark.createDataFrame(list(texts.items()), "text string, parts array<string>")
    want = F.expr("array_sort(transform(parts, p -> xxhash64(p)))")
    assert df.where(F.expr(P.digests("text")) == want).count() == len(texts)


def test_query_by_every_sentence(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy(F.col("doc_id").desc()).collect()]
    got = {r.doc_id: r for r in queries.op6_fingerprints(spark, sf).collect()}
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert abs(got[i].near_edited - jaccard(text, edited)) < 1e-9 and abs(got[i].near_next - jaccard(text, following)) < 1e-9, i
        if len(sentences(text)) > 6:  # two thirds of it are the same
            assert got[i].near_edited > got[i].near_next or text == following, i
