from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from pagelake.llm import filter_audit as A
from pagelake.llm import queries
from pagelake.llm.common import with_found, written

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Every order, step by step, over all documents (id, text, part); labels: (id, quality, toxic)."""
    good, toxic = ({row[0] for row in labels if row[0] is not None and row[i] == 1} for i in (1, 2))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    by_part = defaultdict(list)
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and least[text] < i}
        by_part[part or ""].append((i, fails))
    out = {}
    for part, rows in by_part.items():
        share = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left, gone = list(rows), []
            for step, f in enumerate(order, 1):
                lost = [r for r in left if r[1][f]]
                out[part, order, step] = [
                    len(left) - len(lost), len(lost), sum(r[1][f] for r in gone), sum(sum(r[1].values()) == 1 and r[1][f] for r in rows), sum(r[0] in good for r in lost), sum(r[0] in toxic for r in lost),
                ]
                share[f] += len(lost)
                left, gone = [r for r in left if not r[1][f]], gone + lost
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def shown(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    df = queries.op11_filter_audit(spark, sf)
    assert dict(df.dtypes) == {c: "string" if c in ("part", "filter_order") else "int" if c == "step" else "bigint" for c in COLUMNS}
    assert shown(df) == brute(docs, labels)


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (1, None, None), (2, "", ""), (3, "", "en"), (4, LONG, "en"), (5, LONG, "fr"), (5, LONG, "fr"), (None, LONG, "en"), (None, None, None), (6, "a " * 300, "en"), (7, "ABC " * 300, "de"),
    (8, LONG + " #", "de"), (9, "50% & more", None), (10, LONG + "ÉÉ x\x1cy", "fr"), (11, " \t\r\n\x0b\x0c", "en"), (12, LONG.upper() + " | " + LONG, "fr"), (-3, LONG, "en"),
]
LABELS = [(3, 1, 0), (4, 1, None), (4, 0, 1), (5, None, 1), (None, 1, 1), (8, 1, 1), (99, 1, 1), (12, 1, 0), (12, 1, 0)]


def test_edges(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").select("*", F.lit(1).alias("n"), F.lit("x").alias("digest"), F.struct(F.lit(1).alias("a b")).alias("part"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1))
    assert shown(A.audited(docs, labels)) == brute(DOCS, LABELS)
    assert A.audited(docs.where("false"), labels).count() == 0
    assert shown(A.audited(docs, labels.where("false"))) == brute(DOCS, [])


def test_random_bitmaps():
    """Chunks of any size: the sums of bitmaps are the counts of rows."""
    rng = np.random.default_rng(5)
    for n, n_parts in ((1, 1), (64, 1), (65, 3), (5000, 700)):
        parts = rng.integers(0, n_parts, n)
        parts[:n_parts] = np.arange(n_parts)[:n]
        fails, marks = rng.integers(0, 32, n), [rng.random(n) < 0.3 for _ in range(2)]
        found = A.Bitmaps(parts, n_parts, fails, marks, 5).counts()
        for part in {0, n_parts - 1}:
            for mask in (0, 1, 6, 31):
                left = (parts == part) & (fails & mask == 0)
                assert found[part, mask].tolist() == [left.sum(), *(int((left & m).sum()) for m in marks)]


def test_many_parts_and_chunks(spark, monkeypatch):
    rows = spark.range(3000).select(F.concat(F.lit("p"), F.col("id") % 40).alias("part"), (F.col("id") * 7 % 32).cast("int").alias("fails"), (F.col("id") % 3 == 0).alias("good"), (F.col("id") % 5 == 0).alias("toxic"))
    found = {(r.part, r.subset): (r.n, r.good, r.toxic) for r in A.subset_counts(rows).collect()}
    assert len(found) == 40 * 32 and sum(v[0] for (p, s), v in found.items() if s == 0) == 3000
    kept = rows.where("fails & 5 = 0 AND part = 'p3'").agg(F.count(F.lit(1)), F.count_if("good"), F.count_if("toxic")).first()
    assert found["p3", 5] == tuple(kept)


def test_long_texts():
    text = b"ab\n" * 1_500_000 + b"\x0b" * 10 + b"cd" * 2_000_000
    assert A.word_counts(text) == (1_500_001, 2) == (len(text.split()), len(set(text.split())))


def test_hot_keys_are_broadcast(spark):
    """Every row finds its key's row, hot or not; null keys find none."""
    rows = written(spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 1001 != 0, F.col("id")).alias("k")), "rows")
    found = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")), "found")
    got = {r.id: (r.k, r.top) for r in with_found(rows, ["k"], found, "n").collect()}
    assert len(got) == 3000
    assert all(got[i] == ((0, 2998) if i % 2 == 0 else (i, i) if i % 1001 else (None, None)) for i in range(3000))
