from __future__ import annotations

import hashlib
import random
import re

import pytest

from pagelake.llm import decontamination as D
from pagelake.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= got
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def rows(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows(queries.op9_decontamination(spark, sf))
    assert got == brute([r.text for r in docs], items) and any(r[4] for r in got)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_edges(spark, block_bytes):
    r = random.Random(5)
    vocabulary = ["a", "b", "Ç", "été", "x1", "日本"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate((0, 1, 2, 3, 9, 10, 11, 15, 12))] + [(50, None), (7, "b b b b b b b b b b"), (60, "a-b!a"), (None, "x")]
    texts = [None, "", "!!", "A", "b--B", *(say(r.randint(1, 60)) for _ in range(40)), items[7][1].upper() + " " + items[8][1], items[6][1] * 2, say(40_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, hits int")
    bench = spark.createDataFrame(items, "item_id int, text string")
    known = [(i, t) for i, t in items if i is not None]
    assert rows(D.decontaminate(docs, bench, block_bytes=block_bytes)) == brute(texts, known)
    assert rows(D.decontaminate(docs, bench, block_bytes=block_bytes, window=3)) == brute(texts, known, 3)
    assert all(r[:3] == (len(words(t)), 0, 0) for r, t in zip(rows(D.decontaminate(docs, bench.where("false"))), texts, strict=True))
    assert D.decontaminate(docs.where("false"), bench).collect() == []
    assert D.decontaminate(docs.union(docs), bench).count() == 2 * len(texts)


def test_one_function_for_a_large_benchmark(spark):
    r = random.Random(3)
    items = [(i, " ".join(f"w{r.randint(0, 300)}" for _ in range(200))) for i in range(3000)]  # 2.9 MB
    bench = spark.createDataFrame(items, "item_id int, text string")
    texts = [" ".join(f"w{r.randint(0, 300)}" for _ in range(300)) for _ in range(20)] + [t[50:300] for _, t in items[::300]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    real, calls = type(docs).mapInArrow, []
    type(docs).mapInArrow = lambda *a, **k: calls.append(1) or real(*a, **k)
    try:
        got = rows(D.decontaminate(docs, bench))
    finally:
        type(docs).mapInArrow = real
    assert len(calls) == 1 and got == brute(texts, items) and sum(x[4] for x in got) == 10


def test_collisions_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(D.zlib, "crc32", lambda x, seed=0: 1 << 31)  # every block and prefix falls to one place: only comparisons tell patterns
    tables = D.Patterns(3)
    tables.add([b"a", b"b", b"c", b"d"], 0)
    assert list(tables.close().search([b"x", b"b", b"c", b"d", b"a", b"b", b"c"])) == [(1, 0), (4, 0)]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x y", 2, 3, 4)], "`a.b` int, text string, id int, hits int, items int")
    bench = spark.createDataFrame([(1, "x y", 5)], "item_id int, text string, item int")
    assert [tuple(r) for r in D.decontaminate(docs, bench, id_col="a.b").select("`a.b`", "n_hit").collect()] == [(1, 2)]


def test_blocks_are_built_by_tasks(spark):
    r = random.Random(4)
    items = [(i, " ".join(f"w{r.randint(0, 40)}" for _ in range(60))) for i in range(200)]
    bench = spark.createDataFrame(items + items[:50], "item_id int, text string")
    clean = [" ".join(f"v{r.randint(0, 40)}" for _ in range(80)) for _ in range(150)]
    spread = [items[i][1][:90] + " - " + items[(i * 7) % 200][1][20:] for i in range(40)]  # passages of items of several blocks
    texts = clean + spread + [spread[3]] * 200 + [None, ""] * 10
    schema = "doc_id int, text string, `meta` struct<`a-b c`:int>"
    docs = spark.createDataFrame([(i, t, (i,)) for i, t in enumerate(texts)], schema)
    with D.scratch(spark):
        assert len(D.built(bench, 10, 1000)) > 2 * D.PASSES // 3
    want = brute(texts, items)
    for block_bytes in (700, 4000):  # some 60 and some 12 passes
        found = D.decontaminate(docs, bench, block_bytes=block_bytes, spans=True, keep_text=True)
        got = sorted(found.collect(), key=lambda x: x.doc_id)
        assert [(x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in got] == want
        assert [x.text for x in got] == texts and all(x.items == sorted(x.items) for x in got)
        assert all(sum(b - a for a, b in zip(x.hits[::2], x.hits[1::2], strict=True)) == x.n_hit and x.hits == sorted(set(x.hits)) for x in got)
    boxed = D.decontaminate(docs, bench, id_col="meta", block_bytes=4000).collect()  # ids of any type
    assert sorted((x["meta"][0], x.n_hit) for x in boxed) == [(i, w[1]) for i, w in enumerate(want)]


def test_nothing_of_the_benchmark_on_the_driver(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j"), (2, "x")], "doc_id int, text string")
    for name in ("toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(type(bench), name, lambda *a, **k: pytest.fail("the driver reads rows"))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: pytest.fail("a broadcast"))
    assert rows(D.decontaminate(docs, bench)) == brute(["x a b c d e f g h i j", "x"], [(1, "a b c d e f g h i j k")])
