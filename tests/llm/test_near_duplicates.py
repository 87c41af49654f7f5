from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagelake.llm import components as C
from pagelake.llm import near_duplicates as N
from pagelake.llm import queries


def sets_of(texts, size=5):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        yield frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(docs):
    """docs: (doc_id, text). {doc_id: (n_shingles, component_id)}"""
    sets = list(sets_of([t for _, t in docs]))
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in index[g])
        for g in s:
            index[g].append(i)
        for j, o in shared.items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)}


def near_copies(seed=1, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for k in range(n):
        if k % 4 == 0 or not texts:
            t = [word() for _ in range(r.choice([1, 3, 4, 5, 6, 8, 20, 60, 150]))]
        else:
            t = r.choice(texts).split()
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = word()
            if r.random() < 0.2:
                t = t[: max(1, len(t) - r.randint(0, 6))]
        text = " ".join(t)
        texts.append(text + " " + passage if r.random() < 0.15 else text)
    return texts


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op10_prefix_tree_join(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs) and len(got) == len(docs)


@pytest.mark.parametrize("options", [{}, {"bucket_tokens": 100, "most_tokens": 600}, {"bucket_tokens": 100, "most_sets": 5, "hot_at": 3, "run": 100, "many": 2}, {"node_bits": 4, "hot_at": 8, "many": 2}])
def test_near_copies(spark, options):
    """The second and third settings cut groups into blocks, whose pairs meet, with hot digests; the last has sets that share a name's first half."""
    docs = list(enumerate([None, "", " \t", "A b C", "a B c", "x", *near_copies(), *near_copies(2)]))
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, **options).collect()}
    want = brute(docs)
    want.update({i: (0, i) for i in range(3)})
    assert got == want and len({c for _, c in got.values()}) < len(docs) - 40


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, "one two three four five six"), (5, "one two three four five six"), (5, "other words here they are not alike"), (None, "one two three four five six"), (None, "q"), (7, text), (8, text + " end"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (5, 3, 5), (None, 2, 5), (None, 1, None), (7, 29_996, 7), (8, 29_997, 7), (1, 0, 1)], key=str)
    assert N.near_duplicates(df.where("false")).collect() == []
    kept = N.one_of_each(df, N.near_duplicates(df)).collect()
    assert sorted(((r.doc_id, (r.text or "")[:5]) for r in kept), key=str) == sorted([(5, "one t"), (5, "other"), (None, "q"), (7, "w0 w1"), (1, "")], key=str)


@pytest.mark.parametrize("seed", range(5))
def test_trie_by_brute_force(seed):
    r = np.random.default_rng(seed)
    base = r.choice(200, 40, replace=False)
    sets = {tuple(sorted(set(np.where(r.random(40) < r.choice([0.0, 0.05, 0.3]), r.integers(0, 200, 40), base)[: r.integers(1, 41)].tolist()))) for _ in range(120)}
    sets = [np.array(s, dtype=np.int64) for s in sorted(sets)]
    trie, mask = N.Trie(sets), np.zeros(200, dtype=bool)
    for s in sets:
        want = [j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))]
        assert sorted(trie.query(s, mask, 75).tolist()) == want and not mask.any()


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    want = {}
    for a, b in edges:
        want.setdefault(a, {a}), want.setdefault(b, {b})
        if want[a] is not want[b]:
            joined = want[a] | want[b]
            want.update(dict.fromkeys(joined, joined))
    for few in (0, 60, 10**6):
        got = {x.node: x.root for x in C.components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert got == {x: min(s) for x, s in want.items() if len(s) > 1}
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_shingle_that_all_documents_have(spark):
    """It stays out of the buckets (hot), and a task posts a few intervals of it, not a row a document."""
    r = random.Random(9)
    say = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    common = next(x for x in (f"one common line of {k} " for k in range(99)) if next(N.sets_of(N.pa.array([x]), 5))[0] < N.REGION)
    docs = [(i, common + say(8)) for i in range(600)] + [(1000 + i, common * 5 + str(i % 3)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    shapes = N.written(N.shapes_of(df, "doc_id", "text", 5, 75, 64, 2000, 16), "shapes")
    hot = N.hot_digests(shapes, 10**4, 500)
    assert len(hot) == 1 and len(N.hot_digests(shapes, 10**12, 500)) == 0
    pairs = N.post(shapes, hot, 4, 10**6).toPandas()
    kept = [d for p in pairs[pairs.kind == N.PAIRS].payload for d in N.unpacked(N.pa.array([p]), ["u8", "i8"])[0]]
    assert hot[0] not in kept and (pairs.kind == N.HOT_PAIRS).sum() > 0
    for options in ({}, {"hot_at": 500, "run": 2000}, {"hot_at": 500, "run": 2000, "bucket_tokens": 200, "most_sets": 40}):
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(df, **options).collect()} == brute(docs)


def test_intervals_of_a_hot_digest():
    """A task's own nodes under a digest become one row if their sizes are close."""
    n_nodes, digest = 5000, 7
    node = np.arange(n_nodes, dtype=np.int64)
    pairs = list(N.deal(node, 1, [node, np.full(n_nodes, digest, np.uint64), np.full(n_nodes, N.HOT)], N.PAIRS))
    sized = list(N.deal(node, 1, [node, np.where(node % 2 == 0, 4, 100).astype(np.uint32), np.ones(n_nodes, np.uint32)], N.SIZED))
    out = N.batches_of(N.prefixes(N.batches_of([*pairs, *sized]), 1, 75))
    digests, _, least, most = N.gather(out, ["u8", "i8", "u4", "u4"], N.PAIRS)
    assert digests.tolist() == [digest] * 2 and sorted(zip(least, most, strict=True)) == [(4, 4), (100, 100)]
    found = N.candidates(out, 75)
    assert len(found) == n_nodes - 2


def test_rows_with_ids_and_columns_of_all_kinds(spark):
    text = "one two three four five six seven"
    rows = [(None, text, 1), (None, text + " eight", 2), (3, text, 3), (3, text + " eight", 4), (3, text, 3), (4, None, 5), (4, None, 5), (None, "", 6)]
    df = spark.createDataFrame(rows, "`a.b` long, text string, _id int").selectExpr("*", "77 AS _rank", "88 AS _hash", "99 AS _empty", "11 AS _text_hash", "12 AS component", "13 AS h_id", "14 AS `row`", "15 AS n", "16 AS node")
    found = N.near_duplicates(df, id_col="a.b")
    assert {(x["a.b"], x.component_id) for x in found.collect()} == {(None, 3), (3, 3), (4, 4), (None, None)}
    kept = N.one_of_each(df, found, id_col="a.b")
    assert kept.columns == df.columns
    got = sorted([(x["a.b"], x.text is None, x._rank, x._hash, x.h_id, x.row) for x in kept.collect()], key=str)
    assert got == sorted([(3, False, 77, 88, 13, 14), (4, True, 77, 88, 13, 14), (4, True, 77, 88, 13, 14), (None, False, 77, 88, 13, 14)], key=str)


def test_repeated_rows_of_null_ids_meet_in_no_product(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "concat('a b c d e f g h i j k l m n o p ', id % 3) as text")
    found = N.near_duplicates(df)
    assert found.count() == 3000 and found.where("component_id IS NOT NULL").count() == 0 and found.select("component").distinct().count() == 1
    assert N.one_of_each(df, found).count() == 1
