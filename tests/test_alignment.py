"""Passages of whole-document truths, and edit distances of long texts."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pagelake.functions import distance as D
from pagelake.functions import text as X
from pagelake.operators import evaluate
from pagelake.operators.alignment import chained, passages
from pagelake.sources.dimensions import anchors


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def longest_chain(matches):
    """By trying every pair: (length, first pair, last pair) of the longest increasing chain; of several the one that ends first."""
    best = []
    for i, (p, t) in enumerate(matches):
        own = (1, -t, (p, t), (p, t))
        for j in range(i):
            if matches[j][1] < t and (best[j][0] + 1, best[j][1]) > (own[0], own[4] if len(own) > 4 else float("-inf")):
                own = (best[j][0] + 1, -t, best[j][2], (p, t), best[j][1])
        best.append(own)
    top = max(best, key=lambda x: x[:2], default=None)
    return (top[0], *top[2], *top[3]) if top else (0, 0, 0, 0, 0)


def test_chains():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 12)
        places = rng.sample(range(20), n)
        matches = list(zip(sorted(rng.sample(range(20), n)), places, strict=True))
        assert chained(matches) == longest_chain(matches)


def brute(page, truth, n=3):
    """(passage, matches) of a page in a truth, by dictionaries of n-grams."""
    def grams(words):
        at = {}
        for i in range(len(words) - n + 1):
            at.setdefault(" ".join(w.strip().lower() for w in words[i : i + n]), []).append(i)
        return {g: v[0] for g, v in at.items() if len(v) == 1}

    p, t = (re.findall(r"\s*\S+", x or "") for x in (page, truth))
    own, other = grams(p), grams(t)
    k, page_first, first, page_last, last = longest_chain(sorted((i, other[g]) for g, i in own.items() if g in other))
    return ("".join(t[max(first - page_first, 0) : min(last + len(p) - page_last, len(t))]) if k else "", k)


def made(rng, n):
    return "".join(rng.choice(["the", "a", "of", "sun", "moon", "Star", "é", "x1", "| cell |"]) + rng.choice([" ", " ", "\n", "\t "]) for _ in range(n))


def test_passages(spark):
    rng = random.Random(4)
    docs, rows = {}, []
    for d in range(12):
        parts = [made(rng, rng.randint(0, 60)) for _ in range(rng.randint(1, 6))]
        docs[f"d{d}"] = "".join(parts)
        for i, part in enumerate(parts, 1):
            words = part.split(" ")
            noisy = " ".join(w if rng.random() > 0.1 else "noise" for w in words)
            rows.append((f"d{d}", i, rng.choice([noisy, part, "Head " + part, part[len(part) // 2 :] + part[: len(part) // 2], None])))
    rows += [("d1", 99, rows[3][2]), ("d1", 99, rows[3][2]), ("none", 1, "no truth"), ("d0", 98, "two words"), ("d0", 97, "")]
    truth = spark.createDataFrame([*docs.items(), ("d1", "another truth of the same stem sun moon star")], "stem string, gt string")
    pages = spark.createDataFrame(rows, "stem string, page_num int, markdown string").select("*", F.lit(1).alias("gram"), F.lit(2).alias("n"))
    got = sorted((r.stem, r.page_num, r.markdown or "", r.passage, r.matches) for r in passages(pages, truth).collect())
    want = [(s, i, m or "", *brute(m, t)) for s, i, m in rows if s in docs for t in ([docs[s], "another truth of the same stem sun moon star"] if s == "d1" else [docs[s]])]
    assert got == sorted(want)
    assert passages(pages.where("false"), truth).count() == 0 and passages(pages, truth.where("false")).count() == 0


def test_pages_of_a_whole_truth_score_well(spark):
    """Two pages and one truth for both: against the passage no page lacks the other's text."""
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 400)}" for _ in range(600)]
    halves = [" ".join(words[:300]), " ".join(words[300:])]
    silver = spark.createDataFrame([("a.pdf", i, t) for i, t in enumerate(halves, 1)], "filename string, page_num int, markdown string")
    truth = spark.createDataFrame([("a", None, halves[0] + "\n" + halves[1])], "stem string, page_num int, gt string")
    none = anchors(spark, {"none": []})
    assert all(r.edit_distance > 0.45 for r in evaluate.score_pages(silver, truth, none).collect())
    rows = evaluate.score_passages(silver, truth, none).collect()
    assert len(rows) == 2 and all(r.edit_distance < 0.02 and r.matches > 100 for r in rows)


def test_no_page_gets_the_whole_truth(spark):
    """The truth's words are cut right after the join: no exchange above it carries them."""
    pages = spark.createDataFrame([("a", 1, "x y z")], "stem string, page_num int, markdown string")
    truth = spark.createDataFrame([("a", "x y z w")], "stem string, gt string")
    plan = passages(pages, truth)._jdf.queryExecution().executedPlan().toString()
    top = plan.split("== Initial Plan ==")[-1].split("Join")[0]
    assert "Exchange" not in top


PAIRS = [("", ""), ("a", ""), (None, "a"), ("a", None), ("same", "same"), ("kitten", "sitting"), ("é😀", "😀é"), ("ab" * 3000, "ab" * 3000), ("ab" * 3000, "ab" * 2990 + "x" * 7), ("x" + "ab" * 2500, "ab" * 2500 + "y")]


def test_edit_distance(spark):
    rng = random.Random(2)
    pairs = list(PAIRS)
    for n in (1500, 2100, 2600, 3000):
        a = "".join(rng.choice("abcé") for _ in range(n))
        for edits in (1, 30, 90, 700):
            b = list(a)
            for _ in range(edits):
                at = rng.randrange(len(b))
                b[at : at + rng.randint(0, 2)] = rng.choice(["", "q", "zz"])
            pairs.append((a, "".join(b)))
        pairs.append((a, "".join(rng.choice("abcé") for _ in range(n - 5))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", X.edit_distance("a", "b").alias("d"), D.edit_distance("a", "b").alias("e"), F.levenshtein("a", "b").alias("plain")).collect():
        assert r.d == r.plain == r.e
    small = [p for p in pairs if p[0] is not None and p[1] is not None and len(p[0]) < 50]
    got = spark.createDataFrame(small, "a string, b string").select(X.edit_distance("a", "b")).collect()
    assert [r[0] for r in got] == [levenshtein(*p) for p in small]


def test_edit_distance_of_conversations(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("a"))
    rows = rows.withColumn("b", F.regexp_replace("a", "on", "")).withColumn("c", F.reverse("a"))
    for f in (X.edit_distance, D.edit_distance):
        for other in ("b", "c"):
            assert rows.select(F.count_if(~f("a", other).eqNullSafe(F.levenshtein("a", other)))).first()[0] == 0


def test_diagonals():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab😀") for _ in range(rng.randint(0, 14))) for _ in range(2))
        d = levenshtein(a, b)
        assert D.distance(a, b, 20) == d and D.distance(a, b, d) == d and (d == 0 or D.distance(a, b, d - 1) == -1)


@pytest.mark.parametrize("edits", [0, 3, 60, 900])
def test_near_equal_long_texts_take_seconds(spark, edits):
    rng = random.Random(edits)
    a = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    b = list(a)
    for _ in range(edits):
        b[rng.randrange(len(b))] = "#"
    df = spark.createDataFrame([(a, "".join(b))], "a string, b string")
    began = time.perf_counter()
    assert df.select(D.edit_distance("a", "b")).first()[0] == sum(x == "#" for x in b)
    assert time.perf_counter() - began < 20


def test_the_class_reads_truths_of_either_kind(spark, tmp_path):
    """Pages, passages and whole documents, by flat Markdown files and by folders that Spark wrote."""
    from pagelake.sources.dimensions import ground_truth_folders, write_ground_truth

    rng = random.Random(5)
    words = [f"w{rng.randint(0, 300)}" for _ in range(200)]
    halves = [" ".join(words[:100]), " ".join(words[100:])]
    silver = spark.createDataFrame([("a.pdf", i, t) for i, t in enumerate(halves, 1)] + [("b.pdf", 1, "no truth")], "filename string, page_num int, markdown string")
    truth = spark.createDataFrame([("a", None, " ".join(halves)), ("a", 2, "quite another text\nof two lines\n"), ("c", 1, ""), ("d", 1, None)], "stem string, page_num int, gt string")
    write_ground_truth(truth, str(tmp_path / "folders"))
    (tmp_path / "folders" / "stem=a" / "page_num=2" / "notes.txt").write_text("left out by its name")
    read = sorted((r.stem, r.page_num or 0, r.gt) for r in ground_truth_folders(spark, str(tmp_path / "folders")).collect())
    assert read == [("a", 0, " ".join(halves)), ("a", 2, "quite another text\nof two lines\n"), ("c", 1, ""), ("d", 1, "")]
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "a.md").write_text(" ".join(halves))
    (tmp_path / "flat" / "a_p2.md").write_text("quite another text\nof two lines\n")
    for folder, folders in (("folders", True), ("flat", False)):
        score = lambda by: evaluate.Evaluator(tmp_path / folder, {"a": [words[0]]}, folders, by).score_df(silver)  # noqa: B023, E731
        assert score("page")["n_pages_scored"] == 2 and score("page")["edit_distance"] > 0.4
        assert score("passage")["n_pages_scored"] == 2 and score("passage")["edit_distance"] == 0.0
        assert score("document")["n_pages_scored"] == 1 and score("document")["edit_distance"] == 0.0
    with pytest.raises(ValueError):
        evaluate.Evaluator("x", by="line")
