"""What keeps the engine's queries in proportion to their tables: files, waves, truths, distances."""

from __future__ import annotations

import os
import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelake.functions import distance
from pagelake.operators import alignment, budget, evaluate
from pagelake.plans import queries as core
from pagelake.sources import dimensions, documents
from pagelake.sources.files import write_files


def test_a_file_each_in_few_folders(spark, sf):
    """No folder, checksum file or commit for each document, and a scan in no more tasks than asked for."""
    folder = core.text_files(spark, sf).removeprefix("file://")
    found = [(at, name) for at, _, names in os.walk(folder) for name in names]
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(found) == n and all(name.endswith(".txt") for _, name in found) and len({at for at, _ in found}) < n
    docs = documents.scan_documents(spark, folder, "*.txt", tasks=3)
    assert docs.rdd.getNumPartitions() <= 3 and docs.count() == n


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """The driver's plan names no file, and the rows are those of Spark's own scan: hidden and empty files aside, odd names, nested folders, patterns, bounds on size and time."""
    names = ["a.txt", "b c%20.txt", "é+.txt", "x/d.txt", "x/y/z/e.txt", "x/y/z/f.pdf", "p=1/_q=2.txt", "_hidden/g.txt", ".h.txt", "x/_i.txt", "empty.txt", "k.TXT", "x/l.txt._COPYING_", "nl\n.txt"]
    for i, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "empty.txt" else b"\xff" * (i + 1))
    os.utime(tmp_path / "a.txt", (10**9, 10**9))
    for kw in ({"glob": "*.txt"}, {"glob": "*"}, {"glob": "[a-f]*.{txt,pdf}"}, {"glob": "?.txt", "min_bytes": 2, "max_bytes": 5}, {"glob": "*", "modified_after": "2020-01-01T00:00:00"}, {"glob": "no"}):
        for tasks in (1, 3):
            docs = documents.scan_documents(spark, str(tmp_path), **kw, tasks=tasks)
            assert "binaryFile" not in docs._jdf.queryExecution().toString()
            assert sorted(docs.collect()) == sorted(documents.scan_documents(spark, str(tmp_path), **kw).collect()), kw
            assert docs.schema == documents.scan_documents(spark, str(tmp_path), **kw).schema
    a, b = (documents.list_documents(spark, f"file://{tmp_path}/", "*.txt", t) for t in (2, None))
    assert "binaryFile" not in a._jdf.queryExecution().toString() and sorted(a.collect()) == sorted(b.collect())
    # what isn't one folder is Spark's
    assert documents.scan_documents(spark, f"{tmp_path}/x/*", "*.txt", tasks=2).count() == documents.scan_documents(spark, f"{tmp_path}/x/*", "*.txt").count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        documents.scan_documents(spark, f"{tmp_path}/none", tasks=2)


def test_scans_of_text_files_name_no_file_in_their_plan(spark, sf, tmp_path):
    """Half a million files in the driver's listing and tasks ended its process."""
    for name in ("binary_scan", "list_files", "binary_pages"):
        assert "binaryFile" not in core.QUERIES[name](spark, sf)._jdf.queryExecution().toString(), name
    folder = core.text_files(spark, sf)
    pages = core.OCRPipeline("mock", "m", folder, str(tmp_path / "lake"), pages="text").pages(spark)
    assert "binaryFile" not in pages._jdf.queryExecution().toString()
    assert pages.select("path").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_files_hold_their_bodies(spark, tmp_path):
    bodies = {"a/x.txt": b"1", "a/y é.txt": "zwölf\n".encode(), "b/empty": b"", "c": None}
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in bodies.items()], "name string, body binary")
    assert write_files(rows, f"file://{tmp_path}/o") == write_files(rows, f"file://{tmp_path}/o") == 4  # as a task that runs again
    assert {k: (tmp_path / "o" / k).read_bytes() for k in bodies} == {k: v or b"" for k, v in bodies.items()}


def test_small_documents_share_a_batch(spark):
    """Pages of many documents in one batch stay in order, and a broken document among them gives its row."""
    docs = spark.range(1000).select(F.format_string("/d/%d.txt", "id").alias("path"), F.when(F.col("id") == 500, F.unhex(F.lit("FF"))).otherwise(F.encode(F.lit("word"), "UTF-8")).alias("content"))
    rows = documents.explode_pages(docs.coalesce(1), documents.TextExtractor()).collect()
    assert len(rows) == 1000 and [r.path for r in rows if r.page_num == 0] == ["/d/500.txt"]
    long = spark.createDataFrame([("/d/l.txt", bytearray(b"x" * 10_000)), ("/d/m.txt", bytearray(b"y"))], "path string, content binary").coalesce(1)
    assert [(r.filename, r.page_num) for r in documents.explode_pages(long, documents.TextExtractor(), batch_pages=2).collect()] == [("l.txt", i) for i in range(1, 7)] + [("m.txt", 1)]


def test_canned_results_of_whole_pages(spark, sf):
    """Pages that begin with one letter and differ after it aren't taken for each other; the results don't travel in the plan."""
    rows = core.QUERIES["canned_in_workers"](spark, sf).collect()
    firsts = {r.doc_id for r in rows if r.page_num == 1 and r.doc_id % 50 == 0}
    assert firsts and firsts <= {r.doc_id for r in rows if r.doc_type == "report"}
    n = sum(r.doc_type == "report" for r in rows)
    assert n < len(rows) / 10


def test_files_of_waves_dont_grow_with_their_number(spark, tmp_path):
    """Forty waves, of which some are empty behind a dear page: as many files as shuffle partitions at most, and the waves in their order."""
    rows = spark.range(60).select(F.format_string("d%02d", F.col("id")).alias("path"), F.lit(1).alias("page_num"), F.when(F.col("id") == 10, 2.5).otherwise(0.5).alias("planned_usd"))
    asked = []

    def call(pages):
        asked.append(sorted(r.path for r in pages.collect()))
        return pages.select("path", "page_num", F.lit(0.01).alias("cost_usd"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"))

    silver, records = budget.run_in_waves(rows, call, str(tmp_path / "w"), cap=0.115, wave_usd=1.0)
    files = [name for _, _, names in os.walk(tmp_path / "w" / "pages") for name in names if name.endswith(".parquet")]
    assert len(files) <= 4
    assert [r["wave"] for r in records] == [0, 1, 2, 3, 4, 5, 7]
    assert [x for wave in asked for x in wave] == sorted(r.path for r in silver.collect()) == [f"d{i:02d}" for i in range(sum(map(len, asked)))]


def test_unlike_texts_by_columns_of_bits():
    rng = random.Random(3)

    def plain(a, b):
        above = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
            above = row
        return above[-1]

    for _ in range(500):
        a, b = ("".join(rng.choice("abcé𝄞"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 70))) for _ in range(2))
        assert distance.by_bits(a, b) == plain(a, b)
    began = time.perf_counter()
    found = distance.whole_distance("ab" * 15_000, "ac" * 15_000)  # the plain table has 900 million places
    assert found == 15_000 and time.perf_counter() - began < 10


def test_a_batch_of_texts_is_compared_row_by_row(monkeypatch):
    """Of a batch of texts Python holds one row's at a time, whatever the batch's size."""
    a = pa.array([f"{i:05d}" * 2000 for i in range(1000)] + [None, "x", None, "kitten"])
    b = pa.array(["y" * 10_000] * 1000 + ["x", None, None, "sitting"])
    tracemalloc.start()
    with monkeypatch.context() as m:
        m.setattr(distance, "whole_distance", lambda x, y: len(x) - len(y))
        got = distance.distances(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [0] * 1000 + [None] * 3 + [-1] and most < 2_000_000  # the texts are 20 MB
    assert distance.distances(a[1000:], b[1000:]).to_pylist() == [None, None, None, 3]


def test_pages_are_dealt_out_before_they_are_scored(spark):
    """Of a few kilobytes a join leaves one task; the distances of all pages don't run in it."""
    rows = spark.range(40).select(F.format_string("%d.md", "id").alias("filename"), F.lit(1).alias("page_num"), F.lit("some text").alias("markdown"))
    truth = spark.range(40).select(F.col("id").cast("string").alias("stem"), F.lit(None).cast("int").alias("page_num"), F.lit("other text").alias("gt"))
    none = dimensions.anchors(spark, {"none": []})
    for scored in (evaluate.score_pages(rows, truth, none), evaluate.score_documents(rows, truth, none), evaluate.score_passages(rows, truth.drop("page_num"), none)):
        got = scored.select("edit_distance", F.spark_partition_id().alias("p")).collect()
        assert len(got) == 40 and len({r.p for r in got}) == 4


def test_anchors_of_a_dictionary_move_no_page(spark, sf):
    """Pages of four languages would all go to four tasks; broadcast, nothing is exchanged but the anchors."""
    plan = core.QUERIES["anchor_recall"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_chains_of_arrow_lists():
    kind = pa.list_(pa.struct([("page", pa.int32()), ("at", pa.int32())]))
    rows = [[(0, 5), (1, 1), (2, 2)], [], [(3, 9)], [(0, 1), (1, 0)]]
    given = pa.array([[{"page": p, "at": t} for p, t in row] for row in rows], kind)
    for part in (given, given[1:]):
        got = [tuple(x.values()) for x in alignment.chain(part).to_pylist()]
        assert got == [alignment.chained(row) for row in rows[len(rows) - len(part) :]]


def test_truths_in_folders_as_spark_names_them(spark, tmp_path):
    """Odd stems, nulls and several truths of a page are read back; no checksum files and commits lie about."""
    rows = [("a b", 1, "x"), ("é=%/:", None, "y\nz"), ("c", 2, None), ("c", 3, "2"), ("c", 3, "1"), (None, 1, "n")]
    at = tmp_path / "truth"
    dimensions.write_ground_truth(spark.createDataFrame(rows, "stem string, page_num int, gt string"), str(at))
    got = {(r.stem, r.page_num): r.gt for r in dimensions.ground_truth_folders(spark, str(at)).collect()}
    assert got == {("a b", 1): "x", ("é=%/:", None): "y\nz", ("c", 2): "", ("c", 3): "1\n2", (None, 1): "n"}
    assert {n for _, _, names in os.walk(at) for n in names} == {"part-0.txt"}
