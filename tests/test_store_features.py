"""Tables that rewrite, read or move only what they must: buckets, clusters, observed writes, waves, slim lookups, the synthetic source."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagelake.operators import budget, store
from pagelake.plans import queries as Q
from pagelake.plans.pipeline import OCRPipeline
from pagelake.schema import OCROutput
from pagelake.sources import synthetic
from pagelake.sources.dimensions import canned_results, canned_silver, maybe_among, with_canned


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def pages(spark):
    return spark.range(400).select(F.concat(F.lit("d"), F.floor(F.col("id") / 4).cast("string")).alias("path"), (F.col("id") % 4 + 1).cast("int").alias("page_num"), F.col("id").alias("v"))


# ---------------------------------------------------------------- buckets


def test_upsert_leaves_other_buckets(spark, tmp_path, pages):
    at = str(tmp_path / "t")
    store.write_buckets(pages, at, ["path", "page_num"], 16)
    before = files(at)
    source = pages.where("path IN ('d3', 'd7')").withColumn("v", -F.col("v")).unionByName(spark.createDataFrame([("new", 1, 5)], "path string, page_num int, v long"))
    touched = store.upsert_buckets(source, at)
    after = files(at)
    own = lambda f: int(re.search(r"_bucket=(\d+)", f)[1])
    assert 0 < len(touched) < 16
    assert {f for f in before if own(f) not in touched} == {f for f in after if f in before}  # the same files, none of a touched bucket
    assert all(before[f] == after[f] for f in before if f in after)
    assert rows_of(store.read_buckets(spark, at).select("path", "page_num", "v")) == rows_of(store.upserted(pages, source, ["path", "page_num"]))


def test_upsert_reads_only_its_buckets(spark, tmp_path, pages):
    at = str(tmp_path / "t")
    store.write_buckets(pages, at, ["path", "page_num"], 16, files=2)
    found = store.only_key(spark, at, {"path": "d3", "page_num": 2})
    assert [r.v for r in found.collect()] == [13]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and len(found.inputFiles()) <= 32
    with pytest.raises(ValueError):
        store.only_key(spark, at, {"path": "d3"})


def test_upsert_edges(spark, tmp_path, pages):
    at = str(tmp_path / "t")
    with pytest.raises(ValueError):
        store.upsert_buckets(pages, at)
    store.write_buckets(pages.where("false"), at, ["path", "page_num"], 4)
    assert store.read_buckets(spark, at, pages.schema).count() == 0
    with pytest.raises(ValueError):
        store.write_buckets(pages, at, ["path", "page_num"], 4)
    at = str(tmp_path / "u")
    store.write_buckets(pages, at, ["path", "page_num"], 4)
    assert store.upsert_buckets(pages.where("false"), at) == []
    twice = pages.where("v = 1").unionByName(pages.where("v = 1"))
    with pytest.raises(store.AmbiguousMerge):
        store.upsert_buckets(twice, at)
    null = spark.createDataFrame([(None, 1, 7)], "path string, page_num int, v long")
    store.upsert_buckets(null, at)
    store.upsert_buckets(null.select("v", "page_num", "path"), at)  # columns by name; null keys match nothing
    assert store.read_buckets(spark, at).where("path IS NULL").count() == 2 and store.read_buckets(spark, at).count() == 402


# ---------------------------------------------------------------- observed writes


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_totals_cost_no_job(spark, sf, tmp_path):
    rows = Q.silver(spark, sf)
    seen = {}
    plain = jobs(spark, "plain", lambda: store.write_silver(rows, str(tmp_path / "a")))
    watched = jobs(spark, "watched", lambda: seen.update(store.write_observed(rows, str(tmp_path / "b"))[1]))
    assert watched == plain
    want = rows.agg(F.count(F.lit(1)), F.sum("cost_usd"), F.count("error")).first()
    assert (seen["pages"], seen["errors"]) == (want[0], want[2]) and abs(seen["cost_usd"] - want[1]) < 1e-9
    assert store.write_observed(rows.where("false"), str(tmp_path / "c"))[1] == dict.fromkeys(("pages", "cost_usd", "errors", "failed", "prompt_tokens", "completion_tokens"), 0)


def test_observed_merge_counts_new_rows_once(spark, tmp_path):
    base = spark.createDataFrame([("a", 1, 0.5, None, 1, 1), ("b", 1, 0.25, "x", 1, 1)], "path string, page_num int, cost_usd double, error string, prompt_tokens int, completion_tokens int")
    store.write_observed(base, str(tmp_path / "s"))
    table, totals = store.write_observed(base.where("path = 'b'"), str(tmp_path / "s"), ["path", "page_num"])
    assert totals["pages"] == 1 and totals["cost_usd"] == 0.25 and totals["failed"] == 1 and table.count() == 2


def test_pipeline_has_totals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x" * 4000)
    (tmp_path / "in" / "b.md").write_text("left out by the glob")
    run = OCRPipeline("mock", "mock-model", str(tmp_path / "in"), str(tmp_path / "out"), pages="text", max_cost_usd=1.0)
    assert run.run(spark).count() == 3 and run.totals["pages"] == 3 and run.totals["cost_usd"] == 0.0
    run = OCRPipeline("mock", "mock-model", str(tmp_path / "in"), None, pages="text")
    assert run.run(spark).count() == 3 and run.totals["pages"] == 3


# ---------------------------------------------------------------- waves


def planned(spark, true_usd):
    rows = [(f"d{i // 3}", i % 3 + 1, 0.1, float(t)) for i, t in enumerate(true_usd)]
    return spark.createDataFrame(rows, "path string, page_num int, planned_usd double, true_usd double")


def caller(log):
    """A model whose cost is known, and a record of what it was asked."""

    def call(pages):
        log.append(pages.count())
        none = F.lit(None).cast("string").alias("error")
        return pages.select("path", "page_num", F.col("true_usd").alias("cost_usd"), none, F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"))

    return call


@pytest.mark.parametrize("factor", [0.0, 0.5, 1.0, 2.0, 10.0])
def test_spend_is_beyond_the_cap_by_less_than_a_wave(spark, tmp_path, factor):
    log = []
    pages = planned(spark, [0.1 * factor] * 30)
    silver, records = budget.run_in_waves(pages, caller(log), str(tmp_path / "w"), cap=1.0, wave_usd=0.5)
    costs = [float(r["cost_usd"]) for r in records]  # decimals, whatever the costs are
    spent, largest = sum(costs), max(costs)
    assert spent <= 1.0 + largest and silver.count() == sum(log) == sum(r["pages"] for r in records)
    assert spent > 1.0 or silver.count() == 30  # it stops for the cap alone
    assert abs(silver.agg(F.sum("cost_usd")).first()[0] - spent) < 1e-9
    first = sorted((r.path, r.page_num) for r in pages.collect())[: silver.count()]
    assert sorted((r.path, r.page_num) for r in silver.collect()) == first  # in the order of pages, nothing left out in between


def test_a_stopped_run_goes_on(spark, tmp_path):
    """A wave that fails leaves no record; the next run begins with it and pays no other again."""
    pages, log = planned(spark, [0.1] * 20), []
    good = caller(log)

    def fails(rows):
        if len(log) == 2:
            raise ConnectionError("lost")
        return good(rows)

    with pytest.raises(ConnectionError):
        budget.run_in_waves(pages, fails, str(tmp_path / "w"), cap=10.0, wave_usd=0.5)
    assert log == [5, 5]
    silver, records = budget.run_in_waves(pages, good, str(tmp_path / "w"), cap=10.0, wave_usd=0.5)
    assert log == [5, 5, 5, 5] and silver.count() == 20 and [r["wave"] for r in records] == [0, 1, 2, 3]


def test_no_pages_no_waves(spark, tmp_path):
    silver, records = budget.run_in_waves(planned(spark, [0.1]).where("false"), caller([]), str(tmp_path / "w"), 1.0, 0.5)
    assert silver.count() == 0 and records == [] and "wave" in silver.columns
    with pytest.raises(ValueError):
        budget.in_waves(planned(spark, [0.1]), 0.0)


def test_the_pipeline_stops_half_way_and_resumes(spark, tmp_path):
    """Three documents of four pages, each page for 0.25 USD by its canned answer; a cap of 1 USD, waves of two pages."""
    (tmp_path / "in").mkdir()
    bodies = {n: [f"{n}{i}" * 900 for i in range(4)] for n in "abc"}
    for n, parts in bodies.items():
        (tmp_path / "in" / f"{n}.txt").write_text("".join(parts))
    canned = {hashlib.sha256(p.encode()).hexdigest(): OCROutput(p[:2], cost_usd=0.25) for parts in bodies.values() for p in parts}
    make = lambda **o: OCRPipeline("mock", "mock-model", str(tmp_path / "in"), str(tmp_path / "out"), pages="text", max_cost_usd=1.0, backend_kwargs={"canned": canned}, over_cap="waves", wave_pages=2, **o)
    run = make()
    rows = run.run(spark)
    assert [w["pages"] for w in run.waves] == [2, 2, 2] and run.totals["pages"] == 6 and run.totals["cost_usd"] == 1.5  # 1.0 is within the cap, so a third wave went
    assert sorted(r.markdown for r in rows.collect()) == ["a0", "a1", "a2", "a3", "b0", "b1"]
    again = make(mode="resume")
    assert sorted(r.markdown for r in again.run(spark).collect()) == sorted(p[:2] for parts in bodies.values() for p in parts) and again.totals["pages"] == 6
    with pytest.raises(ValueError):
        OCRPipeline("mock", "mock-model", str(tmp_path / "in"), None, over_cap="waves")


# ---------------------------------------------------------------- catalogue tables and clustered files


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    left = spark.range(500).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    store.save_bucketed(left, "left_rows", ["k"], 4, str(tmp_path / "l"))
    store.save_bucketed(spark.range(50).select(F.col("id").alias("k"), F.lit("old").alias("w")), "right_rows", ["k"], 4, str(tmp_path / "r"))
    store.save_bucketed(spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")), "right_rows", ["k"], 4, str(tmp_path / "r2"))
    try:
        assert spark.table("right_rows").columns == ["k", "x"]  # replaced together with its schema
        joined = spark.table("left_rows").join(spark.table("right_rows").hint("merge"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        assert joined.where("x <> 2 * k").count() == 0 and joined.count() == 500
        counted = spark.table("left_rows").groupBy("k").count()
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in ("left_rows", "right_rows"):
            spark.sql(f"DROP TABLE {name}")


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    rows = spark.range(40_000).select(F.format_string("d%05d", F.floor(F.col("id") * 7919 % 40_000 / 8).cast("int")).alias("path"), (F.col("id") * 7919 % 8 + 1).cast("int").alias("page_num"), F.sha2(F.col("id").cast("string"), 256).alias("markdown"))
    at = str(tmp_path / "s")
    table = store.write_clustered(rows.repartition(6), at, files=3, row_group_bytes=100_000)
    groups, order = [], []
    for f in sorted(Path(at).rglob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        stats = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups)]
        groups += [(s.min, s.max) for s in stats]
        order += pq.read_table(f, columns=["path", "page_num"]).to_pylist()
    assert len(groups) > 6 and sum(a <= "d01234" <= b for a, b in groups) == 1
    assert [tuple(r.values()) for r in order] == sorted(tuple(r.values()) for r in order) and len(order) == 40_000
    assert table.where("path = 'd01234'").count() == 8


# ---------------------------------------------------------------- canned answers


def test_canned_answers_leave_the_bytes(spark, sf):
    pages = spark.range(300).select(F.col("id").alias("doc"), F.encode(F.concat(F.lit("page "), (F.col("id") % 90).cast("string")), "UTF-8").alias("page_png"))
    known = {hashlib.sha256(f"page {i}".encode()).hexdigest(): OCROutput(f"text {i}", "report") for i in range(0, 90, 4)}
    canned = canned_results(spark, known)
    slim = canned_silver(pages, canned, OCROutput("none"), "m")
    assert rows_of(slim) == rows_of(with_canned(pages, canned, OCROutput("none"), "m").drop("page_png"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = canned_silver(pages, canned, OCROutput("none"), "m")
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.split("\n") if "Exchange hashpartitioning(_digest" in x]
        assert moved and not re.search(r"Exchange hashpartitioning\(page_png|sha2\(page_png[^\n]*Exchange", plan)
        top = plan.split("== Initial Plan ==")[-1]
        below = [x for x in top.split("\n") if "Project" in x and "page_png" in x]
        assert all("sha2" in x for x in below)  # the bytes end where the digest is made
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert canned_silver(pages.where("false"), canned, OCROutput("none"), "m").count() == 0
    assert canned_silver(pages, canned.where("false"), OCROutput("none"), "m").where("ocr.markdown <> 'none'").count() == 0


def test_bitmap_misses_no_member(spark):
    rows = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    told = maybe_among(rows, "sha", rows.where("id % 10 = 0").select("sha"))
    counts = told.agg(F.count_if(F.expr("id % 10 = 0 AND NOT maybe")), F.count_if(F.expr("id % 10 <> 0 AND maybe"))).first()
    assert counts[0] == 0 and counts[1] < 0.2 * 18_000


# ---------------------------------------------------------------- synthetic documents


def test_synthetic_source(spark):
    synthetic.register(spark)
    read = lambda **o: spark.read.format("synthetic_documents").options(**o).load()
    rows = {r.number: r for r in read(copies="7", partitions="3").collect()}
    assert sorted(rows) == list(range(7)) and read(copies="7", partitions="3").rdd.getNumPartitions() == 3
    assert {n: bytes(r.content) for n, r in rows.items()} == {r.number: bytes(r.content) for r in read(copies="7", partitions="1").collect()}
    assert {n for n, r in rows.items() if bytes(r.content) != bytes(read(copies="7", seed="1").where(F.col("number") == n).first().content)} == set(range(7))
    assert all(r.markdown.startswith(synthetic.golden(list(synthetic.DOCUMENTS)[n % 3])) and bytes(r.content).startswith(b"%PDF-1.4") for n, r in rows.items())
    assert [r.number for r in read(copies="2", first="5").orderBy("number").collect()] == [5, 6] and read(copies="0").count() == 0
