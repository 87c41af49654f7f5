"""Reports over silver: run statistics, top costs, summaries, throughput."""

from __future__ import annotations

import struct
import time
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.budget import running_cost
from pagelake.operators.ocr import run_ocr
from pagelake.schema import PAGE_SCHEMA

def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">L", len(data)) + kind + data + struct.pack(">L", zlib.crc32(kind + data))


#: A PNG of one white pixel.
PIXEL = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">2L5B", 1, 1, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(b"\x00\xff")) + _chunk(b"IEND", b"")


def error_rows(silver: DataFrame) -> DataFrame:
    return silver.where("error IS NOT NULL AND error <> ''")


def file_rollup(silver: DataFrame) -> DataFrame:
    """Pages, tokens and cost by file, and a row for all files (filename null)."""
    return silver.rollup("filename").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")
    )


def top_cost(silver: DataFrame, n: int = 20) -> DataFrame:
    """The dearest pages; ties by file and page."""
    return silver.orderBy(F.col("cost_usd").desc(), "filename", "page_num").limit(n)


def with_places(silver: DataFrame) -> DataFrame:
    """Adds place, from 1: a row's place in the order of files and pages. No task counts more than a range of files."""
    counted = running_cost(silver.withColumn("_one", F.lit(1).cast("long")), "_one", "filename", "page_num")
    return counted.withColumn("place", F.col("running_usd").cast("long")).drop("_one", "running_usd")


def in_page_order(silver: DataFrame) -> DataFrame:
    return silver.orderBy("filename", "page_num")


def failed_pages(silver: DataFrame) -> DataFrame:
    """One row a failed page: its name."""
    return error_rows(silver).select(F.format_string("%s p%d", "filename", "page_num").alias("failed"))


def page_previews(silver: DataFrame, preview_chars: int = 500) -> DataFrame:
    """One row a page: filename, page_num, and how its text begins."""
    return silver.select("filename", "page_num", F.left(F.coalesce("markdown", F.lit("")), F.lit(preview_chars)).alias("preview"))


def run_summary(silver: DataFrame, preview_chars: int = 500, most_listed: int = 1000) -> DataFrame:
    """One JSON text: number of pages, cost, number of failed pages, and the first `most_listed` failed pages and previews by name.

    It is for a person's eyes; failed_pages and page_previews have all of them, as rows."""
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    totals = silver.agg(F.count(F.lit(1)).alias("total_pages"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("total_cost_usd"), F.count_if(failed).alias("n_failed"))
    names = failed_pages(silver).orderBy("failed").limit(most_listed).agg(F.array_sort(F.collect_list("failed")).alias("failed"))
    previews = page_previews(silver, preview_chars).orderBy("filename", "page_num").limit(most_listed).agg(F.array_sort(F.collect_list(F.struct("*"))).alias("pages"))
    return totals.crossJoin(names).crossJoin(previews).select(F.to_json(F.struct("*")).alias("summary"))  # three tables of one row


def score_means(scores: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return scores.agg(*(F.round(F.avg(c), digits).alias(c) for c in columns))


def perf_totals(silver: DataFrame) -> DataFrame:
    """One row: pages, cost_usd, errors."""
    return silver.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def run_perf(spark: SparkSession, pages: int = 20, backend: str = "mock", model: str = "mock-model", output: str | None = None) -> dict:
    """Runs some one-pixel pages through the OCR step in Spark; a Markdown report goes to `output`."""
    df = spark.range(pages).select(
        F.lit("perf.pdf").alias("path"), F.lit("perf.pdf").alias("filename"), (F.col("id") + 1).cast("int").alias("page_num"), F.lit(PIXEL).alias(PAGE_SCHEMA.fieldNames()[3])
    )
    began = time.perf_counter()
    row = perf_totals(run_ocr(df, backend, model)).first()
    wall = time.perf_counter() - began
    out = {"pages": row.pages, "wall_s": round(wall, 3), "pages_per_s": round(row.pages / wall, 3) if wall else 0.0, "mean_latency_s": round(wall / row.pages, 4) if row.pages else 0.0, "cost_usd": round(row.cost_usd, 6), "errors": row.errors}
    if output:
        with open(output, "w") as f:
            f.write(f"# Throughput: {backend}, {model}\n\n| figure | value |\n|---|---|\n" + "".join(f"| {k} | {v} |\n" for k, v in out.items()))
    return out
