"""The OCR step: one non-deterministic pandas UDF, so that Spark neither doubles nor moves the paid calls."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.backends import Backend, get_backend
from pagelake.schema import OCR_SCHEMA, SILVER_COLUMNS, OCROutput

_backends: dict[str, Backend] = {}
_lock = threading.Lock()


def backend_key(name: str, options: dict) -> str:
    """A digest of a backend's name and options; worked out once for all batches."""
    return hashlib.sha256(repr((name.lower(), sorted(options.items(), key=lambda x: x[0]))).encode("utf-8", "surrogatepass")).hexdigest()


def cached_backend(name: str, options: dict, key: str | None = None) -> Backend:
    """One backend a worker process for each name and set of options."""
    key = key or backend_key(name, options)
    with _lock:
        if key not in _backends:
            _backends[key] = get_backend(name, **options)
        return _backends[key]


def parse_batch(backend: str | Backend, model: str, images: list[bytes], concurrency: int = 1, prompt: str | None = None, key: str | None = None, **options) -> list[dict]:
    """Results of some pages, in order; what goes wrong becomes a row with `error`. key: the backend_key, if it is known."""
    own = backend if isinstance(backend, Backend) else cached_backend(backend, {"model": model, **options}, key)

    def one(image: bytes) -> dict:
        try:
            return own.parse_image(bytes(image), prompt).as_dict()
        except Exception as e:  # a backend may break its word
            return OCROutput(model=model, error=f"{type(e).__name__}: {e}").as_dict()

    if concurrency <= 1:
        return [one(x) for x in images]
    with ThreadPoolExecutor(concurrency) as pool:
        return list(pool.map(one, images))


def make_ocr_udf(backend: str, model: str, concurrency: int = 1, prompt: str | None = None, **options):
    """A pandas UDF bytes -> struct. Keys are read from the worker's settings unless given in `options`."""
    key = backend_key(backend, {"model": model, **options})

    def ocr(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for images in batches:
            rows = parse_batch(backend, model, list(images), concurrency, prompt, key, **options)
            frame = pd.DataFrame(rows, columns=OCR_SCHEMA.fieldNames())
            yield frame.astype({"prompt_tokens": "int32", "completion_tokens": "int32", "confidence": "float64", "cost_usd": "float64"})

    ocr.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(ocr, OCR_SCHEMA).asNondeterministic()


def flatten(pages: DataFrame, ocr: str = "ocr") -> DataFrame:
    """path, filename, page_num and the fields of the result struct."""
    return pages.select("path", "filename", "page_num", *(F.col(f"{ocr}.{f}").alias(f) for f in OCR_SCHEMA.fieldNames()))


def run_ocr(pages: DataFrame, backend: str, model: str, partitions: int | None = None, concurrency: int = 1, **options) -> DataFrame:
    """Pages -> silver rows. Small documents are dealt out first, so that calls run in all tasks; page 0 (unreadable) isn't sent."""
    if partitions:
        pages = pages.repartition(partitions, "path", "page_num")
    udf = make_ocr_udf(backend, model, concurrency, **options)
    good = flatten(pages.where("page_num > 0").withColumn("ocr", udf("page_png")))
    return good.unionByName(unreadable(pages, model)).select(SILVER_COLUMNS)


def unreadable(pages: DataFrame, model: str) -> DataFrame:
    """Error rows of page 0, with the cause that stands in the page's bytes."""
    failed = OCROutput(model=model).as_dict()
    cause = F.col("page_png").cast("string")
    values = {f.name: F.lit(failed[f.name]).cast(f.dataType) for f in OCR_SCHEMA} | {"error": F.when(cause == "", "ValueError: unreadable document").otherwise(cause)}
    return pages.where("page_num = 0").select("path", "filename", "page_num", *(v.alias(k) for k, v in values.items()))


def run_ocr_once_each(pages: DataFrame, folder: str, backend: str, model: str, **options) -> DataFrame:
    """Like run_ocr, but equal pages are sent once; results of the distinct pages are written to `folder` before they are joined back."""
    hashed = pages.withColumn("sha", F.sha2("page_png", 256))
    first = hashed.where("page_num > 0").groupBy("sha").agg(F.min(F.struct("path", "page_num")).alias("at")).select(F.col("sha").alias("_sha"), "at")
    distinct = hashed.join(first, (F.col("sha") == F.col("_sha")) & (F.col("path") == F.col("at.path")) & (F.col("page_num") == F.col("at.page_num"))).select("sha", "page_png")
    udf = make_ocr_udf(backend, model, **options)
    distinct.dropDuplicates(["sha"]).select("sha", udf("page_png").alias("ocr")).write.mode("overwrite").parquet(folder)
    results = pages.sparkSession.read.parquet(folder)
    good = flatten(hashed.where("page_num > 0").drop("page_png").join(results, "sha"))
    return good.unionByName(unreadable(pages, model)).select(SILVER_COLUMNS)
