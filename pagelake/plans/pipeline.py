"""The OCR pipeline: scan, pages, budget, OCR, silver."""

from __future__ import annotations

import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.backends import get_backend
from pagelake.config import settings
from pagelake.operators import budget, store
from pagelake.operators.ocr import parse_batch, run_ocr
from pagelake.schema import OCR_SCHEMA, PipelineConfig
from pagelake.session import prepare
from pagelake.sources.documents import PageExtractor, TextExtractor, explode_pages, scan_documents


class OCRPipeline:
    """Documents below `input_path` -> the silver table below `output_path`.

    Unlike in a plain chain of lazy steps, the results are written once and read again, so that no later action calls the
    model a second time; with a cap the plan is checked before any call, and the true cost afterwards. `over_cap="admit"`
    sends only the pages that the plan has money for; `over_cap="waves"` sends `wave_pages` pages after the others and ends the run, without an error, once their true cost is
    beyond the cap (`waves` has a record of each): what it spends is beyond the cap by less than one wave. Pages that were not sent are pending for mode="resume". `totals` has pages, cost and errors of this run's rows, observed while they were written."""

    def __init__(
        self, backend: str | None = None, model: str | None = None, input_path: str | None = None, output_path: str | None = None, batch_size: int = 8,
        max_cost_usd: float | None = None, dpi: int = 200, max_pages_per_doc: int | None = None, backend_kwargs: dict | None = None,
        pages: str = "pdf", mode: str = "overwrite", keep_failed: bool = True, partitions: int | None = None, concurrency: int = 1, processed_at: bool = False,
        over_cap: str = "raise", wave_pages: int = 1000,
    ):
        own = settings()
        self.cfg = PipelineConfig(backend or own.default_backend, model or own.default_model, input_path, output_path, batch_size, max_cost_usd, dpi, max_pages_per_doc)
        if pages not in ("pdf", "text") or mode not in ("overwrite", "merge", "resume") or over_cap not in ("raise", "admit", "waves"):
            raise ValueError("pages is pdf or text, mode is overwrite, merge or resume, over_cap is raise, admit or waves")
        if over_cap == "waves" and (not output_path or wave_pages < 1):
            raise ValueError("waves are written below output_path, and have a page at least")
        self.over_cap, self.wave_pages = over_cap, wave_pages
        self.waves: list[dict] = []
        self.backend_kwargs, self.kind, self.mode = backend_kwargs or {}, pages, mode
        self.totals: dict = {}
        self.keep_failed, self.partitions, self.concurrency, self.processed_at = keep_failed, partitions, concurrency, processed_at

    @property
    def extractor(self):
        c = self.cfg
        return TextExtractor(max_pages=c.max_pages_per_doc) if self.kind == "text" else PageExtractor(c.dpi, c.max_pages_per_doc)

    def parse_single(self, document: str | bytes | Path) -> pd.DataFrame:
        """One document without Spark: filename, page_num and the result fields. What can't be read raises."""
        content, name = (bytes(document), "<bytes>") if isinstance(document, (bytes, bytearray)) else (Path(document).read_bytes(), Path(document).name)
        rows = parse_batch(self.cfg.backend, self.cfg.model, self.extractor.extract(content), self.concurrency, **self.backend_kwargs)
        frame = pd.DataFrame(rows, columns=OCR_SCHEMA.fieldNames())
        frame.insert(0, "filename", name)
        frame.insert(1, "page_num", range(1, len(frame) + 1))
        return frame

    def pages(self, spark: SparkSession) -> DataFrame:
        if not self.cfg.input_path:
            raise ValueError("run() needs input_path")
        text = self.kind == "text"  # small files, read in no time: few tasks have many of them
        docs = scan_documents(spark, self.cfg.input_path, "*.txt" if text else "*.pdf", tasks=int(spark.conf.get("spark.sql.shuffle.partitions")) if text else None)
        return explode_pages(docs, self.extractor, self.keep_failed)

    def run(self, spark: SparkSession) -> DataFrame:
        prepare(spark)
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(key)
        spark.conf.set(key, str(self.cfg.batch_size))
        try:
            return self._run(spark)
        finally:
            spark.conf.set(key, before)

    def _merge_keys(self) -> list[str] | None:
        return None if self.mode == "overwrite" else ["path", "page_num"]

    def _called(self, pages: DataFrame) -> DataFrame:
        silver = run_ocr(pages, self.cfg.backend, self.cfg.model, self.partitions, self.concurrency, **self.backend_kwargs)
        return silver.withColumn("processed_at", F.current_timestamp()) if self.processed_at else silver

    def _in_waves(self, pages: DataFrame, silver_at: str) -> DataFrame:
        counted = pages.withColumn("_page", F.when(F.col("page_num") > 0, 1.0).otherwise(0.0))  # unreadable documents cost nothing
        folder = f"{self.cfg.output_path}/waves-{uuid.uuid4().hex}"
        silver, self.waves = budget.run_in_waves(counted, lambda rows: self._called(rows.drop("_page")), folder, self.cfg.max_cost_usd, float(self.wave_pages), cost="_page")
        silver, self.totals = store.write_observed(silver.drop("wave"), silver_at, self._merge_keys())
        return silver

    def _run(self, spark: SparkSession) -> DataFrame:
        c = self.cfg
        pages = self.pages(spark)
        silver_at = f"{c.output_path}/silver" if c.output_path else None
        if c.output_path:
            pages = store.write_bronze(pages, f"{c.output_path}/bronze").drop("extracted_at")
        if self.mode == "resume" and silver_at and store.exists(spark, silver_at):
            pages = store.pending(pages, store.read_table(spark, silver_at))
        if c.max_cost_usd is not None:
            backend = get_backend(c.backend, model=c.model, **self.backend_kwargs)
            planned = backend.estimate_cost(1)
            if self.over_cap == "waves":
                return self._in_waves(pages, silver_at)
            if self.over_cap == "raise":
                budget.preflight(pages.where("page_num > 0"), planned, c.max_cost_usd)
            else:  # pages in the order of documents and pages, as far as the plan goes
                usd = F.when(F.col("page_num") > 0, F.lit(planned)).otherwise(F.lit(0.0))
                pages = budget.admit(pages.withColumn("_planned_usd", usd), c.max_cost_usd, "_planned_usd").drop("_planned_usd")
        silver = self._called(pages)
        if silver_at:
            silver, self.totals = store.write_observed(silver, silver_at, self._merge_keys())
        else:
            # without a path to write to, the results are held, or every action would pay again
            silver, seen = store.observed(silver)
            silver = silver.checkpoint() if spark.sparkContext.getCheckpointDir() else silver.persist()
            silver.count()
            self.totals = seen.get
        if c.max_cost_usd is not None:
            budget.check_cap(self.totals["cost_usd"], c.max_cost_usd)
        return silver
