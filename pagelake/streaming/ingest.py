"""New files as they come: Structured Streaming over binary files, each micro-batch upserted into silver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagelake.operators import store
from pagelake.operators.ocr import run_ocr
from pagelake.sources.documents import BINARY_SCHEMA, TextExtractor, explode_pages


def watch_documents(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    """A stream of files below `path`, each of them once, however old it is beside those seen."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").load(path)


def ingest(spark: SparkSession, path: str, silver: str, checkpoint: str, backend: str = "mock", model: str = "mock-model", glob: str = "*.txt", extractor=None, **options) -> StreamingQuery:
    """Takes what is new since the checkpoint, then ends. A batch that runs again replaces its own rows."""
    extractor = extractor or TextExtractor()

    def land(batch: DataFrame, _: int) -> None:
        store.write_silver(run_ocr(explode_pages(batch, extractor), backend, model, **options), silver, ["path", "page_num"])

    return watch_documents(spark, path, glob).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
