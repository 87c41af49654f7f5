"""Schemas and records that all parts share."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds of documents.
DOC_TYPES = ("invoice", "report", "scan", "form", "other", "unknown")

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("filename", T.StringType(), False),
        T.StructField("page_num", T.IntegerType(), False),
        T.StructField("page_png", T.BinaryType(), False),
    ]
)
OCR_SCHEMA = T.StructType(
    [
        T.StructField("markdown", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("prompt_tokens", T.IntegerType()),
        T.StructField("completion_tokens", T.IntegerType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("model", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
SILVER_COLUMNS = ["path", "filename", "page_num", *OCR_SCHEMA.fieldNames()]
SILVER_SCHEMA = T.StructType([T.StructField(f.name, f.dataType) for f in PAGE_SCHEMA.fields[:3]] + OCR_SCHEMA.fields)


@dataclass(frozen=True)
class OCROutput:
    """One page's result. Success means that `error` is None; a blank page is a success."""

    markdown: str = ""
    doc_type: str = "unknown"
    confidence: float = 1.0
    prompt_tokens: int = 0
    completion_tokens: int = 0
    cost_usd: float = 0.0
    model: str = ""
    error: str | None = None

    def __post_init__(self) -> None:
        if self.doc_type not in DOC_TYPES:
            raise ValueError(f"doc_type must be one of {', '.join(DOC_TYPES)}, not {self.doc_type!r}")
        if not 0 <= self.confidence <= 1:
            raise ValueError(f"confidence must lie between 0 and 1, not {self.confidence}")

    def as_dict(self) -> dict:
        return dict(vars(self))  # plain values, which asdict would copy one by one


@dataclass(frozen=True)
class PipelineConfig:
    backend: str = "mock"
    model: str = "mock-model"
    input_path: str | None = None
    output_path: str | None = None
    batch_size: int = 8
    max_cost_usd: float | None = None
    dpi: int = 200
    max_pages_per_doc: int | None = None


assert [f.name for f in fields(OCROutput)] == OCR_SCHEMA.fieldNames()


def violations(doc_type: Column | str = "doc_type", confidence: Column | str = "confidence") -> Column:
    """What a result row breaks of the rules that a Spark schema can't hold: an array of texts, empty if nothing."""
    d, c = (F.col(x) if isinstance(x, str) else x for x in (doc_type, confidence))
    return F.array_compact(F.array(F.when(~d.isin(*DOC_TYPES), F.lit("doc_type")), F.when((c < 0) | (c > 1), F.lit("confidence"))))
