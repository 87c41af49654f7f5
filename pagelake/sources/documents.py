"""Documents and their pages."""

from __future__ import annotations

import io
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.text import base_name
from pagelake.schema import PAGE_SCHEMA
from pagelake.sources import files

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
PAGE_CHARS = 1800


def scan_documents(spark: SparkSession, path: str, glob: str = "*.pdf", min_bytes: int | None = None, max_bytes: int | None = None, modified_after: str | None = None, tasks: int | None = None) -> DataFrame:
    """All files below `path` whose name fits `glob` (case counts). Bounds on size are pushed into the scan.

    Spark lists all files in the driver and counts each as 4 MB at least, so that a task gets 32 small ones or fewer. With `tasks`, so many tasks list and read a folder's files; a
    store that Arrow doesn't open is listed by Spark, and its tasks are joined."""
    if tasks is not None and files.can_list(spark, path):
        found = listed(spark, path, glob, tasks, modified_after)
        for bound in ([F.col("length") >= min_bytes] if min_bytes is not None else []) + ([F.col("length") <= max_bytes] if max_bytes is not None else []):
            found = found.where(bound)
        return files.read_files(found, path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    df = reader.load(path)
    if tasks is not None:
        df = df.coalesce(tasks)
    if min_bytes is not None:
        df = df.where(F.col("length") >= min_bytes)
    return df if max_bytes is None else df.where(F.col("length") <= max_bytes)


def one_document(spark: SparkSession, document: str | bytes | Path) -> DataFrame:
    """One document by path or as bytes, in the scan's shape (path, content)."""
    name, content = ("<bytes>", bytes(document)) if isinstance(document, (bytes, bytearray)) else (str(document), Path(document).read_bytes())
    return spark.createDataFrame([(name, content)], "path string, content binary")


def listed(spark: SparkSession, path: str, glob: str, tasks: int, modified_after: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of a folder's files, listed by tasks. The pattern is Hadoop's, as in Spark's own scan."""
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    found = files.list_files(spark, path, tasks).where(F.substring_index("path", "/", -1).rlike(rf"(?s)\A(?:{pattern})\z"))
    return found if modified_after is None else found.where(F.col("modificationTime") > F.lit(modified_after).cast("timestamp"))


def list_documents(spark: SparkSession, path: str, glob: str = "*", tasks: int | None = None) -> DataFrame:
    """name, path and size of each file; contents aren't read."""
    found = listed(spark, path, glob, tasks) if tasks is not None and files.can_list(spark, path) else scan_documents(spark, path, glob, tasks=tasks)
    return found.select(base_name("path").alias("name"), "path", "length")


class PageExtractor:
    """PDF bytes -> PNG bytes of each page, by the optional pymupdf."""

    def __init__(self, dpi: int = 200, max_pages: int | None = None):
        self.dpi, self.max_pages = dpi, max_pages

    @staticmethod
    def check() -> None:
        """Raises if there is no renderer, so that a run doesn't take every document for unreadable."""
        try:
            import pymupdf  # noqa: F401
        except ImportError:
            raise RuntimeError("rendering PDF pages needs pymupdf; text pages need nothing") from None

    def extract(self, document: bytes) -> list[bytes]:
        return list(self.pages(document))

    def pages(self, document: bytes) -> Iterator[bytes]:
        self.check()
        import pymupdf

        with pymupdf.open(stream=document, filetype="pdf") as opened:
            if not len(opened):
                raise ValueError("the document has no pages")
            for i in range(min(len(opened), self.max_pages or len(opened))):
                yield opened[i].get_pixmap(dpi=self.dpi, alpha=False).tobytes("png")


class TextExtractor:
    """UTF-8 text as pages of `page_chars` code points; the same interface without a renderer."""

    def __init__(self, page_chars: int = PAGE_CHARS, max_pages: int | None = None):
        self.page_chars, self.max_pages = page_chars, max_pages

    def extract(self, document: bytes) -> list[bytes]:
        return list(self.pages(document))

    def pages(self, document: bytes) -> Iterator[bytes]:
        text = document.decode("utf-8")
        n = max(1, -(-len(text) // self.page_chars))
        for i in range(min(n, self.max_pages or n)):
            yield text[i * self.page_chars : (i + 1) * self.page_chars].encode()


#: A batch of pages leaves the worker once it has so many bytes (and `batch_pages` pages), or so many pages.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 4096


def explode_pages(docs: DataFrame, extractor=None, keep_failed: bool = True, batch_pages: int = 16) -> DataFrame:
    """One row a page, numbered from 1. An unreadable document gives one row of page 0 whose bytes are the cause as text, or none.

    Pages leave the worker in small batches, so a large document is never held whole as pages; small documents share a batch."""
    extractor = extractor or PageExtractor()
    if isinstance(extractor, PageExtractor):
        extractor.check()
    kinds = {"path": pa.string(), "filename": pa.string(), "page_num": pa.int32(), "page_png": pa.binary()}
    schema = pa.schema([(f.name, kinds[f.name]) for f in PAGE_SCHEMA])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for docs_batch in batches:
            for path, content in zip(docs_batch.column(0), docs_batch.column(1), strict=True):
                path = path.as_py()
                name = path.rsplit("/", 1)[-1]
                try:
                    for i, page in enumerate(extractor.pages(content.as_py()), 1):
                        rows.append((path, name, i, page))
                        held += len(page)
                        if len(rows) >= BATCH_ROWS or (len(rows) >= batch_pages and held >= BATCH_BYTES):
                            yield batch()
                            rows, held = [], 0
                except Exception as e:
                    if keep_failed:
                        rows.append((path, name, 0, f"{type(e).__name__}: {e}".encode()))
        if rows:
            yield batch()

    return docs.select("path", "content").mapInArrow(pages, PAGE_SCHEMA)


def text_pages(docs: DataFrame, text: str = "text", key: str = "doc_id", page_chars: int = PAGE_CHARS, max_pages: int | None = None) -> DataFrame:
    """(key, page_num, page_text): slices of `page_chars` code points, without Python. An empty or null text is one empty page."""
    body = F.coalesce(F.col(text), F.lit(""))
    last = F.floor((F.greatest(F.length(body), F.lit(1)) - 1) / page_chars).cast("int")
    if max_pages is not None:
        last = F.least(last, F.lit(max_pages - 1))
    rows = docs.select(key, body.alias("_text"), F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    return rows.select(key, (F.col("_i") + 1).alias("page_num"), F.substring("_text", F.col("_i") * page_chars + 1, F.lit(page_chars)).alias("page_text"))


def simple_pdf(pages: list[list[str]]) -> bytes:
    """A small PDF of text lines, the same bytes each time; for tests and trials."""
    objects: list[bytes] = []
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects += [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, text in enumerate(pages):
        shown = " T* ".join("({}) Tj".format(x.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")) for x in text)
        stream = f"BT /F1 12 Tf 14 TL 72 720 Td {shown} ET".encode("latin-1", "replace")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    out, offsets = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for i, body in enumerate(objects, 1):
        offsets.append(out.tell())
        out.write(b"%d 0 obj\n%s\nendobj\n" % (i, body))
    at = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets))
    out.write(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))
    return out.getvalue()
