"""Made-up documents with known texts, the same bytes each time: for trials, tests and canned results."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagelake.schema import OCROutput
from pagelake.sources.documents import simple_pdf

#: stem -> (pages of text lines, the Markdown that a perfect model gives, kind)
DOCUMENTS: dict[str, tuple[list[list[str]], str, str]] = {
    "synth_invoice": (
        [["Invoice INV-2024-001", "Bill to: Example Ltd", "Date: 2024-03-01", "Pens | 10 | 1.50 | 15.00", "Paper | 4 | 5.00 | 20.00", "Total: $35.00"]],
        "# Invoice INV-2024-001\n\nBill to: Example Ltd\nDate: 2024-03-01\n\n| Item | Count | Price | Sum |\n|---|---|---|---|\n| Pens | 10 | 1.50 | 15.00 |\n| Paper | 4 | 5.00 | 20.00 |\n\n**Total: $35.00**\n",
        "invoice",
    ),
    "synth_report": (
        [["Yearly Report", "Summary", "Sales rose in every region."], ["Findings", "North grew by 4 %.", "South grew by 7 %."]],
        "# Yearly Report\n\n## Summary\n\nSales rose in every region.\n\n## Findings\n\n- North grew by 4 %.\n- South grew by 7 %.\n",
        "report",
    ),
    "synth_table": (
        [["Sales by region", "North | 10 | 12 | 14", "South | 9 | 11 | 13"]],
        "# Sales by region\n\n| Region | Q1 | Q2 | Q3 |\n|---|---|---|---|\n| North | 10 | 12 | 14 |\n| South | 9 | 11 | 13 |\n",
        "other",
    ),
}
ANCHORS = {"synth_invoice": ["INV-2024-001", "Example Ltd", "$35.00"], "synth_report": ["Yearly Report", "Summary", "South grew"], "synth_table": ["North", "South", "Q3"]}


class SyntheticReader(DataSourceReader):
    """Documents first .. first + copies - 1 in equal runs; a document's bytes hang on the seed and its number alone."""

    def __init__(self, options: dict):
        self.copies, self.parts = int(options.get("copies", "3")), int(options.get("partitions", "4"))
        self.seed, self.first = int(options.get("seed", "42")), int(options.get("first", "0"))
        if self.copies < 0 or self.parts < 1:
            raise ValueError("copies must not be negative, and there must be a partition")

    def partitions(self) -> list[InputPartition]:
        cuts = [self.first + self.copies * i // self.parts for i in range(self.parts + 1)]
        return [InputPartition((a, b)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n in range(*partition.value):
            stem, pages, markdown, kind = numbered(self.seed, n)
            yield n, f"synthetic://{stem}.pdf", simple_pdf(pages), markdown, kind


class SyntheticSource(DataSource):
    """`spark.read.format("synthetic_documents")` with copies, first, partitions and seed: PDF files made in the tasks, with the Markdown that a perfect model gives."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_documents"

    def schema(self) -> str:
        return "number long, path string, content binary, markdown string, kind string"

    def reader(self, schema) -> SyntheticReader:
        return SyntheticReader(self.options)


def numbered(seed: int, n: int) -> tuple[str, list[list[str]], str, str]:
    """Document n of a seed: stem, pages, Markdown and kind. One of the three patterns, with a number of its own on every page."""
    stem = list(DOCUMENTS)[n % len(DOCUMENTS)]
    pages, markdown, kind = DOCUMENTS[stem]
    mark = f"Copy {n}-{zlib.crc32(f'{seed}:{n}'.encode()):08x}"
    return f"{stem}_{n}", [[*lines, mark] for lines in pages], f"{markdown}\n{mark}\n", kind


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SyntheticSource)


class SyntheticDocuments:
    """Writes the documents as PDF files, and their texts as ground truth."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def build(self, stem: str) -> Path:
        self.folder.mkdir(parents=True, exist_ok=True)
        at = self.folder / f"{stem}.pdf"
        at.write_bytes(simple_pdf(DOCUMENTS[stem][0]))
        return at

    def build_invoice(self) -> Path:
        return self.build("synth_invoice")

    def build_report(self) -> Path:
        return self.build("synth_report")

    def build_table(self) -> Path:
        return self.build("synth_table")

    def build_all(self) -> list[Path]:
        return [self.build(stem) for stem in DOCUMENTS]

    def write_ground_truth(self, folder: str | Path) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for stem, (_, markdown, _) in DOCUMENTS.items():
            (Path(folder) / f"{stem}.md").write_text(markdown)


def golden(stem: str) -> str:
    return DOCUMENTS[stem][1]


def canned_for(extractor, documents: dict[str, bytes]) -> dict[str, OCROutput]:
    """Each page's SHA-256 -> its document's golden text, for documents (by stem) that `extractor` can cut into pages."""
    return {hashlib.sha256(page).hexdigest(): OCROutput(golden(stem), DOCUMENTS[stem][2]) for stem, content in documents.items() for page in extractor.extract(content)}
