"""A backend without a model: canned results by the page's SHA-256, or a default document."""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyarrow import dataset

from pagelake.backends.base import Backend
from pagelake.config import MOCK_MODEL
from pagelake.schema import OCROutput
from pagelake.stores import Stores

DEFAULT = OCROutput(markdown="# Mock document\n\nNo canned text for this page.", doc_type="other", confidence=1.0)


class CannedTable:
    """Canned results of a Parquet folder (sha256, ocr) in a shared store: only its name travels, and a worker reads it once, when it is first asked.

    So no result goes through the driver; a worker holds the digests of all of them."""

    def __init__(self, stores: Stores, folder: str):
        self.stores, self.folder = stores, folder
        self.places: dict[str, int] | None = None

    def get(self, digest: str, default: OCROutput) -> OCROutput:
        if self.places is None:
            store, at = self.stores.at(self.folder)
            found = dataset.dataset(at, filesystem=store, format="parquet").to_table(columns=["sha256", "ocr"])
            self.results, self.places = found["ocr"], {x: i for i, x in enumerate(found["sha256"].to_pylist())}
        i = self.places.get(digest)
        return default if i is None else OCROutput(**self.results[i].as_py())


class MockBackend(Backend):
    """`canned`: SHA-256 hex -> OCROutput, or a CannedTable. It travels with the backend, so workers have it too."""

    name = "mock"

    def __init__(self, model: str = MOCK_MODEL, canned: dict[str, OCROutput] | CannedTable | None = None, **_):
        super().__init__(model)
        self.canned = canned or {}

    def parse_image(self, image: bytes, prompt: str | None = None) -> OCROutput:
        return replace(self.canned.get(hashlib.sha256(image).hexdigest(), DEFAULT), model=self.model)
