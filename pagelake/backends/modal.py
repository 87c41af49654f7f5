"""The serverless backend's place; there is no service behind it."""

from __future__ import annotations

from pagelake.backends.base import Backend
from pagelake.schema import OCROutput


class ModalBackend(Backend):
    name = "modal"

    def __init__(self, model: str = "modal-model", **_):
        super().__init__(model)

    def parse_image(self, image: bytes, prompt: str | None = None) -> OCROutput:
        return OCROutput(model=self.model, error="ModalBackend not yet implemented")
