"""What every backend offers, and the plain-Python cleaning of answers (its column twin is functions.text.clean_markdown)."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod

from pagelake.functions.models import page_estimate
from pagelake.schema import OCROutput

#: Fixed values, as in functions.text.
FENCE = re.compile(r"\A```(?:markdown|md)?\s*\n(.*?)\n```\s*\Z", re.S)
OPENINGS = [re.compile(p, re.I) for p in (r"\A\s*here(?:'s| is)[^.\n:]*[.:]\s*", r"\A\s*sure[!,]?[^.\n:]*[.:]\s*", r"\A\s*of course[!,]?[^.\n:]*[.:]\s*")]


def clean_answer(text: str | None) -> str:
    out = (text or "").strip()
    if fenced := FENCE.search(out):
        out = fenced[1].strip()
    for opening in OPENINGS:
        out = opening.sub("", out)
    return out.strip()


class Backend(ABC):
    """`parse_image` returns a result in every case: what goes wrong stands in its `error`."""

    name = "abstract"

    def __init__(self, model: str):
        self.model = model

    @abstractmethod
    def parse_image(self, image: bytes, prompt: str | None = None) -> OCROutput: ...

    def estimate_cost(self, pages: int) -> float:
        return page_estimate(self.model, pages, self.name)
