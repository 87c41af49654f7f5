"""Vision-model backends behind one interface; the mock is the default and needs no network."""

from __future__ import annotations

from pagelake.backends.base import Backend
from pagelake.backends.http import ChatBackend, GeminiBackend
from pagelake.backends.mock import MockBackend
from pagelake.backends.modal import ModalBackend

#: The endpoints.
ENDPOINTS = {"openrouter": "https://openrouter.ai/api/v1", "together": "https://api.together.xyz/v1"}


def get_backend(name: str, **options) -> Backend:
    """The backend of that name, in any case; unknown names are a ValueError."""
    kind = name.lower()
    if kind == "mock":
        return MockBackend(**options)
    if kind in ENDPOINTS:
        return ChatBackend(kind, **({"base_url": ENDPOINTS[kind]} | options))
    if kind == "gemini":
        return GeminiBackend(**options)
    if kind == "modal":
        return ModalBackend(**options)
    raise ValueError(f"unknown backend {name!r}; there are mock, openrouter, together, gemini, modal")


__all__ = ["Backend", "ChatBackend", "GeminiBackend", "MockBackend", "ModalBackend", "get_backend"]
