"""HTTP backends over the standard library, with retries. Keys go into headers, never into URLs or error texts."""

from __future__ import annotations

import base64
import http.client
import json
import random
import threading
import time
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass

from pagelake.backends.base import Backend, clean_answer
from pagelake.config import settings
from pagelake.functions.models import chat_request, estimate_cost, prompt_for, sampling_for
from pagelake.schema import OCROutput


class RateLimited(Exception):
    """HTTP 429, or a 200 whose body holds an error in place of an answer."""


class ServerBroke(Exception):
    """HTTP 5xx, or no connection."""


class HttpRefused(Exception):
    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


@dataclass(frozen=True)
class Retry:
    attempts: int = 6
    least: float = 2.0
    most: float = 60.0
    jitter: float = 0.1

    def wait(self, attempt: int) -> float:
        return min(self.most, max(self.least, 2.0 * 2**attempt)) * (1 + random.uniform(0, self.jitter))


class Connections:
    """Open connections by server, taken by one call at a time: a worker opens as many as it has calls at once."""

    def __init__(self):
        self.idle: dict[tuple[str, str], list[http.client.HTTPConnection]] = {}
        self.lock = threading.Lock()

    def take(self, scheme: str, host: str, timeout: float) -> tuple[http.client.HTTPConnection, bool]:
        """A connection, and whether it has been used before."""
        with self.lock:
            held = self.idle.get((scheme, host))
            if held:
                one = held.pop()
                one.timeout = timeout
                one.sock.settimeout(timeout)
                return one, True
        kind = http.client.HTTPSConnection if scheme == "https" else http.client.HTTPConnection
        return kind(host, timeout=timeout), False

    def give(self, scheme: str, host: str, one: http.client.HTTPConnection) -> None:
        if one.sock is not None:  # the server may have asked to close it
            with self.lock:
                self.idle.setdefault((scheme, host), []).append(one)


connections = Connections()


def exchange(url: str, headers: dict[str, str], raw: bytes, timeout: float) -> tuple[int, bytes]:
    """Status and body. Where the server has closed a kept connection meanwhile, the next one is taken."""
    at = urllib.parse.urlsplit(url)
    target = at.path + (f"?{at.query}" if at.query else "")
    while True:
        one, used = connections.take(at.scheme, at.netloc, timeout)
        try:
            one.request("POST", target, raw, headers)
            response = one.getresponse()
            got = response.status, response.read()
        except (http.client.HTTPException, OSError) as e:
            one.close()
            if not used or isinstance(e, TimeoutError):
                raise
        else:
            connections.give(at.scheme, at.netloc, one)
            return got


def post_json(url: str, headers: dict[str, str], body: dict, timeout: float) -> dict:
    try:
        code, raw = exchange(url, {"Content-Type": "application/json", **headers}, json.dumps(body).encode(), timeout)
    except (http.client.HTTPException, OSError) as e:
        raise ServerBroke(str(e) or type(e).__name__) from None
    if 200 <= code < 300:
        return json.loads(raw)
    text = raw.decode(errors="replace")
    if code == 429:
        raise RateLimited(f"429 {text[:120]}")
    if code >= 500:
        raise ServerBroke(f"{code} {text[:120]}")
    raise HttpRefused(code, text[:200])


class HttpBackend(Backend):
    """Request, retries, and errors as texts; the subclasses know the bodies."""

    def __init__(self, model: str, api_key: str | None = None, timeout: float = 60.0, retry: Retry | None = None, post: Callable[..., dict] = post_json, sleep: Callable[[float], None] = time.sleep):
        super().__init__(model)
        self.api_key = api_key if api_key is not None else settings().key_for(self.name)
        self.timeout, self.retry, self.post, self.sleep = timeout, retry or Retry(), post, sleep

    def request(self, image: bytes, prompt: str) -> tuple[str, dict[str, str], dict]:
        raise NotImplementedError

    def answer(self, body: dict) -> tuple[str, int, int]:
        raise NotImplementedError

    def _call(self, image: bytes, prompt: str) -> dict:
        url, headers, body = self.request(image, prompt)
        for attempt in range(self.retry.attempts):
            try:
                got = self.post(url, headers, body, self.timeout)
                if isinstance(got, dict) and got.get("error") and not got.get("choices") and not got.get("candidates"):
                    raise RateLimited(json.dumps(got["error"])[:120])
                return got
            except (RateLimited, ServerBroke):
                if attempt == self.retry.attempts - 1:
                    raise
                self.sleep(self.retry.wait(attempt))
        raise AssertionError("no attempt was made")

    def parse_image(self, image: bytes, prompt: str | None = None) -> OCROutput:
        if not self.api_key:
            return OCROutput(model=self.model, error="missing API key")
        try:
            body = self._call(image, prompt_for(self.model, prompt))
        except RateLimited as e:
            return OCROutput(model=self.model, error=self.hide(f"rate_limit: {e}"))
        except HttpRefused as e:
            return OCROutput(model=self.model, error=self.hide(f"http {e.code}: {e}"))
        except Exception as e:  # whatever happens to one page stays with it
            return OCROutput(model=self.model, error=self.hide(f"{type(e).__name__}: {e}"))
        try:
            text, n_in, n_out = self.answer(body)
        except (KeyError, IndexError, TypeError) as e:
            return OCROutput(model=self.model, error=f"parse: {type(e).__name__} {e}")
        return OCROutput(clean_answer(text), "unknown", 1.0, n_in, n_out, estimate_cost(self.model, n_in, n_out), self.model)

    def hide(self, text: str) -> str:
        return text.replace(self.api_key, "***")


class ChatBackend(HttpBackend):
    """Chat completions with an image; `name` also names the key in the settings."""

    def __init__(self, name: str, base_url: str, model: str = "deepseek-ai/DeepSeek-OCR-v2", extra_headers: dict[str, str] | None = None, **options):
        self.name = name
        super().__init__(model, **options)
        self.base_url, self.extra_headers = base_url.rstrip("/"), extra_headers or {}

    def request(self, image: bytes, prompt: str) -> tuple[str, dict[str, str], dict]:
        uri = "data:image/png;base64," + base64.b64encode(image).decode()
        return f"{self.base_url}/chat/completions", {"Authorization": f"Bearer {self.api_key}", **self.extra_headers}, chat_request(self.model, prompt, uri)

    def answer(self, body: dict) -> tuple[str, int, int]:
        usage = body.get("usage") or {}
        return body["choices"][0]["message"]["content"], int(usage.get("prompt_tokens") or 0), int(usage.get("completion_tokens") or 0)


class GeminiBackend(HttpBackend):
    name = "gemini"

    def __init__(self, model: str = "gemini-2.0-flash", base_url: str = "https://generativelanguage.googleapis.com/v1beta", **options):
        super().__init__(model, **options)
        self.base_url = base_url.rstrip("/")

    def request(self, image: bytes, prompt: str) -> tuple[str, dict[str, str], dict]:
        sampling = sampling_for(self.model)
        parts = [{"text": prompt}, {"inline_data": {"mime_type": "image/png", "data": base64.b64encode(image).decode()}}]
        settings_ = {"temperature": sampling["temperature"], "maxOutputTokens": sampling["max_tokens"], "topP": sampling["top_p"]}
        return f"{self.base_url}/models/{self.model}:generateContent", {"x-goog-api-key": self.api_key}, {"contents": [{"parts": parts}], "generationConfig": settings_}

    def answer(self, body: dict) -> tuple[str, int, int]:
        usage = body.get("usageMetadata") or {}
        return body["candidates"][0]["content"]["parts"][0]["text"], int(usage.get("promptTokenCount") or 0), int(usage.get("candidatesTokenCount") or 0)
