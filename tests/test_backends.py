from __future__ import annotations

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pagelake import config
from pagelake.backends import ChatBackend, get_backend
from pagelake.backends import http as H
from pagelake.backends.http import HttpRefused, RateLimited, Retry, ServerBroke, post_json
from pagelake.schema import OCROutput

GOOD = {"choices": [{"message": {"content": "```markdown\n# T\n```"}}], "usage": {"prompt_tokens": 100, "completion_tokens": 50}}


def chat(answers, **options):
    slept = []
    it = iter(answers)

    def post(url, headers, body, timeout):
        got = next(it)
        if isinstance(got, Exception):
            raise got
        return got

    return ChatBackend("openrouter", "https://x", model="qwen/qwen3-vl-instruct", api_key="k-secret", post=post, sleep=slept.append, **options), slept


def test_factory():
    assert get_backend("MOCK").name == "mock" and get_backend("gemini", api_key="x").model == "gemini-2.0-flash"
    assert get_backend("together", api_key="x").base_url.endswith("/v1")
    with pytest.raises(ValueError):
        get_backend("nobody")
    assert get_backend("modal").parse_image(b"").error == "ModalBackend not yet implemented"


def test_mock_canned_and_default():
    backend = get_backend("mock", canned={hashlib.sha256(b"p").hexdigest(): OCROutput(markdown="canned", doc_type="invoice")})
    assert backend.parse_image(b"p").markdown == "canned" and backend.parse_image(b"p").model == "mock-model"
    assert backend.parse_image(b"unknown bytes").doc_type == "other" and backend.estimate_cost(5) == 0.0


def test_success_and_cost():
    backend, _ = chat([GOOD])
    out = backend.parse_image(b"x")
    assert (out.markdown, out.prompt_tokens, out.completion_tokens, out.error) == ("# T", 100, 50, None) and out.cost_usd == pytest.approx(100e-6 * 0.2 + 50e-6 * 0.6)


def test_missing_key(monkeypatch):
    config.reset_settings()
    monkeypatch.delenv("PAGELAKE_OPENROUTER_API_KEY", raising=False)
    assert get_backend("openrouter").parse_image(b"x").error == "missing API key"


@pytest.mark.parametrize(
    ("answers", "error", "waits"),
    [
        ([RateLimited("429"), GOOD], None, 1), ([ServerBroke("503"), RateLimited("429"), GOOD], None, 2), ([{"error": {"m": "busy"}}, GOOD], None, 1),
        ([RateLimited("429 k-secret")] * 6, "rate_limit: 429 ***", 5), ([HttpRefused(404, "no k-secret")], "http 404: no ***", 0), ([{"choices": []}], "parse: IndexError", 0), ([ValueError("odd")], "ValueError: odd", 0),
    ],
)
def test_retries_and_errors(answers, error, waits):
    backend, slept = chat(answers, retry=Retry(jitter=0))
    out = backend.parse_image(b"x")
    assert (out.error or "").startswith(error or "") and (out.error is None) == (error is None) and len(slept) == waits
    assert slept == [min(60.0, 2.0 * 2**i) for i in range(waits)]


def test_settings(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# c\nPAGELAKE_DEFAULT_BACKEND=gemini\nPAGELAKE_LOG_COSTS='1'\nOTHER=x\nPAGELAKE_GEMINI_API_KEY=abc\n")
    own = config.load_settings({"PAGELAKE_DEFAULT_BACKEND": "mock"}, env)
    assert own.default_backend == "mock" and own.log_costs and own.key_for("gemini") == "abc" and "abc" not in repr(own)


def test_output_rules():
    with pytest.raises(ValueError):
        OCROutput(doc_type="poem")
    with pytest.raises(ValueError):
        OCROutput(confidence=1.5)


@pytest.fixture
def server():
    """Answers by path: /200 with what was sent, /429 and so on with an error; /close ends the connection after its answer."""
    opened = []

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            opened.append(1)
            super().setup()

        def do_POST(self):
            sent = self.rfile.read(int(self.headers["Content-Length"]))
            code = 200 if self.path == "/close" else int(self.path[1:4])
            body = json.dumps({"sent": json.loads(sent), "key": self.headers["X-Key"]}).encode() if code == 200 else b"x" * 300
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
            self.close_connection = self.path == "/close"

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    H.connections.idle.clear()
    yield f"http://127.0.0.1:{httpd.server_port}", opened
    httpd.shutdown()


def test_one_connection_for_many_calls(server):
    url, opened = server
    for i in range(5):
        assert post_json(f"{url}/200?a=1", {"X-Key": "k"}, {"i": i}, 5) == {"sent": {"i": i}, "key": "k"}
    assert len(opened) == 1
    assert post_json(f"{url}/close", {}, {}, 5)["sent"] == {} and post_json(f"{url}/200", {}, {"again": 1}, 5)["sent"] == {"again": 1}
    assert len(opened) == 2  # a closed connection is opened again
    for path, kind, text in (("429", RateLimited, "429 " + "x" * 120), ("503", ServerBroke, "503 " + "x" * 120), ("404", HttpRefused, "x" * 200)):
        with pytest.raises(kind) as e:
            post_json(f"{url}/{path}", {}, {}, 5)
        assert str(e.value) == text
    with pytest.raises(ServerBroke):
        post_json("http://127.0.0.1:9/200", {}, {}, 1)
