import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from spanlens.config import Options
from spanlens.functions import backends, models
from spanlens.sources import cache


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            if self.path.endswith("/embeddings"):
                out = {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])][::-1]}
            elif len(seen) == 1:
                self.send_error(500)
                return
            else:
                out = {"choices": [{"message": {"content": body["messages"][0]["content"].upper()}}]}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/v1", seen
    http.shutdown()


def test_servers_retry_and_keep_order(spark, server):
    url, seen = server
    chat = backends.ChatServer(url, "m", threads=1, pause=0.0, stop=("x",), response_format="json_object")
    assert chat.generate(["a", "b"]) == ["A", "B"] and len(seen) == 3 and seen[-1]["stop"] == ["x"] and seen[-1]["response_format"] == {"type": "json_object"}
    rows = spark.createDataFrame([(1, "ab\nc"), (2, "d")], "key long, text string").coalesce(1)
    got = {r["key"]: r["out"] for r in models.embed(rows, backends.factory(backends.EMBEDDINGS, "server", base_url=url, model="e")).collect()}
    assert got == {1: [4.0], 2: [1.0]} and seen[-1]["input"] == ["ab c", "d"]
    with pytest.raises(ValueError):
        backends.factory(backends.CHAT, "nothing")


def test_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/t"
    assert cache.cached(spark, path, make).count() == 3 and cache.cached(spark, path, make).count() == 3 and len(made) == 1
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, sentence string")
    assert cache.fingerprint(one) == cache.fingerprint(one.orderBy("sentence", ascending=False)) != cache.fingerprint(one.limit(1))
    assert cache.retrieval_path("r", Options(), "test", "a/b", "f") != cache.retrieval_path("r", Options(), "dev", "a/b", "f")
    assert "a-b" in cache.embedding_path("r", "t", "test", "a/b", "f")


class Scored:
    """A model that gives log-probabilities, too."""

    def answers(self, prompts):
        return [models.Answer(p.upper(), [-0.5, -1.0]) for p in prompts]


def test_logprobs(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "key long, text string")
    got = sorted(map(tuple, models.generate(rows, Scored, logprobs=True).collect()))
    assert got == [(1, "A", None, [-0.5, -1.0]), (2, "B", None, [-0.5, -1.0])]
    failed = models.generate(rows, models.Echo, logprobs=True, pause=0.0).collect()  # Echo has none: a column of errors, not a failed run
    assert all(r["error"] and r["out"] is None and r["logprobs"] is None for r in failed)


def test_local_server_is_awaited_and_stopped():
    import socket
    import sys
    import urllib.request

    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        url = f"http://127.0.0.1:{s.getsockname()[1]}"
    with backends.local_server([sys.executable, "-m", "http.server", url.rsplit(":", 1)[1], "--bind", "127.0.0.1"], url, pause=0.1):
        assert urllib.request.urlopen(url, timeout=5).status == 200
    with pytest.raises(OSError):
        urllib.request.urlopen(url, timeout=5)
    with pytest.raises(RuntimeError):
        with backends.local_server([sys.executable, "-c", "raise SystemExit(3)"], url, pause=0.1):
            pass
