"""Model backends: servers that speak the common chat and embedding protocol, and local encoders imported when used.

Each is built once for a partition (pass a factory to ``models.generate`` or ``models.embed``), so clients and weights
never travel with tasks.
"""

from __future__ import annotations

import json
import os
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from spanlens.functions.models import Answer, Echo, HashEmbedding, retried


def _post(url: str, body: dict, key: str | None, timeout: float) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


@dataclass
class ChatServer:
    """A hosted or local chat server; prompts of a batch are in flight together, each tried ``tries`` times."""

    base_url: str
    model: str
    key_variable: str | None = None
    temperature: float = 0.0
    top_p: float = 1.0
    max_tokens: int = 1024
    stop: tuple[str, ...] = ()
    response_format: str | None = None
    seed: int | None = 42
    threads: int = 16
    tries: int = 3
    pause: float = 1.0
    timeout: float = 120.0

    def _one(self, prompt: str, logprobs: bool = False) -> Answer:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "top_p": self.top_p, "max_tokens": self.max_tokens}
        if self.stop:
            body["stop"] = list(self.stop)
        if self.response_format:
            body["response_format"] = {"type": self.response_format}
        if self.seed is not None:
            body["seed"] = self.seed
        if logprobs:
            body["logprobs"] = True
        key = os.environ.get(self.key_variable) if self.key_variable else None
        choice = _post(f"{self.base_url}/chat/completions", body, key, self.timeout)["choices"][0]
        found = (choice.get("logprobs") or {}).get("content")
        return Answer(choice["message"]["content"], None if found is None else [x["logprob"] for x in found])

    def answers(self, prompts: list[str], logprobs: bool = True) -> list[Answer]:
        with ThreadPoolExecutor(self.threads) as pool:
            return list(pool.map(lambda p: retried(self._one, p, logprobs, tries=self.tries, pause=self.pause), prompts))

    def generate(self, prompts: list[str]) -> list[str]:
        return [x.text for x in self.answers(prompts, logprobs=False)]


@contextmanager
def local_server(command: list[str], base_url: str, patience: float = 600.0, pause: float = 2.0) -> Iterator[str]:
    """Run a model server as a process of the driver while inside, from when it answers at ``base_url``/models on.

    Executors of other machines need an address of the driver in ``base_url``. A server that ends before it answers, or
    doesn't answer within ``patience`` seconds, raises.
    """
    process = subprocess.Popen(command)
    try:
        end = time.monotonic() + patience
        while True:
            if process.poll() is not None:
                raise RuntimeError(f"the server ended with code {process.returncode}")
            try:
                urllib.request.urlopen(f"{base_url}/models", timeout=10).close()
                break
            except urllib.error.HTTPError:
                break  # it answers, if not to this
            except OSError as e:
                if time.monotonic() > end:
                    raise TimeoutError(f"no answer at {base_url}") from e
                time.sleep(pause)
        yield base_url
    finally:
        process.terminate()
        try:
            process.wait(30)
        except subprocess.TimeoutExpired:
            process.kill()


@dataclass
class EmbeddingServer:
    base_url: str
    model: str
    key_variable: str | None = None
    timeout: float = 120.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        key = os.environ.get(self.key_variable) if self.key_variable else None
        data = _post(f"{self.base_url}/embeddings", {"model": self.model, "input": texts}, key, self.timeout)["data"]
        return [row["embedding"] for row in sorted(data, key=lambda row: row["index"])]


class SentenceEncoder:
    """Local sentence vectors."""

    def __init__(self, name: str) -> None:
        from sentence_transformers import SentenceTransformer

        self.model = SentenceTransformer(name)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v.tolist() for v in self.model.encode(texts)]


class TokenEncoder:
    """Local vectors of single tokens out of context: the mean over all their sub-tokens, special ones included.

    ``contextual`` gives sub-token vectors and character offsets of whole sentences instead.
    """

    def __init__(self, name: str) -> None:
        import torch
        from transformers import AutoModel, AutoTokenizer

        self.torch, self.tokenizer, self.model = torch, AutoTokenizer.from_pretrained(name), AutoModel.from_pretrained(name).eval()

    def _states(self, texts: list[str]):
        parts = self.tokenizer(texts, return_tensors="pt", padding=True, truncation=True, return_offsets_mapping=True)
        offsets = parts.pop("offset_mapping")
        with self.torch.no_grad():
            return self.model(**parts).last_hidden_state, parts["attention_mask"], offsets

    def embed(self, texts: list[str]) -> list[list[float]]:
        states, mask, _ = self._states(texts)
        return ((states * mask[..., None]).sum(1) / mask.sum(1, keepdim=True)).tolist()

    def contextual(self, texts: list[str]) -> list[list[tuple[int, int, list[float]]]]:
        states, mask, offsets = self._states(texts)
        return [[(int(a), int(b), v.tolist()) for v, m, (a, b) in zip(s, k, o, strict=True) if m] for s, k, o in zip(states, mask, offsets, strict=True)]


CHAT: dict[str, Callable] = {"server": ChatServer, "echo": lambda **_: Echo()}
EMBEDDINGS: dict[str, Callable] = {"server": EmbeddingServer, "sentence": SentenceEncoder, "token": TokenEncoder, "hash": lambda **_: HashEmbedding()}


def factory(kinds: dict[str, Callable], kind: str, **how) -> Callable:
    """A factory to be called on the executors; unknown kinds raise here, on the driver."""
    if kind not in kinds:
        raise ValueError(f"unknown backend {kind}; known: {', '.join(sorted(kinds))}")
    make = kinds[kind]
    return lambda: make(**how)
