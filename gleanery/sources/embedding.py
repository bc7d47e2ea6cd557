"""Embedding services over HTTP: OpenAI-compatible, or a model hub's feature extraction."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

# Seconds to wait for a reply, tries, pause that grows with each, replies worth another try.
TIMEOUT, TRIES, PAUSE, AGAIN = 120.0, 3, 1.5, (429, 500, 502, 503, 504)


class EmbeddingError(RuntimeError):
    pass


@dataclass(frozen=True)
class Service:
    model: str = ""
    base_url: str = ""
    api_key: str = ""
    dims: int = 0
    batch_size: int = 64
    threads: int = 2
    provider: str = "openai"

    @property
    def configured(self) -> bool:
        return bool(self.model and self.base_url)

    def _ask(self, url: str, payload: dict | None = None):
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        data = None if payload is None else json.dumps(payload, ensure_ascii=False).encode()
        for n in range(1, TRIES + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, data=data, headers=head), timeout=TIMEOUT) as reply:
                    return json.loads(reply.read())
            except urllib.error.HTTPError as e:
                said, last = f"{url} answers {e.code}: {e.read().decode('utf-8', 'replace')}", e.code not in AGAIN
            except urllib.error.URLError as e:
                said, last = f"{url} cannot be reached: {e.reason}", False
            if last or n == TRIES:
                raise EmbeddingError(said)
            time.sleep(PAUSE * n)
        return None

    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text, checked for number and width."""
        if not texts:
            return []
        if not self.configured:
            raise EmbeddingError("no model or address is set")
        root = self.base_url.rstrip("/")
        if self.provider.strip().lower() == "hf":
            got = self._ask(f"{root}/{self.model}/pipeline/feature-extraction", {"inputs": texts})
            got = [got] if isinstance(got, list) and got and isinstance(got[0], float) else got
            if not isinstance(got, list) or not got or not isinstance(got[0], list):
                raise EmbeddingError("the reply is no list of vectors")
        else:
            got = self._ask(f"{root}/embeddings", {"model": self.model, "input": texts})
            if not isinstance(got, dict):
                raise EmbeddingError("the reply is no record")
            got = [x["embedding"] for x in got.get("data") or []]
        if len(got) != len(texts):
            raise EmbeddingError(f"{len(got)} vectors came for {len(texts)} texts")
        if self.dims and len(got[0]) != self.dims:
            raise EmbeddingError(f"vectors have {len(got[0])} numbers, not {self.dims}")
        return got

    def models(self) -> list[str]:
        reply = self._ask(f"{self.base_url.rstrip('/')}/models")
        return [m["id"] for m in (reply or {}).get("data") or []]

    def client(self) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
        """What :func:`gleanery.operators.incremental.embed_pending` makes once a task."""
        return lambda: self.embed
