"""Embedding of texts: an HTTP client with retries, and a deterministic embedder without a network."""

from __future__ import annotations

import json
import os
import struct
import time
import urllib.error
import urllib.request
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class HashEmbedder:
    """Unit vectors from a hash of the text: the same text, the same vector."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = b"".join(blake2b(f"{i}:{t}".encode(), digest_size=64).digest() for i in range(-(-self.dimensions // 16)))
            v = [x / 2**31 - 1 for x in struct.unpack(f"<{len(raw) // 4}I", raw)][: self.dimensions]
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out

    def ping(self) -> bool:
        return True


class HttpEmbedder:
    """POST {api_base}/embeddings in batches; failures that may pass are tried again after 1 and 4 seconds."""

    def __init__(self, config: dict, wait: float = 1.0, tries: int = 3, timeout: float = 30.0):
        self.config, self.wait, self.tries, self.timeout = config, wait, tries, timeout
        self.dimensions = config["dimensions"]

    def _post(self, texts: list[str]) -> list[list[float]]:
        c = self.config
        head = {"Content-Type": "application/json"}
        if c.get("api_key_env") and os.environ.get(c["api_key_env"]):
            head["Authorization"] = f"Bearer {os.environ[c['api_key_env']]}"
        body = json.dumps({"model": c["model"], "input": texts, "dimensions": c["dimensions"]}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{c['api_base']}/embeddings", body, head), timeout=self.timeout) as reply:
            rows = json.load(reply)["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]

    def _with_retries(self, texts: list[str]) -> list[list[float]]:
        for n in range(self.tries):
            try:
                return self._post(texts)
            except urllib.error.HTTPError as e:
                if n == self.tries - 1 or 400 <= e.code < 500 and e.code not in (408, 429):
                    raise
            except (OSError, ValueError):
                if n == self.tries - 1:
                    raise
            time.sleep(self.wait * 4**n)
        raise AssertionError

    def embed(self, texts: list[str]) -> list[list[float]]:
        n = self.config.get("batch_size") or 10
        return [v for i in range(0, len(texts), n) for v in self._with_retries(texts[i : i + n])]

    def ping(self) -> bool:
        try:
            return bool(self._post(["ping"]))
        except (OSError, ValueError, KeyError):
            return False


def prefixed(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text) if prefix else text


def _vectors(embedder, texts: list[str], skip: bool, misses: list[int]) -> list[list[float] | None]:
    """A vector a text; with ``skip``, None for those that fail alone too. After three misses in a row nothing more is asked."""
    if skip and misses[0] >= 3:
        return [None] * len(texts)
    try:
        vectors = embedder.embed(texts)
        for v in vectors:
            if len(v) != embedder.dimensions:
                raise ValueError(f"vector of {len(v)} dimensions, {embedder.dimensions} expected")
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
    except (OSError, ValueError, KeyError):
        if not skip:
            raise
        if len(texts) == 1:
            misses[0] += 1
            return [None]
        return [v for t in texts for v in _vectors(embedder, [t], skip, misses)]
    misses[0] = 0
    return vectors


def embed_column(rows: DataFrame, embedder, text: str, prefix: str = "", out: str = "embedding", rows_per_batch: int = 64, skip_failures: bool = False) -> DataFrame:
    """rows with the vector of ``text``; each task embeds Arrow batches in calls of ``rows_per_batch`` texts.

    A failing call fails the task; with ``skip_failures`` its texts are tried one by one,
    and those that still fail get null.
    """
    import pyarrow as pa

    rows = rows.withColumn("__text", prefixed(F.col(text), prefix))
    kept = [c for c in rows.columns if c not in ("__text", out)]
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(kept).dtypes)

    def task(batches):
        misses = [0]
        for batch in batches:
            for i in range(0, len(batch), rows_per_batch):
                part = batch.slice(i, rows_per_batch)
                vectors = _vectors(embedder, part.column("__text").to_pylist(), skip_failures, misses)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(vectors, pa.list_(pa.float32()))], [*kept, out])

    return rows.select(*kept, "__text").mapInArrow(task, f"{kinds}, `{out}` array<float>")
