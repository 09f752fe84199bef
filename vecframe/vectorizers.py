"""Text vectorizers: the protocol, a deterministic local one, hosted ones over HTTP, and a DataFrame adapter."""

from __future__ import annotations

import json
import math
import re
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


@runtime_checkable
class Vectorizer(Protocol):
    def vectorize(self, text: str) -> list[float]: ...


def vectorize_many(vectorizer: Vectorizer, texts: Sequence[str]) -> list[list[float]]:
    """By the vectorizer's own batches if it has any, else one text at a time; no texts give no vectors."""
    if not texts:
        return []
    batch = getattr(vectorizer, "vectorize_batch", None)
    out = batch(list(texts)) if batch else [vectorizer.vectorize(t) for t in texts]
    if len(out) != len(texts):
        raise ValueError(f"{len(out)} vectors came for {len(texts)} texts")
    return out


class HashingVectorizer:
    """Unit vectors of hashed words and character trigrams: the same everywhere, without a model."""

    def __init__(self, dims: int = 64) -> None:
        if dims <= 0:
            raise ValueError("dims must be positive")
        self.dims = dims

    def vectorize(self, text: str) -> list[float]:
        v = np.zeros(self.dims)
        for word in re.findall(r"\w+", text.lower()):
            padded = f" {word} "
            for piece in (word, *(padded[i : i + 3] for i in range(len(padded) - 2))):
                h = xxhash.xxh64_intdigest(piece)
                v[h % self.dims] += 1 if h >> 63 else -1
        size = math.sqrt(float(v @ v))
        return (v / size if size else v).tolist()


Post = Callable[[str, dict[str, str], dict[str, Any]], Any]


def http_post(url: str, headers: dict[str, str], body: dict[str, Any]) -> Any:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=60) as response:
        return json.loads(response.read())


def _checked(texts: Sequence[str]) -> list[str]:
    for i, t in enumerate(texts):
        if not isinstance(t, str) or not t.strip():
            raise ValueError(f"text {i} is blank")
    return list(texts)


class EmbeddingsApiVectorizer:
    """A hosted service with the widespread ``/embeddings`` request: model, input, and optional dimensions and user."""

    def __init__(self, url: str, api_key: str, model: str, dimensions: int | None = None, user: str | None = None, post: Post = http_post) -> None:
        if dimensions is not None and dimensions <= 0:
            raise ValueError("dimensions must be positive")
        self.url, self.api_key, self.model, self.dimensions, self.user, self.post = url, api_key, model, dimensions, user, post

    def vectorize(self, text: str) -> list[float]:
        return self.vectorize_batch([text])[0]

    def vectorize_batch(self, texts: Sequence[str]) -> list[list[float]]:
        body = {"model": self.model, "input": _checked(texts)}
        body |= {k: v for k, v in (("dimensions", self.dimensions), ("user", self.user)) if v is not None}
        data = sorted(self.post(self.url, {"Authorization": f"Bearer {self.api_key}"}, body)["data"], key=lambda x: x["index"])
        if len(data) != len(texts):
            raise ValueError(f"{len(data)} vectors came for {len(texts)} texts")
        return [list(map(float, x["embedding"])) for x in data]


class FeatureExtractionVectorizer:
    """A hosted service for feature extraction: inputs, and optional normalize, prompt name and truncation."""

    def __init__(self, url: str, api_key: str, normalize: bool | None = None, prompt_name: str | None = None, truncate: bool | None = None, direction: str | None = None, post: Post = http_post) -> None:
        if direction not in (None, "left", "right"):
            raise ValueError("the direction is left or right")
        self.url, self.api_key, self.post = url, api_key, post
        self.options = {k: v for k, v in (("normalize", normalize), ("prompt_name", prompt_name), ("truncate", truncate), ("truncation_direction", direction)) if v is not None}

    def vectorize(self, text: str) -> list[float]:
        return self.vectorize_batch([text])[0]

    def vectorize_batch(self, texts: Sequence[str]) -> list[list[float]]:
        got = self.post(self.url, {"Authorization": f"Bearer {self.api_key}"}, {"inputs": _checked(texts)} | self.options)
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} vectors came for {len(texts)} texts")
        return [list(map(float, v)) for v in got]


def vector_column(text: Column, vectorizer: Vectorizer) -> Column:
    """The vector of each text, in Arrow batches; null of a null text."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            known = b.notna()
            vectors = iter(vectorize_many(vectorizer, b[known].tolist()))
            yield pd.Series([next(vectors) if k else None for k in known])

    return run(text)
