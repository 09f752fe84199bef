"""The embeddings cache, by exact key, and the semantic cache, by nearness."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecframe.plans.filters import Node
from vecframe.plans.queries import Page, RangeQuery
from vecframe.schema import Field, IndexDefinition, Metric, SearchSchema, TextField, VectorField, VectorType
from vecframe.sources.index import SearchIndex
from vecframe.sources.store import KEY, DocumentStore
from vecframe.vectorizers import Vectorizer


def _text(value: str, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} must not be blank")
    return value


def _ttl(ttl: float | None) -> float | None:
    if ttl is not None and not ttl > 0:
        raise ValueError("a time to live must be positive")
    return ttl


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class CachedEmbedding:
    key: str
    input: str
    model_name: str | None
    embedding: list[float]
    metadata: Any = None


class EmbeddingsCache:
    """Embeddings by the hash of their input and model; a hit must also match these, so a collision is a miss."""

    SCHEMA = f"{KEY} string, input string, model_name string, embedding array<double>, metadata string"

    def __init__(self, spark: SparkSession, warehouse: str, name: str, namespace: str | None = None, ttl: float | None = None) -> None:
        self.prefix = f"embeddings:{_text(name, 'the name').strip()}:" + (f"{_text(namespace, 'the namespace').strip()}:" if namespace is not None else "")
        self.spark, self.ttl = spark, _ttl(ttl)
        self.store = DocumentStore(spark, f"{warehouse}/embeddings/{self.prefix.encode().hex()}")

    def key(self, text: str, model: str | None = None) -> str:
        _text(text, "the input")
        return self.prefix + sha256(text if model is None else f"{text}\n{model}")

    def key_column(self, text: Column, model: Column | None = None) -> Column:
        return F.concat(F.lit(self.prefix), F.sha2(text if model is None else F.concat_ws("\n", text, model), 256))

    def set_many(self, entries: Sequence[tuple[str, Sequence[float], str | None, Any]], ttl: float | None = None) -> list[CachedEmbedding]:
        """Entries of (input, embedding, model, metadata), stored in one write and returned in order."""
        out = [CachedEmbedding(self.key(t, m), t, m, list(map(float, v)), meta) for t, v, m, meta in entries]
        rows = [(e.key, e.input, e.model_name or "", e.embedding, None if e.metadata is None else json.dumps(e.metadata)) for e in out]
        if rows:
            self.set_frame(self.spark.createDataFrame(rows, self.SCHEMA), ttl)
        return out

    def set(self, text: str, embedding: Sequence[float], model: str | None = None, metadata: Any = None, ttl: float | None = None) -> CachedEmbedding:
        return self.set_many([(text, embedding, model, metadata)], ttl)[0]

    def set_frame(self, rows: DataFrame, ttl: float | None = None) -> None:
        ttl = _ttl(ttl) if ttl is not None else self.ttl
        self.store.merge(rows, ttl=ttl)

    def get_many(self, requests: Sequence[tuple[str, str | None]]) -> list[CachedEmbedding | None]:
        """What is stored for each (input, model), in order; None where nothing is."""
        keys = [self.key(t, m) for t, m in requests]
        if not keys or not self.store.exists():
            return [None] * len(keys)
        found = {r[KEY]: r for r in self.store.get(keys).collect()}
        return [self._entry(found.get(k), t, m) for k, (t, m) in zip(keys, requests)]

    @staticmethod
    def _entry(row: Any, text: str | None, model: str | None) -> CachedEmbedding | None:
        if row is None or row["input"] is None or row["embedding"] is None:
            return None
        if text is not None and (row["input"] != text or (row["model_name"] or None) != model):
            return None
        return CachedEmbedding(row[KEY], row["input"], row["model_name"] or None, list(row["embedding"]), json.loads(row["metadata"]) if row["metadata"] else None)

    def get(self, text: str, model: str | None = None) -> CachedEmbedding | None:
        return self.get_many([(text, model)])[0]

    def get_by_key(self, key: str) -> CachedEmbedding | None:
        if not self.store.exists():
            return None
        rows = self.store.get([key]).collect()
        return self._entry(rows[0] if rows else None, None, None)

    def lookup_frame(self, requests: DataFrame, text: str, model: str | None = None, now: Column | None = None) -> DataFrame:
        """Every request with its embedding and metadata, null where nothing is stored or what is stored has expired."""
        m = F.col(model) if model else None
        asked = requests.withColumn(KEY, self.key_column(F.col(text), m))
        stored = self.store.read(now).select(KEY, F.col("input").alias("_input"), F.col("model_name").alias("_model"), "embedding", "metadata")
        same = (F.col("_input") == F.col(text)) & (F.col("_model") == (F.coalesce(m, F.lit("")) if model else F.lit("")))
        hit = asked.join(stored, KEY, "left")
        return hit.withColumn("embedding", F.when(same, F.col("embedding"))).withColumn("metadata", F.when(same, F.col("metadata"))).drop("_input", "_model")

    def exists_frame(self, requests: DataFrame, text: str, model: str | None = None) -> DataFrame:
        """The requests for which an embedding is stored."""
        return self.lookup_frame(requests, text, model).where("embedding is not null").select(*requests.columns)

    def delete_frame(self, requests: DataFrame, text: str, model: str | None = None) -> int:
        """Delete what is stored for the requests; how many entries were there."""
        asked = requests.select(self.key_column(F.col(text), F.col(model) if model else None).alias(KEY))
        return self.store.delete_frame(asked)

    def exists_many(self, requests: Sequence[tuple[str, str | None]]) -> list[bool]:
        keys = [self.key(t, m) for t, m in requests]
        if not keys or not self.store.exists():
            return [False] * len(keys)
        found = {r[0] for r in self.store.get(keys).select(KEY).collect()}
        return [k in found for k in keys]

    def exists(self, text: str, model: str | None = None) -> bool:
        return self.exists_many([(text, model)])[0]

    def delete_many(self, requests: Sequence[tuple[str, str | None]]) -> int:
        keys = list({self.key(t, m) for t, m in requests})
        return self.store.delete(keys) if keys and self.store.exists() else 0

    def delete(self, text: str, model: str | None = None) -> bool:
        return self.delete_many([(text, model)]) > 0


@dataclass(frozen=True)
class CacheHit:
    prompt: str
    response: str
    distance: float
    metadata: Any = None
    key: str | None = None


class SemanticCache:
    """Answers by the nearness of their prompts: a check finds the nearest one within the threshold, whatever its words."""

    RESERVED = ("prompt", "response", "metadata", "embedding", "distance")

    def __init__(self, spark: SparkSession, warehouse: str, name: str, dims: int, threshold: float, namespace: str | None = None, ttl: float | None = None, metric: Metric = Metric.COSINE, filterable: Sequence[Field] = (), names: dict[str, str] | None = None) -> None:
        if not (math.isfinite(threshold) and threshold > 0):
            raise ValueError("the threshold must be finite and positive")
        own = {k: k for k in self.RESERVED[:4]} | {k: _text(v, f"the name of {k}").strip() for k, v in (names or {}).items()}
        if set(own) != set(self.RESERVED[:4]) or len(set(own.values())) != 4:
            raise ValueError(f"names are for {', '.join(self.RESERVED[:4])}, each its own")
        self.names = own
        for f in filterable:
            if f.name in own.values():
                raise ValueError(f"field {f.name} can't be filtered by")
            if f.kind not in ("tag", "text", "numeric") or f.alias or f.name in self.RESERVED:
                raise ValueError(f"field {f.name} can't be filtered by")
        self.prefix = f"semantic:{_text(name, 'the name').strip()}:" + (f"{_text(namespace, 'the namespace').strip()}:" if namespace is not None else "")
        self.threshold, self.ttl, self.filterable = threshold, _ttl(ttl), {f.name: f for f in filterable}
        fields = (TextField(own["prompt"]), TextField(own["response"]), TextField(own["metadata"]), *filterable, VectorField(own["embedding"], dims=dims, metric=metric, datatype=VectorType.FLOAT32))
        index_name = "semantic-cache:" + self.prefix.removeprefix("semantic:").rstrip(":")
        self.index = SearchIndex(spark, warehouse, SearchSchema(IndexDefinition(index_name, (self.prefix,)), fields))

    def create(self, overwrite: bool = False, skip_if_exists: bool = True) -> bool:
        if skip_if_exists and not overwrite and (entry := self.index.catalog.get(self.index.name)):
            if SearchSchema.from_dict(entry["schema"]) != self.index.schema:
                raise ValueError("a cache of this name with another schema exists")
        return self.index.create(overwrite=overwrite, skip_if_exists=skip_if_exists and not overwrite)

    def exists(self) -> bool:
        return self.index.exists()

    def drop(self, delete_documents: bool = False) -> bool:
        return self.index.drop(delete_documents)

    def _filters(self, values: dict[str, Any]) -> dict[str, Any]:
        out = {}
        for name in sorted(values):
            f, v = self.filterable.get(name), values[name]
            if f is None:
                raise ValueError(f"unknown filter field: {name}")
            if f.kind == "numeric":
                if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v):
                    raise ValueError(f"{name} must be a finite number")
            elif f.kind == "tag":
                items = [v] if isinstance(v, str) else list(v)
                if not items or any(not isinstance(x, str) or not x.strip() or f.separator in x for x in items):
                    raise ValueError(f"{name} must be tags without the separator")
                v = v if isinstance(v, str) else items
            elif not isinstance(v, str) or not v.strip():
                raise ValueError(f"{name} must be a text")
            out[name] = v
        return out

    def key(self, prompt: str, filters: dict[str, Any] | None = None) -> str:
        text = _text(prompt, "the prompt")
        return self.prefix + sha256(text + ("\n" + json.dumps(filters, ensure_ascii=False, separators=(",", ":")) if filters else ""))

    def store(self, prompt: str, response: str, embedding: Sequence[float] | None = None, metadata: Any = None, filters: dict[str, Any] | None = None, ttl: float | None = None, vectorizer: Vectorizer | None = None) -> str:
        values = self._filters(filters or {})
        vector = list(embedding) if embedding is not None else vectorizer.vectorize(prompt)
        n = self.names
        f = self.index.schema.resolve(n["embedding"])
        if len(vector) != f.dims:
            raise ValueError(f"the embedding needs {f.dims} parts")
        key = self.key(prompt, values)
        doc = {n["prompt"]: prompt, n["response"]: _text(response, "the response"), n["metadata"]: None if metadata is None else json.dumps(metadata), n["embedding"]: vector} | values
        self.index.load_frame(self.index._rows([(key, doc)]), ttl=_ttl(ttl) if ttl is not None else self.ttl)
        return key

    def check(self, prompt: str | None = None, embedding: Sequence[float] | None = None, filter: Node | None = None, threshold: float | None = None, vectorizer: Vectorizer | None = None) -> CacheHit | None:  # noqa: A002
        if filter is not None and not self.filterable:
            raise ValueError("the cache has no fields to filter by")
        vector = embedding if embedding is not None else vectorizer.vectorize(_text(prompt, "the prompt"))
        n = self.names
        query = RangeQuery(n["embedding"], vector, threshold or self.threshold, filter, (n["prompt"], n["response"], n["metadata"]), "distance", page=Page(0, 1))
        rows = self.index.planner().search(query).collect()
        if not rows:
            return None
        r = rows[0]
        meta = r[n["metadata"]]
        return CacheHit(r[n["prompt"]], r[n["response"]], r["distance"], json.loads(meta) if meta else None, r[KEY])

    def check_frame(self, requests: DataFrame, request_id: str, vector: str, filter: Node | None = None, k: int = 1) -> DataFrame:  # noqa: A002
        """The ``k`` nearest stored entries within the threshold of every request that has one."""
        plan = self.index.planner()
        near = plan.nearest_join(requests, request_id, vector, self.names["embedding"], k, self.threshold, filter)
        return near.join(plan.df.select(KEY, *(F.col(self.names[c]).alias(c) for c in ("prompt", "response", "metadata"))), KEY)
