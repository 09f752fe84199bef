"""The semantic router and message histories, plain and semantic."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecframe.caches import _text, sha256
from vecframe.functions.vectors import distance_to
from vecframe.operators.nearest import nearest_of_few
from vecframe.plans.filters import Filter
from vecframe.plans.planner import Planner
from vecframe.plans.queries import Page, RangeQuery
from vecframe.runtime import numbered
from vecframe.schema import IndexDefinition, Metric, NumericField, SearchSchema, TagField, TextField, VectorField, VectorType
from vecframe.sources.index import SearchIndex
from vecframe.sources.store import KEY
from vecframe.vectorizers import Vectorizer


@dataclass(frozen=True)
class RouteMatch:
    route_name: str
    reference: str
    distance: float
    key: str


class SemanticRouter:
    """The route of the nearest reference within a threshold."""

    def __init__(self, spark: SparkSession, warehouse: str, name: str, dims: int, threshold: float, metric: Metric = Metric.COSINE, vector_type: VectorType = VectorType.FLOAT32) -> None:
        if not (math.isfinite(threshold) and threshold > 0):
            raise ValueError("the threshold must be finite and positive")
        self.prefix = f"router:{_text(name, 'the name').strip()}:"
        self.threshold = threshold
        fields = (TextField("routeName"), TextField("reference"), VectorField("embedding", dims=dims, metric=metric, datatype=vector_type))
        self.index = SearchIndex(spark, warehouse, SearchSchema(IndexDefinition(self.prefix.rstrip(":"), (self.prefix,)), fields))

    def create(self, **options: bool) -> bool:
        return self.index.create(**({"skip_if_exists": True} | options))

    def key(self, route: str, reference: str) -> str:
        return self.prefix + sha256(f"{route}\n{reference}")

    def add(self, route: str, reference: str, embedding: Sequence[float] | None = None, vectorizer: Vectorizer | None = None) -> str:
        route, reference = _text(route, "the route").strip(), _text(reference, "the reference").strip()
        vector = list(embedding) if embedding is not None else vectorizer.vectorize(reference)
        self.index.planner().vector_field("embedding", tuple(vector))
        key = self.key(route, reference)
        self.index.load_frame(self.index._rows([(key, {"routeName": route, "reference": reference, "embedding": vector})]))
        return key

    def route(self, text: str | None = None, embedding: Sequence[float] | None = None, vectorizer: Vectorizer | None = None) -> RouteMatch | None:
        vector = embedding if embedding is not None else vectorizer.vectorize(_text(text, "the text"))
        rows = self.index.planner().search(RangeQuery("embedding", vector, self.threshold, None, ("routeName", "reference"), "distance", page=Page(0, 1))).collect()
        return RouteMatch(rows[0]["routeName"], rows[0]["reference"], rows[0]["distance"], rows[0][KEY]) if rows else None

    def route_frame(self, inputs: DataFrame, input_id: str, vector: str) -> DataFrame:
        """(input_id, _key, distance, routeName, reference) of every input with a route."""
        plan = self.index.planner()
        f = self.index.schema.resolve("embedding")
        near = nearest_of_few(inputs, input_id, vector, plan.df, KEY, f.column, f.metric, f.dims, 1, self.threshold)
        return near.join(F.broadcast(plan.df.select(KEY, "routeName", "reference")), KEY)  # as few as nearest_of_few admits


@dataclass(frozen=True)
class Message:
    session_id: str
    role: str
    content: str
    timestamp: int
    metadata: Any
    sequence: int
    key: str
    distance: float | None = None


def sequenced(rows: DataFrame, session: str, order: list[Column], last: DataFrame | None = None) -> DataFrame:
    """Rows with the next ``sequence`` of their session, on from ``last`` (session, sequence).

    The rows are numbered in the order of sessions over all partitions, so a session of any length is spread over many.
    """
    placed = numbered(rows.orderBy(session, *order), "_place")
    first = placed.groupBy(session).agg(F.min("_place").alias("_first"))
    if last is not None:
        known = last.select(F.col(last.columns[0]).alias(session), F.col(last.columns[1]).alias("_last"))
        first = first.join(known, session, "left")
    else:
        first = first.withColumn("_last", F.lit(0))
    begun = first.select(F.col(session).alias("_session"), (F.coalesce("_last", F.lit(0)) - F.col("_first") + 1).cast("long").alias("_shift"))
    same = F.col(session).eqNullSafe(F.col("_session"))
    return placed.join(begun, same).withColumn("sequence", F.col("_place") + F.col("_shift")).drop("_place", "_session", "_shift")


def recent(rows: DataFrame, sessions: str, sequence: str, n: int, timestamp: str | None = None) -> DataFrame:
    """The last ``n`` rows of each session; Spark limits each partition before it shuffles."""
    order = [F.desc(sequence), *([F.desc(timestamp)] if timestamp else [])]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(sessions).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


class MessageHistory:
    """Messages by session, numbered as they arrive; the last ones are found by number."""

    kind = "history"

    def __init__(self, spark: SparkSession, warehouse: str, name: str, namespace: str | None = None) -> None:
        self.prefix = f"{self.kind}:{_text(name, 'the name').strip()}:" + (f"{_text(namespace, 'the namespace').strip()}:" if namespace is not None else "") + "msg:"
        self.index = SearchIndex(spark, warehouse, SearchSchema(IndexDefinition(self.prefix.rstrip(":"), (self.prefix,)), tuple(self._fields())))

    def _fields(self) -> list:
        return [TagField("sessionId"), TagField("role"), TextField("content"), TextField("metadata"), NumericField("timestamp", sortable=True), NumericField("sequence", sortable=True)]

    def create(self, **options: bool) -> bool:
        return self.index.create(**({"skip_if_exists": True} | options))

    def key(self, session: str, sequence: int) -> str:
        return f"{self.prefix}{sha256(session)}:{sequence:020d}"

    def _next(self, session: str) -> int:
        # the keys of a session begin alike and lie sorted, so other row groups are skipped
        mine = self.index.documents().where(F.col(KEY).startswith(f"{self.prefix}{sha256(session)}:"))
        return int(mine.agg(F.max("sequence")).first()[0] or 0) + 1

    def append(self, session: str, role: str, content: str, metadata: Any = None, timestamp: int | None = None, **more: Any) -> Message:
        session, role, content = _text(session, "the session").strip(), _text(role, "the role").strip(), _text(content, "the content").strip()
        self.index._entry()
        at = int(time.time() * 1000) if timestamp is None else int(timestamp)
        doc = {"sessionId": session, "role": role, "content": content, "metadata": None if metadata is None else json.dumps(metadata), "timestamp": at} | more
        while True:  # another writer may take the number first
            n = self._next(session)
            m = Message(session, role, content, at, metadata, n, self.key(session, n))
            if self.index.store.insert(self.index._rows([(m.key, doc | {"sequence": n})]), m.key):
                return m

    def append_frame(self, rows: DataFrame, order: list[Column]) -> None:
        """Many messages at once: columns sessionId, role, content, timestamp and those of the schema that are given."""
        stored = self.index.documents().groupBy("sessionId").agg(F.max("sequence").alias("sequence"))
        numbered = sequenced(rows, "sessionId", order, stored)
        key = F.concat(F.lit(self.prefix), F.sha2("sessionId", 256), F.lit(":"), F.lpad(F.col("sequence").cast("string"), 20, "0"))
        self.index.load_frame(numbered.withColumn("sequence", F.col("sequence").cast("double")).withColumn("timestamp", F.col("timestamp").cast("double")).withColumn(KEY, key))

    def _where(self, session: str, role: str | None) -> DataFrame:
        rows = self.index.documents().where(F.col("sessionId") == _text(session, "the session").strip())
        return self._of(rows, role)

    def _of(self, rows: DataFrame, role: str | None) -> DataFrame:
        return rows if role is None else rows.where(Filter.tag("role").eq(role).column(self.index.schema))

    def recent_frame(self, limit: int = 10, role: str | None = None) -> DataFrame:
        """The last messages of every session, as rows of the index."""
        if limit <= 0:
            raise ValueError("the limit must be positive")
        return recent(self._of(self.index.documents(), role), "sessionId", "sequence", limit, "timestamp")

    @staticmethod
    def _message(r: Any, distance: float | None = None) -> Message:
        return Message(r["sessionId"], r["role"], r["content"], int(r["timestamp"]), json.loads(r["metadata"]) if r["metadata"] else None, int(r["sequence"]), r[KEY], distance)

    def get_recent(self, session: str, limit: int = 10, role: str | None = None) -> list[Message]:
        """The last messages of a session, the newest first."""
        if limit <= 0:
            raise ValueError("the limit must be positive")
        rows = self._where(session, role).orderBy(F.desc("sequence"), F.desc("timestamp")).limit(limit)
        return [self._message(r) for r in rows.collect()]


class SemanticMessageHistory(MessageHistory):
    """A history whose messages are also found by nearness."""

    kind = "semantic-history"

    def __init__(self, spark: SparkSession, warehouse: str, name: str, dims: int, threshold: float, namespace: str | None = None, metric: Metric = Metric.COSINE) -> None:
        if not (math.isfinite(threshold) and threshold > 0):
            raise ValueError("the threshold must be finite and positive")
        self.dims, self.threshold, self.metric = dims, threshold, metric
        super().__init__(spark, warehouse, name, namespace)

    def _fields(self) -> list:
        return [*super()._fields(), VectorField("embedding", dims=self.dims, metric=self.metric, datatype=VectorType.FLOAT32)]

    def append(self, session: str, role: str, content: str, metadata: Any = None, timestamp: int | None = None, embedding: Sequence[float] | None = None, vectorizer: Vectorizer | None = None) -> Message:
        vector = list(embedding) if embedding is not None else vectorizer.vectorize(content)
        if len(vector) != self.dims:
            raise ValueError(f"the embedding needs {self.dims} parts")
        return super().append(session, role, content, metadata, timestamp, embedding=vector)

    def get_relevant(self, session: str, embedding: Sequence[float] | None = None, text: str | None = None, limit: int = 5, role: str | None = None, threshold: float | None = None, vectorizer: Vectorizer | None = None) -> list[Message]:
        """The nearest messages of a session within the threshold; the limit is one of distance, ties go to the newer."""
        if limit <= 0:
            raise ValueError("the limit must be positive")
        vector = embedding if embedding is not None else vectorizer.vectorize(_text(text, "the text"))
        plan = Planner(self.index.schema, self._where(session, role))
        rows = plan.nearest(RangeQuery("embedding", vector, threshold or self.threshold, score_alias="distance")).orderBy("distance", F.desc("sequence")).limit(limit)
        return [self._message(r, r["distance"]) for r in rows.collect()]

    def relevant_frame(self, embedding: Sequence[float], limit: int = 5, role: str | None = None, threshold: float | None = None) -> DataFrame:
        """The nearest messages of every session within the threshold, with ``distance`` and ``place``; ties go to the newer."""
        if limit <= 0:
            raise ValueError("the limit must be positive")
        plan = Planner(self.index.schema, self._of(self.index.documents(), role))
        f, vector = plan.vector_field("embedding", embedding)
        near = plan.df.withColumn("distance", distance_to(f.metric, F.col(f.column), vector)).where(F.col("distance") <= (threshold or self.threshold))
        order = Window.partitionBy("sessionId").orderBy("distance", F.desc("sequence"))
        return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
