"""The query types: plain values, checked when they are built."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from vecframe.plans.filters import Node

DEFAULT_LIMIT = 10


def _names(fields: Sequence[str] | None) -> tuple[str, ...]:
    out: dict[str, None] = {}
    for f in fields or ():
        name = f.strip().removeprefix("@") if isinstance(f, str) else ""
        if not name:
            raise ValueError("a field name must not be blank")
        out[name] = None
    return tuple(out)


def _text(value: str, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} must not be blank")
    return value.strip()


@dataclass(frozen=True)
class Page:
    offset: int = 0
    limit: int = DEFAULT_LIMIT

    def __post_init__(self) -> None:
        if self.offset < 0 or self.limit < 0:
            raise ValueError("offset and limit must not be negative")


@dataclass(frozen=True)
class Runtime:
    """Options of approximate search: accepted for HNSW fields and without effect, since search is exact."""

    ef_runtime: int | None = None
    epsilon: float | None = None

    def __post_init__(self) -> None:
        if self.ef_runtime is not None and self.ef_runtime <= 0:
            raise ValueError("ef_runtime must be positive")
        if self.epsilon is not None and not (math.isfinite(self.epsilon) and self.epsilon >= 0):
            raise ValueError("epsilon must be finite and not negative")


@dataclass(frozen=True)
class FilterQuery:
    filter: Node | None = None
    return_fields: tuple[str, ...] = ()
    page: Page = field(default_factory=Page)

    def __post_init__(self) -> None:
        object.__setattr__(self, "return_fields", _names(self.return_fields))


@dataclass(frozen=True)
class TextQuery:
    text: str
    return_fields: tuple[str, ...] = ()
    page: Page = field(default_factory=Page)

    def __post_init__(self) -> None:
        object.__setattr__(self, "text", _text(self.text, "the query text"))
        object.__setattr__(self, "return_fields", _names(self.return_fields))


@dataclass(frozen=True)
class CountQuery:
    filter: Node | None = None


@dataclass(frozen=True)
class VectorQuery:
    """The ``top_k`` nearest documents among those that pass the filter; paging stays inside these."""

    field: str
    vector: Sequence[float] | bytes
    top_k: int
    filter: Node | None = None
    return_fields: tuple[str, ...] = ()
    score_alias: str = "vector_distance"
    runtime: Runtime | None = None
    page: Page | None = None

    def __post_init__(self) -> None:
        put = object.__setattr__
        put(self, "field", _text(self.field, "the vector field"))
        put(self, "score_alias", _text(self.score_alias, "the score alias"))
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")
        put(self, "page", self.page or Page(0, self.top_k))
        if self._windowed and self.page.offset + self.page.limit > self.top_k:
            raise ValueError("offset and limit must stay inside top_k")
        put(self, "return_fields", _names(self.return_fields))
        if not isinstance(self.vector, bytes):
            put(self, "vector", tuple(map(float, self.vector)))
        if not self.vector:
            raise ValueError("the vector must not be empty")

    _windowed = True


@dataclass(frozen=True)
class HybridQuery(VectorQuery):
    """Nearest documents among those that pass a filter with at least one text condition, and any further filter."""

    text_filter: Node | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.text_filter is None or not self.text_filter.has_text():
            raise ValueError("a hybrid query needs a text condition")

    @property
    def whole_filter(self) -> Node:
        return self.text_filter if self.filter is None else self.text_filter & self.filter


@dataclass(frozen=True)
class RangeQuery:
    field: str
    vector: Sequence[float] | bytes
    threshold: float
    filter: Node | None = None
    return_fields: tuple[str, ...] = ()
    score_alias: str = "vector_distance"
    runtime: Runtime | None = None
    page: Page = field(default_factory=Page)

    def __post_init__(self) -> None:
        put = object.__setattr__
        put(self, "field", _text(self.field, "the vector field"))
        put(self, "score_alias", _text(self.score_alias, "the score alias"))
        if not (math.isfinite(self.threshold) and self.threshold > 0):
            raise ValueError("the threshold must be finite and positive")
        put(self, "return_fields", _names(self.return_fields))
        if not isinstance(self.vector, bytes):
            put(self, "vector", tuple(map(float, self.vector)))


# the dataclass attribute named field hides the function within these two bodies
@dataclass(frozen=True)
class WeightedVector:
    field: str
    vector: Sequence[float] | bytes
    weight: float = 1.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "field", _text(self.field, "the vector field"))
        if not (math.isfinite(self.weight) and self.weight > 0):
            raise ValueError("a weight must be finite and positive")
        if not isinstance(self.vector, bytes):
            object.__setattr__(self, "vector", tuple(map(float, self.vector)))


@dataclass(frozen=True)
class MultiVectorQuery:
    """Documents among the ``top_k`` of every vector, by the weighted sum of their distances."""

    vectors: tuple[WeightedVector, ...]
    top_k: int
    filter: Node | None = None
    return_fields: tuple[str, ...] = ()
    score_alias: str = "vector_distance"
    runtime: Runtime | None = None
    page: Page | None = None

    def __post_init__(self) -> None:
        put = object.__setattr__
        put(self, "vectors", tuple(self.vectors))
        if not self.vectors:
            raise ValueError("at least one vector is needed")
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")
        put(self, "page", self.page or Page(0, self.top_k))
        if self.page.offset + self.page.limit > self.top_k:
            raise ValueError("offset and limit must stay inside top_k")
        put(self, "score_alias", _text(self.score_alias, "the score alias"))
        put(self, "return_fields", _names(self.return_fields))


@dataclass(frozen=True)
class Apply:
    expression: str
    alias: str

    def __post_init__(self) -> None:
        object.__setattr__(self, "expression", _text(self.expression, "the expression"))
        object.__setattr__(self, "alias", _text(self.alias, "the alias").removeprefix("@"))


@dataclass(frozen=True)
class Reducer:
    """A reducer by name. Arguments that begin with ``@`` are properties, others literals."""

    name: str
    args: tuple[Any, ...] = ()
    alias: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "name", _text(self.name, "the reducer").upper())
        object.__setattr__(self, "alias", _text(self.alias, "the reducer's alias").removeprefix("@"))

    @classmethod
    def count(cls, alias: str) -> Reducer:
        return cls("COUNT", (), alias)

    @classmethod
    def of(cls, name: str, prop: str, alias: str) -> Reducer:
        return cls(name, ("@" + _text(prop, "the property").removeprefix("@"),), alias)

    @classmethod
    def quantile(cls, prop: str, q: float, alias: str, error: float | None = None) -> Reducer:
        """Exact, which holds a group's different values in one task; with an ``error`` of rank by a sketch of bounded size."""
        if not 0 <= q <= 1:
            raise ValueError("a quantile lies between 0 and 1")
        if error is not None and not 0 < error < 1:
            raise ValueError("an error lies between 0 and 1")
        return cls("QUANTILE", ("@" + _text(prop, "the property").removeprefix("@"), q, *([] if error is None else [error])), alias)


@dataclass(frozen=True)
class GroupBy:
    properties: tuple[str, ...] = ()
    reducers: tuple[Reducer, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "properties", _names(self.properties))
        object.__setattr__(self, "reducers", tuple(self.reducers))
        if not self.properties and not self.reducers:
            raise ValueError("a group needs a property or a reducer")


@dataclass(frozen=True)
class SortField:
    property: str
    descending: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "property", _text(self.property, "the property").removeprefix("@"))


@dataclass(frozen=True)
class Pipeline:
    """What follows the rows of an aggregation: load, apply, group, sort, page, in this order."""

    load: tuple[str, ...] = ()
    apply: tuple[Apply, ...] = ()
    group_by: GroupBy | None = None
    sort_by: tuple[SortField, ...] = ()
    page: Page = field(default_factory=Page)

    def __post_init__(self) -> None:
        object.__setattr__(self, "load", _names(self.load))
        object.__setattr__(self, "apply", tuple(self.apply))
        object.__setattr__(self, "sort_by", tuple(self.sort_by))


@dataclass(frozen=True)
class AggregationQuery:
    query: str = "*"
    pipeline: Pipeline = field(default_factory=Pipeline)

    def __post_init__(self) -> None:
        object.__setattr__(self, "query", _text(self.query, "the query string"))

    @property
    def page(self) -> Page:
        return self.pipeline.page


@dataclass(frozen=True)
class AggregateHybridQuery:
    """An aggregation over the ``top_k`` rows of a hybrid query; the page is one of groups."""

    hybrid: HybridQuery
    pipeline: Pipeline = field(default_factory=Pipeline)

    @property
    def page(self) -> Page:
        return self.pipeline.page


Query = FilterQuery | TextQuery | VectorQuery | HybridQuery | RangeQuery | MultiVectorQuery
Aggregation = AggregationQuery | AggregateHybridQuery


def with_page(query: Any, page: Page) -> Any:
    if isinstance(query, (AggregationQuery, AggregateHybridQuery)):
        return replace(query, pipeline=replace(query.pipeline, page=page))
    return replace(query, page=page)
