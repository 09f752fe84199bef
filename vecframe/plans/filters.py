"""The filter tree: built by ``Filter``, rendered as a query string, compiled to a boolean column."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.functions import geo, text
from vecframe.schema import SearchSchema, TagField


def _number(x: float) -> str:
    if math.isinf(x):
        return "+inf" if x > 0 else "-inf"
    return repr(int(x)) if x == int(x) and abs(x) < 1e15 else repr(float(x))


def _escape(value: str, keep: str = "") -> str:
    return "".join(c if c.isalnum() or c == "_" or c in keep else "\\" + c for c in value)


def _given(value: str, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} must not be blank")
    return value.strip()


class Node:
    """A boolean condition on a document. A missing field fails every condition, and so passes its negation."""

    def __and__(self, other: Node) -> Node:
        return Filter.all(self, other)

    def __or__(self, other: Node) -> Node:
        return Filter.any(self, other)

    def __invert__(self) -> Node:
        return Not(self)

    def render(self) -> str:
        raise NotImplementedError

    def column(self, schema: SearchSchema, types: dict[str, T.DataType] | None = None) -> Column:
        raise NotImplementedError

    def leaves(self) -> Iterator[Node]:
        yield self

    def has_text(self) -> bool:
        return any(isinstance(x, (Term, Phrase, Affix, Fuzzy)) for x in self.leaves())


@dataclass(frozen=True)
class Everything(Node):
    def render(self) -> str:
        return "*"

    def column(self, schema, types=None) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Tag(Node):
    field: str
    values: tuple[str, ...]

    def render(self) -> str:
        return f"@{self.field}:{{{'|'.join(_escape(v) for v in self.values)}}}"

    def column(self, schema, types=None) -> Column:
        f = schema.resolve(self.field, "tag")
        assert isinstance(f, TagField)
        if f.no_index:
            return F.lit(False)
        c = F.col(f.column)
        fold = (lambda x: F.trim(x)) if f.case_sensitive else (lambda x: F.lower(F.trim(x)))
        wanted = [v.strip() if f.case_sensitive else v.strip().lower() for v in self.values]
        if types and isinstance(types.get(f.column), T.ArrayType):
            return F.exists(c, lambda x: fold(x).isin(wanted))
        hit = F.exists(F.split(c, re.escape(f.separator)), lambda x: fold(x).isin(wanted))
        # of one tag in its own case the scan can tell where it does not occur
        return c.contains(wanted[0]) & hit if f.case_sensitive and len(wanted) == 1 else hit


@dataclass(frozen=True)
class Missing(Node):
    """Documents without the field, which must be one that indexes its absence."""

    field: str

    def render(self) -> str:
        return f"ismissing(@{self.field})"

    def column(self, schema, types=None) -> Column:
        f = schema.resolve(self.field)
        if not f.index_missing:
            raise ValueError(f"field {self.field} does not index where it is missing")
        return F.col(f.column).isNull()


@dataclass(frozen=True)
class Range(Node):
    field: str
    low: float = -math.inf
    high: float = math.inf
    with_low: bool = True
    with_high: bool = True

    def render(self) -> str:
        low = ("" if self.with_low or math.isinf(self.low) else "(") + _number(self.low)
        high = ("" if self.with_high or math.isinf(self.high) else "(") + _number(self.high)
        return f"@{self.field}:[{low} {high}]"

    def column(self, schema, types=None) -> Column:
        if schema.resolve(self.field, "numeric").no_index:
            return F.lit(False)
        c = F.col(schema.resolve(self.field, "numeric").column)
        if types and isinstance(types.get(schema.resolve(self.field).column), T.StringType):
            c = c.try_cast("double")
        if self.low == self.high and self.with_low and self.with_high:
            return c == F.lit(self.low)
        tests = []
        if self.low != -math.inf:
            tests.append(c >= F.lit(self.low) if self.with_low else c > F.lit(self.low))
        if self.high != math.inf:
            tests.append(c <= F.lit(self.high) if self.with_high else c < F.lit(self.high))
        if not tests:
            return c.isNotNull()
        return tests[0] if len(tests) == 1 else tests[0] & tests[1]


#: Columns of this prefix hold the words of a text field, if they were computed beforehand.
WORDS = "_words_"


def text_fields(schema: SearchSchema, field: str | None) -> list[str]:
    if field is None:
        return [f.column for f in schema.of_kind("text") if not f.no_index]
    if schema.index.no_fields:
        raise ValueError("the index keeps no fields: text can't be searched by field")
    return [f.column for f in (schema.resolve(n, "text") for n in field.split("|")) if not f.no_index]


def _text_columns(schema: SearchSchema, field: str | None, types: dict[str, T.DataType] | None) -> list[Column]:
    ready = types or {}
    return [F.col(WORDS + n) if WORDS + n in ready else text.words(F.col(n)) for n in text_fields(schema, field)]


def _any_of(tests: list[Column]) -> Column:
    out = F.lit(False) if not tests else F.coalesce(tests[0], F.lit(False))
    for t in tests[1:]:
        out = out | F.coalesce(t, F.lit(False))
    return out


@dataclass(frozen=True)
class Term(Node):
    """One term; ``*`` at an end matches any rest. Several words count as a phrase."""

    field: str | None
    term: str

    def render(self) -> str:
        return (f"@{self.field}:" if self.field else "") + _escape(self.term, "*")

    def column(self, schema, types=None) -> Column:
        t = self.term
        if t.lower() in map(str.lower, schema.index.stopwords or ()):
            return F.lit(True)  # an index's own stopwords are not indexed, so they ask for nothing
        if t.endswith("*") or t.startswith("*"):
            return Affix(self.field, t.strip("*"), t.startswith("*"), t.endswith("*")).column(schema, types)
        return _any_of([text.has_phrase(c, t) for c in _text_columns(schema, self.field, types)])


@dataclass(frozen=True)
class Phrase(Node):
    field: str | None
    phrase: str

    def render(self) -> str:
        quoted = self.phrase.replace("\\", "\\\\").replace('"', '\\"')
        return (f"@{self.field}:" if self.field else "") + f'"{quoted}"'

    def column(self, schema, types=None) -> Column:
        if schema.index.no_offsets:
            raise ValueError("the index keeps no offsets: phrases can't be searched")
        return _any_of([text.has_phrase(c, self.phrase) for c in _text_columns(schema, self.field, types)])


@dataclass(frozen=True)
class Affix(Node):
    """Words that begin with, end with or hold a piece."""

    field: str | None
    piece: str
    open_start: bool = False
    open_end: bool = True

    def render(self) -> str:
        return (f"@{self.field}:" if self.field else "") + "*" * self.open_start + _escape(self.piece) + "*" * self.open_end

    def column(self, schema, types=None) -> Column:
        test = text.has_infix if self.open_start and self.open_end else text.has_suffix if self.open_start else text.has_prefix
        return _any_of([test(c, self.piece) for c in _text_columns(schema, self.field, types)])


@dataclass(frozen=True)
class Fuzzy(Node):
    field: str | None
    term: str
    distance: int = 1

    def render(self) -> str:
        return (f"@{self.field}:" if self.field else "") + "%" * self.distance + _escape(self.term) + "%" * self.distance

    def column(self, schema, types=None) -> Column:
        return _any_of([text.has_fuzzy(c, self.term, self.distance) for c in _text_columns(schema, self.field, types)])


@dataclass(frozen=True)
class Radius(Node):
    field: str
    lon: float
    lat: float
    radius: float
    unit: str

    def render(self) -> str:
        return f"@{self.field}:[{_number(self.lon)} {_number(self.lat)} {_number(self.radius)} {self.unit}]"

    def column(self, schema, types=None) -> Column:
        if schema.resolve(self.field, "geo").no_index:
            return F.lit(False)
        return geo.within(F.col(schema.resolve(self.field, "geo").column), self.lon, self.lat, self.radius, self.unit)


@dataclass(frozen=True)
class Group(Node):
    """``all`` of the children, or any of them."""

    children: tuple[Node, ...]
    all: bool

    def render(self) -> str:
        part = lambda x: f"({x.render()})" if isinstance(x, Group) else x.render()
        return (" " if self.all else " | ").join(map(part, self.children))

    def column(self, schema, types=None) -> Column:
        parts = [x.column(schema, types) for x in self.children]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if self.all else out | p
        return out

    def leaves(self) -> Iterator[Node]:
        for x in self.children:
            yield from x.leaves()


@dataclass(frozen=True)
class Not(Node):
    child: Node

    def render(self) -> str:
        return f"-({self.child.render()})" if isinstance(self.child, Group) else f"-{self.child.render()}"

    def column(self, schema, types=None) -> Column:
        return ~F.coalesce(self.child.column(schema, types), F.lit(False))

    def leaves(self) -> Iterator[Node]:
        yield from self.child.leaves()


@dataclass(frozen=True)
class Optional(Node):
    """Raises the rank of what it matches and filters nothing."""

    child: Node

    def render(self) -> str:
        return f"~{self.child.render()}"

    def column(self, schema, types=None) -> Column:
        return F.lit(True)

    def leaves(self) -> Iterator[Node]:
        yield from self.child.leaves()


class _On:
    def __init__(self, field: str) -> None:
        self.field = _given(field.removeprefix("@") if isinstance(field, str) else field, "the field")


class TagOn(_On):
    def eq(self, value: str) -> Node:
        return self.isin(value)

    def isin(self, *values: str) -> Node:
        if not values:
            raise ValueError("a tag filter needs at least one value")
        return Tag(self.field, tuple(_given(v, "a tag") for v in values))


class NumericOn(_On):
    def between(self, low: float, high: float, with_low: bool = True, with_high: bool = True) -> Node:
        if math.isnan(low) or math.isnan(high) or low > high:
            raise ValueError("the bounds must be numbers, the lower one first")
        return Range(self.field, float(low), float(high), with_low, with_high)

    def eq(self, x: float) -> Node:
        return self.between(x, x)

    def gt(self, x: float) -> Node:
        return self.between(x, math.inf, with_low=False)

    def gte(self, x: float) -> Node:
        return self.between(x, math.inf)

    def lt(self, x: float) -> Node:
        return self.between(-math.inf, x, with_high=False)

    def lte(self, x: float) -> Node:
        return self.between(-math.inf, x)


class TextOn(_On):
    def match(self, term: str) -> Node:
        return Term(self.field, _given(term, "the term"))

    def phrase(self, phrase: str) -> Node:
        return Phrase(self.field, _given(phrase, "the phrase"))

    def prefix(self, prefix: str) -> Node:
        return Affix(self.field, _given(prefix, "the prefix"))


class GeoOn(_On):
    def within_radius(self, lon: float, lat: float, radius: float, unit: str = "km") -> Node:
        if not all(map(math.isfinite, (lon, lat, radius))) or radius <= 0:
            raise ValueError("the radius must be positive, and all three finite")
        if unit not in geo.UNITS:
            raise ValueError(f"unknown unit: {unit}")
        return Radius(self.field, float(lon), float(lat), float(radius), unit)


class Filter:
    """Where filters begin: ``Filter.tag("genre").eq("crime") & Filter.numeric("year").gt(1990)``."""

    tag, numeric, text, geo = TagOn, NumericOn, TextOn, GeoOn

    @staticmethod
    def _group(children: tuple[Node, ...], all_: bool) -> Node:
        if len(children) < 2:
            raise ValueError("a group needs at least two filters")
        flat: list[Node] = []
        for x in children:
            flat += x.children if isinstance(x, Group) and x.all == all_ else [x]
        return Group(tuple(flat), all_)

    @staticmethod
    def all(*children: Node) -> Node:
        return Filter._group(children, True)

    @staticmethod
    def any(*children: Node) -> Node:
        return Filter._group(children, False)

    @staticmethod
    def missing(field: str) -> Node:
        return Missing(_given(field, "the field"))

    @staticmethod
    def negate(child: Node) -> Node:
        return Not(child)
