"""The search index: a schema bound to a stored table, with its lifecycle, documents and queries."""

from __future__ import annotations

import copy
import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, is_dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.mapping import map_rows
from vecframe.plans import queries as Q
from vecframe.plans.planner import KEY, Planner
from vecframe.runtime import numbered
from vecframe.schema import IndexDefinition, SearchSchema, Storage
from vecframe.sources.store import EXPIRES, INGESTED, Catalog, DocumentStore, starts_with

_PATH = re.compile(r"\.([A-Za-z_]\w*)|\[(\d+)\]|\['([^']+)'\]")


@dataclass(frozen=True)
class IndexInfo:
    name: str
    storage: str
    prefixes: tuple[str, ...]
    key_separator: str
    stopwords: tuple[str, ...] | None
    num_docs: int
    fields: tuple[dict[str, Any], ...]


class Results:
    """A page of rows and, counted when asked for, the number of rows on all pages."""

    def __init__(self, rows: DataFrame, count: Callable[[], int]) -> None:
        self.rows, self._count = rows, count

    @cached_property
    def total(self) -> int:
        return self._count()

    def collect_as(self, cls: type) -> list[Any]:
        return map_rows(self.rows, cls)


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest) if head else name


def _stored(f: T.StructField, columns: dict[str, T.DataType]) -> str:
    """The column that holds a field: its own name, unless that is taken by another type."""
    return f.name if columns.get(f.name, f.dataType) == f.dataType else f"{f.name}__{re.sub(r'[^a-z]+', '_', f.dataType.simpleString()).strip('_')}"


def _derived(f: Any, t: T.StructField) -> Column:
    """A field's value from the document's JSON, as :meth:`SearchIndex._rows` takes it from the document."""
    paths = [f.name] if f.name.startswith("$") else [f"$['{n}']" for n in dict.fromkeys([f.name, f.column, _camel(f.name)])]
    raw = F.coalesce(*[F.get_json_object("_doc", p) for p in paths])
    if f.kind in ("numeric", "vector"):
        return (raw.try_cast("double") if f.kind == "numeric" else F.from_json(raw, t.dataType)).alias(t.name)
    if f.kind == "tag":
        return F.coalesce(F.array_join(F.from_json(raw, "array<string>"), f.separator), raw)
    return raw


def _document(doc: Any) -> dict[str, Any]:
    plain = asdict(doc) if is_dataclass(doc) and not isinstance(doc, type) else doc
    if not isinstance(plain, dict):
        raise TypeError("a document must be a mapping or a dataclass")
    return {_camel(k): v for k, v in plain.items()} if is_dataclass(doc) else dict(plain)


def _path_steps(path: str) -> list[str | int]:
    if not isinstance(path, str) or not path.startswith(("$.", "$[")):
        raise ValueError(f"a path begins with $. or $[: {path!r}")
    steps: list[str | int] = []
    at = 1
    while at < len(path):
        m = _PATH.match(path, at)
        if not m:
            raise ValueError(f"unsupported path: {path}")
        steps.append(int(m[2]) if m[2] else m[1] or m[3])
        at = m.end()
    return steps


class SearchIndex:
    """Documents of a kind share one store below ``warehouse``; an index holds those whose keys begin with one of its prefixes.

    A document that is loaded gets the columns of every index that holds its key, whichever it came through; a new index
    derives its columns for the documents that are there, unless it skips the initial scan.
    """

    def __init__(self, spark: SparkSession, warehouse: str, schema: SearchSchema) -> None:
        self.spark, self.warehouse, self.schema = spark, warehouse, schema
        self.catalog = Catalog(f"{warehouse}/catalog", spark)
        self.store = DocumentStore(spark, f"{warehouse}/{schema.index.storage.value}")

    # lifecycle

    @property
    def name(self) -> str:
        return self.schema.index.name

    def create(self, overwrite: bool = False, skip_if_exists: bool = False, drop_existing_documents: bool = False) -> bool:
        if overwrite and skip_if_exists:
            raise ValueError("overwrite and skip_if_exists exclude each other")
        if drop_existing_documents and not overwrite:
            raise ValueError("drop_existing_documents needs overwrite")
        if self.exists():
            if skip_if_exists:
                return False
            if not overwrite:
                raise ValueError(f"index {self.name} exists")
            self.drop(drop_existing_documents)
        for f in self.schema.of_kind("vector"):
            f.datatype.width  # noqa: B018 - rejects types that can't be queried
        self.catalog.put(self.name, {"schema": self.schema.to_dict(), "created_at": time.time(), "used_at": time.time()})
        if not self.schema.index.skip_initial_scan:
            self._scan()
        return True

    def _scan(self) -> None:
        """Give the documents that are there the columns of this index."""
        columns = self.store.columns()
        fields = [(f, t) for f, t in zip(self.schema.fields, self.schema.struct().fields[1:]) if _stored(t, columns) not in columns]
        if "_doc" not in columns or not fields:
            return
        rows = self.store.read().where(starts_with(F.col(KEY), self.schema.index.prefixes) & F.col("_doc").isNotNull())
        if rows.take(1):
            self.store.put(rows.withColumns({_stored(t, columns): _derived(f, t) for f, t in fields}))

    def exists(self) -> bool:
        return self.catalog.get(self.name) is not None

    def info(self) -> IndexInfo:
        self._entry()
        i = self.schema.index
        fields = tuple(self.schema.to_dict()["fields"])
        return IndexInfo(i.name, i.storage.value, i.prefixes, i.key_separator, i.stopwords, self.documents().count(), fields)

    def drop(self, delete_documents: bool = False) -> bool:
        self._entry()
        if delete_documents:
            self.clear()
        return self.catalog.drop(self.name)

    def clear(self, batch_size: int = 1000) -> int:
        """Delete the documents of every prefix and keep the index. One rewrite serves any batch size."""
        if batch_size <= 0:
            raise ValueError("batch_size must be positive")
        return self.store.delete_prefixes(self.schema.index.prefixes) if self.store.exists() else 0

    @staticmethod
    def list(spark: SparkSession, warehouse: str) -> DataFrame:
        return spark.createDataFrame([(n,) for n in Catalog(f"{warehouse}/catalog", spark).names()], "name string")

    @classmethod
    def from_existing(cls, spark: SparkSession, warehouse: str, name: str) -> SearchIndex:
        entry = Catalog(f"{warehouse}/catalog", spark).get(name)
        if entry is None:
            raise ValueError(f"no index {name}")
        return cls(spark, warehouse, SearchSchema.from_dict(entry["schema"]))

    def _entry(self) -> dict:
        entry = self.catalog.get(self.name)
        if entry is None:
            raise ValueError(f"no index {self.name}")
        if self.schema.index.temporary_seconds:
            self.catalog.touch(self.name)
        return entry

    # keys

    def key_of(self, doc: dict[str, Any] | None = None, key: str | None = None, id: str | None = None) -> str:  # noqa: A002
        if key is not None and id is not None:
            raise ValueError("give a key or an id, not both")
        if key is None and id is None and doc is not None:
            id = next((str(v) for k, v in doc.items() if k.lower() == "id" and v is not None), None)  # noqa: A001
        value = key if key is not None else id
        if value is None or not str(value).strip():
            raise ValueError("a document needs a key or an id")
        return str(value).strip() if key is not None else self.schema.index.prefix + str(value).strip()

    def key_column(self, id_col: Column) -> Column:
        return F.concat(F.lit(self.schema.index.prefix), F.trim(id_col.cast("string")))

    # documents

    def _guard(self, storage: Storage) -> None:
        if self.schema.index.storage is not storage:
            raise ValueError(f"index {self.name} stores {self.schema.index.storage.value}, not {storage.value} documents")

    def _frame(self, docs: Iterable[Any], key: Callable | None, id: Callable | None) -> DataFrame:  # noqa: A002
        if key and id:
            raise ValueError("give a key selector or an id selector, not both")
        rows = []
        for d in docs:
            plain = _document(d)
            k = self.key_of(plain, key=key(d) if key else None, id=id(d) if id else None)
            rows.append((k, plain))
        return self._rows(rows)

    def _schemas(self) -> list[SearchSchema]:
        """This schema and those of the other indexes over the same store."""
        others = [SearchSchema.from_dict(e["schema"]) for n in self.catalog.names() if n != self.name and (e := self.catalog.get(n))]
        return [self.schema, *(o for o in others if o.index.storage is self.schema.index.storage)]

    def _rows(self, rows: list[tuple[str, dict[str, Any]]]) -> DataFrame:
        """Documents as rows: the fields of every index that holds them as columns, the whole document as JSON beside them."""
        columns = self.store.columns()
        held = []
        for schema in self._schemas():
            for f, t in zip(schema.fields, schema.struct().fields[1:]):
                if any(key.startswith(schema.index.prefixes) for key, _ in rows) and not any(f == g and t == u for _, g, u in held):
                    held.append((schema.index.prefixes, f, t))
        names: dict[str, T.DataType] = {}
        places = []
        for prefixes, f, t in held:
            name = _stored(t, columns | names)
            names[name] = t.dataType
            places.append((prefixes, f, name))
        out = []
        for key, doc in rows:
            values = dict.fromkeys(names)
            for prefixes, f, name in places:
                if key.startswith(prefixes) and values[name] is None:
                    values[name] = self._value(f, doc)
            out.append((key, *values.values(), json.dumps({k: v for k, v in doc.items() if v is not None}, ensure_ascii=False, default=str)))
        structure = [T.StructField(KEY, T.StringType(), False), *(T.StructField(n, t) for n, t in names.items()), T.StructField("_doc", T.StringType())]
        return self.spark.createDataFrame(out, T.StructType(structure))

    @staticmethod
    def _value(f, doc: dict[str, Any]) -> Any:
        at: Any = doc
        if f.name.startswith("$"):
            for step in _path_steps(f.name):
                at = at[step] if isinstance(at, (dict, list)) and (step in at if isinstance(at, dict) else isinstance(step, int) and step < len(at)) else None
        else:
            at = next((doc[n] for n in (f.name, f.column, _camel(f.name)) if n in doc), None)
        if at is None:
            return None
        if f.kind == "numeric":
            return float(at)
        if f.kind == "vector":
            return [float(x) for x in at]
        if isinstance(at, bool):
            return "true" if at else "false"
        if f.kind == "tag" and isinstance(at, (list, tuple)):
            return f.separator.join(map(str, at))
        return at if isinstance(at, str) else json.dumps(at, ensure_ascii=False)

    def load_json(self, docs: Any, key: Callable | None = None, id: Callable | None = None, keys: bool = False) -> int | list[str]:  # noqa: A002
        """Store whole documents, each in the place of one of its key. Their number, or, if asked for, their keys in order."""
        return self._load(docs, Storage.JSON, key, id, keys)

    def load_hash(self, docs: Any, key: Callable | None = None, id: Callable | None = None, keys: bool = False) -> int | list[str]:  # noqa: A002
        """Set the fields of documents that are not null; other fields of a stored document stay."""
        return self._load(docs, Storage.HASH, key, id, keys)

    def _load(self, docs: Any, storage: Storage, key, id, keys: bool) -> int | list[str]:  # noqa: A002
        self._guard(storage)
        many = list(docs) if isinstance(docs, (list, tuple)) else [docs]
        rows = self._frame(many, key, id)
        self.load_frame(rows)
        return [r[0] for r in rows.select(KEY).collect()] if keys else len(many)

    def load_frame(self, rows: DataFrame, ttl: float | None = None) -> None:
        """Load a DataFrame with a ``_key`` column: the way for large loads, without the driver."""
        columns = self.store.columns()
        rows = rows.select([F.col(f.name).alias(_stored(f, columns)) for f in rows.schema.fields])
        if self.schema.index.storage is Storage.JSON:
            self.store.replace(rows, ttl=ttl)
        else:
            self.store.merge(rows, ttl=ttl, documents="_doc")

    def fetch(self, key: str | None = None, id: str | None = None) -> dict[str, Any] | None:  # noqa: A002
        row = self._one(self.key_of(key=key, id=id))
        if row is None:
            return None
        if row.asDict().get("_doc"):
            return json.loads(row["_doc"])
        return {k: v for k, v in row.asDict(recursive=True).items() if v is not None and not k.startswith("_")}  # loaded as a table

    def _one(self, key: str):
        rows = self.store.get([key]).collect()
        return rows[0] if rows else None

    def delete(self, key: str | None = None, id: str | None = None) -> bool:  # noqa: A002
        return self.store.exists() and self.store.delete([self.key_of(key=key, id=id)]) > 0

    def update_json(self, updates: list[tuple[str, Any]], key: str | None = None, id: str | None = None) -> bool:  # noqa: A002
        """Set paths of one document, all checked before any is written; False if the document is not there."""
        self._guard(Storage.JSON)
        if not updates:
            raise ValueError("at least one update is needed")
        steps = [_path_steps(p) for p, _ in updates]
        if len({p for p, _ in updates}) != len(updates):
            raise ValueError("a path occurs twice")
        doc = self.fetch(key=key, id=id)
        if doc is None:
            return False
        doc = copy.deepcopy(doc)
        for path, (_, value) in zip(steps, updates):
            at: Any = doc
            for step in path[:-1]:
                at = at[step]
            at[path[-1]] = value
        self.load_frame(self._rows([(self.key_of(key=key, id=id), doc)]))
        return True

    def update_hash(self, updates: list[tuple[str, Any]], key: str | None = None, id: str | None = None) -> bool:  # noqa: A002
        """Set fields of one document; False if the document is not there."""
        self._guard(Storage.HASH)
        names = [n.strip() for n, _ in updates]
        if not names or not all(names) or len(set(names)) != len(names) or any(v is None for _, v in updates):
            raise ValueError("updates need different fields with values")
        k = self.key_of(key=key, id=id)
        if self._one(k) is None:
            return False
        self.load_frame(self._rows([(k, dict(zip(names, (v for _, v in updates))))]))
        return True

    # queries

    def documents(self) -> DataFrame:
        """The rows of this index."""
        entry = self._entry()
        rows = self.store.read().where(starts_with(F.col(KEY), self.schema.index.prefixes))
        if self.schema.index.skip_initial_scan:
            rows = rows.where(F.col(INGESTED) >= F.timestamp_seconds(F.lit(entry["created_at"])))
        columns = {f.name: f.dataType for f in rows.schema.fields}
        own = self.schema.struct().fields[1:]
        mine = [(F.col(_stored(f, columns)) if _stored(f, columns) in columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in own]
        others = [n for n in columns if n not in (KEY, EXPIRES, INGESTED) and n not in {f.name for f in own} | {_stored(f, columns) for f in own}]
        return rows.select(KEY, *mine, *others)

    def planner(self) -> Planner:
        return Planner(self.schema, self.documents())

    def search(self, query: Q.Query) -> Results:
        plan = self.planner()
        return Results(plan.search(query), lambda: plan.total(query))

    def aggregate(self, query: Q.Aggregation) -> Results:
        plan = self.planner()
        return Results(plan.aggregate(query), lambda: plan.total(query))

    def count(self, query: Q.CountQuery) -> int:
        return self.planner().count(query)

    @contextmanager
    def cancellable(self, tag: str | None = None) -> Iterator[Callable[[], None]]:
        """What runs within is cancelled, from any thread, by the function that this gives."""
        name = tag or f"{self.name}-{time.time_ns()}"
        self.spark.addTag(name)
        try:
            yield lambda: self.spark.interruptTag(name)
        finally:
            self.spark.removeTag(name)

    def batches(self, query: Q.Query | Q.Aggregation, size: int | None = None) -> Iterator[DataFrame]:
        """Pages of one snapshot of the result, which is written once. Its rows are numbered, so that a page is a filter."""
        if size is not None and size <= 0:
            raise ValueError("the batch size must be positive")
        step = size or query.page.limit
        plan = self.planner()
        rows = plan.aggregated(query) if isinstance(query, (Q.AggregationQuery, Q.AggregateHybridQuery)) else plan.ranked(query)
        top = query.page.offset + query.page.limit if isinstance(query, (Q.VectorQuery, Q.MultiVectorQuery)) else None
        if top is not None:
            rows = rows.limit(top)
        pages = numbered(rows, "_place")
        end, at = pages.count(), query.page.offset
        if at >= end or step == 0:
            yield pages.limit(0).drop("_place")
            return
        while at < end:
            yield pages.where((F.col("_place") >= at) & (F.col("_place") < at + step)).orderBy("_place").drop("_place")
            at += step


def inline_schema(name: str, prefixes: list[str], storage: str, fields: list[str]) -> SearchSchema:
    """A schema from ``type:name`` texts; vector fields need a file."""
    from vecframe.schema import KINDS

    out = []
    for f in fields:
        kind, _, field_name = f.partition(":")
        if kind not in ("text", "tag", "numeric", "geo"):
            raise ValueError(f"unsupported inline field: {f}")
        out.append(KINDS[kind](field_name))
    return SearchSchema(IndexDefinition(name, tuple(prefixes), Storage(storage.lower())), tuple(out))
