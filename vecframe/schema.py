"""Index schemas: definitions of an index and its typed fields, from code, YAML or the catalog."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from enum import Enum
from typing import Any

import yaml
from pyspark.sql import types as T


class Storage(str, Enum):
    HASH = "hash"
    JSON = "json"


class Algorithm(str, Enum):
    FLAT = "flat"
    HNSW = "hnsw"


class Metric(str, Enum):
    COSINE = "cosine"
    L2 = "l2"
    IP = "ip"


class VectorType(str, Enum):
    FLOAT32 = "float32"
    FLOAT64 = "float64"
    FLOAT16 = "float16"
    BFLOAT16 = "bfloat16"
    UINT8 = "uint8"
    INT8 = "int8"

    @property
    def width(self) -> int:
        if self not in (VectorType.FLOAT32, VectorType.FLOAT64):
            raise ValueError(f"vectors of {self.value} can be neither created nor queried; use float32 or float64")
        return 4 if self is VectorType.FLOAT32 else 8


def _text(value: Any, what: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{what} must not be blank")
    return value.strip()


def _mark(value: str, what: str) -> str:
    if not isinstance(value, str) or len(value) != 1 or value.isspace():
        raise ValueError(f"{what} must be one character that is not white space")
    return value


@dataclass(frozen=True)
class IndexDefinition:
    """The name of an index, the key prefixes of its documents, their storage and the switches of the index."""

    name: str
    prefixes: tuple[str, ...]
    storage: Storage = Storage.HASH
    key_separator: str = ":"
    stopwords: tuple[str, ...] | None = None
    temporary_seconds: int | None = None
    max_text_fields: bool = False
    no_offsets: bool = False
    no_highlight: bool = False
    no_fields: bool = False
    no_frequencies: bool = False
    skip_initial_scan: bool = False

    def __post_init__(self) -> None:
        put = object.__setattr__
        put(self, "name", _text(self.name, "the index name"))
        given = (self.prefixes,) if isinstance(self.prefixes, str) else tuple(self.prefixes or ())
        if not given:
            raise ValueError("an index needs at least one prefix")
        put(self, "prefixes", tuple(_text(p, "a prefix") for p in given))
        put(self, "storage", Storage(self.storage))
        put(self, "key_separator", _mark(self.key_separator, "the key separator"))
        if self.stopwords is not None:
            put(self, "stopwords", tuple(_text(w, "a stopword") for w in self.stopwords))
        if self.temporary_seconds is not None and self.temporary_seconds < 0:
            raise ValueError("temporary_seconds must not be negative")

    @property
    def prefix(self) -> str:
        return self.prefixes[0]


@dataclass(frozen=True)
class Field:
    name: str
    alias: str | None = None
    sortable: bool = False
    index_missing: bool = False

    kind = "field"

    def __post_init__(self) -> None:
        object.__setattr__(self, "name", _text(self.name, "a field name"))
        if self.alias is not None:
            object.__setattr__(self, "alias", _text(self.alias, "a field alias"))
        if not self.sortable:
            for option in ("no_index", "unf"):
                if getattr(self, option, False):
                    raise ValueError(f"{option} of field {self.name} needs sortable")

    @property
    def column(self) -> str:
        """The query name: the alias, else the name without a leading ``$`` and ``.``."""
        return self.alias or self.name.removeprefix("$").lstrip(".")

    def known_as(self, name: str) -> bool:
        return name in (self.name, self.alias, self.column)


@dataclass(frozen=True)
class TextField(Field):
    weight: float = 1.0
    no_stem: bool = False
    phonetic_match: bool = False
    with_suffix_trie: bool = False
    index_empty: bool = False
    no_index: bool = False
    unf: bool = False
    kind = "text"

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.weight > 0:
            raise ValueError("the weight of a text field must be positive")


@dataclass(frozen=True)
class TagField(Field):
    separator: str = ","
    case_sensitive: bool = False
    with_suffix_trie: bool = False
    index_empty: bool = False
    no_index: bool = False
    kind = "tag"

    def __post_init__(self) -> None:
        super().__post_init__()
        _mark(self.separator, "the tag separator")


@dataclass(frozen=True)
class NumericField(Field):
    no_index: bool = False
    unf: bool = False
    kind = "numeric"


@dataclass(frozen=True)
class GeoField(Field):
    no_index: bool = False
    kind = "geo"


@dataclass(frozen=True)
class VectorField(Field):
    dims: int = 0
    algorithm: Algorithm = Algorithm.FLAT
    datatype: VectorType = VectorType.FLOAT32
    metric: Metric = Metric.COSINE
    initial_capacity: int = 0
    block_size: int = 0
    m: int = 0
    ef_construction: int = 0
    ef_runtime: int = 0
    kind = "vector"

    def __post_init__(self) -> None:
        super().__post_init__()
        for option, of in (("algorithm", Algorithm), ("datatype", VectorType), ("metric", Metric)):
            object.__setattr__(self, option, of(getattr(self, option)))
        if self.dims <= 0:
            raise ValueError("a vector field needs positive dims")
        if self.sortable:
            raise ValueError("a vector field can't be sortable")
        if min(self.initial_capacity, self.block_size, self.m, self.ef_construction, self.ef_runtime) < 0:
            raise ValueError("vector options must not be negative")
        if self.algorithm is Algorithm.FLAT and (self.m or self.ef_construction or self.ef_runtime):
            raise ValueError("m, ef_construction and ef_runtime are options of hnsw")


KINDS: dict[str, type[Field]] = {f.kind: f for f in (TextField, TagField, NumericField, GeoField, VectorField)}
_YAML_INDEX = {"name": "name", "prefix": "prefixes", "prefixes": "prefixes", "key_separator": "key_separator", "storage_type": "storage", "stopwords": "stopwords", "temporary": "temporary_seconds"}
_YAML_VECTOR = {"datatype": "datatype", "dims": "dims", "distance_metric": "metric", "algorithm": "algorithm", "initial_capacity": "initial_capacity", "block_size": "block_size", "m": "m", "ef_construction": "ef_construction", "ef_runtime": "ef_runtime"}
_SWITCHES = ("max_text_fields", "no_offsets", "no_highlight", "no_fields", "no_frequencies", "skip_initial_scan")


def _options(given: Any, names: dict[str, str], what: str) -> dict[str, Any]:
    if not isinstance(given, dict):
        raise ValueError(f"{what} must be a mapping")
    if unknown := sorted(set(map(str, given)) - set(names)):
        raise ValueError(f"{what} has unsupported options: {', '.join(unknown)}")
    return {names[k]: v for k, v in given.items() if v is not None}


def _enum_text(v: Any) -> Any:
    return v.lower().replace("-", "") if isinstance(v, str) else v


@dataclass(frozen=True)
class SearchSchema:
    index: IndexDefinition
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))
        if not self.fields:
            raise ValueError("a schema needs at least one field")
        seen: set[str] = set()
        for f in self.fields:
            if f.column in seen:
                raise ValueError(f"field {f.column} occurs twice")
            seen.add(f.column)

    def find(self, name: str) -> Field | None:
        wanted = name.removeprefix("@")
        return next((f for f in self.fields if f.known_as(wanted)), None)

    def resolve(self, name: str, kind: str | None = None) -> Field:
        found = self.find(name)
        if found is None:
            raise ValueError(f"unknown field: {name}")
        if kind and found.kind != kind:
            raise ValueError(f"field {name} is a {found.kind} field, not a {kind} field")
        return found

    def of_kind(self, kind: str) -> list[Field]:
        return [f for f in self.fields if f.kind == kind]

    def struct(self) -> T.StructType:
        """The columns of a store of this index."""
        types: dict[str, T.DataType] = {"text": T.StringType(), "tag": T.StringType(), "numeric": T.DoubleType(), "geo": T.StringType()}
        of = lambda f: T.ArrayType(T.FloatType() if f.datatype is VectorType.FLOAT32 else T.DoubleType()) if isinstance(f, VectorField) else types[f.kind]
        return T.StructType([T.StructField("_key", T.StringType(), False), *(T.StructField(f.column, of(f)) for f in self.fields)])

    # sources

    @classmethod
    def from_yaml(cls, text: str) -> SearchSchema:
        top = yaml.safe_load(text)
        top = _options(top, {"index": "index", "fields": "fields"}, "the schema")
        if "index" not in top or not isinstance(top.get("fields"), list):
            raise ValueError("a schema needs index and fields")
        raw = top["index"]
        if isinstance(raw, dict) and "prefix" in raw and "prefixes" in raw:
            raise ValueError("give prefix or prefixes, not both")
        index = _options(raw, _YAML_INDEX | {s: s for s in _SWITCHES}, "index")
        if "storage" in index:
            index["storage"] = _enum_text(index["storage"])
        return cls(IndexDefinition(**{"name": "", "prefixes": ()} | index), tuple(map(cls._yaml_field, top["fields"])))

    @staticmethod
    def _yaml_field(raw: Any) -> Field:
        if not isinstance(raw, dict):
            raise ValueError("a field must be a mapping")
        kind = KINDS.get(_enum_text(raw.get("type")))
        if kind is None:
            raise ValueError(f"unsupported field type: {raw.get('type')}")
        own = {n: n for n in kind.__dataclass_fields__ if kind is not VectorField or n in Field.__dataclass_fields__}
        names = own | {"type": "type"} | ({"attrs": "attrs"} if kind is VectorField else {})
        given = _options(raw, names, f"field {raw.get('name')}")
        given.pop("type")
        if kind is VectorField:
            if "attrs" not in given:
                raise ValueError("a vector field needs attrs")
            attrs = _options(given.pop("attrs"), _YAML_VECTOR, "attrs")
            given |= {k: _enum_text(v) for k, v in attrs.items()}
        return kind(**{"name": ""} | given)

    @classmethod
    def from_yaml_file(cls, path: str) -> SearchSchema:
        with open(path, encoding="utf-8") as f:
            return cls.from_yaml(f.read())

    def to_dict(self) -> dict[str, Any]:
        plain = lambda x: {k: v.value if isinstance(v, Enum) else list(v) if isinstance(v, tuple) else v for k, v in asdict(x).items()}
        return {"index": plain(self.index), "fields": [{"kind": f.kind} | plain(f) for f in self.fields]}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> SearchSchema:
        index = dict(d["index"])
        if index.get("stopwords") is not None:
            index["stopwords"] = tuple(index["stopwords"])
        fields = tuple(KINDS[f["kind"]](**{k: v for k, v in f.items() if k != "kind"}) for f in d["fields"])
        return cls(IndexDefinition(**index), fields)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, indent=2)

    def renamed(self, **changes: Any) -> SearchSchema:
        return replace(self, index=replace(self.index, **changes))
