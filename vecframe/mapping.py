"""Rows as typed objects."""

from __future__ import annotations

import base64
import dataclasses
import enum
import json
import types
import typing
import uuid
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, Row

KEY = "_key"


class MappingError(ValueError):
    pass


def _optional(kind: Any) -> tuple[Any, bool]:
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        args = [a for a in typing.get_args(kind) if a is not type(None)]
        return (args[0] if len(args) == 1 else Any), len(args) < len(typing.get_args(kind))
    return kind, False


def convert(value: Any, kind: Any, name: str) -> Any:
    """``value`` as ``kind``: texts are parsed, bytes become vectors, JSON texts nested objects."""
    kind, may_be_null = _optional(kind)
    if value is None:
        if may_be_null:
            return None
        raise MappingError(f"{name} is missing")
    try:
        if kind is Any or (isinstance(kind, type) and type(value) is kind):
            return value
        if kind is bool:
            if isinstance(value, str):
                return {"true": True, "1": True, "false": False, "0": False}[value.strip().lower()]
            return bool(value)
        if kind is int:
            return int(value) if not isinstance(value, float) or value == int(value) else _fail(name, kind)
        if kind is float:
            return float(value)
        if kind is str:
            return value if isinstance(value, str) else str(value)
        if kind is bytes:
            return base64.b64decode(value) if isinstance(value, str) else bytes(value)
        if kind is Decimal:
            return Decimal(str(value))
        if kind is uuid.UUID:
            return uuid.UUID(str(value))
        if isinstance(kind, type) and issubclass(kind, enum.Enum):
            return next(e for e in kind if str(value).lower() in (e.name.lower(), str(e.value).lower()))
        if typing.get_origin(kind) is list:
            if isinstance(value, (bytes, bytearray)):
                from vecframe.functions.vectors import decode

                return decode(bytes(value))
            inner = (typing.get_args(kind) or (Any,))[0]
            return [convert(v, inner, name) for v in (json.loads(value) if isinstance(value, str) else value)]
        if dataclasses.is_dataclass(kind):
            nested = json.loads(value) if isinstance(value, str) else value.asDict() if isinstance(value, Row) else value
            return build(nested, kind)
        if kind is dict or typing.get_origin(kind) is dict:
            return json.loads(value) if isinstance(value, str) else dict(value)
    except MappingError:
        raise
    except (ValueError, TypeError, KeyError, StopIteration, ArithmeticError) as e:
        raise MappingError(f"{name}: {value!r} is no {getattr(kind, '__name__', kind)}") from e
    raise MappingError(f"{name}: can't map to {kind}")


def _fail(name: str, kind: Any) -> Any:
    raise MappingError(f"{name} is no {kind.__name__}")


def _fold(name: str) -> str:
    return name.replace("_", "").lower()


def build(values: dict[str, Any], cls: type) -> Any:
    """An instance of a dataclass; names match without case and underscores, ``id`` is the document key first."""
    known = {_fold(k): v for k, v in values.items()}
    if KEY in values:
        known["id"] = values[KEY]
    hints = typing.get_type_hints(cls)
    out = {}
    for f in dataclasses.fields(cls):
        name = f.metadata.get("name", f.name)
        if _fold(name) in known and known[_fold(name)] is not None:
            out[f.name] = convert(known[_fold(name)], hints[f.name], f.name)
        elif f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            out[f.name] = convert(None, hints[f.name], f.name)
    return cls(**out)


def map_rows(rows: DataFrame, cls: type) -> list[Any]:
    """A page of rows, which is small, as instances of ``cls``."""
    return [build(r.asDict(), cls) for r in rows.collect()]
