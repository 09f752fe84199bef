"""The command line: schemas and indexes of a warehouse."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import SparkSession

from vecframe.schema import SearchSchema
from vecframe.sources.index import SearchIndex, inline_schema
from vecframe.sources.store import Catalog


def _session() -> SparkSession:
    return SparkSession.builder.appName("vecframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vecframe", exit_on_error=False)
    areas = top.add_subparsers(dest="area", required=True)
    schema = areas.add_parser("schema").add_subparsers(dest="action", required=True)
    for action in ("validate", "show"):
        schema.add_parser(action).add_argument("--file", required=True)
    index = areas.add_parser("index").add_subparsers(dest="action", required=True)
    of: dict[str, argparse.ArgumentParser] = {}
    for action in ("list", "info", "create", "clear", "delete"):
        of[action] = index.add_parser(action)
        of[action].add_argument("--warehouse", required=True)
    for action in ("info", "clear", "delete"):
        of[action].add_argument("--name", required=True)
    of["clear"].add_argument("--batch-size", type=int, default=1000)
    of["delete"].add_argument("--drop-documents", action="store_true")
    create = of["create"]
    create.add_argument("--schema")
    create.add_argument("--name")
    create.add_argument("--prefix", action="append", default=[])
    create.add_argument("--storage", default="hash")
    create.add_argument("--field", action="append", default=[])
    for flag in ("--overwrite", "--drop-documents", "--skip-if-exists"):
        create.add_argument(flag, action="store_true")
    return top


def _camel(d: dict) -> dict:
    name = lambda k: k.split("_")[0] + "".join(x.title() for x in k.split("_")[1:])
    return {name(k): [_camel(x) if isinstance(x, dict) else x for x in v] if isinstance(v, (list, tuple)) else _camel(v) if isinstance(v, dict) else v for k, v in d.items()}


def run(argv: list[str], session: Callable[[], SparkSession] = _session) -> str:
    """The output of a command; anything wrong raises."""
    try:
        a = parser().parse_args(argv)
    except argparse.ArgumentError as e:
        raise ValueError(str(e)) from None
    if a.area == "schema":
        schema = SearchSchema.from_yaml_file(a.file)
        return f"Schema {schema.index.name} is valid." if a.action == "validate" else json.dumps(_camel(schema.to_dict()), indent=2, ensure_ascii=False)
    if a.action == "list":
        return "\n".join(Catalog(f"{a.warehouse}/catalog", session()).names())
    if a.action == "create":
        if bool(a.schema) == bool(a.name or a.prefix or a.field):
            raise ValueError("give --schema, or --name, --prefix and --field")
        schema = SearchSchema.from_yaml_file(a.schema) if a.schema else inline_schema(a.name or "", a.prefix, a.storage, a.field)
        made = SearchIndex(session(), a.warehouse, schema).create(a.overwrite, a.skip_if_exists, a.drop_documents)
        return f"{'Created' if made else 'Skipped'} {schema.index.name}"
    index = SearchIndex.from_existing(session(), a.warehouse, a.name)
    if a.action == "info":
        return json.dumps(_camel(asdict(index.info())), indent=2, ensure_ascii=False)
    if a.action == "clear":
        return str(index.clear(a.batch_size))
    index.drop(a.drop_documents)
    return f"Deleted {a.name}"


def main(argv: list[str] | None = None) -> int:
    try:
        print(run(sys.argv[1:] if argv is None else argv))
        return 0
    except (ValueError, OSError, SystemExit) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
