"""Copies that differ in formatting only: canonical keys, a range-partitioned sort and a scan of adjacent runs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.runtime import broadcast_if, materialize, spread

_NOT_KEPT = r"[^\p{L}\p{N}\p{M}]|[\x{FE00}-\x{FE0F}\x{20E3}]"
_FIELD = re.compile(r"""\s*["'“‘]?\s*([^\W\d_][\w .\-]{0,63}?)\s*["'”’]?\s*(?:[:=]|->|=>)\s*(.*?)\s*$""", re.S)
#: Variation selectors and the keycap mark: marks of the category M that are no part of a word.
_JOINERS = {*map(chr, range(0xFE00, 0xFE10)), "\u20e3"}
_NOT_ASCII_WORD = re.compile("[^A-Za-z0-9]+")
_DECORATION = re.compile(r"^[\s>*•\-]+|[\s.]+$")


def _bare(text: str) -> str:
    if text.isascii():
        return _NOT_ASCII_WORD.sub("", text).lower()
    kept = (c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c)[0] in "LNM" and c not in _JOINERS)
    return "".join(kept).upper().lower()


def _pieces(text: str, mark: str) -> list[str]:
    """``text`` split at ``mark`` outside double or, where they open a value, single quotes."""
    if '"' not in text and "'" not in text:
        return text.split(mark)
    out, start, quote, value = [], 0, "", False
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c == '"' or (c == "'" and value):
            quote = c
        elif c == mark:
            out.append(text[start:i])
            start, value = i + 1, False
            continue
        value = c in ":=" or (value and c.isspace())
    return [*out, text[start:]]


def _named(text: str) -> list[tuple[str, str]] | None:
    """The fields of a prompt that is a list of at least two named fields; None of any other text."""
    t = _DECORATION.sub("", text)
    if t.startswith("{") and t.endswith("}"):
        try:
            got = json.loads(t, object_pairs_hook=lambda pairs: pairs)
            if isinstance(got, list) and len(got) > 1 and all(isinstance(x, tuple) for x in got):
                return [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in got]
        except ValueError:
            pass
        t = t[1:-1]
    for mark in ";|\n,&\t":
        if mark not in t:
            continue
        parts = [x for x in _pieces(t, mark) if x.strip(" \t\r\n.　 ")]
        if len(parts) > 1:
            found = [_FIELD.match(_DECORATION.sub("", x)) for x in parts]
            if all(found):
                return [(m[1], m[2]) for m in found if m]
    return None


def canonical(text: str) -> str:
    """The text's letters and digits in lower case; of a list of named fields its sorted ``name=value`` parts.

    Empty if nothing is left. Two texts are copies if their canonical forms are equal and not empty.
    """
    fields = _named(text)
    if fields is None:
        return _bare(text)
    return "\n".join(sorted(f"{_bare(k)}={_bare(v)}" for k, v in fields))


def canonical_column(text: Column) -> Column:
    """:func:`canonical` as a column. Plain texts stay in the JVM; only lists and texts with combining marks visit Python."""
    special = text.rlike(r"(?s)(?:[:=]|->).*?(?:[:=]|->)|\p{M}")
    in_python = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else canonical(x)), "string")
    plain = F.lower(F.upper(F.regexp_replace(text, _NOT_KEPT, "")))
    return F.when(special, in_python(F.when(special, text))).otherwise(plain)


def sorted_keys(df: DataFrame, id_col: str, key: Column, *more: str) -> DataFrame:
    """``key``, ``id`` and ``more``, range-partitioned and sorted by key and id. Rows without a key or an id are left out.

    The keys are written before they are sampled for the ranges, so that each is computed once. The id is part of the
    range, so a key that a third of all rows share is cut over many partitions like any other.
    """
    rows = df.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), *more).where((F.col("key") != "") & F.col("id").isNotNull())
    return materialize(materialize(spread(rows)).repartitionByRange("key", "id").sortWithinPartitions("key", "id"))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """The rows of a sorted partition without repeated (key, id), whether each begins a run of its key, and the run's first id."""
    key = last = run = None
    for b in batches:
        keys, ids = b["key"].to_numpy(object), b["id"].to_numpy(np.int64)
        if not len(ids):
            continue
        new = keys != np.concatenate([np.array([key], object), keys[:-1]])
        again = ~new & (ids == np.concatenate([[ids[0] - 1 if last is None else last], ids[:-1]]))
        b, keys, ids, new = b[~again], keys[~again], ids[~again], new[~again]
        if not len(ids):
            continue
        starts = np.flatnonzero(new)
        runs = np.concatenate([np.full(starts[0] if len(starts) else len(ids), run or 0, np.int64), np.repeat(ids[starts], np.diff([*starts, len(ids)]))])
        yield b, new, runs
        key, last, run = keys[-1], int(ids[-1]), int(runs[-1])


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(run, id) of each row after the first of its run, and of the first row too of a partition's first and last run.

    These two are its edges: they may go on in a partition before or behind.
    """
    tail, first = None, True
    for b, new, runs in _runs(batches):
        ids = b["id"].to_numpy(np.int64)
        show = ~new
        show[0] |= first
        yield pd.DataFrame({"run": runs[show], "id": ids[show]})
        tail, first = int(runs[-1]), False
    if tail is not None:
        yield pd.DataFrame({"run": [tail], "id": [tail]})


def _records(texts: str | None):
    """(run, n, key, text) of each run, with its first row's text; the key is given at a partition's edges only."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_run, at_start = None, True
        for b, new, runs in _runs(batches):
            starts, ids, keys = np.flatnonzero(new), b["id"].to_numpy(np.int64), b["key"].to_numpy(object)
            said = b[texts].to_numpy(object) if texts else np.full(len(ids), None)
            sizes = np.diff([*starts, len(ids)])
            if open_run is not None:
                open_run[1] += int(starts[0]) if len(starts) else len(ids)
            if not len(starts):
                continue
            out = [] if open_run is None else [tuple(open_run)]
            out += zip(ids[starts[:-1]].tolist(), sizes[:-1].tolist(), [None] * (len(starts) - 1), said[starts[:-1]])
            last = starts[-1]
            if out and at_start:
                out[0] = (*out[0][:2], open_run[2] if open_run is not None else keys[0], out[0][3])
            elif open_run is not None:
                out[0] = (*out[0][:2], None, out[0][3])
            at_start &= not out
            if out:
                yield pd.DataFrame(out, columns=["run", "n", "key", "text"])
            open_run = [int(ids[last]), int(sizes[-1]), keys[last], said[last]]
        if open_run is not None:
            yield pd.DataFrame([tuple(open_run)], columns=["run", "n", "key", "text"])

    return scan


def _joined_edges(ordered: DataFrame) -> DataFrame:
    """(run, first_id, n_copies) of the runs that go over a partition's edge: at most two for each partition."""
    runs = ordered.mapInPandas(_records(None), _RECORD).where("key is not null")
    whole = runs.groupBy("key").agg(F.collect_set("run").alias("runs"), F.min("run").alias("first_id"), F.sum("n").alias("n_copies"))
    edges = materialize(whole.where(F.size("runs") > 1).select(F.explode("runs").alias("run"), "first_id", "n_copies"))
    return broadcast_if(edges, edges.count(), 32)


_RECORD = "run long, n long, key string, text string"


def copy_members(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(first_id, id): every row whose key another row with a smaller id has too, with the smallest id of the key.

    A null or empty key has no copies; an id that is delivered more than once counts once; an empty table gives no rows.
    """
    ordered = sorted_keys(df, id_col, key)
    rows = ordered.mapInPandas(_members, "run long, id long")
    whole = rows.join(_joined_edges(ordered), "run", "left")
    return whole.select(F.coalesce("first_id", "run").alias("first_id"), "id").where("first_id <> id")


def copy_records(df: DataFrame, id_col: str, key: Column, text_col: str) -> DataFrame:
    """(first_id, n_copies, text): one row for each distinct key that is not empty, with the exact number of its ids.

    The text is that of the smallest id; it travels with the key, so the source is read once.
    """
    ordered = sorted_keys(df, id_col, key, text_col)
    runs = ordered.mapInPandas(_records(text_col), _RECORD).select("run", "n", "text")
    whole = runs.join(_joined_edges(ordered), "run", "left").where("first_id is null or first_id = run")
    return whole.select(F.col("run").alias("first_id"), F.coalesce("n_copies", "n").alias("n_copies"), "text")


def p1_members(entries: DataFrame) -> DataFrame:
    found = copy_members(entries, "entry_id", canonical_column(F.col("prompt")))
    return found.withColumnRenamed("id", "entry_id")


def p1_records(entries: DataFrame) -> DataFrame:
    """One record for each set of copies: its first entry with that entry's prompt and the number of copies."""
    rows = entries.select("entry_id", "prompt")
    return copy_records(rows, "entry_id", canonical_column(F.col("prompt")), "prompt").withColumnRenamed("text", "prompt")
