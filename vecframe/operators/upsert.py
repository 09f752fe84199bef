"""Upserts, deletions and lookups of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_each(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key: that with the largest ``order``. Partial aggregation keeps hot keys small."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in others])


def replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows take the place of old ones of the same key."""
    return old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Values of new rows that are not null take the place of old ones; other columns of an old row stay."""
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    a, b = old.alias("a"), new.alias("b")
    pick = lambda c: F.coalesce(*[F.col(f"{s}.{c}") for s, df in (("b", new), ("a", old)) if c in df.columns]).alias(c)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*map(pick, columns))


def without(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def lookup(requests: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Every request with the stored columns of its key, null where there are none."""
    return requests.join(store, key, "left")
