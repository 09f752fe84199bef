"""Top N rows of every group by partition lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecframe.runtime import broadcast_if, materialize, trim_blank

#: Bytes that a group's name and bound take in a broadcast, with some room.
_BOUND_BYTES = 200


def _changes(column: pa.Array, before) -> np.ndarray:
    """Whether each value differs from the one before it, the first from ``before``."""
    if before is None:
        first = True
    else:
        first = bool(pc.not_equal(column[0], before).as_py())
    rest = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False).astype(bool)
    return np.concatenate([[first], rest])


def _local_best(n: int):
    """The first ``n`` different rows of each group of a sorted partition; the n-th one carries its score as a bound.

    The partition comes sorted by group, score and id, so the state is one row and a count, whatever the groups.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(i) for i in range(3)]
            was = last or (None, None, None)
            last = tuple(c[len(c) - 1] for c in columns)
            group, *others = (_changes(c, x) for c, x in zip(columns, was))
            fresh = np.flatnonzero(group | others[0] | others[1])  # a row delivered twice stands behind its first copy
            if not len(fresh):
                continue
            starts = np.maximum.accumulate(np.where(group[fresh], np.arange(len(fresh)), -1))
            place = np.arange(len(fresh)) - starts + np.where(starts < 0, seen - 1, 0)
            seen = int(place[-1]) + 1
            kept = place < n
            rows = b.take(pa.array(fresh[kept]))
            score = rows.column(1)
            bound = pc.if_else(pa.array(place[kept] == n - 1), score, pa.scalar(None, score.type))
            yield pa.RecordBatch.from_arrays([*rows.columns, bound], ["g", "score", "id", "bound"])

    return scan


def top_n(df: DataFrame, group: Column, score: Column, id_col: str, n: int = 5) -> DataFrame:
    """The ``n`` rows of each ``group`` with the smallest ``score``, equal scores by the smaller id.

    Columns ``g``, ``score``, ``id``, ``rank`` (from 1). Rows with a null group, score or id or a NaN score do not count;
    a row that occurs more than once (same group, score and id) counts once; an empty input gives no rows.

    Each partition is sorted where it lies and leaves its first N rows of each group, and its own N-th best score as a
    bound of the group's. The least bound of a group drops rows of the other partitions before anything is shuffled: a
    group that holds a large part of all rows leaves N rows for each partition at most, and far fewer behind its bound.
    Groups of fewer than N rows in every partition have no bound and need none. Every other group has one; bounds that
    are more than a broadcast holds meet the rows in a shuffle by group, which the ranking then shares.
    """
    rows = df.select(group.alias("g"), score.cast("double").alias("score"), F.col(id_col).alias("id"))
    rows = rows.where(F.col("g").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & F.col("id").isNotNull())
    types = dict(rows.dtypes)
    schema = f"g {types['g']}, score double, id {types['id']}, bound double"
    local = materialize(rows.sortWithinPartitions("g", "score", "id").mapInArrow(_local_best(n), schema))
    bounds = materialize(local.where("bound is not null").groupBy("g").agg(F.min("bound").alias("least")))
    kept = local.join(broadcast_if(bounds, bounds.count(), _BOUND_BYTES), "g", "left").where(F.col("least").isNull() | (F.col("score") <= F.col("least")))
    order = Window.partitionBy("g").orderBy("score", "id")
    # dense_rank lets delivered-twice rows share a rank; one of them is taken afterwards, among the few survivors
    ranked = kept.select("g", "score", "id", F.dense_rank().over(order).alias("rank")).where(F.col("rank") <= n)
    return ranked.dropDuplicates(["g", "id", "rank"])


def p3_topn(matches: DataFrame, n: int = 5) -> DataFrame:
    """The nearest ``n`` matches of each route; blank routes do not count."""
    name = trim_blank(F.col("route_name"))
    return top_n(matches, F.when(name != "", name), F.col("distance"), "match_id", n)
