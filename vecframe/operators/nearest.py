"""Batch nearest neighbours: few queries against many documents, or many rows against few references."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecframe.runtime import BROADCAST_BYTES, materialize
from vecframe.schema import Metric


def _distances(metric: Metric, queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    dot = queries @ docs.T
    if metric is Metric.IP:
        return 1 - dot
    if metric is Metric.L2:
        return np.stack([((docs - q) ** 2).sum(axis=1) for q in queries])
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dot / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(docs, axis=1)[None, :])


def _scan(block, metric: Metric, dims: int, k: int, threshold: float | None):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, queries = block.value
        best = None
        for b in batches:
            b = b[[x is not None and len(x) == dims for x in b["vector"]]]
            for i in range(0, len(b), 4096):
                part = b.iloc[i : i + 4096]
                d = _distances(metric, queries, np.stack([np.asarray(x, np.float64) for x in part["vector"]]))
                d = np.where(np.isnan(d), np.inf, d)
                top = np.argpartition(d, k, axis=1)[:, :k] if d.shape[1] > k else np.tile(np.arange(d.shape[1]), (len(d), 1))
                # all of the same distance as the k-th, so that the smaller key can win
                edge = np.take_along_axis(d, top, 1).max(axis=1)
                row, col = np.nonzero((d <= edge[:, None]) & np.isfinite(d) & (d <= (np.inf if threshold is None else threshold)))
                found = pd.DataFrame({"query": numbers[row], "key": part["key"].to_numpy()[col], "distance": d[row, col]})
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values(["query", "distance", "key"]).groupby("query", sort=False).head(k)
        if best is not None and len(best):
            yield best

    return scan


def nearest_join(queries: DataFrame, query_id: str, query_vector: str, docs: DataFrame, key: str, vector: str, metric: Metric, dims: int, k: int = 1, threshold: float | None = None) -> DataFrame:
    """(query_id, key, distance): the ``k`` nearest documents of each query, equal distances by the smaller key.

    Queries are the small side: they are sent to the executors in blocks of a checked size, one at a time through the
    driver as Arrow, and each block scans the documents once and leaves ``k`` rows a query and partition. Nulls and
    vectors of another length take no part.
    """
    spark = queries.sparkSession
    names = dict(docs.dtypes)[key], dict(queries.dtypes)[query_id]
    size = max(1, BROADCAST_BYTES // (dims * 8))
    slim = docs.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(F.col(vector).isNotNull())
    asked = materialize(queries.select(F.col(query_id).alias("id"), F.col(query_vector).cast("array<double>").alias("vector")).where(F.size(query_vector) == dims))
    blocks, parts = -(-asked.count() // size), []
    for i in range(blocks):  # by a hash, so that a block is about as large as every other
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()
        if len(part):
            vectors = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            block = spark.sparkContext.broadcast((part["id"].to_numpy(), vectors))
            parts.append(slim.mapInPandas(_scan(block, metric, dims, k, threshold), f"query {names[1]}, key {names[0]}, distance double"))
    if not parts:
        return spark.createDataFrame([], f"{query_id} {names[1]}, {key} {names[0]}, distance double")
    found = reduce(DataFrame.unionAll, parts)
    order = Window.partitionBy("query").orderBy("distance", "key")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return best.select(F.col("query").alias(query_id), F.col("key").alias(key), "distance")


def nearest_of_few(rows: DataFrame, row_id: str, row_vector: str, few: DataFrame, key: str, vector: str, metric: Metric, dims: int, k: int = 1, threshold: float | None = None) -> DataFrame:
    """(row_id, key, distance): the ``k`` nearest of a few references for each of any number of rows, without a shuffle.

    The references are sent to the executors, so their size is checked: more than fit a broadcast are an error, and
    :func:`nearest_join` is the way for those. Equal distances go by the smaller key.
    """
    spark = rows.sparkSession
    names = dict(few.dtypes)[key], dict(rows.dtypes)[row_id]
    most = max(1, BROADCAST_BYTES // (dims * 8))
    known = few.where(F.size(vector) == dims).select(key, vector).orderBy(key).limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} references of {dims} parts don't fit a broadcast; use nearest_join")
    if not known:
        return spark.createDataFrame([], f"{row_id} {names[1]}, {key} {names[0]}, distance double")
    block = spark.sparkContext.broadcast((np.array([r[0] for r in known]), np.array([r[1] for r in known], np.float64)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, references = block.value
        for b in batches:
            b = b[[x is not None and len(x) == dims for x in b["vector"]]]
            for i in range(0, len(b), 4096):
                part = b.iloc[i : i + 4096]
                d = _distances(metric, np.stack([np.asarray(x, np.float64) for x in part["vector"]]), references)
                d = np.where(np.isnan(d), np.inf, d)
                best = np.argsort(d, axis=1, kind="stable")[:, :k]  # references are in order of their keys
                near = np.take_along_axis(d, best, 1)
                row, col = np.nonzero(np.isfinite(near) & (near <= (np.inf if threshold is None else threshold)))
                yield pd.DataFrame({"id": part["id"].to_numpy()[row], "key": keys[best[row, col]], "distance": near[row, col]})

    slim = rows.select(F.col(row_id).alias("id"), F.col(row_vector).alias("vector")).where(F.col(row_vector).isNotNull())
    found = slim.mapInPandas(scan, f"id {names[1]}, key {names[0]}, distance double")
    return found.select(F.col("id").alias(row_id), F.col("key").alias(key), "distance")
