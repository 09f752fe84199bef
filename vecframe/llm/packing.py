"""Texts packed into containers of a fixed number of tokens: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecframe.runtime import materialize, spread

CAPACITY = 2048
#: Items packed together by one task. Larger groups waste less of their last containers, which is little at this size.
GROUP_ITEMS = 20_000
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """The byte-level encoding of a file of ``token rank`` lines; no special tokens, so any text is ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text; null of a null text."""

    name = os.path.basename(vocabulary)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sent = SparkFiles.get(name)  # sent along by p6_pack, so that no executor needs a file of its own
        encode = encoding(sent if os.path.exists(sent) else vocabulary).encode_ordinary
        for b in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in b], dtype="Int64")

    return count(text)


def first_fit_decreasing(sizes: np.ndarray, ids: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item: items by falling size, then id, each into the first container with room.

    A tournament tree over the containers holds the largest room below each node, so the first fit is found in
    logarithmic time. It has a leaf for every item, since no more containers than items are needed.
    """
    width = 1 << max(0, int(len(sizes) - 1).bit_length())
    room = [capacity] * (2 * width)
    out = np.zeros(len(sizes), np.int64)
    for i in np.lexsort((ids, -sizes)).tolist():
        size, node = int(sizes[i]), 1
        while node < width:
            node *= 2
            if room[node] < size:
                node += 1
        out[i] = node - width
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return out


def pack(df: DataFrame, id_col: str, size: Column, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, seed: int = 11) -> DataFrame:
    """(id, piece, first_token, tokens, container): every item placed, no container beyond ``capacity``.

    An item larger than the capacity is cut into full pieces, each a container of its own, and a rest that is packed like
    any other item; no other item is cut. Items of size 0 are placed too; those of a null size or id are no items. Ids
    are unique, as the rule of ties needs. An empty table gives no rows.
    """
    items = materialize(df.select(F.col(id_col).cast("long").alias("id"), size.cast("long").alias("n")).where("id is not null and n is not null"))
    groups = max(1, -(-items.count() // group_items))
    full = items.where(F.col("n") >= capacity).select(
        "id", F.explode(F.sequence(F.lit(0), F.expr(f"cast(n div {capacity} - 1 as int)"))).alias("piece"))
    whole = full.select("id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("tokens"), F.concat_ws("-", F.lit("d"), "id", "piece").alias("container"))
    rest = items.select(
        "id", F.expr(f"cast(n div {capacity} as int)").alias("piece"), F.expr(f"(n div {capacity}) * {capacity}").alias("first_token"), F.expr(f"n % {capacity}").alias("tokens"),
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(groups)).alias("grp")).where("tokens > 0 or first_token = 0")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        bins = first_fit_decreasing(group["tokens"].to_numpy(), group["id"].to_numpy(), capacity)
        name = f"g-{group['grp'].iloc[0]}-"
        return group[["id", "piece", "first_token", "tokens"]].assign(container=[name + str(b) for b in bins])

    schema = "id long, piece int, first_token long, tokens long, container string"
    return rest.groupBy("grp").applyInPandas(fit, schema).unionByName(whole)


def p6_totals(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row on the packing of all documents: how many are placed, and how many break a rule.

    overfull: containers beyond the capacity; cut_short: documents cut though they fit; broken: documents whose pieces do
    not follow each other from token 0; compact: whether the containers are at most 2 % and one a group more than the tokens need.
    """
    placed = materialize(p6_pack(docs, vocabulary))
    loads = placed.groupBy("container").agg(F.sum("tokens").alias("load")).agg(F.count(F.when(F.col("load") > CAPACITY, 1)).alias("overfull"), F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("load"), F.lit(0)).alias("all")).first()
    of_each = placed.groupBy("id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("size"), F.max(F.col("first_token") + F.col("tokens")).alias("end"), F.min("first_token").alias("start"), F.sum(F.when(F.col("first_token") != F.col("piece") * CAPACITY, 1).otherwise(0)).alias("astray"))
    totals = of_each.agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when((F.col("size") <= CAPACITY) & (F.col("pieces") > 1), 1)).alias("cut_short"),
        F.count(F.when((F.col("start") != 0) | (F.col("end") != F.col("size")) | (F.col("astray") > 0), 1)).alias("broken"))
    compact = F.lit(loads["containers"]) <= 1.02 * loads["all"] / CAPACITY + 1 + F.col("documents") / GROUP_ITEMS
    return totals.select("documents", F.lit(loads["overfull"]).cast("long").alias("overfull"), "cut_short", "broken", compact.alias("compact"))


def p6_pack(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    docs.sparkSession.sparkContext.addFile(vocabulary)
    return pack(spread(docs.select("doc_id", "text")), "doc_id", token_count(F.col("text"), vocabulary))
