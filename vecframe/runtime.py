"""What every operator needs from the session: materialised steps, size-checked broadcasts, tables by path."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that an operator may broadcast by a hint of its own.
BROADCAST_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a plain local session gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="vecframe-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors reach."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its known number of rows fits :data:`BROADCAST_BYTES`, else unchanged."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` on as many partitions as the session has cores, if its source has fewer, as a single small file does.

    For the steps of operators that compute long on each row; a large table has more partitions and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def trim_blank(c: Column) -> Column:
    """``c`` without blanks of any kind (tabs, no-break and ideographic spaces included) at either end."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the place of each row in its order, from 0, written once; no task sees more than its own partition.

    A partition's rows are counted by the numbers that Spark gives them, and each begins where those before it end.
    """
    first = F.monotonically_increasing_id()
    rows = materialize(df.withColumn(name, first))
    part = F.shiftright(F.col(name), 33)
    sizes = {r[0]: r[1] for r in rows.groupBy(part).count().collect()}  # one short row a partition
    starts, at = {}, 0
    for p in sorted(sizes):
        starts[p], at = at, at + sizes[p]
    offsets = df.sparkSession.createDataFrame([(p, n) for p, n in starts.items()] or [(0, 0)], "_part long, _start long")
    placed = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_start") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start")
