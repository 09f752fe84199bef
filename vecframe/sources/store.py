"""A keyed document store in Parquet: segments in folders of their own and a manifest that names the current ones.

A write adds a segment of its rows, or of the keys it deletes, and then replaces the manifest, so a reader never sees half a
write, and no folder that is read is written. The newest segment counts for a key. Rows lie by a bucket of their key and
sorted by key, so that a key is looked up in one bucket and a prefix skips row groups. The last segment takes up the next
write while it is small; :data:`TIER` segments of a level are merged into one of the next, so a row is rewritten a
logarithmic number of times. A version is claimed before it is written: of two writers one starts anew from the other's.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.operators import upsert
from vecframe.runtime import broadcast_if
from vecframe.sources.files import Files

KEY, EXPIRES, INGESTED = "_key", "_expires_at", "_ingested_at"
_BUCKET, _DELETED = "_bucket", "_deleted"
_SYSTEM = [T.StructField(KEY, T.StringType(), False), T.StructField(EXPIRES, T.TimestampType()), T.StructField(INGESTED, T.TimestampType())]
#: Rows up to which the last segment takes up the next write; segments of a level that are merged.
OPEN_ROWS, TIER = 1000, 8
#: Bytes of a key in a broadcast.
_KEY_BYTES = 120
#: Seconds after which a claimed version that was never written is free again.
STALE = 6 * 3600
#: Seconds that a writer waits for its turn.
WAIT = 900


class Conflict(RuntimeError):
    """Another writer was first, time and again."""


class DocumentStore:
    """Rows by key below ``path``, any path that Spark reads. ``now`` is given to make expiry the same every time."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2, buckets: int = 16) -> None:
        self.spark, self.path, self.keep, self.buckets = spark, path.rstrip("/"), keep, buckets
        self.files = Files(spark, self.path)

    # versions

    def exists(self) -> bool:
        return self.files.read("manifest.json") is not None

    def _state(self) -> dict:
        text = self.files.read("manifest.json")
        return json.loads(text) if text else {"version": 0, "segments": [], "schema": T.StructType(_SYSTEM).jsonValue(), "buckets": self.buckets, "older": []}

    def _change(self, change: Callable[[dict], tuple[DataFrame | None, int]]) -> int:
        """Add the rows that ``change`` makes of a state as its next version; begin anew if another writer was first."""
        until = time.monotonic() + WAIT
        while time.monotonic() < until:
            state = self._state()
            claim = f"claim-{state['version'] + 1}"
            if not self.files.claim(claim):
                if self.files.age(claim) > STALE and self._state()["version"] == state["version"]:
                    self.files.remove(claim)
                time.sleep(0.1)
                continue
            try:
                if self._state()["version"] != state["version"]:
                    continue
                rows, result = change(state)
                if rows is not None:
                    self._commit(state, rows)
                return result
            finally:
                self.files.remove(claim)
        raise Conflict(f"{self.path}: another writer holds its turn, or left a claim- file when it died")

    def _commit(self, state: dict, rows: DataFrame) -> None:
        types = {f["name"]: f for f in state["schema"]["fields"]}
        types |= {f.name: f.jsonValue() for f in rows.schema.fields if f.name not in (_BUCKET, _DELETED)}
        schema = {"type": "struct", "fields": list(types.values())}
        version, segments, gone = state["version"] + 1, list(state["segments"]), []
        if segments and segments[-1]["level"] == 0 and segments[-1]["rows"] <= OPEN_ROWS:
            gone = [segments.pop()]
            older = self._segment(gone[0], schema)
            rows = older.join(rows.select(KEY), KEY, "left_anti").unionByName(rows, allowMissingColumns=True)
        segments.append(self._written(rows, version, 0, not segments))
        if segments[-1]["rows"] > OPEN_ROWS:
            segments[-1]["level"] = 1
        while len(segments) >= TIER and segments[-1]["level"] and len({s["level"] for s in segments[-TIER:]}) == 1:
            tail, segments = segments[-TIER:], segments[:-TIER]
            merged = self._live(tail, schema, with_deleted=True)
            segments.append(self._written(merged, version, tail[0]["level"] + 1, not segments))
            gone += tail
        older = [*state["older"], [s["folder"] for s in gone]]
        drop, older = older[: -self.keep or None], older[-self.keep :]
        fresh = {"version": version, "segments": [s for s in segments if s["rows"]], "schema": schema, "buckets": state["buckets"], "older": older, "at": time.time()}
        self.files.write("manifest.json", json.dumps(fresh))
        for folder in {f for d in drop for f in d}:
            self.files.remove(folder)

    def _written(self, rows: DataFrame, version: int, level: int, first: bool) -> dict:
        """A new segment; the first one has nothing to delete from."""
        folder = f"v{version}-{uuid.uuid4().hex[:8]}"
        rows = rows if _DELETED in rows.columns else rows.withColumn(_DELETED, F.lit(False))
        rows = rows.withColumn(_DELETED, F.coalesce(_DELETED, F.lit(False))).withColumn(_BUCKET, self._bucket(F.col(KEY)))
        if first:
            rows = rows.where(~F.col(_DELETED))
        rows.hint("rebalance", _BUCKET).sortWithinPartitions(_BUCKET, KEY).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(f"{KEY} string").parquet(f"{self.path}/{folder}").count()  # from the files' footers
        return {"folder": folder, "rows": written, "level": level}

    # rows

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self._state()["buckets"])).cast("int")

    def _segment(self, segment: dict, schema: dict) -> DataFrame:
        whole = T.StructType.fromJson(schema).add(_DELETED, T.BooleanType()).add(_BUCKET, T.IntegerType())
        return self.spark.read.schema(whole).parquet(f"{self.path}/{segment['folder']}")

    def _live(self, segments: list[dict], schema: dict, with_deleted: bool = False, only: Column | None = None) -> DataFrame:
        """The newest row of each key; ``only`` limits every segment's rows. Newer keys are few, or meet in a shuffle."""
        if not segments:
            return self.spark.createDataFrame([], T.StructType.fromJson(schema).add(_DELETED, T.BooleanType()))
        frames = [self._segment(s, schema) if only is None else self._segment(s, schema).where(only) for s in segments]
        out = frames[0].drop(_BUCKET)
        if len(frames) > 1:
            later = reduce(DataFrame.unionByName, [f.drop(_BUCKET).withColumn("_seq", F.lit(i)) for i, f in enumerate(frames[1:])])
            newest = upsert.last_of_each(later, KEY, F.col("_seq")).drop("_seq") if len(frames) > 2 else later.drop("_seq")
            keys = broadcast_if(newest.select(KEY), sum(s["rows"] for s in segments[1:]), _KEY_BYTES)
            out = out.join(keys, KEY, "left_anti").unionByName(newest)
        return out if with_deleted else out.where(~F.col(_DELETED)).drop(_DELETED)

    @staticmethod
    def _unexpired(rows: DataFrame, now: Column | None) -> DataFrame:
        return rows.where(F.col(EXPIRES).isNull() | (F.col(EXPIRES) > (F.current_timestamp() if now is None else now)))

    def read(self, now: Column | None = None) -> DataFrame:
        """The rows that have not expired, with their system columns."""
        state = self._state()
        return self._unexpired(self._live(state["segments"], state["schema"]), now)

    def get(self, keys: list[str], now: Column | None = None) -> DataFrame:
        """The rows of some keys, read from their buckets only."""
        state = self._state()
        keys = sorted(set(keys))
        buckets = [F.pmod(F.xxhash64(F.lit(k)), F.lit(state["buckets"])).cast("int") for k in keys]
        only = F.col(KEY).isin(keys) & (F.col(_BUCKET).isin(*buckets) if len(keys) <= state["buckets"] else F.lit(True))
        return self._unexpired(self._live(state["segments"], state["schema"], only=only), now)

    def columns(self) -> dict[str, T.DataType]:
        """The stored columns by name, system columns aside."""
        return {f.name: f.dataType for f in T.StructType.fromJson(self._state()["schema"]).fields if f.name not in (KEY, EXPIRES, INGESTED)}

    # writes

    def put(self, rows: DataFrame) -> None:
        """Whole rows with their system columns, one a key, each in the place of the stored one."""
        self._change(lambda state: (rows, 0))

    def insert(self, rows: DataFrame, key: str) -> bool:
        """One new row; False, and nothing is written, if its key is there already."""
        new = self._prepared(rows, None, None)
        return bool(self._change(lambda state: (None, 0) if self.get([key]).take(1) else (new, 1)))

    def _prepared(self, rows: DataFrame, now: Column | None, ttl: float | None) -> DataFrame:
        at = F.current_timestamp() if now is None else now
        out = rows.where(F.col(KEY).isNotNull()).withColumn(INGESTED, at)
        expires = F.lit(None).cast("timestamp") if ttl is None else at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(ttl)))
        out = out.withColumn(EXPIRES, expires)
        # of several rows of a key in one batch the last one delivered counts
        return upsert.last_of_each(out.withColumn("_n", F.monotonically_increasing_id()), KEY, F.col("_n")).drop("_n")

    def replace(self, rows: DataFrame, now: Column | None = None, ttl: float | None = None) -> None:
        """Whole documents: a stored one of the same key is replaced."""
        new = self._prepared(rows, now, ttl)
        self._change(lambda state: (new, 0))

    def merge(self, rows: DataFrame, now: Column | None = None, ttl: float | None = None, documents: str | None = None) -> None:
        """Fields: those given and not null are set, others of a stored document stay, and its expiry without a new one.

        ``documents`` names a column of JSON objects; these are merged member by member, each value keeping its type.
        """
        new = self._prepared(rows, now, ttl)

        def change(state: dict) -> tuple[DataFrame, int]:
            if not state["segments"]:
                return new, 0
            buckets = [r[0] for r in new.select(self._bucket(F.col(KEY))).distinct().collect()]  # as many as the store has at most
            stored = self._unexpired(self._live(state["segments"], state["schema"], only=F.col(_BUCKET).isin(buckets)), now)
            old = stored.join(new.select(KEY), KEY, "left_semi")
            given = new
            if documents in new.columns and documents in old.columns:
                given = new.join(old.select(KEY, F.col(documents).alias("_old")), KEY, "left").withColumn(documents, _merged_json(F.col("_old"), F.col(documents))).drop("_old")
            return upsert.merge(old, given, KEY), 0

        self._change(change)

    def delete(self, keys: list[str], now: Column | None = None) -> int:
        return self._change(lambda state: self._deletion(self.get(keys, now)))

    def delete_frame(self, keys: DataFrame, now: Column | None = None) -> int:
        """Delete the rows of the keys of a frame."""
        return self._change(lambda state: self._deletion(self.read(now).join(keys.select(KEY), KEY, "left_semi")))

    def delete_prefixes(self, prefixes: tuple[str, ...], now: Column | None = None) -> int:
        return self._change(lambda state: self._deletion(self.read(now).where(starts_with(F.col(KEY), prefixes))))

    @staticmethod
    def _deletion(rows: DataFrame) -> tuple[DataFrame | None, int]:
        present = rows.count()
        return (rows.select(KEY, F.lit(True).alias(_DELETED)) if present else None), present

    def update(self, key: str, changes: dict[str, Column], now: Column | None = None) -> bool:
        """Set columns of one document; False if it is not there."""

        def change(state: dict) -> tuple[DataFrame | None, int]:
            row = self.get([key], now)
            if not row.take(1):
                return None, 0
            types = {f.name: f.dataType for f in row.schema.fields}
            return row.withColumns({name: value.cast(types[name]) if name in types else value for name, value in changes.items()}), 1

        return bool(self._change(change))


def _merged_json(old: Column, new: Column) -> Column:
    kept, given = (F.from_json(c, "map<string,variant>") for c in (old, new))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.to_json(F.map_concat(F.map_filter(kept, lambda k, _: ~F.map_contains_key(given, k)), given)))


def starts_with(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = c.startswith(prefixes[0])
    for p in prefixes[1:]:
        out = out | c.startswith(p)
    return out


class Catalog:
    """Index schemas as JSON files below ``path``, which the session reaches."""

    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        self.files = Files(spark or SparkSession.builder.getOrCreate(), path)

    @staticmethod
    def _file(name: str) -> str:
        return name.encode().hex() + ".json"

    def get(self, name: str) -> dict | None:
        text = self.files.read(self._file(name))
        entry = json.loads(text) if text else None
        if entry and (idle := entry["schema"]["index"].get("temporary_seconds")) and time.time() > entry["used_at"] + idle:
            self.files.remove(self._file(name))
            return None
        return entry

    def put(self, name: str, entry: dict) -> None:
        self.files.write(self._file(name), json.dumps(entry, ensure_ascii=False))

    def touch(self, name: str) -> None:
        if entry := self.get(name):
            self.put(name, entry | {"used_at": time.time()})

    def drop(self, name: str) -> bool:
        return self.get(name) is not None and self.files.remove(self._file(name))

    def names(self) -> list[str]:
        found = [bytes.fromhex(n.removesuffix(".json")).decode() for n in self.files.names() if n.endswith(".json") and not n.startswith(".")]
        return sorted(n for n in found if self.get(n))
