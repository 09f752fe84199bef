"""The registered queries of stores, indexes, caches, routers and histories, through their classes, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecframe.caches import EmbeddingsCache, SemanticCache
from vecframe.functions.vectors import decode, encode
from vecframe.plans import queries as Q
from vecframe.plans.filters import Filter
from vecframe.runtime import read_table, shared_folder, trim_blank
from vecframe.schema import IndexDefinition, Metric, NumericField, SearchSchema, Storage, TagField, TextField, VectorField, VectorType
from vecframe.sources.index import SearchIndex
from vecframe.streaming import ingest
from vecframe.workflows import MessageHistory, SemanticMessageHistory, SemanticRouter

Query = Callable[[SparkSession, str], DataFrame]
NATIONS = (TextField("n_name"), NumericField("n_regionkey"), TagField("kind"))
PARTS = (TextField("p_name"), TagField("p_brand"), NumericField("p_size"))


def _folder(s: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(s)}/warehouse-{uuid.uuid4().hex}"


def _index(s: SparkSession, folder: str, name: str, *prefixes: str, fields=NATIONS, storage: Storage = Storage.HASH) -> SearchIndex:
    index = SearchIndex(s, folder, SearchSchema(IndexDefinition(name, prefixes, storage), fields))
    index.create()
    return index


def _nations(s: SparkSession, d: str, storage: Storage) -> SearchIndex:
    """The nations as documents, as an application loads a few."""
    index = _index(s, _folder(s), "nations", "nation:", storage=storage)
    docs = [{"id": r["n_nationkey"], "n_name": r["n_name"], "n_regionkey": r["n_regionkey"], "kind": "nation", "at": {"region": r["n_regionkey"]}} for r in read_table(s, d, "nation").collect()]
    (index.load_json if storage is Storage.JSON else index.load_hash)(docs)
    return index


def _parts(s: SparkSession, d: str) -> SearchIndex:
    index = _index(s, _folder(s), "parts", "part:", fields=PARTS)
    index.load_frame(read_table(s, d, "part").select(index.key_column(F.col("p_partkey")).alias("_key"), "p_name", "p_brand", F.col("p_size").cast("double").alias("p_size")))
    return index


def _rows(s: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return s.createDataFrame(rows, columns)


def _load_keys(s: SparkSession, d: str) -> DataFrame:
    index = _index(s, _folder(s), "nations", "nation:", storage=Storage.JSON)
    return _rows(s, [(k,) for k in index.load_json([{"id": r[0]} for r in read_table(s, d, "nation").select("n_nationkey").collect()], keys=True)], "_key string")


def _multi_prefix(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    small, large = _index(s, folder, "small", "small:", fields=PARTS), _index(s, folder, "large", "large:", fields=PARTS)
    both = _index(s, folder, "both", "small:", "large:", fields=PARTS)
    p = read_table(s, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    for index, where in ((small, "p_size <= 25"), (large, "p_size > 25")):
        index.load_frame(p.where(where).select(index.key_column(F.col("p_partkey")).alias("_key"), "p_name", "p_brand", "p_size"))
    return both.search(Q.FilterQuery(Filter.tag("p_brand").eq("Brand#11") & Filter.numeric("p_size").gte(20), ("p_size",), Q.Page(0, 1_000_000_000))).rows


def _lifecycle(s: SparkSession, d: str) -> DataFrame:
    """(step, result) of creating, finding, listing, describing, clearing and dropping an index."""
    index = _nations(s, d, Storage.HASH)
    again = SearchIndex.from_existing(s, index.warehouse, "nations")
    names = [r[0] for r in SearchIndex.list(s, index.warehouse).collect()]
    out = [("exists", str(again.exists())), ("list", ",".join(names)), ("docs", str(again.info().num_docs)), ("fields", str(len(again.info().fields))), ("same", str(again.schema == index.schema)), ("skipped", str(not index.create(skip_if_exists=True)))]
    out += [("cleared", str(again.clear())), ("after", str(again.info().num_docs)), ("dropped", str(again.drop())), ("gone", str(not index.exists()))]
    return _rows(s, out, "step string, result string")


def _fetched(s: SparkSession, d: str) -> DataFrame:
    index = _nations(s, d, Storage.JSON)
    docs = [index.fetch(id="7"), index.fetch(key="nation:3"), index.fetch(id="none") or {"id": -1}]
    return _rows(s, [(x["id"], x.get("n_name"), (x.get("at") or {}).get("region")) for x in docs], "id long, n_name string, region long")


def _deleted(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    gone = index.store.delete_frame(index.search(Q.FilterQuery(Filter.numeric("p_size").gt(30), (), Q.Page(0, 1_000_000_000))).rows)
    one = index.delete(id="1")
    return index.documents().agg(F.count(F.lit(1)).alias("kept"), F.lit(gone + int(one)).cast("long").alias("gone"))


def _cleared(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    removed = index.clear()
    return index.documents().agg(F.count(F.lit(1)).alias("kept"), F.lit(removed).cast("long").alias("gone"))


def _updated_json(s: SparkSession, d: str) -> DataFrame:
    index = _nations(s, d, Storage.JSON)
    index.update_json([("$.n_name", "CHANGED"), ("$.at.region", 99)], id="5")
    missing = index.update_json([("$.n_name", "X")], id="none")
    return index.documents().select("_key", "n_name", F.get_json_object("_doc", "$.at.region").cast("long").alias("region"), F.lit(missing).alias("missing"))


def _updated_hash(s: SparkSession, d: str) -> DataFrame:
    index = _nations(s, d, Storage.HASH)
    index.update_hash([("n_regionkey", 42)], id="5")
    index.load_hash([{"id": 6, "kind": "merged"}, {"id": 6, "n_name": None, "kind": "last"}])
    return index.documents().select("_key", "n_name", "n_regionkey", "kind", F.get_json_object("_doc", "$.n_regionkey").cast("long").alias("in_document"))


def _batches(s: SparkSession, d: str) -> DataFrame:
    pages = _parts(s, d).batches(Q.FilterQuery(Filter.numeric("p_size").between(10, 12), ("p_size",)), 400)
    out = None
    for n, page in enumerate(pages):
        page = page.withColumn("page", F.lit(n))
        out = page if out is None else out.unionByName(page)
    return out


def _aggregate_batches(s: SparkSession, d: str) -> DataFrame:
    by = Q.GroupBy(("p_brand",), (Q.Reducer.count("n"),))
    pages = _parts(s, d).batches(Q.AggregationQuery("*", Q.Pipeline((), (), by, (Q.SortField("p_brand"),))), 10)
    out = None
    for n, page in enumerate(pages):
        page = page.withColumn("page", F.lit(n))
        out = page if out is None else out.unionByName(page)
    return out


def _totals(s: SparkSession, d: str) -> DataFrame:
    index = _parts(s, d)
    node = Filter.numeric("p_size").lt(5)
    by = Q.AggregationQuery("*", Q.Pipeline((), (), Q.GroupBy(("p_brand",), (Q.Reducer.count("n"),))))
    return _rows(s, [("filter", index.search(Q.FilterQuery(node)).total), ("count", index.count(Q.CountQuery(node))), ("groups", index.aggregate(by).total)], "query string, total long")


@dataclass
class Nation:
    id: str
    n_name: str
    n_regionkey: float


def _mapped(s: SparkSession, d: str) -> DataFrame:
    rows = _nations(s, d, Storage.JSON).search(Q.FilterQuery(Filter.numeric("n_regionkey").gte(2), ("n_name", "n_regionkey"), Q.Page(0, 100))).collect_as(Nation)
    return _rows(s, [(r.id, r.n_name, r.n_regionkey) for r in rows], "id string, n_name string, n_regionkey double")


def _codec(s: SparkSession, d: str) -> DataFrame:
    """Every vector packed as bytes of both types and read back, in Arrow batches."""

    def scan(batches):
        for b in batches:
            there = [encode(v) for v in b["embedding"]]
            wide = [encode(v, VectorType.FLOAT64) for v in b["embedding"]]
            b["bytes"], b["bytes_wide"] = [len(x) for x in there], [len(x) for x in wide]
            b["same"] = [decode(x) == decode(y, VectorType.FLOAT64) == list(map(float, v)) for x, y, v in zip(there, wide, b["embedding"])]
            yield b[["vec_id", "bytes", "bytes_wide", "same"]]

    return read_table(s, d, "embeddings").select("vec_id", "embedding").mapInPandas(scan, "vec_id long, bytes int, bytes_wide int, same boolean")


def _cache(s: SparkSession, d: str, ttl: float | None = None) -> EmbeddingsCache:
    """A cache of the documents' texts, each with the embedding of its id; of equal texts the last id's counts."""
    cache = EmbeddingsCache(s, _folder(s), "docs", ttl=ttl)
    rows = read_table(s, d, "documents").where("text is not null and text <> ''").join(read_table(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    last = rows.groupBy("text").agg(F.max_by(F.struct("vec_id", "embedding"), "vec_id").alias("v"))
    cache.set_frame(last.select(cache.key_column(F.col("text"), F.lit("m1")).alias("_key"), F.col("text").alias("input"), F.lit("m1").alias("model_name"), F.col("v.embedding").cast("array<double>").alias("embedding"), F.to_json(F.struct("v.vec_id")).alias("metadata")))
    return cache


def _asked(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "documents").where("text is not null and text <> ''").select("doc_id", "text", F.lit("m1").alias("model"))


def _looked_up(s: SparkSession, d: str) -> DataFrame:
    hit = _cache(s, d).lookup_frame(_asked(s, d), "text", "model")
    return hit.select("doc_id", F.get_json_object("metadata", "$.vec_id").cast("long").alias("vec_id"))


def _cache_deleted(s: SparkSession, d: str) -> DataFrame:
    cache = _cache(s, d)
    cache.delete_frame(_asked(s, d).where(F.length("text") > 400), "text", "model")
    return cache.store.read().select("_key", F.get_json_object("metadata", "$.vec_id").cast("long").alias("vec_id"))


def _cache_expired(s: SparkSession, d: str) -> DataFrame:
    """Hits before and after the entries' time to live."""
    cache = _cache(s, d, ttl=3600)
    later = lambda h: F.current_timestamp() + F.make_dt_interval(F.lit(0), F.lit(h))
    counts = [cache.lookup_frame(_asked(s, d), "text", "model", later(h)).agg(F.count("embedding").alias("hits")).withColumn("hours", F.lit(h)) for h in (0, 2)]
    return counts[0].unionByName(counts[1])


def _cache_set_get(s: SparkSession, d: str) -> DataFrame:
    cache = EmbeddingsCache(s, _folder(s), "few")
    cache.set_many([("a", [1, 2], "m", {"n": 1}), ("b", [3, 4], None, None)])
    cache.set("a", [5, 6], "m")
    got = cache.get_many([("a", "m"), ("a", None), ("b", None)])
    cache.delete("b")
    return _rows(s, [(i, None if g is None else g.embedding, None if g is None or g.metadata is None else g.metadata["n"], cache.exists("b")) for i, g in enumerate(got)], "place int, embedding array<double>, n long, b_there boolean")


def _checked(s: SparkSession, d: str) -> DataFrame:
    """The nearest stored entry of another prompt for every fiftieth embedding; all embeddings are stored."""
    e = read_table(s, d, "embeddings")
    cache = SemanticCache(s, _folder(s), "answers", 64, 1.5, metric=Metric.L2)
    cache.create()
    key = F.concat(F.lit(cache.prefix), F.sha2(F.col("vec_id").cast("string"), 256))
    cache.index.load_frame(e.select(key.alias("_key"), F.col("vec_id").cast("string").alias("prompt"), F.concat(F.lit("r"), "vec_id").alias("response"), F.lit(None).cast("string").alias("metadata"), "embedding"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = cache.check_frame(asked, "query_id", "embedding", k=2).where(F.col("prompt") != F.col("query_id").cast("string"))
    best = near.groupBy("query_id").agg(F.min_by(F.struct("prompt", "distance"), "distance").alias("b"))
    return best.select("query_id", F.col("b.prompt").cast("long").alias("vec_id"), F.round("b.distance", 6).alias("distance"))


def _routed(s: SparkSession, d: str) -> DataFrame:
    """Every embedding to the nearest of the labels' centroids, within a threshold."""
    e = read_table(s, d, "embeddings")
    router = SemanticRouter(s, _folder(s), "labels", 64, 0.9, vector_type=VectorType.FLOAT64)
    router.create()
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    routes = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("embedding"))
    name = F.lpad(F.col("label").cast("string"), 6, "0")
    router.index.load_frame(routes.select(F.concat(F.lit(router.prefix), name).alias("_key"), F.col("label").cast("string").alias("routeName"), name.alias("reference"), "embedding"))
    near = router.route_frame(e, "vec_id", "embedding")
    return near.select("vec_id", F.col("routeName").cast("long").alias("label"), F.round("distance", 6).alias("distance"))


def _messages(s: SparkSession, d: str) -> DataFrame:
    m = read_table(s, d, "history_messages").dropDuplicates(["message_id"])
    return m.select("message_id", trim_blank(F.col("session_id")).alias("sessionId"), F.col("speaker_role").alias("role"), "content", F.col("message_id").cast("double").alias("timestamp"))


def _history(s: SparkSession, d: str) -> MessageHistory:
    history = MessageHistory(s, _folder(s), "chat")
    history.create()
    history.append_frame(_messages(s, d), [F.col("message_id")])
    return history


def _recent(s: SparkSession, d: str, n: int, role: str | None = None) -> DataFrame:
    return _history(s, d).recent_frame(n, role).select(F.col("sessionId").alias("session"), "message_id", F.col("sequence").cast("long").alias("sequence"))


def _appended(s: SparkSession, d: str) -> DataFrame:
    """One more message for a stored session: the next number, and the newest of the last."""
    history = _history(s, d)
    session = read_table(s, d, "history_messages").agg(F.max(trim_blank(F.col("session_id")))).first()[0]
    history.append(session, "user", "one more", {"n": 1})
    return _rows(s, [(m.session_id, m.sequence, m.content == "one more") for m in history.get_recent(session, 2)], "session string, sequence long, new boolean")


def _relevant(s: SparkSession, d: str) -> DataFrame:
    """The five nearest messages of every session within a threshold, equal distances by the newer.

    A message has the embedding whose number is its own, modulo as many embeddings as there are.
    """
    e = read_table(s, d, "embeddings").select("vec_id", "embedding")
    question = tuple(e.where("vec_id = 0").first()["embedding"])
    number = e.count()
    history = SemanticMessageHistory(s, _folder(s), "chat", 64, 0.95)
    history.create()
    rows = _messages(s, d).withColumn("vec_id", F.pmod("message_id", F.lit(number))).join(e, "vec_id").drop("vec_id")
    history.append_frame(rows, [F.col("message_id")])
    found = history.relevant_frame(question, 5)
    return found.select(F.col("sessionId").alias("session"), "message_id", F.round("distance", 6).alias("distance"), "place")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The parts as a stream of files into an index."""
    folder = _folder(s)
    index = _index(s, folder, "parts", "part:", fields=PARTS)
    read_table(s, d, "part").select(index.key_column(F.col("p_partkey")).alias("_key"), "p_name", "p_brand", F.col("p_size").cast("double").alias("p_size")).repartition(3).write.parquet(f"{folder}/in")
    stream = s.readStream.schema("_key string, p_name string, p_brand string, p_size double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ingest(stream, index, f"{folder}/progress").awaitTermination()
    return index.documents().select("_key", "p_brand", "p_size")


def queries() -> dict[str, Query]:
    return {
        "index_lifecycle": _lifecycle,
        "index_load_keys": _load_keys,
        "index_multi_prefix": _multi_prefix,
        "index_fetch": _fetched,
        "index_delete": _deleted,
        "delete_clear": _cleared,
        "partial_update_json": _updated_json,
        "partial_update": _updated_hash,
        "search_batches": _batches,
        "aggregate_batches": _aggregate_batches,
        "search_totals": _totals,
        "typed_mapping": _mapped,
        "vector_codec": _codec,
        "stream_ingest": _streamed,
        "nn_join_router": _routed,
        "semantic_cache_check": _checked,
        "embeddings_cache_lookup": _looked_up,
        "embeddings_cache_exists": lambda s, d: _cache(s, d).exists_frame(_asked(s, d), "text", "model").select("doc_id"),
        "embeddings_cache_delete": _cache_deleted,
        "embeddings_cache_ttl": _cache_expired,
        "embeddings_cache_set_get": _cache_set_get,
        "message_history_recent": lambda s, d: _recent(s, d, 10),
        "message_history_role": lambda s, d: _recent(s, d, 3, "user"),
        "message_history_append": _appended,
        "semantic_history_relevant": _relevant,
    }


_NATION = "'nation:' || n_nationkey"
_JOINED = "documents JOIN embeddings ON doc_id = vec_id"
_HISTORY = r"""(SELECT *, row_number() OVER (PARTITION BY session ORDER BY message_id) AS sequence FROM
    (SELECT DISTINCT ON (message_id) *, regexp_replace(session_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS session FROM history_messages ORDER BY message_id))"""
_CACHE = f"(SELECT 'embeddings:docs:' || sha256(text || chr(10) || 'm1') AS k, max(vec_id) AS vec_id FROM {_JOINED} WHERE text <> '' GROUP BY 1)"
_ASKED = "(SELECT doc_id, length(text) > 400 AS long, 'embeddings:docs:' || sha256(text || chr(10) || 'm1') AS k FROM documents WHERE text <> '')"


def oracle_sql() -> dict[str, str]:
    return {
        "index_lifecycle": """
            SELECT unnest(['exists', 'list', 'docs', 'fields', 'same', 'skipped', 'cleared', 'after', 'dropped', 'gone']) AS step,
                   unnest(['True', 'nations', n, '3', 'True', 'True', n, '0', 'True', 'True']) AS result FROM (SELECT count(*)::VARCHAR n FROM nation)""",
        "index_load_keys": f"SELECT {_NATION} AS _key FROM nation",
        "index_multi_prefix": "SELECT CASE WHEN p_size <= 25 THEN 'small:' ELSE 'large:' END || p_partkey AS _key, p_size::DOUBLE AS p_size FROM part WHERE p_brand = 'Brand#11' AND p_size >= 20",
        "index_fetch": "SELECT n_nationkey::BIGINT AS id, n_name, n_regionkey::BIGINT AS region FROM nation WHERE n_nationkey IN (3, 7) UNION ALL SELECT -1, NULL, NULL",
        "index_delete": "SELECT count(*) FILTER (NOT (p_size > 30 OR p_partkey = 1)) AS kept, count(*) FILTER (p_size > 30 OR p_partkey = 1) AS gone FROM part",
        "delete_clear": "SELECT 0::BIGINT AS kept, count(*) AS gone FROM part",
        "partial_update_json": f"SELECT {_NATION} AS _key, CASE WHEN n_nationkey = 5 THEN 'CHANGED' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 5 THEN 99 ELSE n_regionkey END::BIGINT AS region, false AS missing FROM nation",
        "partial_update": f"""SELECT {_NATION} AS _key, n_name, CASE WHEN n_nationkey = 5 THEN 42 ELSE n_regionkey END::DOUBLE AS n_regionkey, CASE WHEN n_nationkey = 6 THEN 'last' ELSE 'nation' END AS kind,
            CASE WHEN n_nationkey = 5 THEN 42 ELSE n_regionkey END::BIGINT AS in_document FROM nation""",
        "search_batches": "SELECT 'part:' || p_partkey AS _key, p_size::DOUBLE AS p_size, ((row_number() OVER (ORDER BY 'part:' || p_partkey) - 1) // 400)::INTEGER AS page FROM part WHERE p_size BETWEEN 10 AND 12",
        "aggregate_batches": "SELECT p_brand, count(*) AS n, ((row_number() OVER (ORDER BY p_brand) - 1) // 10)::INTEGER AS page FROM part GROUP BY 1",
        "search_totals": "SELECT 'filter' AS query, count(*) AS total FROM part WHERE p_size < 5 UNION ALL SELECT 'count', count(*) FROM part WHERE p_size < 5 UNION ALL SELECT 'groups', count(DISTINCT p_brand) FROM part",
        "typed_mapping": f"SELECT {_NATION} AS id, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation WHERE n_regionkey >= 2",
        "vector_codec": "SELECT vec_id, 4 * len(embedding)::INTEGER AS bytes, 8 * len(embedding)::INTEGER AS bytes_wide, true AS same FROM embeddings",
        "stream_ingest": "SELECT 'part:' || p_partkey AS _key, p_brand, p_size::DOUBLE AS p_size FROM part",
        "nn_join_router": """
            WITH p AS (SELECT label, i, avg(x::DOUBLE) x FROM (SELECT label, unnest(embedding) x, generate_subscripts(embedding, 1) i FROM embeddings) GROUP BY ALL),
            c AS (SELECT label, list(x ORDER BY i) c FROM p GROUP BY 1),
            d AS (SELECT vec_id, c.label, 1 - list_cosine_similarity(embedding::DOUBLE[], c) d FROM embeddings e, c),
            r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) r FROM d)
            SELECT vec_id, label, round(d, 6) AS distance FROM r WHERE r = 1 AND d <= 0.9""",
        "semantic_cache_check": """
            WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2 d
                       FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) r FROM d)
            SELECT query_id, vec_id, round(d, 6) AS distance FROM r WHERE r = 1 AND d <= 1.5""",
        "embeddings_cache_lookup": f"SELECT doc_id, vec_id FROM {_ASKED} LEFT JOIN {_CACHE} USING (k)",
        "embeddings_cache_exists": f"SELECT doc_id FROM {_ASKED} SEMI JOIN {_CACHE} USING (k)",
        "embeddings_cache_delete": f"SELECT k AS _key, vec_id FROM {_CACHE} ANTI JOIN (SELECT * FROM {_ASKED} WHERE long) USING (k)",
        "embeddings_cache_ttl": f"SELECT 0 AS hours, count(*) AS hits FROM {_ASKED} SEMI JOIN {_CACHE} USING (k) UNION ALL SELECT 2, 0",
        "embeddings_cache_set_get": "SELECT * FROM (VALUES (0, [5.0, 6.0]::DOUBLE[], 1::BIGINT, false), (1, NULL, NULL, false), (2, [3.0, 4.0]::DOUBLE[], NULL, false)) t(place, embedding, n, b_there)",
        "message_history_recent": f"SELECT session, message_id, sequence FROM {_HISTORY} QUALIFY row_number() OVER (PARTITION BY session ORDER BY sequence DESC) <= 10",
        "message_history_role": f"SELECT session, message_id, sequence FROM {_HISTORY} WHERE list_contains(list_transform(string_split(speaker_role, ','), lambda x: lower(trim(x))), 'user') QUALIFY row_number() OVER (PARTITION BY session ORDER BY sequence DESC) <= 3",
        "message_history_append": f"""
            WITH h AS (SELECT session, max(sequence) n FROM {_HISTORY} WHERE session = (SELECT max(session) FROM {_HISTORY}) GROUP BY 1)
            SELECT session, n + 1 AS sequence, true AS new FROM h UNION ALL SELECT session, n, false FROM h""",
        "semantic_history_relevant": f"""
            WITH n AS (SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings),
            r AS (SELECT session, message_id, distance, (row_number() OVER (PARTITION BY session ORDER BY distance, sequence DESC))::INTEGER AS place
                  FROM {_HISTORY} m JOIN n ON n.vec_id = m.message_id % (SELECT count(*) FROM embeddings) WHERE distance <= 0.95)
            SELECT * FROM r WHERE place <= 5""",
    }
