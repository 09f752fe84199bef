"""The registered queries of the engine's own operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecframe import queries_index
from vecframe.functions import text
from vecframe.functions.vectors import encode
from vecframe.operators import upsert
from vecframe.plans import queries as Q
from vecframe.plans.filters import Filter
from vecframe.plans.planner import Planner, register_reducer
from vecframe.plans.querylang import parse, rank_terms
from vecframe.rerankers import lexical_score, rerank_frame, score_column
from vecframe.runtime import read_table
from vecframe.schema import Algorithm, GeoField, IndexDefinition, Metric, NumericField, SearchSchema, TagField, TextField, VectorField, VectorType

Query = Callable[[SparkSession, str], DataFrame]


def _schema(*fields, **index) -> SearchSchema:
    return SearchSchema(IndexDefinition("q", ("q:",), **index), fields)


DOCS = _schema(TextField("text"), TagField("lang"), TagField("source"), NumericField("n_chars"))
ORDERS = _schema(TagField("o_orderpriority", separator="-"), TagField("o_orderstatus"), NumericField("o_totalprice"))
PARTS = _schema(TextField("p_name"), TagField("p_brand"), TagField("p_type"), NumericField("p_size"), NumericField("p_retailprice"))
EVENTS = _schema(TagField("event_type"), NumericField("value"), NumericField("user_id"), NumericField("$.k", alias="k"))
CUSTOMERS = _schema(GeoField("place"), NumericField("c_acctbal"), TagField("c_mktsegment"))
ADVANCED = _schema(TagField("genre", separator=";", case_sensitive=True), NumericField("rating"), GeoField("geo_point"), TextField("title"))


def _vec(metric: Metric, algorithm: Algorithm = Algorithm.HNSW) -> SearchSchema:
    return _schema(NumericField("label"), VectorField("embedding", dims=64, metric=metric, algorithm=algorithm), VectorField("second", dims=64, metric=metric, algorithm=algorithm))


HYBRID = _schema(TextField("text"), TagField("lang"), VectorField("embedding", dims=64))


def _planner(schema: SearchSchema, table: str, key: str) -> Callable[[SparkSession, str], Planner]:
    return lambda s, d: Planner(schema, read_table(s, d, table), key)


_docs, _orders = _planner(DOCS, "documents", "doc_id"), _planner(ORDERS, "orders", "o_orderkey")
_parts, _adv = _planner(PARTS, "part", "p_partkey"), _planner(ADVANCED, "advanced_docs", "adv_id")


def _customers(s: SparkSession, d: str) -> Planner:
    place = F.expr("concat((c_custkey * 37) % 360 - 180, ',', (c_custkey * 17) % 170 - 85)")
    return Planner(CUSTOMERS, read_table(s, d, "customer").withColumn("place", place), "c_custkey")


def _events(s: SparkSession, d: str) -> Planner:
    return Planner(EVENTS, read_table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double")), "event_id")


def _embeddings(s: SparkSession, d: str, metric: Metric = Metric.COSINE) -> Planner:
    return Planner(_vec(metric), read_table(s, d, "embeddings").withColumn("second", F.reverse("embedding")), "vec_id")


def _hybrid(s: SparkSession, d: str) -> Planner:
    joined = read_table(s, d, "documents").join(read_table(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return Planner(HYBRID, joined, "doc_id")


def _question(s: SparkSession, d: str) -> tuple[float, ...]:
    """The query vector, an argument of the search: that of vector 0."""
    return tuple(read_table(s, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _filtered(plan: Callable[[SparkSession, str], Planner], node, *fields: str) -> Query:
    return lambda s, d: (p := plan(s, d)).ranked(Q.FilterQuery(node, fields or (p.key,)))


def _text(query: str) -> Query:
    return lambda s, d: _docs(s, d).ranked(Q.TextQuery(query, ("doc_id",)))


def _bm25(query: str, n: int) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        plan = _docs(s, d)
        node = parse(query)
        terms = [w for t in rank_terms(node) for w in text.analyze(t)]
        rows = text.scored(plan.where(node), plan.df, {"text": 1.0}, terms, "score")
        return rows.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(n)

    return run


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _knn(metric: Metric, k: int = 10, node=None, page: Q.Page | None = None) -> Query:
    return lambda s, d: _rounded(_embeddings(s, d, metric).search(Q.VectorQuery("embedding", _question(s, d), k, node, ("label",), runtime=Q.Runtime(ef_runtime=50), page=page)), "vector_distance")


def _range(metric: Metric, r: float, node=None) -> Query:
    return lambda s, d: _rounded(_embeddings(s, d, metric).ranked(Q.RangeQuery("embedding", _question(s, d), r, node, ("label",))), "vector_distance")


def _multi(s: SparkSession, d: str) -> DataFrame:
    q = _question(s, d)
    v = (Q.WeightedVector("embedding", q, 0.7), Q.WeightedVector("second", q, 0.3))
    return _rounded(_embeddings(s, d).search(Q.MultiVectorQuery(v, 100)), "vector_distance")


def _agg(plan: Callable[[SparkSession, str], Planner], query: str, by: tuple[str, ...], *reducers: Q.Reducer, apply: tuple[Q.Apply, ...] = (), round_: tuple[str, ...] = (), sort: tuple[Q.SortField, ...] = (), page: Q.Page | None = None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        q = Q.AggregationQuery(query, Q.Pipeline((), apply, Q.GroupBy(by, reducers), sort, page or Q.Page()))
        p = plan(s, d)
        return _rounded(p.aggregate(q) if page else p.aggregated(q), *round_)

    return run


def _applied(plan: Callable[[SparkSession, str], Planner], load: tuple[str, ...], *apply: Q.Apply, round_: tuple[str, ...] = ()) -> Query:
    return lambda s, d: _rounded(plan(s, d).aggregated(Q.AggregationQuery("*", Q.Pipeline(load, apply))), *round_)


def _agg_hybrid(s: SparkSession, d: str) -> DataFrame:
    h = Q.HybridQuery("embedding", _question(s, d), 100, text_filter=Filter.text("text").match("the"), score_alias="distance")
    p = Q.Pipeline((), (), Q.GroupBy(("lang",), (Q.Reducer.count("n"), Q.Reducer.of("AVG", "distance", "mean"))), (Q.SortField("n", True),))
    return _rounded(_hybrid(s, d).aggregated(Q.AggregateHybridQuery(h, p)), "mean")


def _old_new(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = read_table(s, d, "part")
    old = p.where("p_size <= 40").select("p_partkey", "p_brand", "p_size")
    new = p.where("p_size > 30").select("p_partkey", F.expr("case when p_size % 2 = 0 then upper(p_type) end").alias("p_brand"), (F.col("p_size") + 100).alias("p_size"))
    return old, new


def _rerank(s: SparkSession, d: str) -> DataFrame:
    rows = read_table(s, d, "documents").select("doc_id", "text")
    score = F.round(score_column("the semantic cache loses the time zone", F.col("text"), lexical_score), 6)
    return rerank_frame(rows, score, "doc_id", 20).select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


R = Q.Reducer
_MATH = {
    "up": "ceil(@p_retailprice / 7)", "down": "floor(@p_retailprice / 7)", "root": "sqrt(@p_size)", "natural": "log(@p_size)", "binary": "log2(@p_size)", "grown": "exp(@p_size / 50)",
    "power": "pow(@p_size, 2) + @p_size ^ 0.5", "far": "abs(@p_size - 25)", "none": "sqrt(@p_size - 1000000) / 0",
}


def _knn64(s: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of a field of doubles, asked with the packed bytes of the query vector."""
    schema = _schema(NumericField("label"), VectorField("embedding", dims=64, metric=Metric.COSINE, datatype=VectorType.FLOAT64))
    plan = Planner(schema, read_table(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id")
    return _rounded(plan.search(Q.VectorQuery("embedding", encode(_question(s, d), VectorType.FLOAT64), 10, None, ("label",))), "vector_distance")


def _custom(s: SparkSession, d: str) -> DataFrame:
    register_reducer("SPREAD", lambda x: F.max(x) - F.min(x))
    return _agg(_events, "*", ("event_type",), R("SPREAD", ("@value",), "spread"), round_=("spread",))(s, d)


def queries() -> dict[str, Query]:
    tag, num, txt, geo = Filter.tag, Filter.numeric, Filter.text, Filter.geo
    return queries_index.queries() | {
        "filter_tag_eq": _filtered(_docs, tag("lang").eq("en")),
        "filter_tag_in": _filtered(_docs, tag("lang").isin("de", "fr")),
        "filter_tag_not": _filtered(_docs, ~tag("lang").eq("en")),
        "filter_tag_multivalue": _filtered(_orders, tag("o_orderpriority").eq("low")),
        "filter_tag_case_sensitive": _filtered(_adv, tag("genre").eq("crime")),
        "filter_numeric_eq": _filtered(_parts, num("p_size").eq(7)),
        "filter_numeric_between": _filtered(_parts, num("p_size").between(10, 20)),
        "filter_numeric_exclusive": _filtered(_parts, num("p_size").between(10, 20, False, False)),
        "filter_numeric_gt": _filtered(_orders, num("o_totalprice").gt(200000)),
        "filter_numeric_gte": _filtered(_parts, num("p_size").gte(40)),
        "filter_numeric_lt": _filtered(_orders, num("o_totalprice").lt(50000)),
        "filter_numeric_lte": _filtered(_parts, num("p_size").lte(10)),
        "filter_text_match": _filtered(_docs, txt("text").match("cache")),
        "filter_text_prefix": _filtered(_docs, txt("text").prefix("thresh")),
        "filter_text_phrase": _filtered(_docs, txt("text").phrase("vector index")),
        "filter_text_prefix_of_words": _filtered(_docs, txt("text").prefix("time-z")),
        "filter_text_suffix": _filtered(_docs, txt("text").match("*shold")),
        "filter_geo_radius_km": _filtered(_customers, geo("place").within_radius(10, 20, 2500, "km")),
        "filter_geo_radius_mi": _filtered(_customers, geo("place").within_radius(-70, 40, 1200, "mi")),
        "filter_geo_radius_m": _filtered(_customers, geo("place").within_radius(10, 20, 1500000, "m")),
        "filter_geo_radius_ft": _filtered(_customers, geo("place").within_radius(10, 20, 9000000, "ft")),
        "filter_geo_points": _filtered(_adv, geo("geo_point").within_radius(10, 50, 2000, "km")),
        "filter_and_or_not": _filtered(_parts, tag("p_brand").isin("Brand#11", "Brand#12") & (num("p_size").gte(30) | ~tag("p_type").eq("PROMO"))),
        "filter_query_paged": lambda s, d: _parts(s, d).search(Q.FilterQuery(num("p_size").gte(20), ("p_partkey", "p_size"), Q.Page(20, 15))),
        "count_all": lambda s, d: _orders(s, d).where(None).agg(F.count(F.lit(1)).alias("n")),
        "count_filtered": lambda s, d: _orders(s, d).where(tag("o_orderstatus").eq("f") & num("o_totalprice").gt(100000)).agg(F.count(F.lit(1)).alias("n")),
        "text_query_and": _text("cache threshold"),
        "text_query_or": _text("cache|router"),
        "text_query_not": _text("cache -threshold"),
        "text_query_prefix": _text("semant*"),
        "text_query_phrase": _text('"distance threshold"'),
        "text_query_field": _text("@text:(loader | router) @lang:{en}"),
        "text_query_fuzzy": _text("%loeder%"),
        "text_query_range": _text("@n_chars:[(500 1500] loader"),
        "text_bm25_topk": _bm25("semantic|cache|threshold", 20),
        "knn_cosine": _knn(Metric.COSINE),
        "knn_l2": _knn(Metric.L2),
        "knn_ip": _knn(Metric.IP),
        "knn_float64": _knn64,
        "knn_filtered": _knn(Metric.COSINE, 10, num("label").between(2, 5)),
        "knn_paged": _knn(Metric.COSINE, 30, None, Q.Page(10, 10)),
        "range_cosine": _range(Metric.COSINE, 0.85),
        "range_l2": _range(Metric.L2, 1.6),
        "range_filtered": _range(Metric.COSINE, 0.95, num("label").eq(3)),
        "hybrid_text_knn": lambda s, d: _rounded(_hybrid(s, d).search(Q.HybridQuery("embedding", _question(s, d), 20, tag("lang").eq("en"), ("lang",), text_filter=txt("text").match("the"))), "vector_distance"),
        "multi_vector": _multi,
        "agg_count": _agg(_orders, "*", ("o_orderpriority",), R.count("n")),
        "agg_sum_avg": _agg(_orders, "@o_totalprice:[1000 +inf]", ("o_orderstatus",), R.of("SUM", "o_totalprice", "total"), R.of("AVG", "o_totalprice", "mean"), round_=("mean",)),
        "agg_min_max": _agg(_events, "*", ("event_type",), R.of("MIN", "value", "low"), R.of("MAX", "value", "high")),
        "agg_count_distinct": _agg(_events, "*", ("event_type",), R.of("COUNT_DISTINCT", "user_id", "users")),
        "agg_count_distinctish": lambda s, d: _agg(_events, "*", ("event_type",), R.of("COUNT_DISTINCTISH", "user_id", "about"), R.of("COUNT_DISTINCT", "user_id", "users"))(s, d).select("event_type", (F.abs(F.col("about") - F.col("users")) <= 0.05 * F.col("users")).alias("close")),
        "agg_multi_reduce": _agg(_orders, "*", ("o_orderpriority", "o_orderstatus"), R.count("n"), R.of("SUM", "o_totalprice", "total"), R.of("MIN", "o_totalprice", "low"), R.of("MAX", "o_totalprice", "high"), R.of("AVG", "o_totalprice", "mean"), round_=("total", "mean")),
        "agg_random_sample": lambda s, d: _agg(_parts, "*", ("p_type",), R("RANDOM_SAMPLE", ("@p_size", 7), "sample"), R.of("TOLIST", "p_size", "sizes"))(s, d).select("p_type", F.size("sample").alias("drawn"), (F.size(F.array_except("sample", "sizes")) == 0).alias("from_group")),
        "agg_custom_reducer": _custom,
        "agg_quantile_sketch": lambda s, d: _agg(_orders, "*", ("o_orderstatus",), R.quantile("o_totalprice", 0.5, "about", 0.0005), R.quantile("o_totalprice", 0.498, "low"), R.quantile("o_totalprice", 0.502, "high"))(s, d).select("o_orderstatus", F.expr("about between low and high").alias("close")),
        "agg_apply_math": _applied(_parts, (), *[Q.Apply(e, n) for n, e in _MATH.items()], round_=tuple(_MATH)),
        "agg_apply_geo": _applied(_customers, (), Q.Apply("geodistance(@place, '10,20')", "metres"), round_=("metres",)),
        "agg_tolist": _agg(_parts, "*", ("p_type",), R.of("TOLIST", "p_size", "sizes")),
        "agg_quantile": _agg(_events, "*", ("event_type",), R.quantile("value", 0.5, "median"), R.quantile("value", 0.9, "p90")),
        "agg_stddev": _agg(_orders, "*", ("o_orderpriority",), R.of("STDDEV", "o_totalprice", "sd"), round_=("sd",)),
        "agg_first_value": _agg(_orders, "*", ("o_orderpriority",), R("FIRST_VALUE", ("@o_totalprice", "BY", "@o_orderkey", "DESC"), "latest")),
        "agg_global": _agg(_events, "@event_type:{purchase}", (), R.count("n"), R.of("AVG", "value", "mean"), round_=("mean",)),
        "agg_paged": _agg(_parts, "*", ("p_brand",), R.count("n"), sort=(Q.SortField("n", True),), page=Q.Page(5, 10)),
        "agg_apply_arith": _agg(_parts, "*", ("bucket",), R.count("n"), apply=(Q.Apply("@p_size - (@p_size % 10)", "bucket"),)),
        "agg_apply_string": _applied(_parts, ("p_type",), Q.Apply("upper(substr(@p_name, 0, 5))", "head"), Q.Apply("strlen(@p_name)", "size")),
        "agg_apply_date": _applied(lambda s, d: Planner(ORDERS, read_table(s, d, "orders").withColumn("secs", F.unix_timestamp("o_orderdate")), "o_orderkey"), (), Q.Apply("year(@secs)", "y"), Q.Apply("monthofyear(@secs)", "m"), Q.Apply("timefmt(@secs, '%Y-%m-%d')", "day")),
        "agg_apply_case": _agg(_orders, "*", ("class",), R.count("n"), apply=(Q.Apply("case(@o_totalprice > 150000 && !(@o_orderstatus == 'O'), 'high', 'low')", "class"),)),
        "agg_hybrid": _agg_hybrid,
        "json_path_filter": _filtered(_events, num("k").between(3, 6)),
        "upsert_replace": lambda s, d: upsert.replace(*_old_new(s, d), "p_partkey"),
        "upsert_merge": lambda s, d: upsert.merge(*_old_new(s, d), "p_partkey"),
        "upsert_delete": lambda s, d: upsert.without(*_old_new(s, d), "p_partkey"),
        "rerank_lexical": _rerank,
    }


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
_LANG = "list_transform(string_split(lang, ','), lambda x: lower(trim(x)))"


def _has(word: str) -> str:
    return f"coalesce(list_contains({_TOKENS}, '{word}'), false)"


def _docs_sql(where: str) -> str:
    return f"SELECT doc_id FROM documents WHERE {where}"


def _phrase_sql(phrase: str) -> str:
    return f"contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' {phrase} ')"


def _parts_sql(where: str) -> str:
    return f"SELECT p_partkey FROM part WHERE {where}"


def _place_sql(table: str, key: str, lon: str, lat: str, x: float, y: float, limit: float) -> str:
    a = f"pow(sin(radians({lat} - ({y})) / 2), 2) + cos(radians({y})) * cos(radians({lat})) * pow(sin(radians({lon} - ({x})) / 2), 2)"
    return f"SELECT {key} FROM {table} WHERE 2 * 6372797.560856 * asin(sqrt(least(1.0, {a}))) <= {limit}"


def _customers_sql(x: float, y: float, limit: float) -> str:
    return _place_sql("customer", "c_custkey", "((c_custkey * 37) % 360 - 180)", "((c_custkey * 17) % 170 - 85)", x, y, limit)


_DISTANCE = {"cosine": "1 - list_cosine_similarity({e}, {q})", "l2": "list_distance({e}, {q}) ** 2", "ip": "1 - list_inner_product({e}, {q})"}


def _distance_sql(metric: str, e: str = "embedding::DOUBLE[]") -> str:
    return "round(" + _DISTANCE[metric].format(e=e, q=_Q) + ", 6)"


def _knn_sql(metric: str, k: int = 10, where: str = "true", offset: int = 0) -> str:
    return f"SELECT vec_id, label, {_distance_sql(metric)} AS vector_distance FROM embeddings WHERE {where} ORDER BY 3, 1 LIMIT {k} OFFSET {offset}"


def _range_sql(metric: str, r: float, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT vec_id, label, {_distance_sql(metric)} AS vector_distance FROM embeddings WHERE {where}) WHERE vector_distance <= {r}"


_BM25_SQL = f"""
    WITH t AS (SELECT doc_id, coalesce({_TOKENS}, []) w FROM documents),
    s AS (SELECT count(*) n, avg(len(w)) l FROM t),
    f AS (SELECT u.term, count(*) d FROM t, (SELECT unnest(['semantic', 'cache', 'threshold']) term) u WHERE list_contains(t.w, u.term) GROUP BY 1),
    x AS (SELECT t.doc_id, sum(ln(1 + (s.n - f.d + 0.5) / (f.d + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(t.w) / s.l))) score
          FROM (SELECT t.doc_id, t.w, f.term, f.d, len(list_filter(t.w, lambda x: x = f.term)) k FROM t, f) t JOIN f USING (term), s WHERE k > 0 GROUP BY 1)
    SELECT doc_id, round(score, 6) AS score FROM x ORDER BY round(score, 6) DESC, doc_id LIMIT 20"""
_JOINED = "documents JOIN embeddings ON doc_id = vec_id"
_OLD = "(SELECT p_partkey, p_brand, p_size FROM part WHERE p_size <= 40)"
_NEW = "(SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_type) END AS p_brand, p_size + 100 AS p_size FROM part WHERE p_size > 30)"


def oracle_sql() -> dict[str, str]:
    return queries_index.oracle_sql() | {
        "filter_tag_eq": _docs_sql(f"list_contains({_LANG}, 'en')"),
        "filter_tag_in": _docs_sql(f"list_has_any({_LANG}, ['de', 'fr'])"),
        "filter_tag_not": _docs_sql(f"NOT coalesce(list_contains({_LANG}, 'en'), false)"),
        "filter_tag_multivalue": "SELECT o_orderkey FROM orders WHERE list_contains(list_transform(string_split(lower(o_orderpriority), '-'), lambda x: trim(x)), 'low')",
        "filter_tag_case_sensitive": "SELECT adv_id FROM advanced_docs WHERE list_contains(list_transform(string_split(genre, ';'), lambda x: trim(x)), 'crime')",
        "filter_numeric_eq": _parts_sql("p_size = 7"),
        "filter_numeric_between": _parts_sql("p_size BETWEEN 10 AND 20"),
        "filter_numeric_exclusive": _parts_sql("p_size > 10 AND p_size < 20"),
        "filter_numeric_gt": "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000",
        "filter_numeric_gte": _parts_sql("p_size >= 40"),
        "filter_numeric_lt": "SELECT o_orderkey FROM orders WHERE o_totalprice < 50000",
        "filter_numeric_lte": _parts_sql("p_size <= 10"),
        "filter_text_match": _docs_sql(_has("cache")),
        "filter_text_prefix": _docs_sql(f"len(list_filter({_TOKENS}, lambda x: starts_with(x, 'thresh'))) > 0"),
        "filter_text_phrase": _docs_sql(_phrase_sql("vector index")),
        "filter_text_prefix_of_words": _docs_sql(f"contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' time z')"),
        "filter_text_suffix": _docs_sql(f"len(list_filter({_TOKENS}, lambda x: ends_with(x, 'shold'))) > 0"),
        "filter_geo_radius_km": _customers_sql(10, 20, 2500 * 1000),
        "filter_geo_radius_mi": _customers_sql(-70, 40, 1200 * 1609.34),
        "filter_geo_radius_m": _customers_sql(10, 20, 1500000),
        "filter_geo_radius_ft": _customers_sql(10, 20, 9000000 * 0.3048),
        "filter_geo_points": _place_sql("advanced_docs", "adv_id", "TRY_CAST(split_part(geo_point, ',', 1) AS DOUBLE)", "TRY_CAST(split_part(geo_point, ',', 2) AS DOUBLE)", 10, 50, 2000000),
        "filter_and_or_not": _parts_sql("p_brand IN ('Brand#11', 'Brand#12') AND (p_size >= 30 OR NOT coalesce(lower(p_type) = 'promo', false))"),
        "filter_query_paged": "SELECT p_partkey, p_size FROM part WHERE p_size >= 20 ORDER BY p_partkey LIMIT 15 OFFSET 20",
        "count_all": "SELECT count(*) AS n FROM orders",
        "count_filtered": "SELECT count(*) AS n FROM orders WHERE lower(o_orderstatus) = 'f' AND o_totalprice > 100000",
        "text_query_and": _docs_sql(f"{_has('cache')} AND {_has('threshold')}"),
        "text_query_or": _docs_sql(f"{_has('cache')} OR {_has('router')}"),
        "text_query_not": _docs_sql(f"{_has('cache')} AND NOT {_has('threshold')}"),
        "text_query_prefix": _docs_sql(f"len(list_filter({_TOKENS}, lambda x: starts_with(x, 'semant'))) > 0"),
        "text_query_phrase": _docs_sql(_phrase_sql("distance threshold")),
        "text_query_field": _docs_sql(f"({_has('loader')} OR {_has('router')}) AND list_contains({_LANG}, 'en')"),
        "text_query_fuzzy": _docs_sql(f"len(list_filter({_TOKENS}, lambda x: abs(length(x) - 6) <= 1 AND levenshtein(x, 'loeder') <= 1)) > 0"),
        "text_query_range": _docs_sql(f"n_chars > 500 AND n_chars <= 1500 AND {_has('loader')}"),
        "text_bm25_topk": _BM25_SQL,
        "knn_cosine": _knn_sql("cosine"),
        "knn_l2": _knn_sql("l2"),
        "knn_ip": _knn_sql("ip"),
        "knn_float64": _knn_sql("cosine"),
        "knn_filtered": _knn_sql("cosine", 10, "label BETWEEN 2 AND 5"),
        "knn_paged": _knn_sql("cosine", 10, "true", 10),
        "range_cosine": _range_sql("cosine", 0.85),
        "range_l2": _range_sql("l2", 1.6),
        "range_filtered": _range_sql("cosine", 0.95, "label = 3"),
        "hybrid_text_knn": f"SELECT doc_id, lang, {_distance_sql('cosine')} AS vector_distance FROM {_JOINED} WHERE list_contains({_LANG}, 'en') AND {_has('the')} ORDER BY 3, 1 LIMIT 20",
        "multi_vector": f"""
            WITH d AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}) a, 1 - list_cosine_similarity(list_reverse(embedding::DOUBLE[]), {_Q}) b FROM embeddings),
            x AS (SELECT vec_id, a FROM d ORDER BY a, vec_id LIMIT 100), y AS (SELECT vec_id, b FROM d ORDER BY b, vec_id LIMIT 100)
            SELECT vec_id, round(0.7 * a + 0.3 * b, 6) AS vector_distance FROM x JOIN y USING (vec_id)""",
        "agg_count": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
        "agg_sum_avg": "SELECT o_orderstatus, sum(o_totalprice) AS total, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_totalprice >= 1000 GROUP BY 1",
        "agg_min_max": "SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY 1",
        "agg_count_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
        "agg_count_distinctish": "SELECT event_type, true AS close FROM events GROUP BY 1",
        "agg_multi_reduce": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 6) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1, 2",
        "agg_random_sample": "SELECT p_type, least(count(p_size), 7)::INTEGER AS drawn, true AS from_group FROM part GROUP BY 1",
        "agg_custom_reducer": "SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1",
        "agg_quantile_sketch": "SELECT o_orderstatus, true AS close FROM orders GROUP BY 1",
        "agg_apply_math": """
            SELECT p_partkey, ceil(p_retailprice / 7) AS up, floor(p_retailprice / 7) AS down, round(sqrt(p_size), 6) AS root, round(ln(p_size), 6) AS "natural", round(log2(p_size), 6) AS "binary", round(exp(p_size / 50.0::DOUBLE), 6) AS grown,
                   round(p_size * p_size + sqrt(p_size), 6) AS power, abs(p_size - 25)::DOUBLE AS far, NULL::DOUBLE AS "none" FROM part""",
        "agg_apply_geo": """
            SELECT c_custkey, round(2 * 6372797.560856 * asin(sqrt(least(1.0, pow(sin(radians(lat - 20) / 2), 2) + cos(radians(20)) * cos(radians(lat)) * pow(sin(radians(lon - 10) / 2), 2)))), 6) AS metres
            FROM (SELECT c_custkey, (c_custkey * 37) % 360 - 180 AS lon, (c_custkey * 17) % 170 - 85 AS lat FROM customer)""",
        "agg_tolist": "SELECT p_type, list_sort(list(DISTINCT p_size)) AS sizes FROM part GROUP BY 1",
        "agg_quantile": "SELECT event_type, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY 1",
        "agg_stddev": "SELECT o_orderpriority, round(stddev_samp(o_totalprice), 6) AS sd FROM orders GROUP BY 1",
        "agg_first_value": "SELECT o_orderpriority, arg_max(o_totalprice, o_orderkey) AS latest FROM orders GROUP BY 1",
        "agg_global": "SELECT count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_type = 'purchase'",
        "agg_paged": "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 5",
        "agg_apply_arith": "SELECT (p_size - p_size % 10)::DOUBLE AS bucket, count(*) AS n FROM part GROUP BY 1",
        "agg_apply_string": "SELECT p_partkey, p_type, upper(substr(p_name, 1, 5)) AS head, length(p_name)::DOUBLE AS size FROM part",
        "agg_apply_date": "SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, (month(o_orderdate) - 1)::DOUBLE AS m, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
        "agg_apply_case": "SELECT CASE WHEN o_totalprice > 150000 AND o_orderstatus <> 'O' THEN 'high' ELSE 'low' END AS class, count(*) AS n FROM orders GROUP BY 1",
        "agg_hybrid": f"WITH h AS (SELECT lang, 1 - list_cosine_similarity(embedding::DOUBLE[], {_Q}) d FROM {_JOINED} WHERE {_has('the')} ORDER BY 2, doc_id LIMIT 100) SELECT lang, count(*) AS n, round(avg(d), 6) AS mean FROM h GROUP BY 1",
        "json_path_filter": "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 3 AND 6",
        "upsert_replace": f"SELECT * FROM {_OLD} ANTI JOIN {_NEW} USING (p_partkey) UNION ALL SELECT * FROM {_NEW}",
        "upsert_merge": f"SELECT coalesce(n.p_partkey, o.p_partkey) AS p_partkey, coalesce(n.p_brand, o.p_brand) AS p_brand, coalesce(n.p_size, o.p_size) AS p_size FROM {_OLD} o FULL JOIN {_NEW} n ON o.p_partkey = n.p_partkey",
        "upsert_delete": f"SELECT * FROM {_OLD} ANTI JOIN {_NEW} USING (p_partkey)",
        "rerank_lexical": f"""
            WITH s AS (SELECT doc_id, round(len(list_intersect(['the', 'semantic', 'cache', 'loses', 'time', 'zone'], {_TOKENS})) / 6.0::DOUBLE, 6) AS score FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 20""",
    }
