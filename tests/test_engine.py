"""Golden results on small tables: filters, text, vectors, aggregations, documents, caches, workflows."""

from dataclasses import dataclass

import pytest

from vecframe.functions.expressions import ExpressionError, expression
from vecframe.functions.vectors import decode, encode
from vecframe.mapping import MappingError, build
from vecframe.plans import queries as Q
from vecframe.plans.filters import Filter
from vecframe.plans.planner import Planner
from vecframe.schema import Algorithm, GeoField, IndexDefinition, Metric, NumericField, SearchSchema, Storage, TagField, TextField, VectorField
from vecframe.sources.index import SearchIndex
from vecframe.vectorizers import EmbeddingsApiVectorizer, HashingVectorizer, vectorize_many

MOVIES = SearchSchema(IndexDefinition("movies", ("movie:",)), (TextField("title", weight=3.0), NumericField("year"), TagField("genre"), GeoField("location"), VectorField("embedding", dims=2, algorithm=Algorithm.HNSW), VectorField("image", dims=2)))


def planner(spark, rows, columns="_key string, title string, year double, genre string, location string, embedding array<float>, image array<float>", schema=MOVIES):
    return Planner(schema, spark.createDataFrame(rows, columns))


@pytest.fixture(scope="module")
def movies(spark):
    return planner(spark, [
        ("1", "Heat", 1995.0, "crime", "-118.2437,34.0522", [1.0, 0.0], [0.0, 1.0]),
        ("2", "Thief", 1981.0, "crime", "-87.6298,41.8781", [0.8, 0.2], [0.2, 0.8]),
        ("3", "Arrival", 2016.0, "science-fiction", "-73.5673,45.5017", [0.0, 1.0], [0.4, 0.6]),
        ("4", None, None, None, None, None, None),
    ])


def keys(df):
    return [r[0] for r in df.collect()]


def test_filters(movies):
    where = lambda n: keys(movies.ranked(Q.FilterQuery(n)))
    assert where(Filter.tag("genre").eq("CRIME")) == ["1", "2"]
    assert where(Filter.numeric("year").gt(1990)) == ["1", "3"]
    assert where(Filter.text("title").prefix("Arr")) == ["3"]
    assert where(Filter.text("title").match("he*")) == ["1"]
    assert where(Filter.geo("location").within_radius(-118.2437, 34.0522, 50, "mi")) == ["1"]
    assert where(~Filter.tag("genre").eq("crime")) == ["3", "4"]
    assert where(~~Filter.tag("genre").eq("crime")) == ["1", "2"]
    assert movies.count(Q.CountQuery(Filter.tag("genre").eq("crime"))) == 2
    assert movies.search(Q.FilterQuery(None, ("@title", "title"), Q.Page(1, 1))).collect() == [("2", "Thief")]
    with pytest.raises(ValueError):
        where(Filter.tag("nothing").eq("x"))


def test_vectors(movies):
    crime = Filter.tag("genre").eq("crime")
    q = Q.VectorQuery("embedding", [1, 0], 2, crime, ("title",), runtime=Q.Runtime(ef_runtime=10))
    rows = movies.search(q).collect()
    assert [r["title"] for r in rows] == ["Heat", "Thief"] and rows[0]["vector_distance"] == pytest.approx(0) and movies.total(q) == 2
    assert [r["title"] for r in movies.search(Q.with_page(q, Q.Page(1, 1))).collect()] == ["Thief"]
    assert keys(movies.search(Q.RangeQuery("embedding", encode([1, 0]), 0.3, crime, runtime=Q.Runtime(epsilon=0.1)))) == ["1", "2"]
    assert keys(movies.search(Q.HybridQuery("embedding", [1, 0], 2, crime, text_filter=Filter.text("title").prefix("He")))) == ["1"]
    assert movies.search(Q.VectorQuery("embedding", [1, 0], 2)).columns == ["_key", "vector_distance"]
    for bad in (Q.VectorQuery("embedding", [1, 0, 0], 2), Q.VectorQuery("title", [1, 0], 2), Q.VectorQuery("image", [1, 0], 2, runtime=Q.Runtime(ef_runtime=3)), Q.VectorQuery("embedding", b"1234", 2)):
        with pytest.raises(ValueError):
            movies.search(bad)
    for bad in (lambda: Q.VectorQuery("e", [1], 0), lambda: Q.VectorQuery("e", [1], 2, page=Q.Page(1, 2)), lambda: Q.RangeQuery("e", [1], 0), lambda: Q.HybridQuery("e", [1], 2, text_filter=crime), lambda: Q.WeightedVector("e", [1], 0), lambda: Q.Page(-1), lambda: Q.Runtime(ef_runtime=0)):
        with pytest.raises(ValueError):
            bad()


def test_squared_l2(spark):
    s = SearchSchema(IndexDefinition("c", ("c:",)), (VectorField("v", dims=2, metric=Metric.L2),))
    p = planner(spark, [("a", [1.0, 0.0])], "_key string, v array<float>", s)
    assert keys(p.search(Q.RangeQuery("v", [1.4, 0], 0.25))) == ["a"] and keys(p.search(Q.RangeQuery("v", [1.4, 0], 0.15))) == []


def test_multi_vector(movies):
    q = Q.MultiVectorQuery((Q.WeightedVector("embedding", [1, 0], 0.7), Q.WeightedVector("image", [0, 1], 0.3)), 3, return_fields=("title",))
    rows = movies.search(q).collect()
    assert [r["_key"] for r in rows] == ["1", "2", "3"] and rows[0]["title"] == "Heat"
    assert rows[0]["vector_distance"] < rows[1]["vector_distance"] < rows[2]["vector_distance"]
    assert movies.search(Q.MultiVectorQuery((Q.WeightedVector("embedding", [1, 0]), Q.WeightedVector("image", [1, 0])), 1)).count() == 0


def test_text_rank(spark):
    p = planner(spark, [("1", "Heat Heat", 1995.0, "crime"), ("2", "Heat", 1981.0, "crime"), ("3", "Arrival", 2016.0, "science-fiction")], "_key string, title string, year double, genre string")
    q = Q.TextQuery("heat", ("title",))
    assert p.search(q).collect() == [("1", "Heat Heat"), ("2", "Heat")] and p.total(q) == 2
    assert keys(p.search(Q.TextQuery("@genre:{crime} @year:[1990 +inf]"))) == ["1"]
    assert keys(p.search(Q.TextQuery("arr*|%heet%"))) == ["1", "2", "3"]
    stopped = Planner(MOVIES.renamed(stopwords=("the",)), p.df)
    assert keys(stopped.search(Q.TextQuery("the heat"))) == ["1", "2"] and keys(p.search(Q.TextQuery("the heat"))) == []


def test_aggregation(movies):
    by = Q.GroupBy(("@genre",), (Q.Reducer.count("n"), Q.Reducer.of("AVG", "year", "mean")))
    sort = (Q.SortField("n", True), Q.SortField("mean", True))
    rows = lambda page: [tuple(r) for r in movies.aggregate(Q.AggregationQuery("@year:[0 +inf]", Q.Pipeline((), (), by, sort, page))).collect()]
    assert rows(Q.Page()) == [("crime", 2, 1988.0), ("science-fiction", 1, 2016.0)]
    assert rows(Q.Page(1, 1)) == [("science-fiction", 1, 2016.0)]
    q = Q.AggregationQuery("*", Q.Pipeline(("title",), (Q.Apply("@year - (@year % 10)", "decade"),), sort_by=(Q.SortField("decade"),)))
    assert [r["decade"] for r in movies.aggregate(q).collect()] == [None, 1980.0, 1990.0, 2010.0]
    with pytest.raises(ValueError):
        movies.aggregate(Q.AggregationQuery("*", Q.Pipeline((), (), Q.GroupBy((), (Q.Reducer("MEDIAN", ("@year",), "m"),)))))


def test_aggregate_hybrid(spark):
    p = planner(spark, [("1", "Heat", "crime", [1.0, 0.0]), ("2", "Heatwave", "crime", [0.8, 0.2]), ("3", "Arrival", "science-fiction", [0.3, 0.7]), ("4", "Argo", "thriller", [0.1, 0.9])], "_key string, title string, genre string, embedding array<float>")
    h = Q.HybridQuery("embedding", [1, 0], 3, text_filter=Filter.text("title").prefix("He") | Filter.text("title").prefix("Ar"), score_alias="d")
    q = Q.AggregateHybridQuery(h, Q.Pipeline((), (), Q.GroupBy(("genre",), (Q.Reducer.count("n"), Q.Reducer.of("AVG", "d", "mean"))), (Q.SortField("n", True),)))
    rows = p.aggregate(q).collect()
    assert [(r["genre"], r["n"]) for r in rows] == [("crime", 2), ("science-fiction", 1)] and rows[0]["mean"] < rows[1]["mean"] and p.total(q) == 2


def test_plans(spark, movies, tmp_path):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan(movies.search(Q.VectorQuery("embedding", [1, 0], 2)))
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("cast(id as string) as _key", "cast(id as int) as year", "'x' as genre", "'y' as title").write.parquet(path)
    p = Planner(MOVIES, spark.read.parquet(path))
    text = plan(p.where(Filter.numeric("year").gte(10)).select("_key"))
    assert "GreaterThanOrEqual(year,10)" in text and "ReadSchema: struct<_key:string,year:int>" in text
    by = Q.GroupBy(("genre",), (Q.Reducer.count("n"),))
    assert "ReadSchema: struct<genre:string>" in plan(p.aggregated(Q.AggregationQuery("*", Q.Pipeline((), (), by))))


def test_expressions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(7.0, "a,b , a", 1700000000.0)], "x double, s string, t double")
    get = lambda e: df.select(expression(e, F.col).alias("v")).first()[0]
    assert get("@x * 2 + 1") == 15 and get("2 ^ 3 ^ 0") == 2 and get("-@x % 4") == -3 and get("@x / 0") is None
    assert get("@x > 3 && !(@s == 'z')") == 1 and get("case(@x < 3, 'low', 'high')") == "high"
    assert get("split(@s)") == ["a", "b"] and get("substr(@s, 0, 3)") == "a,b" and get("contains(@s, 'a')") == 2
    assert get("year(@t)") == 2023 and get("timefmt(@t, '%Y-%m-%d')") == "2023-11-14" and get("dayofweek(@t)") == 2
    assert get("format('%s!', @s)") == "a,b , a!" and get("exists(@x)") == 1 and get("floor(sqrt(@x))") == 2
    assert get("geodistance('0,0', '0,1')") == pytest.approx(111226.3, abs=1)
    for bad in ("@x +", "nothing(@x)", "abs(@x, 1)", "(1", "1 2"):
        with pytest.raises(ExpressionError):
            get(bad)


@dataclass
class Movie:
    id: str
    title: str
    year: int
    distance: float | None = None


def test_mapping():
    assert build({"_key": "k", "TITLE": "Heat", "year": "1995", "distance": "0.5"}, Movie) == Movie("k", "Heat", 1995, 0.5)
    for bad in ({"_key": "k", "title": "Heat"}, {"_key": "k", "title": "Heat", "year": "soon"}):
        with pytest.raises(MappingError):
            build(bad, Movie)
    assert decode(encode([1.5, 2.5])) == [1.5, 2.5]


def test_documents(spark, tmp_path):
    schema = SearchSchema(IndexDefinition("m", ("m:",), Storage.JSON), (TextField("title"), NumericField("year"), TagField("genre")))
    index = SearchIndex(spark, str(tmp_path), schema)
    assert index.create() and index.exists() and not index.create(skip_if_exists=True)
    with pytest.raises(ValueError):
        index.create()
    assert index.load_json([{"id": "1", "title": "Heat", "year": 1995, "genre": "crime", "meta": {"director": "Mann", "tags": [1, 2]}}, {"id": "2", "title": "Thief", "year": 1981}]) == 2
    assert index.fetch(id="1")["meta"]["director"] == "Mann" and index.fetch(key="m:9") is None
    assert index.update_json([("$.meta.director", "M. Mann"), ("$.meta.tags[1]", 5)], id="1") and index.fetch(id="1")["meta"] == {"director": "M. Mann", "tags": [1, 5]}
    assert not index.update_json([("$.x", 1)], id="9")
    for bad in ([], [("x", 1)], [("$.a", 1), ("$.a", 2)]):
        with pytest.raises(ValueError):
            index.update_json(bad, id="1")
    with pytest.raises(ValueError):
        index.load_hash({"id": "3"})
    index.load_json({"id": "1", "title": "New"})
    assert index.fetch(id="1") == {"id": "1", "title": "New"}
    again = SearchIndex.from_existing(spark, str(tmp_path), "m")
    assert again.schema == schema and again.info().num_docs == 2 and keys(SearchIndex.list(spark, str(tmp_path))) == ["m"]
    res = again.search(Q.FilterQuery(Filter.text("title").match("thief"), ("title", "year")))
    assert res.total == 1 and res.collect_as(Movie) == [Movie("m:2", "Thief", 1981)]
    assert [b.count() for b in again.batches(Q.FilterQuery(None, ("title",)), 1)] == [1, 1]
    assert [b.count() for b in again.batches(Q.FilterQuery(Filter.numeric("year").gt(3000)), 1)] == [0]
    assert again.delete(id="2") and not again.delete(id="2") and again.clear() == 1 and again.exists()
    assert again.drop() and not again.exists()


def test_hash_documents(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path), SearchSchema(IndexDefinition("h", ("h:",)), (TextField("title"), NumericField("year"))))
    index.create()
    index.load_hash({"id": "1", "title": "Heat", "year": 1995})
    index.load_hash({"id": "1", "year": 1996, "title": None})
    row = index.documents().first()
    assert (row["title"], row["year"]) == ("Heat", 1996.0)
    assert index.update_hash([("title", "Heat 2")], id="1") and index.documents().first()["title"] == "Heat 2" and not index.update_hash([("title", "x")], id="2")
    with pytest.raises(ValueError):
        index.update_hash([("title", None)], id="1")


def test_embeddings_cache(spark, tmp_path):
    from vecframe.caches import EmbeddingsCache

    c = EmbeddingsCache(spark, str(tmp_path), "c")
    assert c.get("a") is None and c.exists_many([("a", None)]) == [False]
    c.set_many([("a", [1, 2], "m", {"x": 1}), ("b", [3, 4], None, None)])
    got = c.get_many([("b", None), ("a", "m"), ("a", None)])
    assert got[0].embedding == [3, 4] and got[1].metadata == {"x": 1} and got[2] is None
    c.set("a", [5, 6], "m")
    assert c.get("a", "m").embedding == [5, 6] and c.get("a", "m").metadata == {"x": 1}
    asked = spark.createDataFrame([("b",), ("z",)], "text string")
    assert {r["text"]: r["embedding"] for r in c.lookup_frame(asked, "text").collect()} == {"b": [3, 4], "z": None}
    assert c.delete_many([("a", "m"), ("a", "m"), ("z", None)]) == 1 and not c.exists("a", "m")
    with pytest.raises(ValueError):
        c.set("a", [1], ttl=0)


def test_semantic_cache(spark, tmp_path):
    from vecframe.caches import SemanticCache

    c = SemanticCache(spark, str(tmp_path), "s", 2, 0.25, metric=Metric.L2, filterable=[TagField("tenant")])
    assert c.create() and not c.create()
    c.store("p", "cached-a", [1, 0], filters={"tenant": "team-a"}, metadata={"n": 1})
    c.store("p", "cached-b", [1, 0], filters={"tenant": "team-b"})
    assert c.check(embedding=[1.4, 0], filter=Filter.tag("tenant").eq("team-a")).response == "cached-a"
    assert c.check(embedding=[1.4, 0], threshold=0.15) is None
    assert c.check(embedding=[1.4, 0], filter=Filter.tag("tenant").eq("team-c")) is None
    with pytest.raises(ValueError):
        c.store("p", "r", [1, 0], filters={"other": "x"})
    with pytest.raises(ValueError):
        SemanticCache(spark, str(tmp_path), "s", 3, 0.25, metric=Metric.L2, filterable=[TagField("tenant")]).create()
    asked = spark.createDataFrame([(1, [1.1, 0.0]), (2, [9.0, 9.0])], "q int, v array<double>")
    assert [r["q"] for r in c.check_frame(asked, "q", "v").collect()] == [1]


def test_router_and_histories(spark, tmp_path):
    from vecframe.workflows import MessageHistory, SemanticMessageHistory, SemanticRouter

    v = HashingVectorizer(32)
    r = SemanticRouter(spark, str(tmp_path), "r", 32, 0.6)
    r.create()
    r.add("billing", "where is my invoice", vectorizer=v)
    r.add("search", "find similar documents", vectorizer=v)
    assert r.route("where is the invoice", vectorizer=v).route_name == "billing" and r.route("zzz qqq", vectorizer=v) is None
    asked = spark.createDataFrame([(1, v.vectorize("where is the invoice")), (2, v.vectorize("zzz qqq")), (3, None)], "n int, v array<double>")
    assert [(x["n"], x["routeName"]) for x in r.route_frame(asked, "n", "v").collect()] == [(1, "billing")]
    h = MessageHistory(spark, str(tmp_path), "h")
    h.create()
    for i, (s, role) in enumerate([("a", "user"), ("a", "assistant"), ("b", "user"), ("a", "user")]):
        h.append(s, role, f"m{i}", timestamp=1000 * i)
    assert [m.content for m in h.get_recent("a")] == ["m3", "m1", "m0"] and [m.sequence for m in h.get_recent("a", 2, "user")] == [3, 1]
    s = SemanticMessageHistory(spark, str(tmp_path), "sh", 2, 0.3)
    s.create()
    for t, e in (("x", [1, 0]), ("y", [0.9, 0.1]), ("z", [0, 1])):
        s.append("a", "user", t, embedding=e)
    assert [m.content for m in s.get_relevant("a", [1, 0])] == ["x", "y"]
    with pytest.raises(ValueError):
        s.append("a", "user", "w", embedding=[1])


def test_vectorizers_and_rerankers(spark):
    from vecframe.rerankers import CrossEncoderReranker, HostedReranker, LexicalReranker, RerankRequest, WordPieceTokenizer

    assert vectorize_many(HashingVectorizer(8), []) == [] and len(vectorize_many(HashingVectorizer(8), ["a", "b"])) == 2
    api = EmbeddingsApiVectorizer("u", "k", "m", 2, post=lambda u, h, b: {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]})
    assert api.vectorize_batch(["a", "b"]) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        api.vectorize_batch(["a", " "])
    with pytest.raises(ValueError):
        api.vectorize_batch(["a"])
    t = WordPieceTokenizer({w: i for i, w in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "你", "good"])}, max_length=6)
    assert t.encode("Unáffable", "你 good") == ([1, 3, 4, 2, 6, 2], [1] * 6, [0, 0, 0, 0, 1, 1])
    req = RerankRequest("good day", ("bad", "good", "good day"), 2)
    assert [x.index for x in LexicalReranker().rerank(req)] == [2, 1]
    assert [x.index for x in CrossEncoderReranker(t, lambda ids, m, k: len(ids), 4).rerank(RerankRequest("good", ("good", "good good")))] == [1, 0]
    hosted = HostedReranker("u", "k", "m", post=lambda u, h, b: {"results": [{"index": 5, "relevance_score": 1}]})
    with pytest.raises(ValueError):
        hosted.rerank(req)
    for bad in (lambda: RerankRequest(" ", ()), lambda: RerankRequest("q", (), 0), lambda: RerankRequest("q", (" ",))):
        with pytest.raises(ValueError):
            bad()


def test_stream_ingest(spark, tmp_path):
    from vecframe.streaming import ingest

    index = SearchIndex(spark, str(tmp_path / "w"), SearchSchema(IndexDefinition("s", ("s:",)), (TextField("title"),)))
    index.create()
    spark.createDataFrame([("s:1", "a"), ("s:2", "b"), ("s:1", "c")], "_key string, title string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("_key string, title string").parquet(str(tmp_path / "in"))
    ingest(stream, index, str(tmp_path / "cp")).awaitTermination()
    assert {r["_key"]: r["title"] for r in index.documents().collect()} == {"s:1": "c", "s:2": "b"}


def test_cli(spark, tmp_path, capsys):
    from vecframe.cli import main, run

    w = ["--warehouse", str(tmp_path)]
    ask = lambda *a: run([*a, *w], lambda: spark)
    assert ask("index", "create", "--name", "b", "--prefix", "b:", "--field", "text:title", "--field", "tag:genre") == "Created b"
    assert ask("index", "create", "--name", "b", "--prefix", "b:", "--field", "text:title", "--skip-if-exists") == "Skipped b"
    assert ask("index", "list") == "b" and '"numDocs": 0' in ask("index", "info", "--name", "b") and ask("index", "clear", "--name", "b") == "0"
    assert ask("index", "delete", "--name", "b") == "Deleted b" and ask("index", "list") == ""
    (tmp_path / "s.yaml").write_text("index: {name: y, prefix: 'y:'}\nfields: [{name: t, type: text}]")
    assert "valid" in run(["schema", "validate", "--file", str(tmp_path / "s.yaml")])
    assert '"keySeparator"' in run(["schema", "show", "--file", str(tmp_path / "s.yaml")])
    assert main(["schema", "validate", "--file", str(tmp_path / "none.yaml")]) == 1 and main(["index", "create", "--what", "x", *w]) == 1
