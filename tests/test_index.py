"""The shared keyspace of indexes, its segments and its writers."""

import json
import threading

from pyspark.sql import functions as F

from vecframe.plans import queries as Q
from vecframe.plans.filters import Filter
from vecframe.schema import IndexDefinition, NumericField, SearchSchema, Storage, TagField, TextField, VectorField
from vecframe.sources import store as stores
from vecframe.sources.index import SearchIndex
from vecframe.sources.store import DocumentStore
from vecframe.workflows import MessageHistory


def index(spark, path, name, *prefixes, fields=(TextField("title"), NumericField("pages")), storage=Storage.HASH, **more):
    return SearchIndex(spark, str(path), SearchSchema(IndexDefinition(name, prefixes, storage, **more), fields))


def keys(df):
    return sorted(r[0] for r in df.collect())


def test_an_index_sees_the_documents_of_all_its_prefixes(spark, tmp_path):
    books, papers = index(spark, tmp_path, "books", "book:"), index(spark, tmp_path, "papers", "paper:")
    both = index(spark, tmp_path, "both", "book:", "paper:")
    for i in (books, papers, both):
        i.create()
    assert books.load_hash({"id": 1, "title": "Dunes", "pages": 300}, keys=True) == ["book:1"]
    assert papers.load_hash([{"id": 7, "title": "On dunes", "pages": 9}, {"id": 8, "title": "On sand", "pages": 12}], keys=True) == ["paper:7", "paper:8"]
    assert keys(both.documents()) == ["book:1", "paper:7", "paper:8"] and keys(books.documents()) == ["book:1"]
    assert keys(both.search(Q.FilterQuery(Filter.text("title").match("dunes"))).rows) == ["book:1", "paper:7"]
    assert both.clear() == 3 and books.info().num_docs == 0 and papers.exists()


def test_a_new_index_scans_the_documents_that_are_there(spark, tmp_path):
    first = index(spark, tmp_path, "a", "x:", storage=Storage.JSON)
    first.create()
    first.load_json([{"id": "1", "title": "T", "pages": "12", "tags": ["red", "blue"], "at": {"city": "Rome"}, "vec": [1, 2]}, {"id": "2", "title": "U"}])
    more = (TagField("tags"), NumericField("pages"), TagField("$.at.city", alias="city"), VectorField("vec", dims=2), TextField("pages2", alias="other"))
    second = index(spark, tmp_path, "b", "x:", fields=more, storage=Storage.JSON)
    second.create()
    row = {r["_key"]: r for r in second.documents().collect()}["x:1"]
    assert row["pages"] == 12.0 and list(row["vec"]) == [1.0, 2.0] and row[more[2].column] == "Rome"
    assert keys(second.search(Q.FilterQuery(Filter.tag("tags").eq("blue"))).rows) == ["x:1"]
    first.load_json({"id": "3", "tags": ["blue"], "title": "V"})  # through the other index
    assert keys(second.search(Q.FilterQuery(Filter.tag("tags").eq("blue"))).rows) == ["x:1", "x:3"]
    late = index(spark, tmp_path, "c", "x:", storage=Storage.JSON, skip_initial_scan=True)
    late.create()
    assert late.documents().count() == 0


def test_fields_of_one_name_and_two_types(spark, tmp_path):
    a = index(spark, tmp_path, "a", "k:", fields=(NumericField("year"),))
    b = index(spark, tmp_path, "b", "k:", fields=(TagField("year"),))
    a.create(), b.create()
    a.load_hash([{"id": "1", "year": 1999}, {"id": "2", "year": 2001}])
    assert keys(a.search(Q.FilterQuery(Filter.numeric("year").gt(2000))).rows) == ["k:2"]
    assert keys(b.search(Q.FilterQuery(Filter.tag("year").eq("1999"))).rows) == ["k:1"]


def test_merged_documents_keep_their_types(spark, tmp_path):
    i = index(spark, tmp_path, "h", "h:")
    i.create()
    i.load_hash({"id": "1", "title": "A", "pages": 5, "n": {"a": 1}, "l": [1, "x"], "f": 1.5, "t": True})
    assert i.update_hash([("pages", 7)], id="1")
    i.load_hash({"id": "1", "more": {"b": [2]}})
    assert i.fetch(id="1") == {"id": "1", "title": "A", "pages": 7, "n": {"a": 1}, "l": [1, "x"], "f": 1.5, "t": True, "more": {"b": [2]}}
    i.load_frame(spark.createDataFrame([("h:2", "B", 4.0)], "_key string, title string, pages double"))
    assert i.fetch(id="2") == {"title": "B", "pages": 4.0}


def test_segments_are_merged_by_tiers_and_read_as_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "OPEN_ROWS", 1)
    monkeypatch.setattr(stores, "TIER", 3)
    store, truth = DocumentStore(spark, str(tmp_path / "s"), buckets=4), {}
    for n in range(8):
        rows = [(f"k{(5 * n + j) % 11}", n) for j in range(3)]
        store.replace(spark.createDataFrame(rows, "_key string, n int"))
        truth |= dict(rows)
        if n % 3 == 1:
            gone = sorted(truth)[:2]
            assert store.delete([*gone, "none"]) == 2
            for k in gone:
                del truth[k]
        assert {r["_key"]: r["n"] for r in store.read().collect()} == truth
        assert {r["_key"]: r["n"] for r in store.get(["k1", "k5", "none"]).collect()} == {k: truth[k] for k in ("k1", "k5") if k in truth}
    state = json.loads((tmp_path / "s/manifest.json").read_text())
    assert len(state["segments"]) <= 5 and any(s["level"] > 1 for s in state["segments"])
    plan = store.get(["k1"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan


def test_appended_messages_do_not_rewrite_the_store(spark, tmp_path):
    h = MessageHistory(spark, str(tmp_path), "h")
    h.create()
    rows = spark.range(3000).selectExpr("'old' as sessionId", "'user' as role", "concat('m', id) as content", "cast(id as double) as timestamp")
    h.append_frame(rows, [F.col("timestamp")])
    big = json.loads((tmp_path / "hash/manifest.json").read_text())["segments"][0]["folder"]
    for n in range(3):
        assert h.append("new", "user", f"x{n}", timestamp=n).sequence == n + 1
    state = json.loads((tmp_path / "hash/manifest.json").read_text())
    assert [s["rows"] for s in state["segments"]] == [3000, 3] and state["segments"][0]["folder"] == big
    assert [m.content for m in h.get_recent("new", 2)] == ["x2", "x1"] and h.get_recent("old", 1)[0].sequence == 3000


def test_writers_do_not_lose_updates(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"))
    store.replace(spark.createDataFrame([("k", 0)], "_key string, n int"))
    failed = []

    def write(name):
        try:
            DocumentStore(spark, str(tmp_path / "s")).merge(spark.createDataFrame([("k", name)], f"_key string, {name} string"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b", "c")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    row = store.read().first()
    assert not failed and (row["a"], row["b"], row["c"]) == ("a", "b", "c")
    assert store.insert(spark.createDataFrame([("z", 1)], "_key string, n int"), "z") and not store.insert(spark.createDataFrame([("z", 2)], "_key string, n int"), "z")


def test_pages_of_a_long_result(spark, tmp_path):
    i = index(spark, tmp_path, "p", "p:")
    i.create()
    i.load_frame(spark.range(500).selectExpr("concat('p:', lpad(id, 4, '0')) as _key", "'t' as title", "cast(id % 7 as double) as pages"))
    got = [[r["_key"] for r in b.collect()] for b in i.batches(Q.FilterQuery(Filter.numeric("pages").eq(3), ("pages",)), 30)]
    whole = [f"p:{n:04d}" for n in range(500) if n % 7 == 3]
    assert [len(b) for b in got] == [30, 30, 11] and sum(got, []) == whole


def test_fields_that_are_not_indexed_or_missing(spark):
    from vecframe.plans.planner import Planner
    from vecframe.plans.querylang import parse

    fields = (TextField("t", sortable=True, no_index=True), TagField("g", index_missing=True), NumericField("n", sortable=True, no_index=True))
    plan = Planner(SearchSchema(IndexDefinition("i", ("i:",)), fields), spark.createDataFrame([("a", "word", "x", 1.0), ("b", "word", None, 2.0)], "_key string, t string, g string, n double"))
    assert keys(plan.ranked(Q.FilterQuery(Filter.missing("g")))) == ["b"] and keys(plan.search(Q.TextQuery("-ismissing(@g)"))) == ["a"]
    assert parse("ismissing(@g) word").render() == "ismissing(@g) word"
    assert keys(plan.ranked(Q.FilterQuery(Filter.text("t").match("word")))) == [] == keys(plan.ranked(Q.FilterQuery(Filter.numeric("n").gt(0))))
    try:
        plan.where(Filter.missing("n"))
        raise AssertionError
    except ValueError:
        pass


def test_a_cache_with_names_of_its_own(spark, tmp_path):
    from vecframe.caches import SemanticCache

    c = SemanticCache(spark, str(tmp_path), "s", 2, 0.3, names={"prompt": "question", "embedding": "vector"})
    c.create()
    c.store("p", "r", [1, 0], metadata={"n": 1})
    hit = c.check(embedding=[1, 0.01])
    assert (hit.prompt, hit.response, hit.metadata) == ("p", "r", {"n": 1}) and c.index.name == "semantic-cache:s"
    for bad in ({"answer": "x"}, {"prompt": "response"}):
        try:
            SemanticCache(spark, str(tmp_path), "s", 2, 0.3, names=bad)
            raise AssertionError
        except ValueError:
            pass


def test_reducers_of_the_users_own_and_samples(spark):
    from vecframe.plans.planner import Planner, register_reducer

    register_reducer("SPREAD", lambda x: F.max(x) - F.min(x))
    rows = spark.range(300).selectExpr("cast(id as string) as _key", "cast(id % 3 as string) as g", "cast(id as double) as n")
    plan = Planner(SearchSchema(IndexDefinition("i", ("i:",)), (TagField("g"), NumericField("n"))), rows)
    by = Q.GroupBy(("g",), (Q.Reducer("SPREAD", ("@n",), "spread"), Q.Reducer("RANDOM_SAMPLE", ("@n", 4), "some")))
    got = plan.aggregated(Q.AggregationQuery("*", Q.Pipeline((), (), by))).collect()
    assert {r["spread"] for r in got} == {297.0} and all(len(set(r["some"])) == 4 and {int(x) % 3 for x in r["some"]} == {int(r["g"])} for r in got)
