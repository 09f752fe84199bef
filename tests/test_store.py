import json

from pyspark.sql import functions as F

from vecframe.runtime import spread, trim_blank
from vecframe.sources.store import Catalog, DocumentStore


def test_versions_expiry_and_ties(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"), keep=1)
    at = lambda t: F.timestamp_seconds(F.lit(t))
    rows = lambda *r: spark.createDataFrame(list(r), "_key string, a string, b string").coalesce(1)
    store.merge(rows(("k1", "x", None), ("k1", "y", "z"), (None, "n", "n")), now=at(0), ttl=10)
    assert [(r["_key"], r["a"], r["b"]) for r in store.read(at(5)).collect()] == [("k1", "y", "z")]  # the last of a batch counts
    assert store.read(at(10)).count() == 0
    store.merge(rows(("k1", None, "w"), ("k2", "q", None)), now=at(5))
    got = {r["_key"]: (r["a"], r["b"], r["_expires_at"]) for r in store.read(at(6)).collect()}
    assert got["k1"][:2] == ("y", "w") and got["k1"][2] is not None and got["k2"] == ("q", None, None)
    store.replace(rows(("k1", None, "only")), now=at(6))
    assert {r["_key"]: r["a"] for r in store.read(at(7)).collect()} == {"k1": None, "k2": "q"}
    assert store.update("k2", {"b": F.lit("set")}, now=at(7)) and not store.update("none", {"b": F.lit("x")}, now=at(7))
    assert store.delete(["k1", "k9"], now=at(7)) == 1 and store.delete_prefixes(("k",), now=at(7)) == 1
    state = json.loads((tmp_path / "s/manifest.json").read_text())
    assert state["version"] == 6 and len(list((tmp_path / "s").glob("v*"))) == 2  # the current version and one older


def test_a_reader_keeps_its_version(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "s"))
    store.replace(spark.createDataFrame([("a", 1)], "_key string, n int"))
    before = store.read()
    store.replace(spark.createDataFrame([("b", 2)], "_key string, n int"))
    assert [r["_key"] for r in before.collect()] == ["a"] and store.read().count() == 2


def test_catalog(tmp_path):
    c = Catalog(str(tmp_path))
    c.put("x/y", {"schema": {"index": {"temporary_seconds": 5}}, "used_at": 0})
    c.put("z", {"schema": {"index": {}}, "used_at": 0})
    assert c.names() == ["z"] and c.get("x/y") is None and c.drop("z") and not c.drop("z")


def test_runtime(spark):
    assert [r[0] for r in spark.createDataFrame([("\t a b ",), (" ",), (None,)], "s string").select(trim_blank(F.col("s"))).collect()] == ["a b", "", None]
    assert spread(spark.range(8).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(8).repartition(9)).rdd.getNumPartitions() == 9
