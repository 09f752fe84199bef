import pytest

from vecframe.schema import GeoField, IndexDefinition, NumericField, SearchSchema, Storage, TagField, TextField, VectorField, VectorType

FULL = """
index: {name: full-idx, prefixes: ["docs:", "archive:"], key_separator: "|", storage_type: json, stopwords: [], temporary: 900, no_offsets: true, skip_initial_scan: true}
fields:
  - {name: title, type: text, sortable: true, weight: 2.5, no_stem: true, unf: true}
  - {name: genre, type: tag, sortable: true, separator: ";", case_sensitive: true, no_index: true}
  - {name: rating, type: numeric}
  - {name: place, type: geo}
  - {name: embedding, type: vector, attrs: {algorithm: hnsw, datatype: float32, dims: 384, distance_metric: cosine, m: 32, ef_runtime: 24}}
"""


def test_yaml_and_round_trip():
    s = SearchSchema.from_yaml(FULL)
    assert s.index.storage is Storage.JSON and s.index.stopwords == () and s.index.prefixes == ("docs:", "archive:")
    assert s.resolve("@embedding").dims == 384 and s.resolve("genre").separator == ";"
    assert SearchSchema.from_dict(s.to_dict()) == s


@pytest.mark.parametrize("change", [
    ("key_separator", "key_divider"), ("prefixes: [\"docs:\", \"archive:\"]", "prefix: a, prefixes: [b]"), ("type: geo", "type: shape"), ("dims: 384", "dims: 0"),
    ("algorithm: hnsw", "algorithm: flat"), ("weight: 2.5", "weight: 0"), ('separator: ";"', 'separator: ";;"'), ("sortable: true, separator", "separator"), ("name: full-idx", "name: ' '"),
])
def test_rejected_yaml(change):
    with pytest.raises(ValueError):
        SearchSchema.from_yaml(FULL.replace(*change))


def test_rejected_in_code():
    for bad in (lambda: IndexDefinition("i", ()), lambda: TextField("t", unf=True), lambda: NumericField("n", no_index=True), lambda: GeoField(" "), lambda: VectorField("v", sortable=True, dims=2), lambda: TagField("t", separator=" "), lambda: SearchSchema(IndexDefinition("i", ("p",)), (TagField("a"), TextField("a")))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        VectorType.INT8.width  # noqa: B018
    assert TextField("$.a.b").column == "a.b" and TextField("$.a", alias="z").column == "z"
