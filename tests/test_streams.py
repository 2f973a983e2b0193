"""Streams made and read line by line: the same as by the tables, and the same errors."""

import gzip
import json

import pyarrow as pa
import pytest

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from urbanframe.sources import model_json, streams

HEAD = {"type": "CityJSON", "version": "2.0", "transform": {"scale": [0.5, 0.5, 0.5], "translate": [100, 0, 0]}, "metadata": {"title": "t"}, "CityObjects": {}, "vertices": []}
OTHER = HEAD | {"transform": {"scale": [1, 1, 1], "translate": [0, 0, 0]}}
TARGET = HEAD["transform"]


def feature(name, **more):
    objects = {name: {"type": "Building", "attributes": {"type": "x", "n": 1}, "children": [name + "-p"], "+odd": {"a": {"type": "y"}}}, name + "-p": {"parents": [name], "geometry": [{"type": "MultiPoint", "lod": "1", "boundaries": [1, 0]}], "type": "BuildingPart"}}
    return {"type": "CityJSONFeature", "id": name, "CityObjects": objects, "vertices": [[0, 0, 0], [10, -4, 0]]} | more


def compact(item):
    return item if isinstance(item, str) else json.dumps(item, separators=(",", ":"))


def written(path, *items, head=HEAD):
    path.mkdir(parents=True)
    if head:
        (path / "metadata.json").write_text(json.dumps(head))
    (path / "a.jsonl").write_text("\n".join(map(compact, items)) + "\n\n")
    return f"file://{path}"


def rows(df):
    return sorted(df.select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0])


def test_streams_of_files_hold_all_features(spark, tmp_path):
    top = written(tmp_path / "f", *[feature(f"b{i}") for i in range(40)], json.dumps(feature("spaced")), feature('q"ü\\'), feature("empty", CityObjects={}), feature("null", CityObjects={"null-o": None}))
    written(tmp_path / "f/inner", *[feature(f"c{i}", appearance={"materials": []}) for i in range(9)], feature("last", vertices=[]), head=OTHER)
    models = model_json.read_feature_files(spark, top)
    for shards in (1, 3):
        path = f"file://{tmp_path}/s{shards}"
        head = streams.of_files(spark, top, TARGET, path, shards=shards, compression="gzip")
        files = sorted((tmp_path / f"s{shards}").glob("*.gz"))
        assert head["metadata"] == {"title": "t"} and len(files) == shards
        for f in files:
            kinds = [json.loads(x)["type"] for x in gzip.open(f, "rt").read().splitlines()]
            assert kinds[0] == "CityJSON" and set(kinds[1:]) <= {"CityJSONFeature"}
        back = model_json.read_stream(spark, path)
        want = model_json.objects(models)
        assert rows(model_json.objects(back)) == rows(want) and rows(model_json.vertices(back)) == rows(model_json.vertices(models))
        assert rows(back.select("model_id", "root.appearance")) == rows(models.select("model_id", "root.appearance"))
        assert rows(streams.objects(spark, path)) == rows(want.select("model_id", "external_id", "cityobject_type"))


def test_streams_of_files_as_by_tables(spark, tmp_path):
    top = written(tmp_path / "f", *[feature(f"b{i}") for i in range(5)])
    models = model_json.read_feature_files(spark, top)
    model_json.write_stream(spark, model_json.objects(models), model_json.vertices(models), TARGET, f"file://{tmp_path}/t", shards=2)
    streams.of_files(spark, top, TARGET, f"file://{tmp_path}/l", shards=2)
    a, b = (model_json.read_stream(spark, f"file://{tmp_path}/{x}") for x in "tl")
    assert rows(model_json.vertices(a)) == rows(model_json.vertices(b)) and model_json.vertices(b).count() == 10
    relations = lambda models: rows(model_json.objects(models).select("model_id", "external_id", "cityobject_type", "parents", "children"))
    assert relations(a) == relations(b)


def test_no_features_make_a_header(spark, tmp_path):
    streams.of_files(spark, written(tmp_path / "f"), TARGET, f"file://{tmp_path}/s", shards=3)
    assert streams.objects(spark, f"file://{tmp_path}/s").count() == 0 and model_json.read_stream(spark, f"file://{tmp_path}/s").count() == 0


@pytest.mark.parametrize(
    "items, head, what",
    [
        ([feature("a"), feature("b", CityObjects={"a": {"type": "Road"}})], HEAD, "object a is in two"), ([compact(feature("a")).replace('"a-p":{', '"a":{')], HEAD, "object a is in two"), ([feature("a"), {"type": "Other"}], HEAD, "no feature"),
        ([feature("a"), compact(feature("b"))[:-3]], HEAD, "no feature"), ([HEAD], HEAD, "a header among"), ([feature("a", id=None)], HEAD, "without id"), ([feature("a")], None, "no metadata.json"), ([feature("a")], HEAD | {"version": "1.0"}, "version 2"),
    ],
)
def test_nothing_is_written_of_wrong_files(spark, tmp_path, items, head, what):
    with pytest.raises((ValueError, PySparkException), match=what):
        streams.of_files(spark, written(tmp_path / "f", *items, head=head), TARGET, f"file://{tmp_path}/s")
    assert not (tmp_path / "s").exists()


@pytest.mark.parametrize(
    "items, what",
    [
        ([feature("a")], "no header"), ([feature("a"), HEAD], "not the first"), ([HEAD | {"version": "1.0"}, feature("a")], "version 2"), ([HEAD, {"type": "Other"}], "neither"), ([HEAD, "text"], "neither"), ([HEAD, HEAD], "two headers"),
        ([HEAD, feature("a", id=None)], "without id"), ([HEAD, feature("a"), feature("a")], "id twice: a"), ([HEAD, compact(feature("a")).replace("-4", "-")], "neither"),
    ],
)
def test_stream_errors(spark, tmp_path, items, what):
    with pytest.raises(ValueError, match=what):
        streams.objects(spark, written(tmp_path / "s", *items, head=None))


def test_an_id_may_be_in_two_streams(spark, tmp_path):
    written(tmp_path / "s/one", HEAD, feature("a"), head=None)
    written(tmp_path / "s/two", HEAD, feature("a"), head=None)
    assert streams.objects(spark, f"file://{tmp_path}/s/*").count() == 4


def test_lines_at_once_as_one_by_one():
    plain = [feature("a"), feature("b", CityObjects={}), feature("c", CityObjects={"o": {}, "p": {"geometry": [{"type": "z"}]}}), HEAD | {"CityObjects": {"h": {"type": "Road"}}}, {"type": "Other", "x": [{"CityObjects": {"n": {"type": "q"}}}], "id": "d"}, {"id": "no"}, feature("e", metadata={"type": {"type": "m"}})]
    odd = [feature("ü\n"), json.dumps(feature("w")), feature("n", CityObjects={"o": None, "p": [{"type": "x"}]}), feature("t", CityObjects={"o": {"type": 5}}), feature("l", CityObjects=[{"o": {"type": "x"}}]), '{"type":"CityJSONFeature","id":"x","CityObjects":{"a":{"type":"T"},"a":{"type":"U"}}}', "5", "[]", "{", '{"a":1}}', '"', feature("i", id=7)]
    same = lambda x, y: [c.to_pylist() if isinstance(c, pa.Array) else c.tolist() for c in x] == [c.to_pylist() if isinstance(c, pa.Array) else c.tolist() for c in y]
    for lines in (plain, *[[*plain, o] for o in odd], *[[o] for o in odd], *[[p] for p in plain]):
        texts = [compact(x) for x in lines]
        assert same(streams.parsed(pa.array(texts, pa.string())), streams._one_by_one(texts)), texts[-1]
    found = streams._at_once(pa.array(list(map(compact, plain))))
    assert found.name.to_pylist() == ["a", "a-p", "o", "p", "e", "e-p"] and found.type.to_pylist() == ["Building", "BuildingPart", None, None, "Building", "BuildingPart"] and found.line.tolist() == [0, 0, 2, 2, 6, 6]
