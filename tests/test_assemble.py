"""Documents to canonical tables and back give the same tables."""

import json

import pytest
from pyspark.sql import functions as F

from urbanframe.plans.canonical import canonical
from urbanframe.sources import assemble, model_json

QUAD = [[0, 1, 2, 3]]
SHELL = [[[0, 1, 2, 3]], [[4, 5, 6, 7], [0, 1, 2]], [[1, 2, 6, 5]]]
MODEL = {
    "type": "CityJSON", "version": "2.0", "transform": {"scale": [0.001] * 3, "translate": [10.0, 20.0, 0.0]}, "metadata": {"identifier": "m\"1", "title": "é", "referenceSystem": "EPSG:7415"},
    "CityObjects": {
        "b": {"type": "Building", "children": ["q", "p"], "attributes": {"n": 1, "zip": "007"}, "geographicalExtent": [0, 0, 0, 1, 1, 1], "+more": {"a": "x"}},
        "p": {"type": "BuildingPart", "parents": ["b"], "geometry": [
            {"type": "Solid", "lod": "2.2", "boundaries": [SHELL, SHELL[:1]], "semantics": {"surfaces": [{"type": "RoofSurface", "children": [1]}, {"type": "Window", "parent": 0}], "values": [[0, None, 1], [0]]}},
            {"type": "MultiSurface", "lod": "1.0", "boundaries": [QUAD, QUAD], "semantics": {"surfaces": [{"type": "WallSurface"}], "values": [None, 0]}},
        ]},
        "q": {"type": "BuildingPart", "parents": ["b"], "geometry": [{"type": "MultiPoint", "boundaries": [3, 4]}, {"type": "MultiLineString", "lod": "0", "boundaries": [[0, 1], [1, 2, 3]]}, {"type": "MultiSolid", "lod": "2", "boundaries": [[SHELL], [SHELL, SHELL[:1]]]}]},
    },
    "vertices": [[i, i * i, -i] for i in range(8)],
}
SAME = ("vertices", "cityobjects", "cityobject_children", "geometries", "geometry_boundaries", "semantics", "semantic_children", "geometry_surface_semantics", "geometry_point_semantics", "geometry_linestring_semantics")


def test_round_trip(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.city.json").write_text(json.dumps(MODEL | {"metadata": MODEL["metadata"] | {"identifier": f'm"{i}'}}))
    one = canonical(model_json.read_documents(spark, str(tmp_path)), once=True)
    back = model_json.parsed_root(assemble.documents(one, 0.001, (10.0, 20.0, 0.0))).select("model_id", "root", "raw")
    assert {json.loads(r["raw"])["metadata"]["title"] for r in back.collect()} == {"é"}
    two = canonical(back, once=True)
    for name in SAME:
        a, b = ([json.dumps(r.asDict(recursive=True), sort_keys=True) for r in t[name].collect()] for t in (one, two))
        assert sorted(a) == sorted(b), name
        assert a or name in ("geometry_point_semantics", "geometry_linestring_semantics")


def test_what_is_not_written_is_an_error(spark, tmp_path):
    (tmp_path / "a.city.json").write_text(json.dumps(MODEL | {"appearance": {"materials": [{"name": "x"}]}}))
    with pytest.raises(ValueError, match="materials"):
        assemble.documents(canonical(model_json.read_documents(spark, str(tmp_path))), 0.001, (0.0, 0.0, 0.0))


def test_ids_of_a_large_document_take_time_in_proportion(spark):
    import time

    def took(n):
        objects = ",".join(f'"o{i:06d}":{{"type":"Building","geometry":[{{"type":"MultiPoint","lod":"1","boundaries":[{i % 8}]}}]}}' for i in range(n))
        text = spark.createDataFrame([(json.dumps(MODEL | {"CityObjects": {}})[:-1].replace('"CityObjects": {}', f'"CityObjects": {{{objects}}}') + "}",)], "value string")
        models = model_json.parsed_root(text).select(F.lit("m").alias("model_id"), "root", "raw")
        start = time.perf_counter()
        last = canonical(models)["geometries"].agg(F.count("*"), F.max("geometry_id"), F.max("cityobject_ix")).first()
        assert tuple(last) == (n, n - 1, n - 1)
        return time.perf_counter() - start

    took(100)
    assert took(16_000) < 4 * took(4_000) + 5
