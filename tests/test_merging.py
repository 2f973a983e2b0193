"""Whole models merged: pools appended, objects of one id joined, errors."""

import json

import pytest

from urbanframe.operators import merging
from urbanframe.plans.canonical import canonical
from urbanframe.sources import model_json


def model(name, objects, **more):
    quad = {"type": "MultiSurface", "lod": "2", "boundaries": [[[0, 1, 2]]], "semantics": {"surfaces": [{"type": "RoofSurface"}], "values": [0]}, "material": {"t": {"value": 0}}}
    made = {k: {"type": v.get("type", "Building"), "geometry": [quad], **{m: x for m, x in v.items() if m != "type"}} for k, v in objects.items()}
    scale = more.pop("scale", 1.0)
    meta = {"identifier": name} | more.pop("metadata", {})
    return {"type": "CityJSON", "version": "2.0", "transform": {"scale": [scale] * 3, "translate": [0.0] * 3}, "metadata": meta, "CityObjects": made, "vertices": [[i, i, i] for i in range(3)], "appearance": {"materials": [{"name": name}]}} | more


@pytest.fixture
def tables(spark, tmp_path):
    def build(*models):
        for i, m in enumerate(models):
            (tmp_path / f"{i}.city.json").write_text(json.dumps(m))
        return canonical(model_json.read_documents(spark, str(tmp_path)), once=True)

    return build


def members(spark, *rows):
    return spark.createDataFrame(list(rows), "model_id string, into string, place long")


def test_pools_and_objects(spark, tables):
    one = model("m1", {"a": {"attributes": {"n": 1, "old": "x"}, "children": ["k"]}, "k": {"type": "BuildingPart", "parents": ["a"]}}, metadata={"geographicalExtent": [0, 0, 0, 1, 1, 1]}, extensions={"E": {"url": "u1", "version": "1"}})
    two = model("m2", {"a": {"attributes": {"n": 2, "s": "007"}, "children": ["k", "c"]}, "k": {"type": "BuildingPart", "parents": ["a"]}, "c": {"type": "BuildingPart", "parents": ["a"]}}, scale=2.0, metadata={"title": "two", "geographicalExtent": [-1, 0, 0, 1, 5, 1]}, extensions={"E": {"url": "u2", "version": "1"}})
    out = merging.merge(tables(one, two), members(spark, ("m1", "all", 0), ("m2", "all", 1)))
    rows = {n: [r.asDict(recursive=True) for r in out[n].collect()] for n in out}
    objects = {r["cityobject_id"]: r for r in rows["cityobjects"]}
    assert {k: r["cityobject_ix"] for k, r in objects.items()} == {"a": 0, "k": 1, "c": 2}
    assert json.loads(objects["a"]["attributes"]) == {"n": 2, "old": "x", "s": "007"}
    assert sorted((r["parent_cityobject_ix"], r["child_ordinal"], r["child_cityobject_ix"]) for r in rows["cityobject_children"]) == [(0, 0, 1), (0, 1, 2)]
    assert sorted((r["vertex_id"], r["x"]) for r in rows["vertices"]) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 0.0), (4, 2.0), (5, 4.0)]
    shapes = {r["geometry_id"]: r["vertex_indices"] for r in rows["geometry_boundaries"]}
    assert shapes == {0: [0, 1, 2], 1: [0, 1, 2], 2: [3, 4, 5], 3: [3, 4, 5], 4: [3, 4, 5]}
    assert sorted((r["geometry_id"], r["cityobject_ix"], r["geometry_ordinal"]) for r in rows["geometries"]) == [(0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 2, 0), (4, 1, 1)]
    assert sorted((r["geometry_id"], r["material_id"]) for r in rows["geometry_surface_materials"]) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)]
    assert {r["material_id"]: r["name"] for r in rows["materials"]} == {0: "m1", 1: "m2"}
    named = {r["semantic_id"] for r in rows["semantics"]}
    assert len(named) == 5 and {r["semantic_id"] for r in rows["geometry_surface_semantics"]} == named
    (meta,) = rows["metadata"]
    assert (meta["model_id"], meta["identifier"], meta["title"], meta["geographical_extent"]) == ("all", "m1", "two", [-1, 0, 0, 1, 5, 1])
    assert [(r["extension_name"], r["uri"]) for r in rows["extensions"]] == [("E", "u2")]


def test_targets_are_apart(spark, tables):
    t = tables(*[model(f"m{i}", {"a": {}}) for i in range(3)])
    out = merging.merge(t, members(spark, ("m0", "x", 0), ("m2", "y", 0)))
    assert sorted((r["model_id"], r["vertex_id"]) for r in out["vertices"].collect()) == [(m, i) for m in "xy" for i in range(3)]


def test_errors(spark, tables):
    t = tables(model("m1", {"a": {}}, extensions={"E": {"url": "u1", "version": "1"}}), model("m2", {"a": {"type": "Bridge"}}), model("m3", {"a": {}}))
    with pytest.raises(ValueError, match="nothing"):
        merging.merge(t, members(spark))
    with pytest.raises(ValueError, match="twice"):
        merging.merge(t, members(spark, ("m1", "x", 0), ("m1", "y", 0)))
    with pytest.raises(Exception, match="types differ"):
        merging.merge(t, members(spark, ("m1", "x", 0), ("m2", "x", 1)))
    with pytest.raises(ValueError, match="duplicate id a"):
        merging.merge(t, members(spark, ("m1", "x", 0), ("m3", "x", 1)), strict=True)
