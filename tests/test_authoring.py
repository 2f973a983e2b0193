"""Models written by hand, the writers, datasets with their manifest, mappings and checks of canonical tables."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_index import RICH
from tests.test_model import HEAD
from urbanframe.authoring import ModelBuilder
from urbanframe.functions import types
from urbanframe.operators import bounds, graph, validate
from urbanframe.plans.canonical import STRIDE, canonical
from urbanframe.sources import dataset, model_json

SQUARE = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]


def built(name="m", shift=0.0):
    b = ModelBuilder(name)
    b.add_object(f"{name}-b", "Building", attributes={"h": 3})
    b.add_object(f"{name}-p", "BuildingPart", parent=f"{name}-b")
    at = [(x + shift, y, z) for x, y, z in SQUARE]
    b.add_geometry(f"{name}-p", "MultiSurface", [[at], [at[:3]]], lod="2.2", semantics=["RoofSurface", None])
    return b


def textured(theme_values, material):
    doc = json.loads(json.dumps(RICH))
    doc["CityObjects"]["s"] = {"type": "Road", "geometry": [{"type": "MultiSurface", "lod": "1", "boundaries": [[[0, 1, 2]], [[2, 1, 0]]], "texture": {"day": {"values": theme_values}}, "material": {"day": material}}]}
    doc["appearance"]["vertices-texture"] = [[0, 0], [1, 0], [1, 1]]
    return doc


def read(spark, tmp_path, doc):
    (tmp_path / "d.json").write_text(json.dumps(doc))
    return canonical(model_json.read_documents(spark, str(tmp_path / "d.json")), once=True)


def test_builder(spark):
    b = built()
    assert len(b.vertices) == 4  # equal points of one call are one vertex
    made = canonical(b.models(spark), once=True)
    assert validate.canonical_violations(made).collect() == []
    assert [(r["surface_ordinal"], r["semantic_id"]) for r in made["geometry_surface_semantics"].orderBy("surface_ordinal").collect()] == [(0, 0), (1, None)]
    for bad in (
        lambda: b.add_object("m-b", "Building"), lambda: b.add_object("x", "Castle"), lambda: b.add_object("x", "Road", parent="none"),
        lambda: b.add_geometry("m-b", "MultiSurface", [[]]), lambda: b.add_geometry("m-b", "Solid", [[SQUARE]]), lambda: b.add_geometry("none", "MultiPoint", [(0, 0, 0)]),
        lambda: b.add_geometry("m-b", "MultiPoint", [(9, 9, 9)], lod="7"), lambda: b.add_geometry("m-b", "MultiPoint", [(9, 9, 9)], semantics=["Roof"]), lambda: b.add_geometry("m-b", "MultiPoint", [(9, 9, 9)], semantics=[]),
    ):
        with pytest.raises(ValueError):
            bad()
    assert len(b.vertices) == 4 and "geometry" not in b.objects["m-b"]


def test_builder_semantics_by_primitive(spark):
    b = ModelBuilder("h")
    b.add_object("h", "Building")
    hole = [(x / 2, y / 2, z) for x, y, z in SQUARE]
    b.add_geometry("h", "MultiSurface", [[SQUARE, hole], [SQUARE]], semantics=["RoofSurface", "WallSurface"])
    b.add_geometry("h", "MultiLineString", [SQUARE, SQUARE[:2]], semantics=["Door", None])
    b.add_geometry("h", "Solid", [[[SQUARE, hole], [SQUARE]]], semantics=[None, "Door"])
    assert [g["semantics"]["values"] for g in b.objects["h"]["geometry"]] == [[0, 1], [0, None], [[None, 0]]]
    assert validate.canonical_violations(canonical(b.models(spark), once=True)).collect() == []


def test_documents_and_streams(spark, tmp_path):
    models = built("one").models(spark).unionByName(built("two", 0.5).models(spark))
    objs, verts, t = model_json.objects(models), model_json.vertices(models), {"scale": [0.001] * 3, "translate": [0.0, 0.0, 0.0]}
    model_json.write_documents(objs, verts, t, str(tmp_path / "docs"))
    back = model_json.read_documents(spark, str(tmp_path / "docs" / "model=two"))
    assert [tuple(r) for r in back.select("model_id").collect()] == [("two",)]
    assert model_json.vertices(back).agg(F.max("x")).first()[0] == 1.5
    meta = spark.createDataFrame([("one", '{"title": "t", "geographicalExtent": [0]}'), ("two", '{"geographicalExtent": [1], "title": "t"}')], "model_id string, metadata string")
    head = model_json.write_stream(spark, objs, verts, t, str(tmp_path / "s"), meta, shards=2)
    assert head["metadata"] == {"title": "t"}
    again = model_json.read_stream(spark, str(tmp_path / "s"))
    assert sorted(r["external_id"] for r in model_json.objects(again).collect()) == ["one-b", "one-p", "two-b", "two-p"]
    assert model_json.vertices(again).agg(F.max("x")).first()[0] == 1.5
    with pytest.raises(ValueError):
        model_json.write_stream(spark, objs, verts, t, str(tmp_path / "x"), meta.withColumn("metadata", F.concat(F.lit('{"title": "'), "model_id", F.lit('"}'))))
    with pytest.raises(ValueError):
        model_json.write_stream(spark, objs.withColumn("external_id", F.lit("same")), verts, t, str(tmp_path / "x"))


def test_dataset(spark, tmp_path):
    path = str(tmp_path / "d")
    made = dataset.write_dataset(spark, canonical(built().models(spark)), path)
    assert made == dataset.read_manifest(spark, path) and [e["rows"] for e in made["tables"] if e["name"] == "vertices"] == [4]
    assert dataset.read_dataset(spark, path)["cityobjects"].count() == 2

    def spoilt(change, name):
        bad = json.loads(json.dumps(made))
        change(bad["tables"])
        spark.createDataFrame([(json.dumps(bad),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")
        with pytest.raises(ValueError, match=name):
            dataset.read_dataset(spark, path)

    spoilt(lambda t: t.reverse(), "order")
    spoilt(lambda t: t[2].update(rows=9), "rows")
    spoilt(lambda t: t[0].update(path="../x"), "leaves")
    spoilt(lambda t: t.pop(0), "missing")
    spoilt(lambda t: t[2].update(path=t[0]["path"]), "missing|unknown")


def test_mappings(spark, tmp_path):
    made = read(spark, tmp_path, textured([[[0, 0, 1, 2]], [[None]]], {"value": 0}))
    rows = made["geometry_ring_textures"].collect()
    assert [(r["surface_ordinal"], r["ring_ordinal"], r["theme"], r["texture_id"], r["uv_indices"]) for r in rows] == [(0, 0, "day", 0, [0, 1, 2])]
    assert sorted(r["surface_ordinal"] for r in made["geometry_surface_materials"].where("geometry_id = 3").collect()) == [0, 1]
    assert validate.canonical_violations(made).collect() == []


def test_template_mappings(spark, tmp_path):
    doc = json.loads(json.dumps(RICH))
    doc["geometry-templates"]["templates"][0] |= {"semantics": {"surfaces": [{"type": "RoofSurface"}], "values": [0]}, "material": {"day": {"values": [0]}}}
    made = read(spark, tmp_path, doc)
    assert [(r["primitive_type"], r["primitive_ordinal"], r["semantic_id"]) for r in made["template_geometry_semantics"].collect()] == [("surface", 0, -1)]
    assert [(r["primitive_type"], r["material_id"]) for r in made["template_geometry_materials"].collect()] == [("surface", 0)]
    assert made["semantics"].where("semantic_id < 0").count() == 1 and made["semantics"].where(f"semantic_id >= {STRIDE}").count() == 2


def test_violations_are_found(spark, tmp_path):
    made = read(spark, tmp_path, textured([[[7, 0, 1]], [[None]]], {"value": 4}) | {"appearance": RICH["appearance"] | {"default-theme-material": "night"}})
    found = {r["check"] for r in validate.canonical_violations(made).collect()}
    assert found == {"texture", "ring texture", "material", "uv", "default material theme"}


def test_instance_extent(spark, tmp_path):
    doc = json.loads(json.dumps(RICH))
    doc["CityObjects"]["a"]["geometry"][1]["transformationMatrix"] = [2.0, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    row = bounds.instance_extents(read(spark, tmp_path, doc)).first()
    # HEAD's transform halves: the reference point, vertex 2, lies at (100, 1, 0)
    assert HEAD["transform"]["scale"][0] == 0.5 and (row["min_x"], row["max_x"], row["min_y"], row["max_y"]) == (105.0, 107.0, 1.0, 2.0)


def test_preorder(spark):
    e = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (2, 0, 4), (3, 0, 2), (3, 1, 5), (4, 0, 3)], "parent_record_id long, child_ordinal int, child_record_id long")
    got = graph.preorder(spark, e, spark.createDataFrame([(1,)], "record_id long")).orderBy("path").collect()
    assert [r["record_id"] for r in got] == [1, 2, 4, 3, 5]  # 3 is seen first below 4, and leads back to 2


def test_types(spark):
    df = spark.createDataFrame([("Road", [1, 1], 0.1), ("+Own", [1, 2], 0.2), (None, [], 0.3)], "t string, v array<int>, x double")
    out = df.select(types.parsed(F.col("t"), types.OBJECT_TYPES, "type", True).alias("t"), types.uniform(F.col("v")).alias("u"), types.shortest_float(F.col("x")).alias("x")).collect()
    assert [tuple(r) for r in out] == [("Road", True, 0.1), ("+Own", False, 0.2), (None, False, 0.3)]
    with pytest.raises(PySparkException):
        df.select(types.parsed(F.col("t"), types.SEMANTIC_TYPES, "type")).collect()
    assert len(types.OBJECT_TYPES) == 34 and len(types.SEMANTIC_TYPES) == 18
