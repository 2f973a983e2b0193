"""Index, commands and canonical tables over small files."""

import io
import json

import pytest
from pyspark.sql import functions as F

from tests.test_model import FEATURE, HEAD, lines
from urbanframe import cli
from urbanframe.operators import index, validate
from urbanframe.plans.canonical import STRIDE, canonical
from urbanframe.plans.schema import TABLES, schema
from urbanframe.sources import model_json

BARE = {"type": "CityJSONFeature", "id": "bare", "CityObjects": {"bare": {"type": "Road"}}, "vertices": [[4, 4, 4], [8, 8, 8]]}
NONE = {"type": "CityJSONFeature", "id": "none", "CityObjects": {"none": {"type": "Road"}}, "vertices": []}
RICH = HEAD | {
    "metadata": {"identifier": "rich", "referenceSystem": "EPSG:7415"},
    "appearance": {"materials": [{"name": "red", "diffuseColor": [1, 0, 0]}], "textures": [{"type": "PNG", "image": "a.png"}], "vertices-texture": [[0, 0.5]]},
    "extensions": {"Noise": {"url": "u", "version": "1"}},
    "geometry-templates": {"templates": [{"type": "MultiSurface", "lod": "1", "boundaries": [[[0, 1, 2]]]}], "vertices-templates": [[0, 0, 0], [1, 0, 0], [0, 1, 0]]},
    "CityObjects": {
        "b": {"type": "Building", "children": ["p", "gone"], "geometry": [{"type": "Solid", "lod": "2", "boundaries": [[[[0, 1, 2], [2, 1, 0]], [[0, 2, 1]]]], "semantics": {"surfaces": [{"type": "RoofSurface", "children": [1]}, {"type": "WallSurface", "parent": 0}], "values": [[1, None]]}, "material": {"day": {"values": [[0, None]]}}}]},
        "a": {"type": "Road", "geometry": [{"type": "MultiLineString", "lod": "0", "boundaries": [[0, 1], [1, 2]]}, {"type": "GeometryInstance", "template": 0, "boundaries": [2], "transformationMatrix": [1.0] * 16}]},
        "p": {"type": "BuildingPart", "parents": ["b"]},
    },
    "vertices": [[0, 0, 0], [2, 0, 0], [0, 2, 0]],
}


def test_index_and_commands(spark, tmp_path):
    folder, at = lines(tmp_path / "s", HEAD, FEATURE, BARE, NONE), str(tmp_path / "i")
    run = lambda *a: (cli.main([*a, "--index", at], spark, out := io.StringIO()), out.getvalue().strip())
    assert run("index", "--lines", folder)[0] == 0
    boxes = {r["model_id"]: (r["min_x"], r["max_x"]) for r in index.load(spark, at)["package_bbox"].collect()}
    assert boxes == {"one": (100.0, 105.0), "bare": (102.0, 104.0)}
    assert json.loads(run("inspect")[1])["packages"] == 3 and run("validate")[0] == 0
    assert json.loads(run("get", "--lines", folder, "--id", "p")[1])["id"] == "one"
    assert run("get", "--lines", folder, "--id", "nobody")[0] == 1
    assert [json.loads(x)["id"] for x in run("query", "--lines", folder, "--bbox", "104.5", "0", "200", "9")[1].split("\n")] == ["one"]


def test_failed_build_keeps_the_index(spark, tmp_path):
    at = str(tmp_path / "i")
    index.build(spark, model_json.read_stream(spark, lines(tmp_path / "good", HEAD, BARE)), at)
    lost = FEATURE | {"CityObjects": {"one": {"type": "Building", "children": ["nowhere"]}}}
    loop = FEATURE | {"CityObjects": {"one": {"type": "Building", "children": ["two"]}, "two": {"type": "Building", "children": ["one"]}}}
    for i, bad in enumerate((lost, loop)):
        with pytest.raises(ValueError):
            index.build(spark, model_json.read_stream(spark, lines(tmp_path / f"bad{i}", HEAD, bad)), at)
    assert [r["model_id"] for r in index.load(spark, at)["packages"].collect()] == ["bare"]


def test_canonical_tables(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(RICH))
    got = canonical(model_json.read_documents(spark, str(tmp_path / "d.json")))
    assert set(got) == set(TABLES) and len(TABLES) == 24
    for name, df in got.items():
        assert validate.schema_differences(df, schema(name)) == []
    rows = {name: df.orderBy(*[c for c, t in df.dtypes if "map" not in t][:4]).collect() for name, df in got.items()}
    assert [(r["cityobject_id"], r["cityobject_ix"]) for r in rows["cityobjects"]] == [("a", 0), ("b", 1), ("p", 2)]
    assert [(r["parent_cityobject_ix"], r["child_cityobject_ix"]) for r in rows["cityobject_children"]] == [(1, 2)]
    assert [(r["geometry_id"], r["geometry_type"]) for r in rows["geometries"]] == [(0, "MultiLineString"), (2, "Solid")]
    solid = next(r for r in rows["geometry_boundaries"] if r["geometry_id"] == 2)
    assert (solid["vertex_indices"], solid["ring_offsets"], solid["surface_offsets"], solid["shell_offsets"]) == ([0, 1, 2, 2, 1, 0, 0, 2, 1], [0, 3, 6], [0, 2], [0])
    assert [(r["template_geometry_id"], r["reference_point_vertex_id"]) for r in rows["geometry_instances"]] == [(0, 2)]
    assert [(r["surface_ordinal"], r["semantic_id"]) for r in rows["geometry_surface_semantics"]] == [(0, 2 * STRIDE + 1), (1, None)]
    assert [r["semantic_type"] for r in rows["semantics"]] == ["RoofSurface", "WallSurface"] and len(rows["semantic_children"]) == 1
    assert [(r["surface_ordinal"], r["material_id"], r["theme"]) for r in rows["geometry_surface_materials"]] == [(0, 0, "day")]
    assert (rows["materials"][0]["name"], rows["textures"][0]["image_uri"], rows["texture_vertices"][0]["v"], rows["extensions"][0]["extension_name"]) == ("red", "a.png", 0.5, "Noise")
    assert rows["metadata"][0]["identifier"] == "rich" and len(rows["template_vertices"]) == 3 and len(rows["template_geometry_boundaries"]) == 1
    assert got["vertices"].agg(F.max("x")).first()[0] == 101.0
