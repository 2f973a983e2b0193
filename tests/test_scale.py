"""One pass where there were many: the same results as by the tables, and plans that stay small."""

import json

import pytest

from pyspark.sql import functions as F

from urbanframe.operators import index, views
from urbanframe.plans import derive, modules
from urbanframe.plans.canonical import canonical, model_themes
from urbanframe.sources import model_json


def parsed(spark, *documents):
    rows = [(f"m{i}", json.dumps(d)) for i, d in enumerate(documents)]
    return model_json.parsed_root(spark.createDataFrame(rows, "model_id string, value string")).select("model_id", "root", "raw")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def odd_themes():
    quad, pair = [[[0, 1, 2]]], [[0, 1]]
    shapes = [
        {"type": "MultiSurface", "boundaries": quad, "material": {"a": {"values": [None]}, "b": {"value": 3}}, "texture": {"t": {"values": [[[None]]]}, "u": {"values": [[[2, 0, 1, 2]]]}, "e": {"values": [[]]}}},
        {"type": "MultiSurface", "boundaries": [], "material": {"none": {"value": 0}, "list": {"values": [7]}}},
        {"type": "MultiSurface", "boundaries": [[]], "material": {"bare": {"value": 0}}},
        {"type": "MultiLineString", "boundaries": pair, "material": {"line": {"value": 0}}, "texture": {"line": {"values": [[0, 1]]}}},
        {"type": "Solid", "boundaries": [quad], "material": {"c": {"value": 1}}, "texture": {"s": {"values": [[[[None], [1, 2]]]]}}},
        {"type": "CompositeSolid", "boundaries": [[quad]], "material": {"d": {}}, "texture": {"x": {"values": [[[[[4, 2]]]]]}, "y": {}}},
        {"type": "GeometryInstance", "template": 0, "boundaries": [1], "material": {"i": {"value": 1}}},
        {"type": "MultiPoint", "boundaries": [1]},
    ]
    head = {"type": "CityJSON", "version": "2.0", "CityObjects": {"o": {"type": "Building", "geometry": shapes}, "p": {"type": "Road"}}, "vertices": []}
    only = {**head, "CityObjects": {}, "geometry-templates": {"templates": [{"type": "MultiSurface", "boundaries": quad, "material": {"b": {"value": 0}, "z": {"values": [None]}}}], "vertices-templates": []}}
    return head, only, {**head, "CityObjects": {}}, modules.DOCUMENT | {"transform": None}


def test_themes_in_one_pass(spark):
    models = parsed(spark, *odd_themes())
    got, want = model_themes(models), views.themes(canonical(models))
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted(tuple(r) for r in want.collect()) and ("m0", "material", "bare") in found and ("m1", "material", "b") in found
    assert plan(got).count("Exchange") <= 2 < plan(want).count("Exchange")  # the distinct alone deals rows out


def test_canonical_deals_no_rows_out(spark):
    made = canonical(parsed(spark, *odd_themes()))
    for name in ("cityobjects", "geometries", "geometry_boundaries", "materials"):
        assert "Exchange" not in plan(made[name]) and "Window" not in plan(made[name]), name


def test_tables_that_are_empty_are_not_read(spark):
    bare = {"type": "CityJSON", "version": "2.0", "CityObjects": {"o": {"type": "Road", "geometry": [{"type": "MultiSurface", "boundaries": [[[0, 1, 2]]]}]}}, "vertices": [[0, 0, 0]] * 3}
    for documents in ((bare,), (bare, *odd_themes()), ({**bare, "CityObjects": {}},)):
        models = parsed(spark, *documents)
        lazy, once = canonical(models), canonical(models, once=True)
        for name, df in lazy.items():
            text = lambda t: sorted(t.select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0])
            assert text(df) == text(once[name]), name
    assert "FileScan" not in plan(canonical(parsed(spark, bare), once=True)["geometry_surface_materials"])


def test_index_bounds_and_checks_stay_in_rows(spark, tmp_path):
    thing = lambda *rest: {"type": "CityJSONFeature", "id": "x", "transform": {"scale": [-1, 2, 1], "translate": [0, 0, 5]}, "vertices": [[0, 0, 0], [5, 1, 2], [9, 9, 9]], "CityObjects": dict(rest)}
    shape = lambda *at: {"type": "Road", "geometry": [{"type": "MultiPoint", "boundaries": list(at)}]}
    deep = {"type": "A", "children": ["b"]}, {"type": "B", "children": ["c"]}, {"type": "C"}
    models = parsed(spark, thing(("a", shape(0, 1))), thing(("a", {"type": "Road"})), thing(("a", shape(1, 7, -1))), thing(*zip("abc", deep)), thing(("a", shape(9))), {**thing(), "vertices": []})
    made = index.tables(models)
    got = {r["model_id"]: tuple(r)[1:] for r in made["package_bbox"].collect()}
    whole = (-9.0, 0.0, 0.0, 18.0, 5.0, 14.0)
    assert got == {"m0": (-5.0, 0.0, 0.0, 2.0, 5.0, 7.0), "m1": whole, "m2": (-5.0, -5.0, 2.0, 2.0, 7.0, 7.0), "m3": whole}
    assert "Join" not in plan(made["package_bbox"]) and "Join" not in plan(made["packages"])
    assert {r["model_id"]: r["n_objects"] for r in made["packages"].collect()} == {"m0": 1, "m1": 1, "m2": 1, "m3": 3, "m4": 1, "m5": 0}
    index.build(spark, models, f"file://{tmp_path}/i")
    loop = parsed(spark, thing(("a", {"type": "A", "children": ["b"]}), ("b", {"type": "B", "children": ["a"]})))
    for bad, what in ((loop, "cycle"), (parsed(spark, thing(("a", {"type": "A", "children": ["q"]}))), "missing child q")):
        with pytest.raises(ValueError, match=what):
            index.build(spark, bad, f"file://{tmp_path}/i")


def test_lines_are_not_dealt_out_to_find_their_header(spark, tmp_path):
    derive.feature_files(spark, "/root/testdata/sf0.001", f"file://{tmp_path}/f")
    assert "Exchange hash" not in plan(model_json.read_feature_files(spark, f"file://{tmp_path}/f")).split("Broadcast")[0]
    assert list((tmp_path / "f/features").glob("*.gz"))


def test_default_themes_with_themes_at_hand(spark):
    models = parsed(spark, *odd_themes())
    made = canonical(models)
    made["metadata"] = made["metadata"].withColumns({"default_material_theme": F.when(F.col("model_id") != "m3", F.lit("b")), "default_texture_theme": F.lit("u")})
    got, want = (sorted(tuple(r) for r in df.collect()) for df in (views.default_themes(made, model_themes(models)), views.default_themes(made)))
    assert got == want and ("m0", "texture", "u", True) in got and ("m1", "texture", "u", False) in got
