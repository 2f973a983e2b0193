"""Views over whole models: what is an error, and what stays, on two small documents."""

import json

import pytest
from pyspark.sql import functions as F

from urbanframe.operators import graph, index, lod, lookup, selection, views
from urbanframe.operators.validate import canonical_violations
from urbanframe.plans import modules
from urbanframe.plans.canonical import canonical
from urbanframe.sources import model_json


def models(spark, keys):
    texts = [(f"R{k}", json.dumps(modules.DOCUMENT).replace('["@", 0, 0]', f"[{k}, 0, 0]").replace("@", str(k))) for k in keys]
    return model_json.parsed_root(spark.createDataFrame(texts, "model_id string, value string")).select("model_id", "root", "raw")


@pytest.fixture(scope="module")
def made(spark):
    return canonical(models(spark, (1, 2)), once=True)


def shape(made, key, kind, vertices, **offsets):
    names = [c for c in made["geometry_boundaries"].columns if c.endswith(("indices", "offsets"))]
    given = {"vertex_indices": vertices, **offsets}
    row = made["vertices"].sparkSession.createDataFrame([("R1", key, kind, "1", *[given.get(c) for c in names])], "model_id string, geometry_id long, geometry_type string, lod string, " + ", ".join(f"{c} array<long>" for c in names))
    return row


def test_template_that_is_missing(made):
    assert views.resolved(made).count() == 10
    with pytest.raises(Exception, match="no template 0 in R"):
        views.resolved(made | {"template_geometries": made["template_geometries"].limit(0)}).collect()


@pytest.mark.parametrize(
    "key, kind, vertices, offsets, what",
    [(9, "MultiPoint", [1], {}, "no geometry 9 in R1"), (4, "MultiPoint", [1], {}, "no geometry 4"), (0, "MultiPoint", [], {}, "unsound shape"), (0, "MultiLineString", [1, 2], {"line_offsets": [1]}, "unsound shape"), (0, "MultiPoint", [1, 80], {}, "missing vertex")],
)
def test_shapes_that_are_refused(made, key, kind, vertices, offsets, what):
    out = views.replaced(made, shape(made, key, kind, vertices, **offsets))
    for name in ("geometries", "geometry_boundaries"):
        with pytest.raises(Exception, match=what):
            out[name].collect()


def test_replaced_geometry_keeps_id_and_place(made):
    new = shape(made, 0, "MultiPoint", [7, 7, 0])
    with pytest.raises(Exception, match="given twice: 0 in R1"):
        views.replaced(made, new.unionByName(new))["geometries"].collect()
    out = views.replaced(made, new)
    row = out["geometries"].where("model_id = 'R1' AND geometry_id = 0").first()
    assert (row.geometry_type, row.lod, row.cityobject_ix, row.geometry_ordinal) == ("MultiPoint", "1", 0, 0)
    count = lambda name: {r[0]: r[1] for r in out[name].groupBy("model_id").count().collect()}
    assert count("geometries") == {"R1": 4, "R2": 4} and count("semantics") == {"R1": 3, "R2": 5} and count("semantic_children") == {"R2": 1}
    assert count("geometry_ring_textures") == {"R2": 2} and count("geometry_surface_materials") == {"R1": 2, "R2": 4}


def test_clean_models_stay(made):
    out = views.cleaned(made)
    for name, df in made.items():
        assert out[name].columns == df.columns and out[name].count() == df.count(), name


def test_default_theme_of_a_template_alone_is_known(made):
    held = made | {"geometry_surface_materials": made["geometry_surface_materials"].where("theme <> 'm'")}
    assert {r["known"] for r in views.default_themes(held).collect()} == {True}
    assert canonical_violations(held).where("check LIKE 'default%'").count() == 0
    gone = held | {"template_geometry_materials": held["template_geometry_materials"].limit(0)}
    assert {r["known"] for r in views.default_themes(gone).collect()} == {False}
    assert canonical_violations(gone).where("check = 'default material theme'").count() == 2


def test_extent_of_models_without_vertices(made):
    none = made | {"vertices": made["vertices"].limit(0)}
    assert views.extents(none).count() == 0
    stated = made["cityobjects"].where("cityobject_ix = 0").withColumn("geographical_extent", F.array(*[F.lit(float(i)) for i in range(6)]))
    assert {tuple(r)[1:] for r in views.extents(none | {"cityobjects": stated}).collect()} == {(0.0, 3.0, 1.0, 4.0, 2.0, 5.0)}


def test_index_state(spark, tmp_path):
    was = models(spark, (1, 2, 3))
    path = f"file://{tmp_path}/index"
    index.build(spark, was, path)
    held = index.load(spark, path)
    found = index.inspect(held, was)
    assert found["ok"] and found["covered"] and found["fresh"]
    now = models(spark, (2, 3, 4)).withColumn("raw", F.when(F.col("model_id") == "R3", F.concat("raw", F.lit(" "))).otherwise(F.col("raw")))
    assert {tuple(r) for r in index.state(held, now).collect()} == {("R1", "missing"), ("R2", "fresh"), ("R3", "changed"), ("R4", "unindexed")}
    found = index.inspect(held, now)
    assert not (found["ok"] or found["covered"] or found["fresh"]) and len(found["issues"]) == 3
    part = index.inspect(held, was.withColumn("raw", F.concat("raw", F.lit(" "))))
    assert part["covered"] and not part["fresh"] and part["issues"] == ["3 indexed models have changed"]


def test_roots_rules_ids_and_places(spark):
    edges = spark.createDataFrame([(10, 11), (11, 12), (20, 21), (21, 20)], "parent_record_id long, child_record_id long")
    rows = spark.createDataFrame([(1, 11, 1, False), (1, 12, 2, False), (2, 20, 0, False)], "package_id long, record_id long, ordinal long, is_root boolean")
    assert [tuple(r) for r in graph.chosen_roots(rows, edges).collect()] in ([(1, 11), (2, 20)], [(2, 20), (1, 11)])
    with pytest.raises(Exception, match="no root is left of package 2"):
        graph.chosen_roots(rows.unionByName(spark.createDataFrame([(2, 21, 1, False)], rows.schema)), edges).collect()
    assert not lod.is_active() and lod.is_active("highest") and lod.is_active(types=[]) and lod.is_active(by_type={"Building": "1"})
    objects = rows.withColumn("external_id", F.col("record_id").cast("string"))
    with pytest.raises(ValueError, match="no object"):
        selection.exact(objects, objects, edges, ["x"])
    for n, want in ((0, []), (1, [0]), (2, [0, 1]), (5, [0, 2, 4]), (6, [0, 3, 5])):
        got = lookup.representatives(spark, spark.range(n), ["id"]).collect()
        assert sorted(r["id"] for r in got) == want
