"""Small cases with results worked out by hand."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from urbanframe.functions import scalars
from urbanframe.operators import attributes, geometry, graph, lod, lookup, selection, validate
from urbanframe.sources import generate, model_json
from urbanframe.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first()["v"]


def test_hilbert_small_grid(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0)], "x int, y int")
    assert [r[0] for r in cells.select(scalars.hilbert(F.col("x"), F.col("y"), 1)).collect()] == [0, 1, 2, 3]


def test_hilbert_is_a_path(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    at = {r["d"]: (r["x"], r["y"]) for r in cells.select("x", "y", scalars.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect()}
    assert sorted(at) == list(range(256))
    assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(255))


def test_quantise_halves_away_from_zero(spark):
    assert [one(spark, scalars.quantise(F.col("x"), 1, 0), x=x) for x in (2.5, -2.5, 0.49)] == [3, -3, 0]


def test_crs(spark):
    for text, want in (("EPSG:7415", "EPSG:7415"), (" https://www.opengis.net/def/crs/EPSG/0/7415 ", "EPSG:7415"), ("urn:ogc:def:crs:EPSG::28992", "EPSG:28992"), ("local", "local")):
        assert one(spark, scalars.canonical_crs(F.col("t")), t=text) == want


def test_unknown_lod_is_an_error(spark):
    with pytest.raises(PySparkException):
        one(spark, scalars.lod_parsed(F.col("t")), t="2.7")


def test_shrink():
    assert scalars.shrink((0, 0, 10, 0), 0.5) == (2.5, 0, 7.5, 0)


def test_page_limit(spark):
    with pytest.raises(ValueError):
        lookup.page(spark.range(3), "id", None, 0)


def test_highest_lod_takes_the_last_of_equal_levels(spark):
    g = spark.createDataFrame([(1, "2", 0), (1, "2.0", 1), (1, None, 2), (2, None, 0)], "record_id long, lod string, geometry_ordinal long")
    assert [tuple(r) for r in lod.highest(g).collect()] == [(1, "2.0")]


def test_closure_levels_and_cycles(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "parent_record_id long, child_record_id long")
    seeds = spark.createDataFrame([(1,)], "record_id long")
    assert {r[0]: r[1] for r in graph.closure(spark, e, seeds).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert graph.cyclic(spark, e).count() == 0
    loop = e.unionByName(spark.createDataFrame([(5, 4), (9, 9)], e.schema))
    assert {9, 4, 5} <= {r[0] for r in graph.cyclic(spark, loop).collect()}


def test_selection_algebra(spark):
    kind = "record_id long, whole boolean, geometries array<bigint>"
    a = spark.createDataFrame([(1, True, []), (2, False, [0]), (3, False, [1])], kind)
    b = spark.createDataFrame([(1, False, [2]), (2, False, [1]), (3, False, [1])], kind)
    show = lambda df: {r[0]: (r[1], r[2]) for r in df.collect()}
    assert show(selection.union(a, b)) == {1: (True, []), 2: (False, [0, 1]), 3: (False, [1])}
    assert show(selection.intersection(a, b)) == {1: (False, [2]), 3: (False, [1])}


def test_subset_without_match(spark):
    o = spark.createDataFrame([(1, "a")], "record_id long, external_id string")
    e = spark.createDataFrame([], "parent_record_id long, child_record_id long")
    with pytest.raises(ValueError):
        selection.subset(spark, o, e, ["b"])


def test_merge_and_append(spark):
    kind = "external_id string, cityobject_type string, attributes map<string,string>"
    a, b = spark.createDataFrame([("x", "Building", {"h": "1", "n": "a"})], kind), spark.createDataFrame([("x", "Building", {"h": "2"}), ("y", "Bridge", None)], kind)
    got = {r[0]: r["attributes"] for r in selection.merge_objects(a, b).collect()}
    assert got == {"x": {"h": "2", "n": "a"}, "y": None}
    with pytest.raises(ValueError):
        selection.append_strict(a, b)
    with pytest.raises(PySparkException):
        selection.merge_objects(a, a.withColumn("cityobject_type", F.lit("Road"))).collect()


def test_transforms():
    t, u = ((1,), (0,)), ((2,), (0,))
    assert selection.reconcile_transforms([t, None, t]) == t
    assert selection.reconcile_transforms([t, u]) is None
    assert selection.reconcile_transforms([]) is None


def test_attribute_types(spark):
    df = spark.createDataFrame([("f", '{"a": 1, "b": -1, "c": 1.5, "d": null, "e": true}'), ("f", '{"a": -2, "b": 2.5, "c": "x"}')], "family string, json string")
    assert {r["name"]: r["type"] for r in attributes.discover(df, "family", "json").collect()} == {"a": "integer", "b": "float", "c": "string", "d": "null", "e": "boolean"}
    assert [r[1] for r in attributes.column(df, "family", "json", "a", "integer").collect()] == [-2]


def test_boundaries_flatten(spark):
    df = spark.createDataFrame([([[[0, 1, 2], [3, 4, 5]], [[6, 7, 8]]],)], "b array<array<array<int>>>")
    got = df.select(*[c.alias(n) for n, c in geometry.flattened(F.col("b"), "MultiSurface").items()]).first().asDict()
    assert got == {"vertex_indices": list(range(9)), "surface_offsets": [0, 2], "ring_offsets": [0, 3, 6]}


def test_offsets(spark):
    for offsets, total, ok in (([0, 2, 2], 5, True), ([1, 2], 5, False), ([0, 3, 2], 5, False), ([0, 6], 5, False)):
        assert one(spark, scalars.offsets_consistent(F.col("o"), F.col("n")), o=offsets, n=total) is ok


def test_violations(spark):
    o = spark.createDataFrame([(1,)], "record_id long")
    e = spark.createDataFrame([(1, 2), (1, 1)], "parent_record_id long, child_record_id long")
    g = spark.createDataFrame([(1, 1, "Solid", "9"), (2, 7, "Cube", None)], "geometry_id long, record_id long, geometry_type string, lod string")
    assert sorted(r["check"] for r in validate.violations(o, e, g).collect()) == ["child", "geometry_type", "lod", "owner", "self"]


FEATURE = {"type": "CityJSONFeature", "id": "one", "CityObjects": {"one": {"type": "Building", "attributes": {"n": 1}, "children": ["p"], "geometry": [{"type": "MultiSurface", "lod": "1.0", "boundaries": [[[0, 1, 2]]]}]}, "p": {"type": "BuildingPart", "parents": ["one"]}}, "vertices": [[0, 0, 0], [10, 0, 0], [0, 10, 0]]}
HEAD = {"type": "CityJSON", "version": "2.0", "transform": {"scale": [0.5, 0.5, 0.5], "translate": [100, 0, 0]}, "CityObjects": {}, "vertices": []}


def lines(path, *items):
    path.mkdir(exist_ok=True)
    (path / "a.jsonl").write_text("\n".join(map(json.dumps, items)) + "\n\n")
    return str(path)


def test_stream_reader(spark, tmp_path):
    models = model_json.read_stream(spark, lines(tmp_path / "s", HEAD, FEATURE))
    objs = model_json.objects(models)
    assert {r["external_id"]: r["cityobject_type"] for r in objs.collect()} == {"one": "Building", "p": "BuildingPart"}
    assert [tuple(r)[1:] for r in model_json.relationships(objs).collect()] == [("one", 0, "p")]
    g = model_json.boundary_indices(model_json.geometries(objs)).first()
    assert (g["geometry_type"], g["lod"], g["vertex_indices"]) == ("MultiSurface", "1.0", [0, 1, 2])
    assert sorted((r["x"], r["y"]) for r in model_json.vertices(models).collect()) == [(100.0, 0.0), (100.0, 5.0), (105.0, 0.0)]


def test_stream_rules(spark, tmp_path):
    with pytest.raises(PySparkException):
        model_json.read_stream(spark, lines(tmp_path / "two", HEAD, HEAD, FEATURE)).collect()
    with pytest.raises(PySparkException):
        model_json.read_stream(spark, lines(tmp_path / "twice", HEAD, FEATURE, FEATURE)).collect()
    with pytest.raises(ValueError):
        model_json.read_documents(spark, "x.city.jsonl")


@pytest.mark.parametrize(
    "items, what",
    [
        ([FEATURE], "no header"), ([FEATURE, HEAD], "not the first"), ([HEAD | {"version": "1.0"}, FEATURE], "version 2"), ([HEAD, {"type": "Other"}], "neither"), ([HEAD, "text"], "neither"),
        ([HEAD, {k: v for k, v in FEATURE.items() if k != "id"}], "without id"),
    ],
)
def test_stream_errors(spark, tmp_path, items, what):
    with pytest.raises(ValueError, match=what):
        model_json.read_stream(spark, lines(tmp_path / "s", *items))


def test_nearest_header_counts(spark, tmp_path):
    (tmp_path / "features/a/b").mkdir(parents=True)
    (tmp_path / "metadata.json").write_text(json.dumps(HEAD))
    (tmp_path / "features/a/metadata.json").write_text(json.dumps(HEAD | {"transform": {"scale": [1, 1, 1], "translate": [0, 0, 0]}}))
    (tmp_path / "features/x.jsonl").write_text(json.dumps(FEATURE))
    (tmp_path / "features/a/b/y.jsonl").write_text(json.dumps(FEATURE | {"id": "two"}))
    top = {r["model_id"]: r["x"] for r in model_json.vertices(model_json.read_feature_files(spark, str(tmp_path))).where("vertex_id = 1").collect()}
    assert top == {"one": 105.0, "two": 10.0}
    (tmp_path / "metadata.json").unlink()
    with pytest.raises(PySparkException):
        model_json.read_feature_files(spark, str(tmp_path)).collect()


def test_unknown_object_members_and_extents_survive(spark, tmp_path):
    odd = {"type": "Building", "geographicalExtent": [0, 0, 0, 1, 2, 3], "+note": {"a": ["x", 1]}, "address": "1"}
    models = model_json.read_stream(spark, lines(tmp_path / "s", HEAD, FEATURE | {"CityObjects": {"one": odd, "two": {"type": "Building"}}}))
    got = {r["external_id"]: r for r in model_json.objects(models).collect()}
    assert json.loads(got["one"]["extra"]) == {"+note": {"a": ["x", 1]}, "address": "1"} and got["one"]["geographical_extent"] == [0, 0, 0, 1, 2, 3]
    assert got["two"]["extra"] is None and got["two"]["geographical_extent"] is None


def test_document_and_feature_files(spark, tmp_path):
    (tmp_path / "d.city.json").write_text(json.dumps(HEAD | {"CityObjects": FEATURE["CityObjects"], "vertices": FEATURE["vertices"]}))
    assert model_json.objects(model_json.read_documents(spark, str(tmp_path / "d.city.json"))).count() == 2
    (tmp_path / "ff/features/x").mkdir(parents=True)
    (tmp_path / "ff/metadata.json").write_text(json.dumps(HEAD))
    (tmp_path / "ff/features/x/a.city.jsonl").write_text(json.dumps(FEATURE) + "\n")
    assert model_json.vertices(model_json.read_feature_files(spark, str(tmp_path / "ff"))).agg(F.max("x")).first()[0] == 105.0


def test_write_and_read_back(spark, tmp_path):
    models = model_json.read_stream(spark, lines(tmp_path / "s", HEAD, FEATURE))
    objs, verts = model_json.objects(models), model_json.vertices(models)
    t = model_json.auto_transform(verts)
    model_json.write_features(objs, verts, t, str(tmp_path / "out"))
    (line,) = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    got = json.loads(line)
    assert got["vertices"] == [[0, 0, 0], [5000, 0, 0], [0, 5000, 0]]
    assert got["CityObjects"]["one"]["geometry"] == FEATURE["CityObjects"]["one"]["geometry"]
    assert got["CityObjects"]["p"]["parents"] == ["one"]


def test_tables_round_trip(spark, tmp_path):
    made = generate.buildings(spark, 5)
    model_json.write_tables(made, str(tmp_path / "t"))
    back = model_json.read_tables(spark, str(tmp_path / "t"), list(made))
    assert back["vertices"].count() == 40 and back["boundaries"].count() == 5


def test_stream_ingest_rejects_known_ids(spark, tmp_path):
    source = tmp_path / "in"
    lines(source, FEATURE, FEATURE | {"id": "two"})
    run = lambda: ingest.ingest(ingest.feature_lines(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "again"), str(tmp_path / "state")).awaitTermination()
    run()
    (source / "b.jsonl").write_text(json.dumps(FEATURE) + "\n" + json.dumps(FEATURE | {"id": "three"}) + "\n")
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "three", "two"]
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "again")).collect()] == ["one"]


def test_stream_ingest_hands_out_every_rejected_line(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [f'{{"id": "a", "v": {i}}}' for i in (1, 2, 3, 3)] + ['{"id": "b"}']
    (source / "one.jsonl").write_text("\n".join(lines))
    ingest.ingest(ingest.feature_lines(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "again"), str(tmp_path / "state")).awaitTermination()
    show = lambda at: sorted(r["value"] for r in spark.read.parquet(str(tmp_path / at)).collect())
    assert show("out") == [lines[0], lines[4]]
    assert show("again") == lines[1:4]
