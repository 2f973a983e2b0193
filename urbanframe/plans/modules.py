"""Documents that use every module of the model, one for each derived package, and what their canonical tables hold."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.plans.derive import city
from urbanframe.sources import model_json

_SOLID = {
    "type": "Solid", "lod": "2.2", "boundaries": [[[[0, 1, 2, 3]], [[4, 5, 6, 7], [0, 1, 2]]], [[[1, 2, 6, 5]]]],
    "semantics": {"surfaces": [{"type": "RoofSurface", "children": [1]}, {"type": "Window", "parent": 0}], "values": [[0, 1], [None]]},
    "material": {"m": {"values": [[0, 1], [None]]}}, "texture": {"m": {"values": [[[[0, 0, 1, 2, 0]], [[None], [0, 1, 2, 0]]], [[[None]]]]}},
}
_GEOMETRIES = [
    _SOLID,
    {"type": "MultiPoint", "boundaries": [3, 4], "semantics": {"surfaces": [{"type": "Door"}], "values": [0, None]}},
    {"type": "MultiLineString", "lod": "0", "boundaries": [[0, 1], [1, 2, 3]], "semantics": {"surfaces": [{"type": "TrafficArea"}], "values": [None, 0]}},
    {"type": "MultiSolid", "lod": "3", "boundaries": [[[[[0, 1, 2]]]], [[[[3, 4, 5]]]]], "material": {"n": {"value": 1}}},
    {"type": "GeometryInstance", "template": 0, "boundaries": [5], "transformationMatrix": [2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1]},
]
_TEMPLATE = {"type": "MultiSurface", "lod": "1", "boundaries": [[[0, 1, 2]]], "semantics": {"surfaces": [{"type": "WallSurface"}], "values": [0]}, "material": {"m": {"value": 0}}, "texture": {"m": {"values": [[[0, 2, 1, 0]]]}}}

#: ``@`` stands for the package's key.
DOCUMENT = {
    "type": "CityJSON", "version": "2.0", "transform": {"scale": [0.5, 0.5, 0.5], "translate": ["@", 0, 0]},
    "metadata": {"identifier": "R@", "title": "t", "referenceSystem": "EPSG:7415"}, "extensions": {"E": {"url": "u@", "version": "1.0"}},
    "appearance": {
        "materials": [{"name": "a@", "transparency": 0.5}, {"name": "b", "diffuseColor": [0.25, 0.5, 0.75], "isSmooth": True}], "textures": [{"type": "PNG", "image": "i@.png", "wrapMode": "wrap"}],
        "vertices-texture": [[0, 0], [0, 1], [1, 1]], "default-theme-material": "m",
    },
    "geometry-templates": {"templates": [_TEMPLATE], "vertices-templates": [[0, 0, 0], [1, 0, 0], [0, 1, 0]]},
    "CityObjects": {"o": {"type": "Building", "attributes": {"k": "@"}, "children": ["p"], "geometry": _GEOMETRIES}, "p": {"type": "BuildingPart", "parents": ["o"]}},
    "vertices": [[i, i * i, -i] for i in range(8)],
}

# name: (columns, lists among them, rows in SQL over {k}, the key); what the document above says, by hand.
EXPECTED: dict[str, tuple[str, str, str]] = {
    "metadata": ("identifier, title, reference_system, default_material_theme", "", "('R' || {k}, 't', 'EPSG:7415', 'm')"),
    "extensions": ("extension_name, uri, version", "", "('E', 'u' || {k}, '1.0')"),
    "vertices": ("vertex_id, x, y, z", "", ", ".join(f"({i}, {{k}} + {i * 0.5}::DOUBLE, {i * i * 0.5}::DOUBLE, {-i * 0.5}::DOUBLE)" for i in range(8))),
    "cityobjects": ("cityobject_ix, cityobject_id, object_type", "", "(0, 'o', 'Building'), (1, 'p', 'BuildingPart')"),
    "cityobject_children": ("parent_cityobject_ix, child_ordinal, child_cityobject_ix", "", "(0, 0, 1)"),
    "geometries": ("geometry_id, geometry_ordinal, geometry_type, lod", "", "(0, 0, 'Solid', '2.2'), (1, 1, 'MultiPoint', NULL), (2, 2, 'MultiLineString', '0'), (3, 3, 'MultiSolid', '3')"),
    "geometry_boundaries": (
        "geometry_id, vertex_indices, line_offsets, ring_offsets, surface_offsets, shell_offsets, solid_offsets", "vertex_indices line_offsets ring_offsets surface_offsets shell_offsets solid_offsets",
        "(0, '0,1,2,3,4,5,6,7,0,1,2,1,2,6,5', '', '0,4,8,11', '0,1,3', '0,2', ''), (1, '3,4', '', '', '', '', ''), (2, '0,1,1,2,3', '0,2', '', '', '', ''), (3, '0,1,2,3,4,5', '', '0,3', '0,1', '0,1', '0,1')",
    ),
    "geometry_instances": ("geometry_id, geometry_ordinal, template_geometry_id, reference_point_vertex_id, transform_matrix", "transform_matrix", "(4, 4, 0, 5, '2.0,0.0,0.0,0.0,0.0,2.0,0.0,0.0,0.0,0.0,2.0,0.0,0.0,0.0,0.0,1.0')"),
    "template_vertices": ("template_vertex_id, x, y, z", "", "(0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE), (1, 1::DOUBLE, 0::DOUBLE, 0::DOUBLE), (2, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE)"),
    "template_geometries": ("template_geometry_id, geometry_type, lod", "", "(0, 'MultiSurface', '1')"),
    "template_geometry_boundaries": ("template_geometry_id, vertex_indices, ring_offsets, surface_offsets", "vertex_indices ring_offsets surface_offsets", "(0, '0,1,2', '0', '0')"),
    "semantics": ("semantic_id, geometry_id, semantic_type, parent_semantic_id", "", "(0, 0, 'RoofSurface', -9), (1, 0, 'Window', 0), (4294967296, 1, 'Door', -9), (8589934592, 2, 'TrafficArea', -9), (-1, -9, 'WallSurface', -9)"),
    "semantic_children": ("parent_semantic_id, child_ordinal, child_semantic_id", "", "(0, 0, 1)"),
    "geometry_surface_semantics": ("geometry_id, surface_ordinal, semantic_id", "", "(0, 0, 0), (0, 1, 1), (0, 2, -9)"),
    "geometry_point_semantics": ("geometry_id, point_ordinal, semantic_id", "", "(1, 0, 4294967296), (1, 1, -9)"),
    "geometry_linestring_semantics": ("geometry_id, linestring_ordinal, semantic_id", "", "(2, 0, -9), (2, 1, 8589934592)"),
    "template_geometry_semantics": ("template_geometry_id, primitive_type, primitive_ordinal, semantic_id", "", "(0, 'surface', 0, -1)"),
    "materials": ("material_id, name, transparency, diffuse_color, is_smooth", "diffuse_color", "(0, 'a' || {k}, 0.5::DOUBLE, '', NULL), (1, 'b', NULL, '0.25,0.5,0.75', true)"),
    "geometry_surface_materials": ("geometry_id, surface_ordinal, theme, material_id", "", "(0, 0, 'm', 0), (0, 1, 'm', 1), (3, 0, 'n', 1), (3, 1, 'n', 1)"),
    "template_geometry_materials": ("template_geometry_id, primitive_type, primitive_ordinal, theme, material_id", "", "(0, 'surface', 0, 'm', 0)"),
    "textures": ("texture_id, image_uri, image_type, wrap_mode", "", "(0, 'i' || {k} || '.png', 'PNG', 'wrap')"),
    "texture_vertices": ("uv_id, u, v", "", "(0, 0::DOUBLE, 0::DOUBLE), (1, 0::DOUBLE, 1::DOUBLE), (2, 1::DOUBLE, 1::DOUBLE)"),
    "geometry_ring_textures": ("geometry_id, surface_ordinal, ring_ordinal, theme, texture_id, uv_indices", "uv_indices", "(0, 0, 0, 'm', 0, '0,1,2,0'), (0, 1, 1, 'm', 0, '1,2,0')"),
    "template_geometry_ring_textures": ("template_geometry_id, surface_ordinal, ring_ordinal, theme, texture_id, uv_indices", "uv_indices", "(0, 0, 0, 'm', 0, '2,1,0')"),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, root, raw): a document a package."""
    key = F.col("package_id").cast("string")
    parts = json.dumps(DOCUMENT).replace('["@", 0, 0]', "[@, 0, 0]").split("@")
    text = F.concat(F.lit(parts[0]), *[c for p in parts[1:] for c in (key, F.lit(p))])
    models = model_json.parsed_root(city(spark, sf_dir, "packages").select("package_id", text.alias("value")))
    return models.select(F.concat(F.lit("R"), key).alias("model_id"), "root", "raw")


def expected(name: str) -> str:
    """The rows of a canonical table over all documents, in SQL over packages."""
    columns, _, rows = EXPECTED[name]
    return f"SELECT concat('R', package_id) AS model_id, {columns} FROM packages, LATERAL (VALUES {rows.format(k='package_id')}) t({columns})"


def shown(name: str, table: DataFrame) -> DataFrame:
    """The same columns of the table; lists as text, a missing one as the empty text; a missing id as -9."""
    columns, lists, _ = EXPECTED[name]
    as_text = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")).alias(c)
    as_id = lambda c: F.coalesce(F.col(c), F.lit(-9)).alias(c) if c.endswith("_id") and c != "cityobject_id" else F.col(c)
    return table.select("model_id", *[as_text(c) if c in lists.split() else as_id(c) for c in columns.split(", ")])
