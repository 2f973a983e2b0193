"""The canonical tables of a model, each with a leading model_id so that many models share one DataFrame."""

from __future__ import annotations

from pyspark.sql.types import StructType

_LISTS = "vertex_indices array<bigint>, line_offsets array<bigint>, ring_offsets array<bigint>, surface_offsets array<bigint>, shell_offsets array<bigint>, solid_offsets array<bigint>"

# Names and columns of the tables.
TABLES: dict[str, str] = {
    "metadata": "kind string, version string, feature_root_id string, identifier string, title string, reference_system string, geographical_extent array<double>, reference_date string, default_material_theme string, default_texture_theme string, point_of_contact string, extra string",
    "extensions": "extension_name string, uri string, version string",
    "vertices": "vertex_id bigint, x double, y double, z double",
    "cityobjects": "cityobject_id string, cityobject_ix bigint, object_type string, geographical_extent array<double>, attributes string, extra string",
    "cityobject_children": "parent_cityobject_ix bigint, child_ordinal int, child_cityobject_ix bigint",
    "geometries": "geometry_id bigint, cityobject_ix bigint, geometry_ordinal int, geometry_type string, lod string",
    "geometry_boundaries": f"geometry_id bigint, {_LISTS}",
    "geometry_instances": "geometry_id bigint, cityobject_ix bigint, geometry_ordinal int, lod string, template_geometry_id bigint, reference_point_vertex_id bigint, transform_matrix array<double>",
    "template_vertices": "template_vertex_id bigint, x double, y double, z double",
    "template_geometries": "template_geometry_id bigint, geometry_type string, lod string",
    "template_geometry_boundaries": f"template_geometry_id bigint, {_LISTS}",
    "semantics": "semantic_id bigint, geometry_id bigint, semantic_type string, parent_semantic_id bigint, attributes string",
    "semantic_children": "parent_semantic_id bigint, child_ordinal int, child_semantic_id bigint",
    "geometry_surface_semantics": "geometry_id bigint, surface_ordinal int, semantic_id bigint",
    "geometry_point_semantics": "geometry_id bigint, point_ordinal int, semantic_id bigint",
    "geometry_linestring_semantics": "geometry_id bigint, linestring_ordinal int, semantic_id bigint",
    "template_geometry_semantics": "template_geometry_id bigint, primitive_type string, primitive_ordinal int, semantic_id bigint",
    "materials": "material_id bigint, name string, ambient_intensity double, diffuse_color array<double>, emissive_color array<double>, specular_color array<double>, shininess double, transparency double, is_smooth boolean",
    "geometry_surface_materials": "geometry_id bigint, surface_ordinal int, theme string, material_id bigint",
    "template_geometry_materials": "template_geometry_id bigint, primitive_type string, primitive_ordinal int, theme string, material_id bigint",
    "textures": "texture_id bigint, image_uri string, image_type string, wrap_mode string, texture_type string, border_color array<double>",
    "texture_vertices": "uv_id bigint, u double, v double",
    "geometry_ring_textures": "geometry_id bigint, surface_ordinal int, ring_ordinal int, theme string, texture_id bigint, uv_indices array<bigint>",
    "template_geometry_ring_textures": "template_geometry_id bigint, surface_ordinal int, ring_ordinal int, theme string, texture_id bigint, uv_indices array<bigint>",
}
REQUIRED = ("metadata", "vertices", "cityobjects", "geometries", "geometry_boundaries")


def schema(name: str) -> StructType:
    return StructType.fromDDL("model_id string, " + TABLES[name])
