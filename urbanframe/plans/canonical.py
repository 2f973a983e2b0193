"""Models read from JSON as the canonical tables.

A model is a row, and model ids don't repeat.  Ids that are dense within a model (object index, geometry id) are places in
lists of that row, so nothing is numbered across rows: no sort, no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.operators.geometry import flattened, rings
from urbanframe.plans.lineage import cut
from urbanframe.plans.schema import TABLES, schema
from urbanframe.sources import model_json

_SHAPES = {"MultiPoint": 1, "MultiLineString": 2, "MultiSurface": 3, "CompositeSurface": 3, "Solid": 4, "MultiSolid": 5, "CompositeSolid": 5}
_MATERIAL = "array<struct<name: string, ambientIntensity: double, diffuseColor: array<double>, emissiveColor: array<double>, specularColor: array<double>, shininess: double, transparency: double, isSmooth: boolean>>"
_TEXTURE = "array<struct<type: string, image: string, wrapMode: string, textureType: string, borderColor: array<double>>>"
_SEMANTICS = "struct<surfaces: array<struct<type: string, parent: bigint, children: array<bigint>>>, values: string>"
_GEOMETRY = "array<struct<type: string, lod: string, boundaries: string, semantics: string, material: string, texture: string, template: bigint, transformationMatrix: array<double>>>"


#: Semantic ids are the geometry's id times this plus the place in its list; those of templates are below zero.
STRIDE = 1 << 32


def _shaped(df: DataFrame, name: str) -> DataFrame:
    """The canonical columns in order and type; those that are not there are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])


def _member(path: str) -> Column:
    top, _, rest = path.partition(".")
    return F.get_json_object(F.col("root")[top], "$." + rest) if rest else F.col("root")[top]


def _in_order() -> Column:
    """The objects of a model as (key, value) in order of their ids."""
    return F.array_sort(F.map_entries("root.CityObjects"))


def geometry_list() -> Column:
    """All geometries of a model's row as (cityobject_ix, geometry_ordinal, g), in order of object id and ordinal."""
    text = lambda e: F.from_json(e.value, "geometry string").geometry
    own = lambda e, i: F.transform(F.coalesce(F.from_json(text(e), _GEOMETRY), F.array()), lambda g, k: F.struct(i.cast("long").alias("cityobject_ix"), k.alias("geometry_ordinal"), g.alias("g")))
    return F.flatten(F.transform(_in_order(), own))


def _geometries(models: DataFrame) -> DataFrame:
    """All geometries with dense ids in order of object id and ordinal; a model is a row, so they are places in its list."""
    g = models.select("model_id", F.posexplode(geometry_list()).alias("geometry_id", "x"))
    return g.select("model_id", F.col("geometry_id").cast("long").alias("geometry_id"), "x.cityobject_ix", "x.geometry_ordinal", F.col("x.g.type").alias("geometry_type"), "x.g.*")


def objects(models: DataFrame) -> DataFrame:
    """Objects with a dense index by id within the model, a row of ``models``."""
    placed = models.select("model_id", F.posexplode(_in_order()).alias("cityobject_ix", "e"))
    return model_json.object_rows(placed.select("model_id", F.col("cityobject_ix").cast("long").alias("cityobject_ix"), F.col("e.key").alias("external_id"), F.col("e.value").alias("json")))


def boundaries(geometries: DataFrame, key: str, kinds: set[str] | None = None) -> DataFrame:
    """Offset form of all nested boundaries; each shape is parsed with its own depth.  ``kinds``: those there are, if known."""
    out = None
    for kind, depth in _SHAPES.items():
        if kinds is not None and kind not in kinds | {"MultiPoint"}:
            continue
        part = geometries.where(F.col("geometry_type") == kind).withColumn("b", F.from_json("boundaries", "array<" * depth + "bigint" + ">" * depth))
        part = part.select("model_id", key, *[c.alias(n) for n, c in flattened(F.col("b"), kind).items()])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    none = F.lit(None).cast("array<int>")
    return out.select("*", *[none.alias(f"{n}_offsets") for n in ("line", "ring", "surface", "shell", "solid") if f"{n}_offsets" not in out.columns])


_PRIMITIVE = "CASE geometry_type WHEN 'MultiPoint' THEN 'point' WHEN 'MultiLineString' THEN 'linestring' ELSE 'surface' END"


def _numbers(text: str) -> Column:
    """The numbers of nested lists in order, null where it says so."""
    return F.transform(F.regexp_extract_all(text, F.lit("null|[0-9]+"), F.lit(0)), lambda v: F.when(v != "null", v.cast("long")))


def _semantics(geometries: DataFrame, key: str, name) -> tuple[DataFrame, DataFrame]:
    """Semantic rows, and the semantic of each primitive, of geometries; ``name`` makes the id from the place in the list."""
    held = geometries.withColumn("s", F.from_json("semantics", _SEMANTICS)).where("s IS NOT NULL")
    each = held.select("model_id", key, F.posexplode("s.surfaces").alias("k", "x"))
    rows = each.select("model_id", key, name(F.col("k")).alias("semantic_id"), F.col("x.type").alias("semantic_type"), name(F.col("x.parent")).alias("parent_semantic_id"), F.transform("x.children", name).alias("child_ids"))
    mapped = held.select("model_id", key, "geometry_type", F.posexplode(_numbers("s.values")).alias("ordinal", "v")).withColumn("semantic_id", name(F.col("v")))
    return rows, mapped


def _materials(geometries: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """The material of each surface by theme: one value stands for all surfaces; surfaces without any have no row."""
    themes = geometries.select("model_id", key, F.explode(F.from_json("material", "map<string, struct<value: bigint, values: string>>")).alias("theme", "x"))
    many = themes.where("x.values IS NOT NULL").select("model_id", key, "theme", F.posexplode(_numbers("x.values")).alias("surface_ordinal", "material_id")).where("material_id IS NOT NULL")
    one = themes.where("x.values IS NULL AND x.value IS NOT NULL").join(shapes.where("size(surface_offsets) > 0").select("model_id", key, F.size("surface_offsets").alias("n")), ["model_id", key])
    one = one.select("model_id", key, "theme", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("surface_ordinal"), F.col("x.value").alias("material_id"))
    return many.unionByName(one)


def _ring_textures(geometries: DataFrame, key: str) -> DataFrame:
    """Texture and uv indices of each ring by theme, the ring numbered within its surface; rings without texture have no row."""
    held = geometries.select("model_id", key, "geometry_type", F.explode(F.from_json("texture", "map<string, struct<values: string>>")).alias("theme", "x")).withColumn("boundaries", F.col("x.values"))
    out = None
    for kind, depth in _SHAPES.items():
        if depth < 3:  # points and lines have no rings
            continue
        part = held.where(F.col("geometry_type") == kind).withColumn("b", F.from_json("boundaries", "array<" * depth + "bigint" + ">" * depth))
        part = part.select("model_id", key, "theme", *[c.alias(n) for n, c in flattened(F.col("b"), kind).items() if n in ("vertex_indices", "ring_offsets", "surface_offsets")])
        out = part if out is None else out.unionByName(part)
    r = rings(out, ["model_id", key, "theme"]).where("size(ring) > 0 AND ring[0] IS NOT NULL")
    return r.select("model_id", key, "surface_ordinal", F.col("ring_in_surface").alias("ring_ordinal"), "theme", F.col("ring")[0].alias("texture_id"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("uv_indices"))


#: Parts of the models without any of which a table has no rows; tables not named are always read.
NEEDS = {
    "extensions": ("extensions",), "materials": ("appearance",), "textures": ("appearance",), "texture_vertices": ("appearance",), "semantics": ("semantics", "geometry-templates"), "semantic_children": ("semantics", "geometry-templates"),
    "geometry_instances": ("GeometryInstance",), "geometry_surface_semantics": ("semantics",), "geometry_point_semantics": ("semantics",), "geometry_linestring_semantics": ("semantics",),
    "geometry_surface_materials": ("material",), "geometry_ring_textures": ("texture",),
} | {name: ("geometry-templates",) for name in TABLES if name.startswith("template_")}


def _used(models: DataFrame, g: DataFrame) -> tuple[set[str], set[str]]:
    """The parts that any model or geometry has, types of geometries among them, and the types alone."""
    tops, parts = ("appearance", "extensions", "geometry-templates"), ("semantics", "material", "texture")
    some = lambda c: F.coalesce(F.bool_or(c.isNotNull()), F.lit(False))
    row = models.agg(*[some(F.col("root")[t]).alias(t) for t in tops]).first()
    rows = g.groupBy("geometry_type").agg(*[some(F.col(c)).alias(c) for c in parts]).where(F.col("geometry_type").isin(*_SHAPES, "GeometryInstance")).collect()  # a row a type
    kinds = {r["geometry_type"] for r in rows}
    return {t for t in tops if row[t]} | {c for c in parts if any(r[c] for r in rows)} | kinds, kinds


def _by_kind(text: str, body) -> Column:
    """``body`` of the nested lists in a geometry's text, parsed with the depth of its type; null for those without surfaces."""
    out = F.lit(None)
    for kind, depth in _SHAPES.items():
        if depth >= 3:
            lists = F.from_json(F.col(text) if isinstance(text, str) else text, "array<" * depth + "bigint" + ">" * depth)
            for _ in range(depth - 3):
                lists = F.flatten(lists)
            out = F.when(F.col("geometry_type") == kind, body(lists)).otherwise(out)
    return out


def model_themes(models: DataFrame) -> DataFrame:
    """``views.themes`` of the tables of these models, read from the models in one pass: (model_id, kind, theme), each once.

    A theme counts that some surface (material) or ring (texture) of a geometry or a template has; the tables are not made.
    """
    templates = F.coalesce(F.from_json(_member("geometry-templates.templates"), _GEOMETRY), F.array())
    every = F.concat(F.transform(geometry_list(), lambda x: x.g), templates)
    held = F.transform(F.filter(every, lambda g: g.material.isNotNull() | g.texture.isNotNull()), lambda g: F.struct(g.type.alias("geometry_type"), g.boundaries.alias("boundaries"), g.material.alias("material"), g.texture.alias("texture")))
    g = models.select("model_id", F.explode(F.array_distinct(held)).alias("g")).select("model_id", "g.*")
    surfaces = _by_kind("boundaries", lambda s: F.size(s) > 0)
    ring = lambda r: (F.size(r) > 0) & r[0].isNotNull()
    material, texture = F.from_json("material", "map<string, struct<value: bigint, values: string>>"), F.from_json("texture", "map<string, struct<values: string>>")
    each = g.select("model_id", "geometry_type", "boundaries", F.explode(F.concat(
        F.coalesce(F.transform(F.map_entries(material), lambda e: F.struct(F.lit("material").alias("kind"), e.key.alias("theme"), e.value["value"].alias("value"), e.value["values"].alias("texts"))), F.array()),
        F.coalesce(F.transform(F.map_entries(texture), lambda e: F.struct(F.lit("texture").alias("kind"), e.key.alias("theme"), F.lit(None).cast("bigint").alias("value"), e.value["values"].alias("texts"))), F.array()),
    )).alias("x")).select("model_id", "geometry_type", "boundaries", "x.*")
    of_material = F.when(F.col("texts").isNotNull(), F.col("texts").rlike("[0-9]")).otherwise(F.col("value").isNotNull() & surfaces)
    found = F.when(F.col("kind") == "material", of_material).otherwise(_by_kind("texts", lambda s: F.exists(F.flatten(s), ring)))
    return each.where(found).select("model_id", "kind", "theme").distinct()


def canonical(models: DataFrame, once: bool = False) -> dict[str, DataFrame]:
    """The canonical tables of (model_id, root, raw) rows; those the models have nothing for are empty.

    They are lazy, and each reads and parses the models for itself.  With ``once``, for a caller that wants many of them,
    the parsed models, objects and geometries are first written to the shared folder and the tables read from there;
    tables of modules that no model uses are known to be empty then, and nothing is read for them.
    """
    held = (lambda df: cut(models.sparkSession, df)) if once else (lambda df: df)
    models = held(models.select("model_id", "root"))
    o = held(objects(models).drop("geometry"))
    g = held(_geometries(models))
    used, kinds = (_used(models, g) if once else (None, None))
    meta = models.select("model_id", F.col("root.type").alias("kind"), F.col("root.version").alias("version"), F.col("root.id").alias("feature_root_id"), F.coalesce(_member("metadata"), "root.metadata").alias("m"), _member("appearance.default-theme-material").alias("default_material_theme"), _member("appearance.default-theme-texture").alias("default_texture_theme"))
    of = lambda key: F.get_json_object("m", f"$.{key}")
    meta = meta.withColumns({"identifier": of("identifier"), "title": of("title"), "reference_system": of("referenceSystem"), "reference_date": of("referenceDate"), "point_of_contact": of("pointOfContact"), "geographical_extent": F.from_json(of("geographicalExtent"), "array<double>")})
    children = o.select("model_id", F.col("cityobject_ix").alias("parent_cityobject_ix"), F.posexplode("children").alias("child_ordinal", "child"))
    named = o.select("model_id", F.col("external_id").alias("child"), F.col("cityobject_ix").alias("child_cityobject_ix"))
    tg = models.select("model_id", F.posexplode(F.from_json(_member("geometry-templates.templates"), _GEOMETRY)).alias("template_geometry_id", "x")).select("model_id", "template_geometry_id", F.col("x.type").alias("geometry_type"), "x.lod", "x.boundaries", "x.semantics", "x.material", "x.texture")
    semantics, mapped = _semantics(g, "geometry_id", lambda k: F.col("geometry_id") * STRIDE + k)
    t_semantics, t_mapped = _semantics(tg, "template_geometry_id", lambda k: -1 - (F.col("template_geometry_id") * STRIDE + k))
    all_semantics = semantics.unionByName(t_semantics.withColumn("geometry_id", F.lit(None).cast("long")), allowMissingColumns=True)
    materials = models.select("model_id", F.posexplode(F.from_json(_member("appearance.materials"), _MATERIAL)).alias("material_id", "x")).select("model_id", "material_id", "x.name", F.col("x.ambientIntensity").alias("ambient_intensity"), F.col("x.diffuseColor").alias("diffuse_color"), F.col("x.emissiveColor").alias("emissive_color"), F.col("x.specularColor").alias("specular_color"), "x.shininess", "x.transparency", F.col("x.isSmooth").alias("is_smooth"))
    textures = models.select("model_id", F.posexplode(F.from_json(_member("appearance.textures"), _TEXTURE)).alias("texture_id", "x")).select("model_id", "texture_id", F.col("x.image").alias("image_uri"), F.col("x.type").alias("image_type"), F.col("x.wrapMode").alias("wrap_mode"), F.col("x.textureType").alias("texture_type"), F.col("x.borderColor").alias("border_color"))
    uv = models.select("model_id", F.posexplode(F.from_json(_member("appearance.vertices-texture"), "array<array<double>>")).alias("uv_id", "x")).select("model_id", "uv_id", F.col("x")[0].alias("u"), F.col("x")[1].alias("v"))
    tv = models.select("model_id", F.posexplode(F.from_json(_member("geometry-templates.vertices-templates"), "array<array<double>>")).alias("template_vertex_id", "x")).select("model_id", "template_vertex_id", *[F.col("x")[i].alias(a) for i, a in enumerate("xyz")])
    extensions = models.select("model_id", F.explode(F.from_json(_member("extensions"), "map<string, struct<url: string, version: string>>")).alias("extension_name", "x")).select("model_id", "extension_name", F.col("x.url").alias("uri"), "x.version")
    shapes, t_shapes = boundaries(g, "geometry_id", kinds), boundaries(tg, "template_geometry_id")
    instances = g.where("geometry_type = 'GeometryInstance'").select("model_id", "geometry_id", "cityobject_ix", "geometry_ordinal", "lod", F.col("template").alias("template_geometry_id"), F.from_json("boundaries", "array<bigint>")[0].alias("reference_point_vertex_id"), F.col("transformationMatrix").alias("transform_matrix"))
    found = {
        "metadata": meta, "extensions": extensions, "vertices": model_json.vertices(models), "materials": materials, "textures": textures, "texture_vertices": uv, "template_vertices": tv, "template_geometries": tg,
        "cityobjects": o.withColumnsRenamed({"external_id": "cityobject_id", "cityobject_type": "object_type"}),
        "cityobject_children": children.join(named, ["model_id", "child"]),
        "geometries": g.where("geometry_type <> 'GeometryInstance'"), "geometry_boundaries": shapes, "geometry_instances": instances, "template_geometry_boundaries": t_shapes,
        "semantics": all_semantics,
        "semantic_children": all_semantics.select("model_id", F.col("semantic_id").alias("parent_semantic_id"), F.posexplode("child_ids").alias("child_ordinal", "child_semantic_id")),
        "geometry_surface_semantics": mapped.where("geometry_type NOT IN ('MultiPoint', 'MultiLineString')").withColumnRenamed("ordinal", "surface_ordinal"),
        "geometry_point_semantics": mapped.where("geometry_type = 'MultiPoint'").withColumnRenamed("ordinal", "point_ordinal"),
        "geometry_linestring_semantics": mapped.where("geometry_type = 'MultiLineString'").withColumnRenamed("ordinal", "linestring_ordinal"),
        "template_geometry_semantics": t_mapped.withColumn("primitive_type", F.expr(_PRIMITIVE)).withColumnRenamed("ordinal", "primitive_ordinal"),
        "geometry_surface_materials": _materials(g, shapes, "geometry_id"),
        "template_geometry_materials": _materials(tg, t_shapes, "template_geometry_id").withColumnRenamed("surface_ordinal", "primitive_ordinal").withColumn("primitive_type", F.lit("surface")),
        "geometry_ring_textures": _ring_textures(g, "geometry_id"), "template_geometry_ring_textures": _ring_textures(tg, "template_geometry_id"),
    }
    empty = models.select("model_id").where("false")
    there = lambda name: used is None or name not in NEEDS or any(part in used for part in NEEDS[name])
    return {name: _shaped(found[name] if name in found and there(name) else empty, name) for name in TABLES}
