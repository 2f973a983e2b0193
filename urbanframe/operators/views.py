"""Views over the canonical tables of whole models: resolved geometry, themes, clean-up, replaced geometry, extents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.operators import bounds
from urbanframe.operators.validate import sound_shapes

KEY = ["model_id", "geometry_id"]
_LEVELS = ["vertex_indices", "line_offsets", "ring_offsets", "surface_offsets", "shell_offsets", "solid_offsets"]

#: The tables that hang on a geometry by its id.
DEPENDENT = ("geometry_boundaries", "geometry_surface_semantics", "geometry_point_semantics", "geometry_linestring_semantics", "geometry_surface_materials", "geometry_ring_textures")


def resolved(tables: dict[str, DataFrame]) -> DataFrame:
    """The shape of every geometry, that of an instance taken from its template.

    (model_id, geometry_id, cityobject_ix, geometry_type, lod, the boundary lists, from_template, reference_point_vertex_id,
    transform_matrix); an instance of a template that does not exist is an error.
    """
    own = tables["geometries"].join(tables["geometry_boundaries"], KEY, "left")
    own = own.select(*KEY, "cityobject_ix", "geometry_type", "lod", *_LEVELS, F.lit(False).alias("from_template"), F.lit(None).cast("long").alias("reference_point_vertex_id"), F.lit(None).cast("array<double>").alias("transform_matrix"))
    on = ["model_id", "template_geometry_id"]
    template = tables["template_geometries"].join(tables["template_geometry_boundaries"], on, "left")
    placed = tables["geometry_instances"].drop("lod").join(template, on, "left")
    lost = F.raise_error(F.concat(F.lit("no template "), F.col("template_geometry_id").cast("string"), F.lit(" in "), "model_id"))
    kind = F.when(F.col("geometry_type").isNotNull(), F.col("geometry_type")).otherwise(lost)
    return own.unionByName(placed.select(*KEY, "cityobject_ix", kind.alias("geometry_type"), "lod", *_LEVELS, F.lit(True).alias("from_template"), "reference_point_vertex_id", "transform_matrix"))


def themes(tables: dict[str, DataFrame]) -> DataFrame:
    """(model_id, kind, theme): each material and texture theme that a geometry or a template has."""
    held = [
        tables[name].select("model_id", F.lit(kind).alias("kind"), "theme")
        for kind, names in (("material", ("geometry_surface_materials", "template_geometry_materials")), ("texture", ("geometry_ring_textures", "template_geometry_ring_textures")))
        for name in names
    ]
    return reduce(DataFrame.unionByName, held).distinct()


def default_themes(tables: dict[str, DataFrame], held: DataFrame | None = None) -> DataFrame:
    """(model_id, kind, theme, known): the default themes that are set, and whether some geometry or template has them.

    ``held``: the themes there are, if they are at hand (``canonical.model_themes``); else they are read from the tables.
    """
    both = F.expr("stack(2, 'material', default_material_theme, 'texture', default_texture_theme) AS (kind, theme)")
    asked = tables["metadata"].select("model_id", both).where("theme IS NOT NULL")
    return asked.join((themes(tables) if held is None else held).withColumn("known", F.lit(True)), ["model_id", "kind", "theme"], "left").select("model_id", "kind", "theme", F.coalesce("known", F.lit(False)).alias("known"))


def cleaned(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without geometries, instances and semantics that no object leads to, and without relations to objects
    that are not there.  Vertices, materials, textures and templates stay as they are, used or not.
    """
    out = dict(tables)
    ids = tables["cityobjects"].select("model_id", "cityobject_ix").distinct()
    for name in ("geometries", "geometry_instances"):
        out[name] = tables[name].join(ids, ["model_id", "cityobject_ix"], "left_semi")
    for end in ("parent", "child"):
        out["cityobject_children"] = out["cityobject_children"].join(ids.withColumnRenamed("cityobject_ix", f"{end}_cityobject_ix"), ["model_id", f"{end}_cityobject_ix"], "left_semi")
    held = out["geometries"].select(*KEY)
    for name in DEPENDENT:
        out[name] = tables[name].join(held, KEY, "left_semi")
    own = tables["semantics"].where("geometry_id IS NOT NULL").join(held, KEY, "left_semi")
    out["semantics"] = own.select(*tables["semantics"].columns).unionByName(tables["semantics"].where("geometry_id IS NULL"))
    names = out["semantics"].select("model_id", F.col("semantic_id").alias("parent_semantic_id"))
    out["semantic_children"] = tables["semantic_children"].join(names, ["model_id", "parent_semantic_id"], "left_semi")
    return {name: df.select(*tables[name].columns) for name, df in out.items()}


def replaced(tables: dict[str, DataFrame], new: DataFrame) -> dict[str, DataFrame]:
    """The tables with the shapes of ``new`` in place of those of the same (model_id, geometry_id); ids stay.

    new: the columns of geometry_boundaries, geometry_type and lod.  A geometry that is not there, one given twice, and a
    shape that is not sound for its type or names a missing vertex is an error.  What hung on the old shape (semantics,
    materials, textures) goes with it.
    """
    named = lambda what: F.raise_error(F.concat(F.lit(what + " "), F.col("geometry_id").cast("string"), F.lit(" in "), "model_id"))
    used = new.select(*KEY, F.explode(F.array_distinct("vertex_indices")).alias("vertex_id"))
    lost = used.join(tables["vertices"].select("model_id", "vertex_id"), ["model_id", "vertex_id"], "left_anti").select(*KEY).distinct().withColumn("lost", F.lit(True))
    there = tables["geometries"].select(*KEY, "cityobject_ix", "geometry_ordinal", F.lit(True).alias("there"))
    times = new.groupBy(*KEY).agg(F.count("*").alias("times"))
    checked = new.join(times, KEY).join(there, KEY, "left").join(lost, KEY, "left")
    fault = F.when(F.col("there").isNull(), named("no geometry")).when(F.col("times") > 1, named("given twice:")).when(~sound_shapes(), named("unsound shape of")).when(F.col("lost"), named("missing vertex of"))
    checked = checked.withColumn("geometry_type", F.coalesce(fault, F.col("geometry_type")))
    out, given = dict(tables), new.select(*KEY).distinct()
    for name in ("geometries", *DEPENDENT):
        out[name] = tables[name].join(given, KEY, "left_anti").select(*tables[name].columns)
    out["geometries"] = out["geometries"].unionByName(checked.select(*out["geometries"].columns))
    # the type is asked for here too, so that a fault shows in whichever table is read
    shapes = checked.where("geometry_type IS NOT NULL")
    out["geometry_boundaries"] = out["geometry_boundaries"].unionByName(shapes.select(*out["geometry_boundaries"].columns))
    gone = tables["semantics"].join(given, KEY, "left_semi").select("model_id", "semantic_id")
    out["semantics"] = tables["semantics"].join(gone, ["model_id", "semantic_id"], "left_anti").select(*tables["semantics"].columns)
    parents = gone.withColumnRenamed("semantic_id", "parent_semantic_id")
    out["semantic_children"] = tables["semantic_children"].join(parents, ["model_id", "parent_semantic_id"], "left_anti").select(*tables["semantic_children"].columns)
    return out


def extents(tables: dict[str, DataFrame]) -> DataFrame:
    """(model_id, bounds): over all vertices of a model and the extents its objects state; a model with neither has no row."""
    stated = tables["cityobjects"].where("size(geographical_extent) = 6").select("model_id", F.col("geographical_extent").alias("e"))
    ends = F.explode(F.array(*[F.struct(*[F.col("e")[i + 3 * end].alias(a) for i, a in enumerate(bounds.AXES)]) for end in (0, 1)])).alias("p")
    points = tables["vertices"].select("model_id", *bounds.AXES).unionByName(stated.select("model_id", ends).select("model_id", "p.*"))
    return points.groupBy("model_id").agg(*[(F.min if c.startswith("min") else F.max)(c[-1]).alias(c) for c in bounds.COLUMNS])


def model_names(tables: dict[str, DataFrame], default: str = "citymodel") -> DataFrame:
    """(model_id, name): the identifier that the metadata give, ``default`` where it is missing or empty."""
    return tables["metadata"].select("model_id", F.coalesce(F.nullif("identifier", F.lit("")), F.lit(default)).alias("name"))
