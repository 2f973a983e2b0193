"""Canonical tables back to JSON documents: boundaries nested again, semantics, hierarchy, attributes, vertices, metadata.

Materials, textures, templates and instances are not written; a model that has any of them is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.functions.scalars import quantise, segments
from urbanframe.operators.geometry import NESTING
from urbanframe.sources.model_json import _quoted

LEFT_OUT = ("materials", "textures", "template_geometries", "geometry_instances")


def _grouped(offsets: Column, members: Column) -> Column:
    return F.transform(segments(offsets, F.size(members)), lambda s: F.slice(members, (s.start + 1).cast("int"), s.length.cast("int")))


def nested(kind: str) -> Column:
    """The nested boundaries of an offset-form row as JSON, innermost level first."""
    held = F.col("vertex_indices")
    for level in reversed(NESTING[kind]):
        held = _grouped(F.col(f"{level}_offsets"), held)
    return F.to_json(held)


def _values(kind: str) -> Column:
    """Semantic places by primitive, ``places`` in order, grouped as the levels above the surfaces are."""
    held = F.col("places")
    for level in [n for n in reversed(NESTING[kind]) if n in ("shell", "solid")]:
        held = _grouped(F.col(f"{level}_offsets"), held)
    return F.to_json(held)


def _members(*parts: tuple[str, Column]) -> Column:
    """A JSON object of (name, JSON text or null); nulls are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), value) for name, value in parts]), F.lit("}"))


def _semantics(tables: dict[str, DataFrame]) -> DataFrame:
    """(model_id, geometry_id, surfaces, places): the semantic objects as JSON, and the place of each primitive's."""
    key = ["model_id", "geometry_id"]
    rows = tables["semantics"].where("geometry_id IS NOT NULL")
    first = rows.groupBy(*key).agg(F.min("semantic_id").alias("first"))
    children = tables["semantic_children"].groupBy("model_id", F.col("parent_semantic_id").alias("semantic_id")).agg(F.array_sort(F.collect_list(F.struct("child_ordinal", "child_semantic_id"))).alias("cs"))
    each = rows.join(first, key).join(children, ["model_id", "semantic_id"], "left")
    text = _members(("type", _quoted(F.col("semantic_type"))), ("parent", (F.col("parent_semantic_id") - F.col("first")).cast("string")), ("children", F.to_json(F.transform("cs", lambda c: c.child_semantic_id - F.col("first")))))
    surfaces = each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("semantic_id", text.alias("t")))), lambda x: x.t).alias("surfaces"), F.min("first").alias("first"))
    named = [tables[f"geometry_{n}_semantics"].select(*key, F.col(f"{n}_ordinal").alias("ordinal"), "semantic_id") for n in ("surface", "point", "linestring")]
    mapped = named[0].unionByName(named[1]).unionByName(named[2]).join(first, key)
    places = mapped.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", (F.col("semantic_id") - F.col("first")).alias("place")))), lambda x: x.place).alias("places"))
    return surfaces.join(places, key, "left").select(*key, F.concat(F.lit("["), F.array_join("surfaces", ","), F.lit("]")).alias("surfaces"), "places")


def documents(tables: dict[str, DataFrame], scale: float, translate: tuple[float, float, float]) -> DataFrame:
    """(model_id, value): a whole document a model.  Vertices are rounded to ``scale``; beyond 64 bits is an error."""
    for name in LEFT_OUT:
        if name in tables and not tables[name].isEmpty():
            raise ValueError(f"{name} are not written")
    key = ["model_id", "geometry_id"]
    g = tables["geometries"].join(tables["geometry_boundaries"], key).join(_semantics(tables), key, "left")
    by_kind = lambda f: F.coalesce(*[F.when(F.col("geometry_type") == kind, f(kind)) for kind in NESTING])
    semantics = F.when(F.col("surfaces").isNotNull(), _members(("surfaces", F.col("surfaces")), ("values", by_kind(_values))))
    text = _members(("type", _quoted(F.col("geometry_type"))), ("lod", F.when(F.col("lod").isNotNull(), _quoted(F.col("lod")))), ("boundaries", by_kind(nested)), ("semantics", semantics))
    g = g.select("model_id", "cityobject_ix", F.struct("geometry_ordinal", text.alias("t")).alias("g")).groupBy("model_id", "cityobject_ix").agg(F.transform(F.array_sort(F.collect_list("g")), lambda x: x.t).alias("gs"))
    o = tables["cityobjects"]
    ids = o.select("model_id", "cityobject_ix", "cityobject_id")
    links = tables["cityobject_children"]
    child = links.join(ids.withColumnRenamed("cityobject_ix", "child_cityobject_ix"), ["model_id", "child_cityobject_ix"]).groupBy("model_id", F.col("parent_cityobject_ix").alias("cityobject_ix"))
    child = child.agg(F.transform(F.array_sort(F.collect_list(F.struct("child_ordinal", "cityobject_id"))), lambda x: x.cityobject_id).alias("children"))
    parent = links.join(ids.withColumnRenamed("cityobject_ix", "parent_cityobject_ix"), ["model_id", "parent_cityobject_ix"]).groupBy("model_id", F.col("child_cityobject_ix").alias("cityobject_ix"))
    parent = parent.agg(F.array_sort(F.collect_set("cityobject_id")).alias("parents"))
    at = ["model_id", "cityobject_ix"]
    o = o.join(g, at, "left").join(child, at, "left").join(parent, at, "left")
    body = _members(
        ("type", _quoted(F.col("object_type"))), ("geographicalExtent", F.to_json("geographical_extent")), ("parents", F.to_json("parents")), ("children", F.to_json("children")),
        ("attributes", F.col("attributes")), ("geometry", F.concat(F.lit("["), F.array_join("gs", ","), F.lit("]"))),
    )
    extra = F.regexp_extract("extra", "(?s)^\\{(.*)\\}$", 1)  # the members that no column has
    body = F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.substring(body, F.lit(1), F.char_length(body) - 1), F.lit(","), extra, F.lit("}"))).otherwise(body)
    objects = o.groupBy("model_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cityobject_ix", F.concat(_quoted(F.col("cityobject_id")), F.lit(":"), body).alias("t")))), lambda x: x.t), ",").alias("objects"))
    whole = F.struct("vertex_id", F.array(*[quantise(F.col(a), scale, translate[i]) for i, a in enumerate("xyz")]).alias("v"))
    pools = tables["vertices"].groupBy("model_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(whole)), lambda x: x.v)).alias("vertices"))
    m = tables["metadata"]
    string = lambda c: F.when(F.col(c).isNotNull(), _quoted(F.col(c)))
    meta = _members(("identifier", string("identifier")), ("title", string("title")), ("referenceSystem", string("reference_system")), ("referenceDate", string("reference_date")), ("pointOfContact", F.col("point_of_contact")), ("geographicalExtent", F.to_json("geographical_extent")))
    head = F.lit(f'{{"type":"CityJSON","version":"2.0","transform":{{"scale":{[scale] * 3},"translate":{list(translate)}}},"metadata":')
    value = F.concat(head, meta, F.lit(',"CityObjects":{'), F.coalesce("objects", F.lit("")), F.lit('},"vertices":'), F.coalesce("vertices", F.lit("[]")), F.lit("}"))
    return m.join(objects, "model_id", "left").join(pools, "model_id", "left").select("model_id", value.alias("value"))
