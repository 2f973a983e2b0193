"""Merging whole models: the canonical tables of many models become those of the models they go into.

Pools (vertices, templates, materials, textures, semantics, geometries) are appended: each id moves by the sum of the
pool sizes of the models before it, so no table is sorted or numbered as a whole.  Objects of one id become one object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanframe.functions import scalars
from urbanframe.plans.canonical import STRIDE
from urbanframe.plans.lineage import cut
from urbanframe.plans.schema import TABLES, schema
from urbanframe.sources.model_json import _quoted

#: The tables whose ids make up a pool.
POOLS = {
    "vertex": (("vertices", "vertex_id"),), "geometry": (("geometries", "geometry_id"), ("geometry_instances", "geometry_id")),
    "template_vertex": (("template_vertices", "template_vertex_id"),), "template_geometry": (("template_geometries", "template_geometry_id"),),
    "material": (("materials", "material_id"),), "texture": (("textures", "texture_id"),), "uv": (("texture_vertices", "uv_id"),),
}
_IDS = {f"{pool}_id": pool for pool in POOLS} | {"reference_point_vertex_id": "vertex"}
_LISTS = {"geometry_boundaries": ("vertex_indices", "vertex"), "template_geometry_boundaries": ("vertex_indices", "template_vertex"), "geometry_ring_textures": ("uv_indices", "uv"), "template_geometry_ring_textures": ("uv_indices", "uv")}
_SEMANTIC = ("semantic_id", "parent_semantic_id", "child_semantic_id")
_OBJECT_TABLES = ("metadata", "extensions", "cityobjects", "cityobject_children")
_FIRST = ("kind", "version", "feature_root_id", "identifier", "title", "reference_system", "reference_date", "default_material_theme", "default_texture_theme", "point_of_contact")


def _bases(tables: dict[str, DataFrame], members: DataFrame) -> DataFrame:
    """(model_id, into, place, a column a pool): where each model's ids start in the model it goes into."""
    sizes = None
    for pool, parts in POOLS.items():
        for name, key in parts:
            part = tables[name].groupBy("model_id").agg((F.max(key) + 1).alias("n")).withColumn("pool", F.lit(pool))
            sizes = part if sizes is None else sizes.unionByName(part)
    wide = members.join(sizes.groupBy("model_id").pivot("pool", list(POOLS)).agg(F.max("n")), "model_id", "left").fillna(0)
    before = Window.partitionBy("into").orderBy("place", "model_id").rowsBetween(Window.unboundedPreceding, -1)
    return wide.select("model_id", "into", "place", *[F.coalesce(F.sum(pool).over(before), F.lit(0)).alias(pool) for pool in POOLS])


def _semantic(c: str) -> Column:
    """Ids are made from the geometry's; below zero, from the template's."""
    return F.when(F.col(c) >= 0, F.col(c) + F.col("geometry") * STRIDE).otherwise(F.col(c) - F.col("template_geometry") * STRIDE)


def _moved(name: str, df: DataFrame, bases: DataFrame) -> DataFrame:
    """The rows of a table with the ids of their pools moved; model_id stays that of the source."""
    out, (listed, pool) = {}, _LISTS.get(name, (None, None))
    for c in df.columns:
        if c in _SEMANTIC:
            out[c] = _semantic(c)
        elif c in _IDS:
            out[c] = F.col(c) + F.col(_IDS[c])
        elif c == listed:
            out[c] = scalars.shifted(F.col(c), F.col(pool))
    return df.join(bases, "model_id").withColumns(out) if out else df.join(bases, "model_id")


def _merged_json(df: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """(keys, text): JSON objects merged member by member, the last in order wins; members by name."""
    each = df.select(*keys, F.struct(*order).alias("at"), F.explode(F.from_json(text, "map<string, variant>")).alias("k", "v"))
    each = each.select(*keys, "at", "k", F.coalesce(F.to_json("v"), F.lit("null")).alias("v")).groupBy(*keys, "k").agg(F.max_by("v", "at").alias("v"))
    members = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: F.concat(_quoted(e.k), F.lit(":"), e.v))
    return each.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias(text))


def _extent(c: str) -> Column:
    """The union of boxes, null without any."""
    parts = [(F.min if i < 3 else F.max)(F.col(c)[i]) for i in range(6)]
    return F.when(F.count(c) > 0, F.array(*parts))


def _objects(tables: dict[str, DataFrame], members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One object an id and target; and the place (model_id, cityobject_ix) -> (into, new_ix, ordinal_base) of each source object.

    Objects are numbered by first occurrence: within the model that has it first, after those of the models before.
    """
    spark = members.sparkSession
    o = tables["cityobjects"].join(members, "model_id")
    key = ["into", "cityobject_id"]
    at = F.struct("place", "model_id", "cityobject_ix")
    kind = F.when(F.min("object_type").eqNullSafe(F.max("object_type")), F.min("object_type")).otherwise(F.raise_error(F.concat(F.lit("types differ for "), F.first("cityobject_id"))))
    one = cut(spark, o.groupBy(*key).agg(F.min(at).alias("at"), kind.alias("object_type"), _extent("geographical_extent").alias("geographical_extent"), F.count("*").alias("n")))
    rank = (F.row_number().over(Window.partitionBy("at.model_id").orderBy("at.cityobject_ix")) - 1).cast("long")
    first = one.groupBy("into", "at.place", "at.model_id").agg(F.count("*").alias("held"))
    before = Window.partitionBy("into").orderBy("place", "model_id").rowsBetween(Window.unboundedPreceding, -1)
    start = first.select("model_id", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    placed = one.withColumn("rank", rank).withColumn("model_id", F.col("at.model_id")).join(start, "model_id").withColumn("new_ix", F.col("start") + F.col("rank"))
    placed = cut(spark, placed.select(*key, "new_ix", "object_type", "geographical_extent", "n"))

    shapes = tables["geometries"].select("model_id", "cityobject_ix", "geometry_ordinal").unionByName(tables["geometry_instances"].select("model_id", "cityobject_ix", "geometry_ordinal"))
    counts = shapes.groupBy("model_id", "cityobject_ix").agg((F.max("geometry_ordinal") + 1).alias("g"))
    mine = o.select("model_id", "cityobject_ix", "place", *key).join(placed.select(*key, "new_ix"), key).join(counts, ["model_id", "cityobject_ix"], "left")
    earlier = Window.partitionBy("into", "new_ix").orderBy("place", "model_id").rowsBetween(Window.unboundedPreceding, -1)
    moved = cut(spark, mine.select("model_id", "cityobject_ix", "into", "place", "new_ix", F.coalesce(F.sum("g").over(earlier), F.lit(0)).cast("int").alias("ordinal_base")))

    several = o.join(placed.where("n > 1").select(*key), key)
    order = ["place", "model_id", "cityobject_ix"]
    alone = o.join(placed.where("n = 1").select(*key), key).select(*key, "attributes", "extra")
    texts = several.select(*key).distinct().join(_merged_json(several, key, "attributes", order), key, "left").join(_merged_json(several, key, "extra", order), key, "left")
    whole = placed.join(alone.unionByName(texts), key).withColumnRenamed("new_ix", "cityobject_ix")
    return whole, moved


def _metadata(tables: dict[str, DataFrame], members: DataFrame) -> DataFrame:
    """The first value of each member in order, the union of extents, other members last wins.  A document after a feature is an error."""
    m = tables["metadata"].join(members, "model_id")
    at = F.struct("place", "model_id")
    firsts = {c: F.min_by(c, F.when(F.col(c).isNotNull(), at)) for c in _FIRST}
    mixed = (firsts["kind"] == "CityJSONFeature") & (F.count_if(F.col("kind") == "CityJSON") > 0)
    firsts["kind"] = F.when(~mixed, firsts["kind"]).otherwise(F.raise_error(F.concat(F.lit("a document cannot go into a feature: "), F.first("into"))))
    out = m.groupBy("into").agg(*[c.alias(n) for n, c in firsts.items()], _extent("geographical_extent").alias("geographical_extent"))
    return out.join(_merged_json(m, ["into"], "extra", ["place", "model_id"]), "into", "left")


def _extensions(tables: dict[str, DataFrame], members: DataFrame, strict: bool) -> DataFrame:
    e = tables["extensions"].join(members, "model_id")
    value = F.struct("uri", "version")
    out = e.groupBy("into", "extension_name").agg(F.max_by(value, F.struct("place", "model_id")).alias("v"), F.countDistinct(value).alias("n"))
    v = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("extension declared twice: "), "extension_name"))).otherwise(F.col("v")) if strict else F.col("v")
    return out.withColumn("v", v).select("into", "extension_name", "v.uri", "v.version")


def merge(tables: dict[str, DataFrame], members: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """The canonical tables of the models that ``members`` (model_id, into, place) makes of those in ``tables``.

    Models go into a target by place, then id; one without a target is left out.  Nothing to merge, and a model named
    twice, are a ValueError.  Objects of one id must agree in type; attributes merge member by member (the last wins),
    extents are united, geometries and children follow each other, a child named twice stays once.  With ``strict`` an
    id in two models, and an extension declared in two ways, are errors.  Vertices are appended without comparing them;
    they are world coordinates, so models of different transforms need nothing more.
    """
    spark = members.sparkSession
    members = cut(spark, members.select("model_id", "into", F.col("place").cast("long").alias("place")))
    if members.isEmpty():
        raise ValueError("nothing to merge")
    if twice := members.groupBy("model_id").count().where("count > 1").first():
        raise ValueError(f"{twice['model_id']} is named twice")
    objects, moved = _objects(tables, members)
    if strict and (clash := objects.where("n > 1").first()):
        raise ValueError(f"duplicate id {clash['cityobject_id']}")
    bases = cut(spark, _bases(tables, members))
    found = {"cityobjects": objects, "metadata": _metadata(tables, members), "extensions": _extensions(tables, members, strict)}
    end = lambda side: moved.select("model_id", F.col("cityobject_ix").alias(f"{side}_cityobject_ix"), F.col("new_ix").alias(f"{side}_new"))
    links = tables["cityobject_children"].join(members, "model_id").join(end("parent"), ["model_id", "parent_cityobject_ix"]).join(end("child"), ["model_id", "child_cityobject_ix"])
    links = links.groupBy("into", F.col("parent_new").alias("parent_cityobject_ix"), F.col("child_new").alias("child_cityobject_ix")).agg(F.min(F.struct("place", "model_id", "child_ordinal")).alias("at"))
    found["cityobject_children"] = links.withColumn("child_ordinal", F.row_number().over(Window.partitionBy("into", "parent_cityobject_ix").orderBy("at")) - 1)
    for name in TABLES:
        if name in _OBJECT_TABLES:
            continue
        df = _moved(name, tables[name], bases)
        if name in ("geometries", "geometry_instances"):
            df = df.join(moved.select("model_id", "cityobject_ix", "new_ix", "ordinal_base"), ["model_id", "cityobject_ix"])
            df = df.withColumns({"cityobject_ix": F.col("new_ix"), "geometry_ordinal": F.col("geometry_ordinal") + F.col("ordinal_base")})
        found[name] = df
    return {name: found[name].select(*[F.col("into" if f.name == "model_id" else f.name).cast(f.dataType).alias(f.name) for f in schema(name)]) for name in TABLES}
