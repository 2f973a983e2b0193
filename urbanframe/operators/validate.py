"""Checks that give a DataFrame of violations: (check, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanframe.functions.scalars import GEOMETRY_TYPES, LODS, offsets_consistent, segments
from urbanframe.operators.geometry import NESTING, rings
from urbanframe.operators.graph import dangling
from urbanframe.plans.lineage import cut


def _found(df: DataFrame, check: str, key: str, detail) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def violations(objects: DataFrame, edges: DataFrame, geometries: DataFrame) -> DataFrame:
    """Unknown levels and types, edges to nothing, geometries of nothing, objects without any parent or package."""
    owners = objects.select("record_id")
    parts = [
        _found(geometries.where(F.col("lod").isNotNull() & ~F.col("lod").isin(*LODS)), "lod", "geometry_id", F.col("lod")),
        _found(geometries.where(~F.col("geometry_type").isin(*GEOMETRY_TYPES)), "geometry_type", "geometry_id", F.col("geometry_type")),
        _found(geometries.join(owners, "record_id", "left_anti"), "owner", "geometry_id", F.col("record_id")),
        _found(dangling(objects, edges), "child", "child_record_id", F.col("parent_record_id")),
        _found(edges.where("parent_record_id = child_record_id"), "self", "parent_record_id", F.col("child_record_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def schema_differences(df: DataFrame, wanted) -> list[str]:
    """Names, types and nullability that are not as in a StructType."""
    have = {f.name: f for f in df.schema}
    out = [f"missing {f.name}" for f in wanted if f.name not in have]
    out += [f"{f.name}: {have[f.name].dataType.simpleString()} for {f.dataType.simpleString()}" for f in wanted if f.name in have and have[f.name].dataType != f.dataType]
    return out + [f"unknown {n}" for n in have if n not in wanted.names]


def strictly_increasing(spark: SparkSession, df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key is not above the one before, in order.

    Rows are dealt by ranges of ``order`` and compared within a range; the last row of each range, one a partition, is
    what the next one's first row is compared with.
    """
    ranged = cut(spark, df.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    lasts = ranged.groupBy("range").agg(F.max_by(key, order).alias("last"))
    lasts = lasts.withColumn("ahead", F.lag("last").over(Window.orderBy("range"))).select("range", "ahead")  # a row a partition
    before = F.coalesce(F.lag(key).over(Window.partitionBy("range").orderBy(order)), F.col("ahead"))
    return ranged.join(F.broadcast(lasts), "range").withColumn("before", before).where(F.col(key) <= F.col("before")).drop("range", "ahead")


def canonical_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, model_id, key, detail) of canonical tables: shapes, references and mappings that don't hold.

    A boundary has the levels of its geometry's type and no others, with offsets that start at 0, never fall and leave no
    part empty.  Vertices, templates, semantics, materials, textures and uv pairs that are named exist; a textured ring has
    a uv pair for each of its vertices; a semantic is given for all surfaces or none; default themes are themes of some
    geometry or template.
    """
    key = ["model_id", "geometry_id"]
    shapes = tables["geometries"].select(*key, "geometry_type").join(tables["geometry_boundaries"], key)

    def found(df: DataFrame, check: str, detail: str, row: str = "geometry_id") -> DataFrame:
        return df.select(F.lit(check).alias("check"), "model_id", F.col(row).cast("string").alias("key"), F.expr(detail).cast("string").alias("detail"))

    def lost(rows: DataFrame, column: str, pool: str, check: str, id_column: str | None = None, row: str = "geometry_id") -> DataFrame:
        ids = tables[pool].select("model_id", F.col(id_column or column).alias(column))
        return found(rows.where(F.col(column).isNotNull()).join(ids, ["model_id", column], "left_anti"), check, column, row)

    parts = [found(shapes.where(~sound_shapes()), "boundary", "geometry_type")]
    used = shapes.select(*key, F.explode(F.array_distinct("vertex_indices")).alias("vertex_id"))
    parts.append(lost(used, "vertex_id", "vertices", "vertex"))
    parts.append(lost(tables["geometry_instances"], "template_geometry_id", "template_geometries", "template"))
    parts.append(lost(tables["geometry_instances"].withColumnRenamed("reference_point_vertex_id", "vertex_id"), "vertex_id", "vertices", "reference point"))
    parts.append(found(tables["geometry_instances"].where("coalesce(size(transform_matrix), 0) <> 16"), "matrix", "size(transform_matrix)"))
    for name in ("geometry_surface_semantics", "geometry_point_semantics", "geometry_linestring_semantics"):
        parts.append(lost(tables[name], "semantic_id", "semantics", "semantic"))
    parts.append(lost(tables["geometry_surface_materials"], "material_id", "materials", "material"))
    textured = tables["geometry_ring_textures"]
    parts.append(lost(textured, "texture_id", "textures", "texture"))
    parts.append(lost(textured.select(*key, F.explode("uv_indices").alias("uv_id")), "uv_id", "texture_vertices", "uv"))
    given = tables["geometry_surface_semantics"].groupBy(*key).agg(F.count("*").alias("n"))
    parts.append(found(given.join(shapes, key).where("n <> size(surface_offsets)"), "semantics length", "n"))
    sizes = rings(shapes.where("size(surface_offsets) > 0"), key).select(*key, "surface_ordinal", F.col("ring_in_surface").alias("ring_ordinal"), F.size("ring").alias("n"))
    fit = textured.join(sizes, [*key, "surface_ordinal", "ring_ordinal"], "left").where("n IS NULL OR n <> size(uv_indices)")
    parts.append(found(fit, "ring texture", "concat(surface_ordinal, '/', ring_ordinal)"))
    for kind, pool in (("material", "geometry_surface_materials"), ("texture", "geometry_ring_textures")):
        column = f"default_{kind}_theme"
        there = tables[pool].select("model_id", "theme").unionByName(tables[f"template_{pool.replace('surface_', '')}"].select("model_id", "theme"))
        asked = tables["metadata"].select("model_id", F.col(column).alias("theme")).where("theme IS NOT NULL")
        parts.append(found(asked.join(there, ["model_id", "theme"], "left_anti"), f"default {kind} theme", "theme", "theme"))
    return reduce(DataFrame.unionByName, parts)


def sound_shapes() -> Column:
    """The levels that the type asks for are there and sound, and no others."""
    out = F.lit(False)
    for kind, levels in NESTING.items():
        ok = F.size("vertex_indices") > 0
        for level in ("line", "ring", "surface", "shell", "solid"):
            offsets = F.col(f"{level}_offsets")
            if level not in levels:
                ok = ok & (offsets.isNull() | (F.size(offsets) == 0))
                continue
            inner = levels[levels.index(level) + 1 :]
            total = F.size(f"{inner[0]}_offsets") if inner else F.size("vertex_indices")
            filled = F.forall(segments(offsets, total), lambda s: s.length > 0)
            ok = ok & offsets.isNotNull() & offsets_consistent(offsets, total) & filled
        out = F.when(F.col("geometry_type") == kind, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out
