"""Extents, summaries and the Hilbert-ordered spatial index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanframe.functions.scalars import bbox_measures, dequantise, grid_cell, hilbert

AXES = ("x", "y", "z")
COLUMNS = [f"{m}_{a}" for a in AXES for m in ("min", "max")]


def world(vertices: DataFrame, scale, translate) -> DataFrame:
    return vertices.withColumns({a: dequantise(F.col(f"i{a}"), s, t) for a, s, t in zip(AXES, scale, translate)})


def package_bounds(vertices: DataFrame, scale, translate, key: str = "package_id") -> DataFrame:
    """Bounds by key; a coordinate that is not finite is an error.  Integers are aggregated, so one pass combines map-side."""
    aggs = [f(F.col(f"i{a}")).alias(f"{m}_{a}") for a in AXES for m, f in (("min", F.min), ("max", F.max))]
    out = vertices.groupBy(key).agg(*aggs)
    step = {a: (s, t) for a, s, t in zip(AXES, scale, translate)}
    return out.withColumns({c: dequantise(F.col(c), *step[c[-1]]) for c in COLUMNS})


def union(bbox: DataFrame, *keys: str) -> DataFrame:
    """The union of boxes, by key or of all; no row of boxes gives null bounds and has_bounds false."""
    aggs = [(F.min if c.startswith("min") else F.max)(c).alias(c) for c in COLUMNS]
    out = bbox.groupBy(*keys).agg(*aggs, F.count("*").alias("n")) if keys else bbox.agg(*aggs, F.count("*").alias("n"))
    return out.withColumn("has_bounds", F.col("min_x").isNotNull())


def hilbert_index(bbox: DataFrame, key: str = "package_id") -> DataFrame:
    """(key, hilbert): the curve place of each box's centre on a grid over the whole extent (one broadcast row)."""
    extent = bbox.agg(F.min("min_x").alias("x0"), F.max("max_x").alias("x1"), F.min("min_y").alias("y0"), F.max("max_y").alias("y1"))
    m = bbox_measures()
    cells = bbox.crossJoin(F.broadcast(extent)).select(key, grid_cell(m["centre_x"], F.col("x0"), F.col("x1")).alias("gx"), grid_cell(m["centre_y"], F.col("y0"), F.col("y1")).alias("gy"))
    return cells.select(key, "gx", "gy", hilbert(F.col("gx"), F.col("gy")).alias("hilbert"))


def summary(objects: DataFrame, relationships: DataFrame, geometries: DataFrame) -> DataFrame:
    """Counts of a model in one row."""
    o = objects.agg(F.count("*").alias("n_objects"), F.countDistinct("cityobject_type").alias("n_types"), F.sum(F.col("is_root").cast("long")).alias("n_roots"))
    r = relationships.agg(F.count("*").alias("n_relationships"))
    g = geometries.agg(F.count("*").alias("n_geometries"), F.count("lod").alias("n_with_lod"), F.sum((F.col("geometry_type") == "Solid").cast("long")).alias("n_solids"))
    return o.crossJoin(r).crossJoin(g)  # one row each


def instance_extents(tables: dict[str, DataFrame]) -> DataFrame:
    """(model_id, geometry_id, bounds) of instances: the template's vertices under the matrix, moved to the reference point."""
    corners = tables["template_geometry_boundaries"].select("model_id", "template_geometry_id", F.explode(F.array_distinct("vertex_indices")).alias("template_vertex_id"))
    corners = corners.join(tables["template_vertices"], ["model_id", "template_vertex_id"])
    at = tables["vertices"].select("model_id", F.col("vertex_id").alias("reference_point_vertex_id"), *[F.col(a).alias(f"at_{a}") for a in AXES])
    placed = tables["geometry_instances"].join(at, ["model_id", "reference_point_vertex_id"]).join(corners, ["model_id", "template_geometry_id"])
    m = F.col("transform_matrix")
    moved = [m[4 * i] * F.col("x") + m[4 * i + 1] * F.col("y") + m[4 * i + 2] * F.col("z") + m[4 * i + 3] + F.col(f"at_{a}") for i, a in enumerate(AXES)]
    placed = placed.select("model_id", "geometry_id", *[c.alias(f"w{a}") for c, a in zip(moved, AXES)])
    return placed.groupBy("model_id", "geometry_id").agg(*[(F.min if c.startswith("min") else F.max)(f"w{c[-1]}").alias(c) for c in COLUMNS])


def mean_coordinates(gathered: DataFrame, *keys: str) -> DataFrame:
    """The mean of the coordinates in boundary order, repeats counted."""
    return gathered.groupBy(*keys).agg(*[F.avg(a).alias(a) for a in AXES], F.count("*").alias("n"))
