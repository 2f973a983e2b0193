"""Boundaries: nested arrays to offset form and back, ring layouts, gathers and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanframe.functions.scalars import ring_triangles, segments

#: Levels of nesting below the geometry, outermost first.
NESTING = {
    "MultiPoint": (),
    "MultiLineString": ("line",),
    "MultiSurface": ("surface", "ring"),
    "CompositeSurface": ("surface", "ring"),
    "Solid": ("shell", "surface", "ring"),
    "MultiSolid": ("solid", "shell", "surface", "ring"),
    "CompositeSolid": ("solid", "shell", "surface", "ring"),
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: in lambdas, an expression from outside is computed again for each element."""
    return F.transform(F.array(value), body)[0]


def _starts(lists: Column) -> Column:
    """Where each list starts in the flattened one: sums before each chunk of about the root of their number, then sums within the chunk."""
    summed = lambda z, start, n: F.aggregate(F.slice(z, start + 1, n), F.lit(0), lambda a, b: a + b)
    step = lambda z: F.ceil(F.sqrt(F.size(z))).cast("int")
    firsts = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / step(z)).cast("int")), lambda c: summed(z, F.lit(0), c * step(z)))
    each = lambda e: F.transform(F.sequence(F.lit(0), F.size(e.z) - 1), lambda i: e.f[F.floor(i / e.s).cast("int")] + summed(e.z, i - i % e.s, i % e.s))
    return let(F.transform(lists, lambda x: F.size(x)), lambda z: let(F.struct(z.alias("z"), firsts(z).alias("f"), step(z).alias("s")), each))


def flattened(nested: Column, kind: str) -> dict[str, Column]:
    """vertex_indices and the offsets of each level, from nested arrays."""
    out, level = {}, nested
    for name in NESTING[kind]:
        out[f"{name}_offsets"] = F.when(F.size(level) > 0, _starts(level)).otherwise(F.array().cast("array<int>"))
        level = F.flatten(level)
    # the offsets of a level say where its members start in the next one
    return {"vertex_indices": level} | out


def rings(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """One row a ring of surface boundaries: (keys, surface_ordinal, ring_ordinal, ring); ordinals run through the geometry."""
    surfaces = boundaries.select(*keys, "vertex_indices", "ring_offsets", F.posexplode(segments(F.col("surface_offsets"), F.size("ring_offsets"))).alias("surface_ordinal", "s"))
    all_rings = segments(F.col("ring_offsets"), F.size("vertex_indices"))
    each = surfaces.select(*keys, "vertex_indices", "surface_ordinal", F.col("s.start").alias("first"), F.posexplode(F.slice(all_rings, F.col("s.start") + 1, F.col("s.length"))).alias("k", "r"))
    return each.select(*keys, "surface_ordinal", (F.col("first") + F.col("k")).alias("ring_ordinal"), F.col("k").alias("ring_in_surface"), F.slice("vertex_indices", F.col("r.start") + 1, F.col("r.length")).alias("ring"))


def triangles(ring_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Fan triangles of exterior rings."""
    return ring_rows.where("ring_in_surface = 0").select(*keys, "surface_ordinal", F.posexplode(ring_triangles(F.col("ring"))).alias("triangle", "corners"))


def gathered(boundaries: DataFrame, vertices: DataFrame, keys: list[str], pool: str) -> DataFrame:
    """Coordinates in boundary order, repeats kept: an equi-join of exploded indices with the pool's vertices."""
    at = boundaries.select(*keys, pool, F.posexplode("vertex_indices").alias("position", "vertex_id"))
    return at.join(vertices.select(pool, "vertex_id", "x", "y", "z"), [pool, "vertex_id"], "left")


def missing_vertices(boundaries: DataFrame, vertices: DataFrame, keys: list[str], pool: str) -> DataFrame:
    """Indices that no vertex has."""
    at = boundaries.select(*keys, pool, F.explode(F.transform(F.array_distinct("vertex_indices"), lambda v: v.cast("long"))).alias("vertex_id"))
    return at.join(vertices.select(pool, F.col("vertex_id").cast("long").alias("vertex_id")), [pool, "vertex_id"], "left_anti")


def localised(boundaries: DataFrame, key: str) -> DataFrame:
    """(key, vertex_id, new_id): the distinct vertices each package uses, numbered in ascending order."""
    used = boundaries.select(key, F.explode("vertex_indices").alias("vertex_id")).groupBy(key).agg(F.array_sort(F.collect_set("vertex_id")).alias("ids"))
    return used.select(key, F.posexplode("ids").alias("new_id", "vertex_id"))
