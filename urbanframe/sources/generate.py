"""A synthetic generator on ``spark.range``: seeded by id, so any part can be made again alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def buildings(spark: SparkSession, n: int, seed: int = 7) -> dict[str, DataFrame]:
    """objects, vertices, boundaries of ``n`` boxes on a grid, each a MultiSurface of six quads."""
    r = lambda tag: F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), "id"), F.lit(1000)) / 1000.0
    base = spark.range(n).select("id", (F.col("id") % 1000 * 20.0).alias("x0"), (F.floor(F.col("id") / 1000) * 20.0).alias("y0"), (5 + 10 * r("w")).alias("w"), (5 + 10 * r("l")).alias("l"), (3 + 30 * r("h")).alias("h"))
    objects = base.select(F.col("id").alias("package_id"), F.format_string("building-%06d", "id").alias("external_id"), F.lit("Building").alias("cityobject_type"))
    corner = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("vertex_id")
    v = base.select("*", corner)
    bit = lambda b: F.expr(f"cast(shiftright(vertex_id, {b}) & 1 as double)")
    vertices = v.select(F.col("id").alias("package_id"), "vertex_id", (F.col("x0") + F.col("w") * bit(0)).alias("x"), (F.col("y0") + F.col("l") * bit(1)).alias("y"), (F.col("h") * bit(2)).alias("z"))
    faces = [0, 2, 3, 1, 4, 5, 7, 6, 0, 1, 5, 4, 2, 6, 7, 3, 0, 4, 6, 2, 1, 3, 7, 5]
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    boundaries = base.select(F.col("id").alias("package_id"), lits(faces).alias("vertex_indices"), lits(range(0, 24, 4)).alias("ring_offsets"), lits(range(6)).alias("surface_offsets"))
    return {"objects": objects, "vertices": vertices, "boundaries": boundaries}
