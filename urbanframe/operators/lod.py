"""Levels of detail and the package filter with its report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def highest(geometries: DataFrame) -> DataFrame:
    """(record_id, lod): the highest level by number, then text; of equal ones the last in geometry order.  No level, no row."""
    rank = F.struct(F.expr("try_cast(lod AS double)").alias("n"), F.when(F.expr("try_cast(lod AS double)").isNull(), F.col("lod")).alias("t"), "geometry_ordinal")
    return geometries.where("lod IS NOT NULL").groupBy("record_id").agg(F.max_by("lod", rank).alias("lod"))


def select(geometries: DataFrame, objects: DataFrame, default: str = "all", by_type: dict[str, str] | None = None) -> DataFrame:
    """Geometries kept by a rule: ``all``, ``highest`` or an exact level, by object type or by default.  Those without a level never are."""
    rule = F.lit(default)
    for kind, r in (by_type or {}).items():
        rule = F.when(F.col("cityobject_type") == kind, F.lit(r)).otherwise(rule)
    top = highest(geometries).withColumnRenamed("lod", "top")
    g = geometries.where("lod IS NOT NULL").join(objects.select("record_id", "cityobject_type"), "record_id").join(top, "record_id")
    g = g.withColumn("rule", rule)
    return g.where((F.col("rule") == "all") | ((F.col("rule") == "highest") & (F.col("lod") == F.col("top"))) | (F.col("rule") == F.col("lod"))).drop("rule", "top")


def report(geometries: DataFrame, objects: DataFrame, kept: DataFrame) -> DataFrame:
    """By object type: available and retained objects with a level, retained geometries and the levels there are."""
    g = geometries.where("lod IS NOT NULL").join(objects.select("record_id", "cityobject_type"), "record_id")
    there = g.groupBy("cityobject_type").agg(F.countDistinct("record_id").alias("available"), F.array_join(F.array_sort(F.collect_set("lod")), ",").alias("lods"))
    held = kept.groupBy("cityobject_type").agg(F.countDistinct("record_id").alias("retained"), F.count("*").alias("retained_geometries"))
    return there.join(held, "cityobject_type", "left").fillna(0, ["retained", "retained_geometries"])


def missing(geometries: DataFrame, objects: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(cityobject_type, lod) that were asked for exactly and are nowhere."""
    spark = geometries.sparkSession
    asked = spark.createDataFrame(sorted(wanted.items()) or [], "cityobject_type string, lod string")
    there = geometries.join(objects.select("record_id", "cityobject_type"), "record_id").select("cityobject_type", "lod").distinct()
    return asked.join(there, ["cityobject_type", "lod"], "left_anti")


def is_active(default: str = "all", by_type: dict[str, str] | None = None, types: list[str] | None = None) -> bool:
    """Whether a rule can leave anything out: types are named, or a level other than all is asked for."""
    return types is not None or any(r != "all" for r in [default, *(by_type or {}).values()])


def merge_reports(*reports: DataFrame) -> DataFrame:
    """One report of reports over different objects: counts are added, levels united."""
    if not reports:
        raise ValueError("nothing to merge")
    every = reduce(DataFrame.unionByName, reports)
    counts = every.groupBy("cityobject_type").agg(*[F.sum(c).alias(c) for c in ("available", "retained", "retained_geometries")])
    levels = every.select("cityobject_type", F.explode(F.split("lods", ",")).alias("lod")).groupBy("cityobject_type").agg(F.array_join(F.array_sort(F.collect_set("lod")), ",").alias("lods"))
    return counts.join(levels, "cityobject_type")
