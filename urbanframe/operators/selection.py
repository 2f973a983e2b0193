"""Selections (whole objects or some of their geometries), their algebra, and subset / extract / merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.operators.graph import closure, prune


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Selections are (record_id, whole, geometries array<bigint>): whole wins, else the ordinals of both."""
    both = a.unionByName(b).groupBy("record_id").agg(F.bool_or("whole").alias("whole"), F.flatten(F.collect_list("geometries")).alias("g"))
    return both.select("record_id", "whole", F.when(F.col("whole"), F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct("g"))).alias("geometries"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whole with partial is the partial; two partials share ordinals, and without any the object goes."""
    j = a.join(b.select("record_id", F.col("whole").alias("w2"), F.col("geometries").alias("g2")), "record_id")
    g = F.when(F.col("whole"), F.col("g2")).when(F.col("w2"), F.col("geometries")).otherwise(F.array_intersect("geometries", "g2"))
    out = j.select("record_id", (F.col("whole") & F.col("w2")).alias("whole"), F.array_sort(g).alias("geometries"))
    return out.where(F.col("whole") | (F.size("geometries") > 0))


def complement(objects: DataFrame, a: DataFrame) -> DataFrame:
    """All objects that are not selected, whole; of those selected in part nothing is taken."""
    return objects.select("record_id").distinct().join(a.select("record_id"), "record_id", "left_anti").select("record_id", F.lit(True).alias("whole"), F.array().cast("array<bigint>").alias("geometries"))


def with_relatives(spark: SparkSession, selected: DataFrame, edges: DataFrame) -> DataFrame:
    """All that parents and children lead to, added whole; what was partial stays partial."""
    more = closure(spark, edges, selected, both=True).where("level > 0").select("record_id", F.lit(True).alias("whole"), F.array().cast("array<bigint>").alias("geometries"))
    return selected.unionByName(more)


def subset(spark: SparkSession, objects: DataFrame, edges: DataFrame, ids: list[str], exclude: bool = False) -> tuple[DataFrame, DataFrame]:
    """Objects of the ids and their descendants (or all others), and the edges among them.  No id, or none found, is an error."""
    seeds = objects.where(F.col("external_id").isin(sorted(set(ids)))).select("record_id")
    if not ids or seeds.isEmpty():
        raise ValueError("no object has one of the ids")
    held = closure(spark, edges, seeds).select("record_id")
    kept = objects.join(held, "record_id", "left_anti" if exclude else "left_semi")
    return kept, prune(edges, kept)


def exact(objects: DataFrame, geometries: DataFrame, edges: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Just the objects of the ids, without descendants, their geometries and the edges among them.  None found is an error."""
    kept = objects.where(F.col("external_id").isin(sorted(set(ids))))
    if kept.isEmpty():
        raise ValueError("no object has one of the ids")
    return kept, geometries.join(kept.select("record_id"), "record_id", "left_semi"), prune(edges, kept)


def extract(objects: DataFrame, geometries: DataFrame, edges: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selected objects, the geometries selected of them, and the edges among them; a partial object without any geometry goes."""
    g = geometries.join(selected, "record_id").where(F.col("whole") | F.array_contains("geometries", F.col("geometry_ordinal")))
    g = g.select(*geometries.columns)
    partial = selected.where("not whole").join(g.select("record_id").distinct(), "record_id", "left_semi").select("record_id")
    kept = objects.join(selected.where("whole").select("record_id").unionByName(partial), "record_id", "left_semi")
    return kept, g, prune(edges, kept)


def merge_objects(*models: DataFrame) -> DataFrame:
    """One object per external id of (external_id, cityobject_type, attributes map): attributes last-wins by key; types must agree."""
    if not models:
        raise ValueError("nothing to merge")
    every = None
    for i, m in enumerate(models):
        m = m.select("external_id", "cityobject_type", "attributes", F.lit(i).alias("model"))
        every = m if every is None else every.unionByName(m)
    flat = every.select("external_id", "model", F.explode_outer("attributes").alias("k", "v"))
    attrs = flat.where("k IS NOT NULL").groupBy("external_id", "k").agg(F.max_by("v", "model").alias("v")).groupBy("external_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    kinds = every.groupBy("external_id").agg(F.min("cityobject_type").alias("cityobject_type"), F.max("cityobject_type").alias("other"))
    ok = F.when(F.col("other") == F.col("cityobject_type"), F.col("cityobject_type")).otherwise(F.raise_error(F.concat(F.lit("types differ for "), F.col("external_id"))))
    return kinds.select("external_id", ok.alias("cityobject_type")).join(attrs, "external_id", "left")


def append_strict(a: DataFrame, b: DataFrame) -> DataFrame:
    """Objects of both; an id in both is an error."""
    twice = a.join(b.select("external_id"), "external_id", "left_semi")
    if not twice.isEmpty():
        raise ValueError(f"duplicate id {twice.first()['external_id']}")
    return a.unionByName(b)


def reconcile_transforms(transforms: list[tuple | None]) -> tuple | None:
    """Equal ones are kept, a missing one does not matter, different ones give none."""
    held = [t for t in transforms if t is not None]
    return held[0] if held and all(t == held[0] for t in held) else None
