"""Lookups, memberships, paging and window queries over the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanframe.functions.scalars import BBox, bbox_intersects
from urbanframe.plans.lineage import cut


def with_bbox(objects: DataFrame, bbox: DataFrame, key: str = "package_id") -> DataFrame:
    """Left outer: what has no extent keeps null bounds."""
    return objects.join(bbox, key, "left")


def by_external_id(objects: DataFrame, ids: list[str]) -> DataFrame:
    """All occurrences of any of the ids, each id asked once."""
    return objects.where(F.col("external_id").isin(sorted(set(ids))))


def packages_of(objects: DataFrame, memberships: DataFrame, packages: DataFrame, ids: list[str]) -> DataFrame:
    """Distinct packages that hold an object of one of the ids."""
    found = by_external_id(objects, ids).select("record_id").join(memberships.select("record_id", "package_id"), "record_id")
    return packages.join(found.select("package_id").distinct(), "package_id")


def members(objects: DataFrame, memberships: DataFrame) -> DataFrame:
    return memberships.select("package_id", "record_id", F.col("ordinal").alias("member_ordinal")).join(objects.drop("package_id", "ordinal"), "record_id")


def page(df: DataFrame, key: str, after: int | None, limit: int, where: BBox | None = None) -> DataFrame:
    """Keyset page: key > after, in order, at most ``limit`` (> 0) rows; optionally within a window."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    if where is not None:
        df = df.where(bbox_intersects(where))
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def window_query(bbox: DataFrame, window: BBox) -> DataFrame:
    return bbox.where(bbox_intersects(window))


def read_in_order(packages: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested packages in request order, repeats kept; ``requests``: (position, package_id).  A missing one shows as found = false."""
    return requests.join(packages.withColumn("found", F.lit(True)), "package_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def last_package_wins(memberships: DataFrame) -> DataFrame:
    """The last package of each object: a shared child takes its bounds from there."""
    return memberships.groupBy("record_id").agg(F.max("package_id").alias("package_id"))


def first_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dense_ids(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """0 .. n-1 within each key, in order."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))


def record_ids(spark: SparkSession, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0 .. n-1 over the whole table in order: ranges are numbered apart and start after the sizes of those before (a row a partition, broadcast)."""
    held = cut(spark, df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = held.groupBy("_part").count()
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return held.withColumn("_place", place).join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_place")).alias(name), *df.columns)


def representatives(spark: SparkSession, df: DataFrame, order: list[str]) -> DataFrame:
    """The first, the middle and the last row in order (fewer where they are the same), each with its place."""
    numbered = record_ids(spark, df, order, "place")
    last = numbered.agg(F.max("place").alias("last"))
    return numbered.join(F.broadcast(last), (F.col("place") == 0) | (F.col("place") == F.floor((F.col("last") + 1) / 2)) | (F.col("place") == F.col("last"))).drop("last")


def status(indexed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(path, state): unindexed, missing, changed or fresh, from (path, size, mtime) on either side."""
    a = indexed.select("path", F.struct("size", "mtime").alias("was"))
    b = on_disk.select("path", F.struct("size", "mtime").alias("now"))
    state = F.when(F.col("was").isNull(), "unindexed").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed").otherwise("fresh")
    return a.join(b, "path", "full").select("path", state.alias("state"))
