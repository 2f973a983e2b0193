"""Hierarchy: closures by joined frontiers, roots, order checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from urbanframe.plans.lineage import cut, shared


def closure(spark: SparkSession, edges: DataFrame, seeds: DataFrame, both: bool = False, limit: int = 10_000) -> DataFrame:
    """(record_id, level): the seeds at level 0 and all they lead to, each at its first level.

    edges: (parent_record_id, child_record_id); both: parents are followed too.  Each round joins the frontier with the
    edges and drops what was seen; a round writes its frontier alone, and what was seen is one scan of the folder of all
    of them.  More than ``limit`` levels is an error.
    """
    e = edges.select(F.col("parent_record_id").alias("a"), F.col("child_record_id").alias("b"))
    if both:
        e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    start = seeds.select("record_id").distinct()
    path = shared(spark, "closure")
    schema = StructType([start.schema[0], StructField("level", IntegerType())])
    front, level = start, 0
    while True:
        front.write.parquet(f"{path}/level={level}")
        front = spark.read.schema(start.schema).parquet(f"{path}/level={level}")
        seen = spark.read.schema(schema).parquet(path)
        if front.isEmpty():
            return seen
        level += 1
        if level > limit:
            raise ValueError("the hierarchy is deeper than the limit")
        front = front.join(e, F.col("record_id") == F.col("a")).select(F.col("b").alias("record_id")).distinct().join(seen.select("record_id"), "record_id", "left_anti")


def descendants(spark: SparkSession, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(spark, edges, seeds).where("level > 0")


def roots(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects that no edge names as a child."""
    return objects.join(edges.select(F.col("child_record_id").alias("record_id")).distinct(), "record_id", "left_anti")


def dangling(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose child does not exist."""
    return edges.join(objects.select(F.col("record_id").alias("child_record_id")), "child_record_id", "left_anti")


def cyclic(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Nodes on, or held up by, a cycle: what is left when nodes without remaining parents are taken away again and again."""
    left = cut(spark, edges.select(F.col("parent_record_id").alias("a"), F.col("child_record_id").alias("b")).distinct())
    size = left.count()
    while size:
        left = cut(spark, left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
        now = left.count()
        if now == size:
            break
        size = now
    return left.select(F.col("a").alias("record_id")).distinct()


def prune(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends kept."""
    ids = kept.select("record_id").distinct()
    return edges.join(ids.withColumnRenamed("record_id", "parent_record_id"), "parent_record_id", "left_semi").join(ids.withColumnRenamed("record_id", "child_record_id"), "child_record_id", "left_semi")


def preorder(spark: SparkSession, edges: DataFrame, seeds: DataFrame, limit: int = 10_000) -> DataFrame:
    """(root_id, record_id, path): what each seed leads to in depth-first order, children as listed; order by path.

    A node's first visit is by the smallest of its paths of (ordinal, child) steps, so paths are relaxed round by round
    until none gets smaller.  A way round a cycle is longer than the path it starts from, so it never is smaller.
    """
    step = "array<struct<child_ordinal: bigint, child_record_id: bigint>>"
    e = edges.select("parent_record_id", F.struct(F.col("child_ordinal").cast("long").alias("child_ordinal"), F.col("child_record_id").cast("long").alias("child_record_id")).alias("step"))
    front = cut(spark, seeds.select(F.col("record_id").alias("root_id"), "record_id").distinct().withColumn("path", F.array().cast(step)))
    best = front
    for _ in range(limit):
        reached = front.join(e, F.col("record_id") == F.col("parent_record_id")).select("root_id", F.col("step.child_record_id").alias("record_id"), F.concat("path", F.array("step")).alias("path"))
        reached = reached.groupBy("root_id", "record_id").agg(F.min("path").alias("path"))
        old = best.withColumnRenamed("path", "old")
        front = cut(spark, reached.join(old, ["root_id", "record_id"], "left").where("old IS NULL OR path < old").drop("old"))
        if front.isEmpty():
            return best
        best = cut(spark, best.unionByName(front).groupBy("root_id", "record_id").agg(F.min("path").alias("path")))
    raise ValueError("the hierarchy is deeper than the limit")


def chosen_roots(selected: DataFrame, edges: DataFrame, key: str = "package_id") -> DataFrame:
    """(key, record_id): the root that stands for what is selected of each package: its own root if that is selected, else
    the first selected object in order whose parents are not.  A selection of which all have selected parents is an error.

    selected: (key, record_id, ordinal, is_root); packages of which nothing is selected have no row.
    """
    under = edges.join(selected.select(F.col("record_id").alias("parent_record_id")), "parent_record_id", "left_semi").select(F.col("child_record_id").alias("record_id")).distinct()
    held = selected.join(under.withColumn("under", F.lit(True)), "record_id", "left")
    best = held.groupBy(key).agg(F.min(F.when(F.col("is_root") | F.col("under").isNull(), F.struct(~F.col("is_root"), "ordinal", "record_id"))).alias("best"))
    lost = F.raise_error(F.concat(F.lit("no root is left of package "), F.col(key).cast("string")))
    return best.select(key, F.when(F.col("best").isNotNull(), F.col("best.record_id")).otherwise(lost).alias("record_id"))
