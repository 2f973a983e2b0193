"""A rebuilt-as-a-whole index of models: tables in a folder of their own, named in a manifest when all are there."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.functions.scalars import BBox
from urbanframe.operators import bounds, graph, lookup
from urbanframe.operators.geometry import let
from urbanframe.plans.lineage import cut
from urbanframe.sources import model_json

TABLES = ("packages", "cityobjects", "relationships", "package_bbox", "sources")


def fingerprints(models: DataFrame) -> DataFrame:
    """(path, size, mtime) of each model as ``lookup.status`` compares them: its length, and a hash of its text in place of a time."""
    return models.select(F.col("model_id").alias("path"), F.length("raw").cast("long").alias("size"), F.xxhash64("raw").alias("mtime"))


def tables(models: DataFrame, all_vertices: bool = True) -> dict[str, DataFrame]:
    """packages, cityobjects, relationships, package_bbox and sources of (model_id, root) rows; keys are (model_id, external_id).

    A package's bounds are those of the vertices its boundaries use; with ``all_vertices`` (streams and feature files),
    a package without any boundary index takes all its vertices.  Without vertices it has no bounds.
    """
    objs = model_json.objects(models)
    rel = model_json.relationships(objs)
    # a model is a row, so that its vertices and its boundaries meet without a join
    shapes = F.transform(F.map_values("root.CityObjects"), lambda o: F.from_json(F.from_json(o, "geometry string").geometry, "array<struct<boundaries: string>>"))
    texts = F.transform(F.flatten(F.filter(shapes, lambda s: s.isNotNull())), lambda g: g.boundaries)
    used = F.array_distinct(F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), model_json.indices)))
    row = F.struct(F.col("root.transform").alias("transform"), F.col("root.vertices").alias("vs"), used.alias("used"))

    def mine(x: Column) -> Column:
        some = F.transform(F.filter(x.used, lambda i: (i >= 0) & (i < F.size(x.vs))), lambda i: F.get(x.vs, i))
        return F.when(F.coalesce(F.size(x.used), F.lit(0)) <= 0, x.vs).otherwise(some) if all_vertices else some

    along = lambda m, i: F.transform(m, lambda v: v[i])
    side = lambda m, f: F.struct(*[f(along(m, i)).alias(a) for i, a in enumerate(bounds.AXES)])
    corners = let(row, lambda x: F.struct(x["transform"].alias("transform"), let(mine(x), lambda m: F.when(F.size(m) > 0, F.array(side(m, F.array_min), side(m, F.array_max)))).alias("ends")))
    ends = models.select("model_id", corners.alias("c")).select("model_id", "c.transform", F.explode("c.ends").alias("v"))
    ends = ends.select("model_id", *[model_json.in_world(F.col("v")[a], i).alias(a) for i, a in enumerate(bounds.AXES)])
    box = ends.groupBy("model_id").agg(*[(F.min if c.startswith("min") else F.max)(c[-1]).alias(c) for c in bounds.COLUMNS])  # a negative scale turns the ends round
    packages = models.select("model_id", F.col("root.type").alias("package_type"), F.col("root.id").alias("root_id"), F.greatest(F.coalesce(F.size("root.CityObjects"), F.lit(0)), F.lit(0)).cast("long").alias("n_objects"))
    return {"packages": packages, "cityobjects": objs.select("model_id", "external_id", "cityobject_type"), "relationships": rel, "package_bbox": box, "sources": fingerprints(models)}


def clustered(spark: SparkSession, box: DataFrame, key: str = "model_id") -> DataFrame:
    """Bounds with their place on the Hilbert curve, in its order: files and row groups hold neighbours, so their min and max leave out most for a small window."""
    box = cut(spark, box)  # the extent and the cells both need it
    return box.join(bounds.hilbert_index(box, key).select(key, "hilbert"), key).repartitionByRange("hilbert").sortWithinPartitions("hilbert", key)


def window(index: dict[str, DataFrame], at: BBox) -> DataFrame:
    """Packages that meet the window, along the curve; the comparison reaches the scan of the stored bounds."""
    return lookup.window_query(index["package_bbox"], at).orderBy("hilbert", "model_id")


def build(spark: SparkSession, models: DataFrame, path: str) -> str:
    """Writes a new index and then its line in the manifest: until then, and if it fails, readers see the one before.

    A relationship to an object that does not exist, or a cycle of them, is an error.
    """
    version = uuid.uuid4().hex
    made = tables(models)
    for name, df in made.items():
        if name == "package_bbox":
            df = clustered(spark, df)
        df.write.option("compression", "zstd").parquet(f"{path}/versions/{version}/{name}")
    back = {name: spark.read.parquet(f"{path}/versions/{version}/{name}") for name in made}
    ids = back["cityobjects"].select("model_id", F.col("external_id").alias("child_id"))
    # first within rows: a model's children are its objects, and none of them has children; the rest is looked up and followed
    entries = F.transform(F.map_entries("root.CityObjects"), lambda e: F.struct(e.key.alias("key"), F.coalesce(F.from_json(e.value, "children array<string>").children, F.array()).alias("children")))
    named = lambda es: F.flatten(F.transform(es, lambda e: e.children))
    above = lambda es: F.transform(F.filter(es, lambda e: F.size(e.children) > 0), lambda e: e.key)
    strange = let(entries, lambda es: (F.size(F.array_except(named(es), F.transform(es, lambda e: e.key))) > 0) | F.arrays_overlap(above(es), named(es)))
    odd = models.select("model_id", strange.alias("odd")).where("odd")
    odd = cut(spark, odd.select("model_id").distinct())
    rel = back["relationships"].join(odd, "model_id", "left_semi")
    lost = rel.join(ids, ["model_id", "child_id"], "left_anti").first()
    if lost:
        raise ValueError(f"object {lost['parent_id']} of {lost['model_id']} names a missing child {lost['child_id']}")
    key = lambda c: F.xxhash64("model_id", c)
    if not graph.cyclic(spark, rel.select(key("parent_id").alias("parent_record_id"), key("child_id").alias("child_record_id"))).isEmpty():
        raise ValueError("relationships have a cycle")
    spark.createDataFrame([(version,)], "version string").withColumn("built", F.current_timestamp()).write.mode("append").parquet(f"{path}/manifest")
    return version


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    version = spark.read.parquet(f"{path}/manifest").agg(F.max_by("version", "built")).first()[0]
    return {name: spark.read.parquet(f"{path}/versions/{version}/{name}") for name in TABLES}


def state(index: dict[str, DataFrame], models: DataFrame) -> DataFrame:
    """(path, state): each model as the index knows it against the models there are now: fresh, changed, missing, unindexed."""
    return lookup.status(index["sources"], fingerprints(models))


def inspect(index: dict[str, DataFrame], models: DataFrame | None = None) -> dict:
    """Counts, and issues in words; ok where there is none.  With ``models``, those there are now: covered and fresh too."""
    packages, objs, box = index["packages"].count(), index["cityobjects"].count(), index["package_bbox"].count()
    lost = index["packages"].join(index["cityobjects"].select("model_id").distinct(), "model_id", "left_anti").count()
    issues = ([f"{lost} packages without objects"] if lost else []) + (["no packages"] if not packages else [])
    found = {"packages": packages, "cityobjects": objs, "relationships": index["relationships"].count(), "spatial": box}
    if models is not None:
        n = {r["state"]: r["count"] for r in state(index, models).groupBy("state").count().collect()}  # at most four rows
        said = {"missing": "indexed models are gone", "unindexed": "models are not in the index", "changed": "indexed models have changed"}
        issues += [f"{n[k]} {words}" for k, words in said.items() if n.get(k)]
        found["covered"] = not (n.get("missing") or n.get("unindexed"))
        found["fresh"] = found["covered"] and not n.get("changed")
    return found | {"issues": issues, "ok": not issues}
