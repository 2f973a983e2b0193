"""Datasets: the canonical tables as Parquet, under a manifest that names them in order with their columns and rows.

The manifest is written last, so that a dataset without one is not there yet.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from urbanframe.operators.validate import schema_differences
from urbanframe.plans.schema import REQUIRED, TABLES, schema

FORMAT = 1


def write_dataset(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict:
    """Writes each table once and gives the manifest; rows are counted from the files' footers."""
    _whole(list(tables))
    entries = []
    for name in (n for n in TABLES if n in tables):
        part = f"tables/{name}.parquet"
        tables[name].write.option("compression", "zstd").parquet(f"{path}/{part}")
        back = spark.read.schema(schema(name)).parquet(f"{path}/{part}")
        entries.append({"name": name, "path": part, "rows": back.count(), "columns": schema(name).simpleString()})
    manifest = {"format": FORMAT, "tables": entries}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest.json")
    return manifest


def _whole(names: list[str]) -> None:
    unknown, lost = [n for n in names if n not in TABLES], [n for n in REQUIRED if n not in names]
    if unknown or lost or len(set(names)) < len(names):
        raise ValueError(f"unknown tables {unknown}, missing tables {lost}" if unknown or lost else "a table is named twice")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest alone; no table is opened."""
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables, after checks of the manifest's order, paths, columns and rows; anything amiss is a ValueError."""
    manifest = read_manifest(spark, path)
    if manifest.get("format") != FORMAT:
        raise ValueError(f"unknown format {manifest.get('format')}")
    names = [e["name"] for e in manifest["tables"]]
    _whole(names)
    if names != [n for n in TABLES if n in names]:
        raise ValueError("tables are out of order")
    out = {}
    for entry in manifest["tables"]:
        name, part = entry["name"], entry["path"]
        if part.startswith("/") or ":" in part or ".." in part.split("/"):
            raise ValueError(f"path of {name} leaves the dataset: {part}")
        df = spark.read.parquet(f"{path}/{part}")
        if wrong := schema_differences(df, schema(name)):
            raise ValueError(f"{name}: {', '.join(wrong)}")
        if (rows := df.count()) != entry["rows"]:
            raise ValueError(f"{name} has {rows} rows and not {entry['rows']}")
        out[name] = df
    return out
