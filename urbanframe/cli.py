"""Commands: index, get, query, metadata, inspect, validate, over a folder of feature lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from urbanframe.functions.scalars import bbox_intersects
from urbanframe.operators import index
from urbanframe.sources import model_json


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    p = argparse.ArgumentParser(prog="urbanframe")
    p.add_argument("command", choices=("index", "get", "query", "metadata", "inspect", "validate"))
    p.add_argument("--lines", help="folder of feature lines")
    p.add_argument("--index", required=True)
    p.add_argument("--id", action="append", default=[])
    p.add_argument("--bbox", type=float, nargs=4, metavar=("MIN_X", "MIN_Y", "MAX_X", "MAX_Y"))
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    say = lambda x: print(x, file=out)
    if a.command == "index":
        say(index.build(spark, model_json.read_stream(spark, a.lines), a.index))
        return 0
    held = index.load(spark, a.index)
    if a.command in ("inspect", "validate"):
        found = index.inspect(held, model_json.read_stream(spark, a.lines) if a.lines else None)
        say(json.dumps(found))
        return int(a.command == "validate" and not found["ok"])
    if a.command == "metadata":
        for row in held["packages"].groupBy("package_type").agg(F.count("*").alias("n")).orderBy("package_type").collect():
            say(json.dumps(row.asDict()))
        return 0
    if a.command == "get":
        wanted = held["cityobjects"].where(F.col("external_id").isin(a.id)).select("model_id").distinct()
    else:
        wanted = held["package_bbox"].where(bbox_intersects(tuple(a.bbox))).select("model_id")
    raw = model_json.read_stream(spark, a.lines).join(wanted, "model_id").orderBy("model_id").select("raw")
    n = 0
    for row in raw.toLocalIterator():  # one partition at a time
        say(row["raw"])
        n += 1
    return int(a.command == "get" and not n)


if __name__ == "__main__":
    sys.exit(main())
