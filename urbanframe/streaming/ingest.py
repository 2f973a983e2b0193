"""Streaming ingest of feature lines: ids seen before go to a side output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def feature_lines(spark: SparkSession, directory: str, files_per_batch: int = 64) -> DataFrame:
    """(id, value, file, arrived) for each feature line of files as they arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(directory).where(F.trim("value") != "")
    lines = lines.withColumn("id", F.get_json_object("value", "$.id")).where("id IS NOT NULL")
    return lines.select("id", "value", F.input_file_name().alias("file"), F.current_timestamp().alias("arrived"))


def ingest(lines: DataFrame, target: str, duplicates: str, checkpoint: str):
    """Starts a query that appends new ids to ``target`` and lines whose id is known, or repeats in the batch, to ``duplicates``.

    Each micro-batch writes under its own number, so a batch that is run again after a failure replaces what it wrote.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        try:
            known = spark.read.parquet(target).where(F.col("batch") != number).select("id").distinct()
        except Exception as error:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            known = spark.createDataFrame([], "id string")
        numbered = df.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("file", "value")))
        fresh = numbered.where("n = 1").join(known, "id", "left_anti")
        fresh.select("id", "value").write.mode("overwrite").parquet(f"{target}/batch={number}")
        again = df.join(known, "id", "left_semi").select("id", "value").unionByName(numbered.where("n > 1").join(known, "id", "left_anti").select("id", "value"))
        again.write.mode("overwrite").parquet(f"{duplicates}/batch={number}")

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
