"""The corpus pipeline: five stages over documents, each written and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but the last return
the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.llm import decontaminate, ngram_join, packing, quality_bt, suffix_dedup
from urbanframe.llm.queries import tokenizer_path
from urbanframe.llm.util import shared_dir, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL: the classifier is learned and packing has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, whole rows.

    A null or empty text is judged as an empty one; rows that repeat are judged each, and alike; nulls in other columns stay;
    without labels of both kinds, or of an empty table, all rows stay.
    """
    return quality_bt.accepted(spark, docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest id, null last; of rows that share it, the first as written.

    Rows are compared under a key of their own, so that repeated ids and rows without one are texts like others.
    """
    rows = written(spark, docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "rows")
    found = ngram_join.jaccard_components(spark, rows.select(F.col("row").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("first.row")
    copies = found.select("row").join(first, "row", "left_anti")
    return rows.join(copies, "row", "left_anti").select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated strings; a character that is cut through goes, and so does a document with nothing left."""
    found = suffix_dedup.remove_repeats(spark, docs.select(COLUMNS), as_text=True)
    out = found.select("row.*", F.col("kept").alias("text"), (F.size("spans") > 0).alias("cut")).where("not cut or text <> ''")
    return out.withColumn("n_chars", F.when(F.col("cut"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole rows; each row by its own text, so a repeated id may go in part.

    A null or empty text holds nothing and stays, as all rows do if the benchmark is empty or its texts are.
    """
    return decontaminate.decontaminated(spark, docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces in sequences; a null text is packed as an empty one, repeated rows each; an empty table gives none."""
    return packing.pack(spark, docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("benchmark decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
