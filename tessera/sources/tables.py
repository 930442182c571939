"""Readers for the input tables and for plain-text documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_text_documents(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Each UTF-8 text file is one document: ``doc_id`` = file name."""
    return (spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
                 .select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text")))


def read_text_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Lines of UTF-8 text files of any size, each file a document: ``doc_id, major, minor, line``.

    Spark reads a large file by splits, in many tasks; ``major`` is where the
    line's split starts in the file, ``minor`` rises within it.
    """
    return (spark.read.option("pathGlobFilter", glob).text(path)
                 .select(F.col("_metadata.file_name").alias("doc_id"),
                         F.col("_metadata.file_block_start").alias("major"),
                         F.monotonically_increasing_id().alias("minor"), F.col("value").alias("line")))
