"""The driver's tables as transcripts, turns and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("video_id"), "text", F.col("lang").alias("language"), "source")


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), F.col("role").alias("speaker_id"), F.col("turn").alias("idx"), "text")
