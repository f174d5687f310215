"""Stored chunks and graphs as Parquet, and captions of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ["en", "hi", "sa"]


def add_chunks(chunks: DataFrame, path: str) -> None:
    """Appends the chunks whose chunk_id isn't stored yet: a second load adds nothing. One of rows that share an id is stored."""
    new = chunks.dropDuplicates(["chunk_id"])
    if exists(chunks.sparkSession, path):
        new = new.join(chunks.sparkSession.read.parquet(path).select("chunk_id"), "chunk_id", "left_anti").select(*chunks.columns)
    new.write.mode("append").parquet(path)


def add_videos(docs: DataFrame, path: str, *, size: int = 500, overlap: int = 75) -> DataFrame:
    """Cuts the texts into chunks, embeds and stores them; video_id, chunks: how many each has. docs: video_id, text, and columns that chunks keep."""
    from parlance.operators import retrieval

    c = retrieval.embedded(retrieval.chunk_transcripts(docs, size, overlap).join(docs.drop("text"), "video_id"))
    add_chunks(c, path)
    return load(docs.sparkSession, path).join(docs.select("video_id").distinct(), "video_id", "left_semi").groupBy("video_id").agg(F.count("*").alias("chunks"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def clear(spark: SparkSession, path: str, confirm: bool = False) -> bool:
    """Deletes the store, only if confirm is True; whether it did."""
    if confirm is not True or not exists(spark, path):
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def save_graph(path: str, entities: DataFrame, edges: DataFrame, references: DataFrame) -> None:
    for name, df in (("entities", entities), ("edges", edges), ("references", references)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Entities, edges and references, or None where any is missing."""
    parts = [f"{path}/{n}" for n in ("entities", "edges", "references")]
    return tuple(map(spark.read.parquet, parts)) if all(exists(spark, p) for p in parts) else None


def captions(videos: DataFrame) -> DataFrame:
    """video_id, text, language of videos (video_id, subtitles, automatic: maps of language to entries of data and text).

    English, Hindi, then Sanskrit; a manual caption before an automatic one; else the first there is; else '' and unknown.
    """
    text = lambda e: F.array_join(F.transform(e, lambda x: F.coalesce(x["data"], x["text"], F.lit(""))), " ")
    each = [F.when(F.size(F.col(m)[lang]) > 0, F.struct(text(F.col(m)[lang]).alias("text"), F.lit(lang).alias("language"))) for lang in LANGUAGES for m in ("subtitles", "automatic")]
    some = lambda m: F.get(F.filter(F.transform(F.map_entries(m), lambda e: F.struct(text(e["value"]).alias("text"), e["key"].alias("language"))), lambda s: s["text"] != ""), F.lit(0))
    best = F.coalesce(*each, some("subtitles"), some("automatic"))
    return videos.select("video_id", best.alias("b")).select("video_id", F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.language", F.lit("unknown")).alias("language"))
