"""All that is known of a recording, of every kind, as one JSON object."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import graph
from parlance.sources.scratch import kept


def key_entities(mentions: DataFrame, most: int = 15) -> DataFrame:
    """video_id, place, name, entity_type, frequency: the entities that a video names most; ties by name."""
    place = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("frequency"), "name", "entity_id"))
    return mentions.withColumn("place", place).filter(F.col("place") <= most).select("video_id", "place", "name", "entity_type", "frequency")


def nested(df: DataFrame, part: str, most: int | None, order: list[str], /, **cols: Column) -> DataFrame:
    """video_id and `part`: the first `most` rows of each video as an array of structs."""
    if most:
        n = F.row_number().over(Window.partitionBy("video_id").orderBy(*order))
        df = df.withColumn("_n", n).filter(F.col("_n") <= most)
    row = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.struct(*(c.alias(k) for k, c in cols.items())).alias("v"))
    return df.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]).alias(part))


def merged(videos: DataFrame, *, known: DataFrame | None = None, visual: dict | None = None, voices: dict | None = None, topics: DataFrame | None = None, chapters: DataFrame | None = None, mentions: DataFrame | None = None, edges: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """video_id, body: one object with the parts that were given; a part that has nothing of a video is left out of its object.

    visual: visual.analysis(); voices: speakers.analysis(); mentions, edges, references: of the graph, edges with
    source_video, references as cross_references() or as best_references(). Lists are cut: 20 slides of 500 characters and 20 diagrams, five keywords a topic, 15 entities, ten
    references.
    """
    c, parts = F.col, []
    count = lambda df, name: df.groupBy("video_id").agg(F.count("*").alias(name))
    join = lambda base, *dfs: reduce(lambda a, b: a.join(b, "video_id", "left"), dfs, base)
    as_part = lambda df, name: df.select("video_id", F.struct(*(x for x in df.columns if x != "video_id")).alias(name))
    if known is not None:
        parts.append(as_part(known, "knowledge"))
    if visual:
        texts = nested(visual["slides"], "slide_texts", 20, ["slide"], timestamp=c("timestamp"), text=F.substring("text", 1, 500), confidence=c("confidence"))
        seen = nested(visual["diagrams"], "diagrams", 20, ["timestamp"], timestamp=c("timestamp"), type=c("kind"))
        counts = [count(visual["frames"], "frames_analyzed"), count(visual["slides"], "unique_slides"), count(visual["scenes"], "scene_changes")]
        parts.append(as_part(join(visual["summary"].withColumnRenamed("summary", "visual_summary"), *counts, texts, seen).fillna(0, ["frames_analyzed", "unique_slides", "scene_changes"]), "visual"))
    if voices:
        who = nested(voices["profiles"], "profiles", None, ["rank"], speaker_id=c("speaker_id"), speaking_duration=c("duration"), speaking_ratio=c("ratio"), segment_count=c("segments"))
        v = join(voices["summary"].drop("total_duration"), who)
        if "emotion_report" in voices:
            v = join(v, as_part(voices["emotion_report"], "emotions"))
        parts.append(as_part(v, "speakers"))
    if chapters is not None:
        parts.append(nested(chapters, "chapters", None, ["chapter_id"], chapter_id=c("chapter_id"), title=c("title"), start_time=c("start_time"), end_time=c("end_time"), duration=c("duration"), summary=c("summary")))
    if topics is not None:
        parts.append(nested(topics, "topics", None, ["topic_id"], topic_id=c("topic_id"), title=c("title"), keywords=F.slice("keywords", 1, 5), start_time=c("start_time"), end_time=c("end_time")))
    if mentions is not None:
        kinds = mentions.groupBy("video_id", "entity_type").agg(F.count_distinct("entity_id").alias("n"))
        kinds = kinds.groupBy("video_id").agg(F.sum("n").alias("total_entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("entity_types"))
        best = nested(key_entities(mentions), "key_entities", None, ["place"], name=c("name"), type=c("entity_type"), frequency=c("frequency"))
        g = join(kinds, best)
        if edges is not None:
            g = join(g, edges.groupBy(F.col("source_video").alias("video_id")).agg(F.count("*").alias("total_relationships")))
        parts.append(as_part(g, "knowledge_graph"))
    if references is not None:
        both = references
        if "source_video" in references.columns:
            side = lambda a, b: references.select(F.col(a).alias("video_id"), F.col(b).alias("other"), "shared", "similarity", "ref_type")
            both = side("source_video", "target_video").unionByName(side("target_video", "source_video"))
        both = both.withColumn("far", -F.col("similarity"))
        parts.append(nested(both, "cross_references", 10, ["far", "other"], target_video=c("other"), shared_entities=c("shared"), similarity=c("similarity"), type=c("ref_type")))
    # Each part is written by itself, so that no plan holds the shuffles of all of them at once.
    j = join(videos.select("video_id"), *map(kept, parts))
    return j.select("video_id", F.to_json(F.struct(*(x for x in j.columns if x != "video_id"))).alias("body"))


def updated(batch: DataFrame, path: str, extract) -> None:
    """For foreachBatch: merges the graph that extract(batch) finds (mentions, relations, references) into the one stored at `path`."""
    from parlance.sources import stores
    from parlance.sources.scratch import ready

    spark = ready(batch.sparkSession)
    old = stores.load_graph(spark, path)
    g = graph.build_graph(*extract(batch), existing=graph.Graph(*old) if old else None)
    # Files are read before they are replaced.
    kept = [df.checkpoint() for df in (g.mentions, g.relations, g.references)]
    stores.save_graph(path, *kept)
