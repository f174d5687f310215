"""Frames, slides and scene changes of recordings. A recording has at most some hundred frames, so folds stay within its row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T

# What the media tools print before a time, and the classes of frames.
SCENE_MARK = r"pts_time:(\d+\.?\d*)"
SILENCE_MARK = r"silence_end:\s*(\d+\.?\d*)"
DENSE, CHART, SIMPLE, COMPLEX, NOTHING = "dense_text_slide", "diagram_or_chart", "simple_slide", "complex_visual", "unknown"
FRAME = "kind string, confidence double, edges double, spread double, light double"


def times_in_log(log: DataFrame, mark: str = SCENE_MARK) -> DataFrame:
    """video_id, s: the times that `mark` finds in the lines of a media tool's log (video_id, line). Null lines hold none."""
    found = F.explode(F.regexp_extract_all(F.coalesce("line", F.lit("")), F.lit(mark), 1))
    return log.select("video_id", found.alias("s")).withColumn("s", F.col("s").cast("double"))


def frame_times(videos: DataFrame, every: float = 5.0, most: int = 200, unknown: float = 3600.0) -> DataFrame:
    """video_id, frame, timestamp: a frame each `every` seconds, further apart where more than `most` would result. A null duration counts as `unknown`."""
    d = F.coalesce(F.col("duration").cast("double"), F.lit(unknown))
    v = videos.select("video_id", d.alias("d")).withColumn("step", F.when(F.col("d") / every > most, F.col("d") / most).otherwise(F.lit(every)))
    n = F.least(F.ceil(F.col("d") / F.col("step")), F.lit(most)).cast("int")
    some = v.withColumn("n", n).filter("n > 0")
    return some.select("video_id", "step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame")).select("video_id", "frame", F.round(F.col("frame") * F.col("step"), 6).alias("timestamp"))


def slides(words: DataFrame, least: float = 0.4, *, inclusive: bool = False) -> DataFrame:
    """video_id, timestamp, text, confidence, language: recognised words (video_id, timestamp, ord, word, conf of 100) above `least`, by frame; `inclusive`: of at least that."""
    sure = F.col("conf") >= least * 100 if inclusive else F.col("conf") > least * 100
    w = words.filter(sure & (T.strip(F.col("word")) != ""))
    g = w.groupBy("video_id", "timestamp").agg(F.array_sort(F.collect_list(F.struct("ord", "word"))).alias("l"), F.round(F.avg("conf") / 100, 6).alias("confidence"))
    g = g.withColumn("text", F.array_join("l.word", " "))
    return g.select("video_id", "timestamp", "text", "confidence", T.script_language(F.col("text")).alias("language"))


def distinct_slides(found: DataFrame, alike: float = 0.85) -> DataFrame:
    """video_id, slide, timestamp, text, confidence: one slide for each run of similar ones.

    A slide is compared with the one last kept, by Jaccard similarity of words; of similar ones the more confident is
    kept, and the next is compared with that. Blank texts are like no other. The fold goes over one recording's slides.
    """
    s = found.select("video_id", "timestamp", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    s = s.withColumn("w", F.array_distinct(T.words(F.lower("text"))))
    g = s.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "text", "confidence", "w"))).alias("l"))

    def step(kept, x):
        last = F.element_at(kept, -1)
        swapped = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))
        return F.when(T.jaccard(last["w"], x["w"]) < alike, F.concat(kept, F.array(x))).when(x["confidence"] > last["confidence"], swapped).otherwise(kept)

    folded = F.aggregate(F.slice("l", 2, F.size("l")), F.slice("l", 1, 1), step)
    return g.select("video_id", F.posexplode(folded).alias("slide", "k")).select("video_id", "slide", "k.timestamp", "k.text", "k.confidence")


def measured(pixels: np.ndarray) -> tuple[str, float, float, float, float]:
    """FRAME's values of one frame (height x width, or height x width x channels)."""
    if not pixels.size:
        return NOTHING, 0.0, 0.0, 0.0, 0.0
    deep = pixels.ndim == 3
    grey = pixels.mean(axis=2).astype(np.uint8) if deep else pixels
    steps = [np.abs(np.diff(grey.astype(np.float64), axis=a)) for a in (1, 0)]
    edges = float(sum(s.mean() if s.size else 0.0 for s in steps) / 2)
    spread = float(pixels.reshape(-1, pixels.shape[2]).std(axis=0).mean() if deep else pixels.std())
    light = float((grey > 200).mean())
    if light > 0.5 and edges > 15:
        kind = DENSE if edges > 40 else CHART if edges > 25 else SIMPLE
        return kind, min(0.9, light / 2 + edges / 100), edges, spread, light
    return (COMPLEX, 0.5, edges, spread, light) if edges > 30 and spread > 50 else (NOTHING, 0.0, edges, spread, light)


def frame_class(height: pd.Series, width: pd.Series, channels: pd.Series, pixels: pd.Series) -> pd.DataFrame:
    """FRAME of raw 8-bit frames; null or of the wrong length: unknown, 0."""

    def one(h, w, c, raw):
        if raw is None or pd.isna(h) or pd.isna(w) or pd.isna(c) or len(raw) != int(h) * int(w) * int(c):
            return measured(np.empty(0, np.uint8))
        return measured(np.frombuffer(raw, np.uint8).reshape((int(h), int(w)) if c == 1 else (int(h), int(w), int(c))))

    return pd.DataFrame([one(*r) for r in zip(height, width, channels, pixels, strict=True)], columns=[x.split()[0] for x in FRAME.split(", ")])


def diagrams(frames: DataFrame) -> DataFrame:
    """video_id, timestamp and FRAME's columns, of the frames that have a class."""
    f = frames.select("video_id", "timestamp", F.pandas_udf(frame_class, FRAME)("height", "width", "channels", "pixels").alias("f"))
    return f.select("video_id", "timestamp", "f.*").filter(F.col("kind") != NOTHING)


def kind_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("video_id", "kind").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"))


def visual_summary(videos: DataFrame, frames: DataFrame, unique: DataFrame, found: DataFrame, scenes: DataFrame) -> DataFrame:
    """video_id, summary: counts of frames, slides, visual elements and scene changes in words, with the first three slides."""
    count = lambda df, name: df.groupBy("video_id").agg(F.count("*").alias(name))
    t = F.col("text")
    line = F.format_string('  - At %.1fs: "%s"', F.col("timestamp").cast("double"), F.when(F.length(t) > 100, F.concat(F.substring(t, 1, 100), F.lit("..."))).otherwise(t))
    shown = unique.filter("slide < 3").groupBy("video_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("slide", line.alias("l"))))["l"], "\n").alias("shown"))
    kinds = kind_counts(found).withColumn("l", F.format_string("%d %s", "n", "kind"))
    kinds = kinds.groupBy("video_id").agg(F.sum("n").alias("elements"), F.array_join(F.array_sort(F.collect_list(F.struct("first", "kind", "l")))["l"], ", ").alias("kinds"))
    j = videos.select("video_id").distinct()
    for part in (count(frames, "frames"), count(unique, "slides"), shown, kinds, count(scenes, "scenes")):
        j = j.join(part, "video_id", "left")
    lines = [
        F.format_string("Analyzed %d frames from video.", F.coalesce("frames", F.lit(0))),
        F.when(F.col("slides") > 0, F.format_string("Found %d unique slides/text screens.", "slides")),
        F.col("shown"),
        F.when(F.col("elements") > 0, F.format_string("Detected %d visual elements: %s.", "elements", "kinds")),
        F.when(F.col("scenes") > 0, F.format_string("Detected %d scene changes.", "scenes")),
    ]
    return j.select("video_id", F.concat_ws("\n", *lines).alias("summary"))


def analysis(videos: DataFrame, words: DataFrame, frames: DataFrame, log: DataFrame, every: float = 5.0, most: int = 200) -> dict[str, DataFrame]:
    """frames, scenes, slides, diagrams and summary of recordings. videos: video_id, duration; words: as for slides(); frames: as for diagrams(); log: lines of the scene detector."""
    times, scenes, unique, found = frame_times(videos, every, most), times_in_log(log), distinct_slides(slides(words)), diagrams(frames)
    return {"frames": times, "scenes": scenes, "slides": unique, "diagrams": found, "summary": visual_summary(videos, times, unique, found, scenes)}
