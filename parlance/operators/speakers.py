"""Speakers of timed turns (video_id, speaker_id, idx, start, end, text)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance import lexicons as lex
from parlance.functions import text as T
from parlance.operators.hooks import with_model


def timed_turns(turns: DataFrame) -> DataFrame:
    """video_id, speaker_id, idx, text and a running clock of 0.4 s a word, a second at least."""
    d = turns.withColumn("d", F.greatest(F.lit(1.0), F.size(T.words(F.coalesce(F.col("text"), F.lit("")))) * 0.4))
    end = F.sum("d").over(Window.partitionBy("video_id").orderBy("idx"))
    return d.select("video_id", "speaker_id", "idx", "text", F.round(end - F.col("d"), 3).alias("start"), F.round(end, 3).alias("end"))


def profiles(t: DataFrame) -> DataFrame:
    """video_id, speaker_id, duration, segments, average, ratio, rank."""
    g = t.groupBy("video_id", "speaker_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("duration"), F.count("*").alias("segments"))
    whole = F.sum("duration").over(Window.partitionBy("video_id"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("duration"), "speaker_id"))
    return g.select("video_id", "speaker_id", "duration", "segments", F.round(F.col("duration") / F.col("segments"), 3).alias("average"), F.round(F.col("duration") / F.greatest(whole, F.lit(1.0)), 3).alias("ratio"), rank.alias("rank"))


def samples(t: DataFrame, most: int = 5, clip: int = 200) -> DataFrame:
    """video_id, speaker_id, sample_texts: the first texts of each speaker's first turns that aren't empty."""
    n = F.row_number().over(Window.partitionBy("video_id", "speaker_id").orderBy("idx"))
    first = t.filter(F.length("text") > 0).withColumn("n", n).filter(F.col("n") <= most)
    g = first.groupBy("video_id", "speaker_id").agg(F.array_sort(F.collect_list(F.struct("n", F.substring("text", 1, clip).alias("t")))).alias("l"))
    return g.select("video_id", "speaker_id", F.col("l.t").alias("sample_texts"))


def full_profiles(t: DataFrame) -> DataFrame:
    """profiles() with sample_texts."""
    none = F.array().cast("array<string>")
    return profiles(t).join(samples(t), ["video_id", "speaker_id"], "left").withColumn("sample_texts", F.coalesce("sample_texts", none))


def lone_speaker(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """video_id, speaker_id, duration, segments, average, ratio, sample_texts: all that is said (video_id, ord, start, end, text) is one speaker's, also where nothing is. videos: video_id."""
    said = segments.select("video_id", F.lit("SPEAKER_00").alias("speaker_id"), F.col("ord").alias("idx"), "start", "end", "text")
    g = said.groupBy("video_id").agg(F.max("end").alias("duration"), F.count("*").alias("segments"))
    first = said.filter("idx is not null").withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("idx"))).filter("n <= 5 and length(text) > 0")
    texts = first.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("n", F.substring("text", 1, 200).alias("t")))).alias("l"))
    j = videos.select("video_id").join(g, "video_id", "left").join(texts, "video_id", "left")
    d, n = F.coalesce(F.col("duration").cast("double"), F.lit(0.0)), F.coalesce("segments", F.lit(0))
    return j.select("video_id", F.lit("SPEAKER_00").alias("speaker_id"), d.alias("duration"), n.alias("segments"), F.round(d / F.greatest(n, F.lit(1)), 3).alias("average"), F.lit(1.0).alias("ratio"), F.coalesce(F.col("l.t"), F.array().cast("array<string>")).alias("sample_texts"))


def dominant(p: DataFrame) -> DataFrame:
    return p.filter("rank = 1").select("video_id", "speaker_id", "duration")


def speaker_at(points: DataFrame, t: DataFrame) -> DataFrame:
    """video_id, at, speaker_id: the first turn that holds each point, ends included; null if none."""
    hit = points.join(t.select("video_id", "speaker_id", "idx", "start", "end"), "video_id").filter(F.col("at").between(F.col("start"), F.col("end")))
    best = hit.groupBy("video_id", "at").agg(F.min(F.struct("idx", "speaker_id")).alias("m"))
    return points.join(best, ["video_id", "at"], "left").select("video_id", "at", F.col("m.speaker_id").alias("speaker_id"))


def aligned(spans: DataFrame, t: DataFrame) -> DataFrame:
    """video_id, id, text: texts of the turns that overlap each span, in order. spans: video_id, id, a, b."""
    hit = spans.join(t, "video_id").filter((F.col("start") < F.col("b")) & (F.col("end") > F.col("a")))
    g = hit.groupBy("video_id", "id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("l"))
    return g.select("video_id", "id", F.array_join("l.text", " ").alias("text"), F.size("l").alias("turns"))


def emotions(t: DataFrame, lexicon: dict[str, list[str]] | None = None, bright: list[str] | None = None) -> DataFrame:
    """video_id, idx, emotion, score, sentiment: the class whose entries a text holds most of; none: neutral, 0.5."""
    lexicon, bright = lexicon or lex.EMOTIONS, bright or lex.BRIGHT
    low = F.lower("text")
    n = F.greatest(F.size(T.words(low)), F.lit(1))
    each = [F.struct((sum((F.contains(low, F.lit(w)).cast("int") for w in dict.fromkeys(ws)), F.lit(0)) / n).alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("e")) for i, (k, ws) in enumerate(lexicon.items())]
    e = t.filter(F.length(T.strip(F.col("text"))) >= 5).select("video_id", "idx", F.array_max(F.array(*each)).alias("m"))
    some = F.col("m.s") > 0
    emotion = F.when(some, F.col("m.e")).otherwise("neutral")
    sign = F.when(~some, "neutral").when(F.col("m.e").isin(bright), "positive").otherwise("negative")
    return e.select("video_id", "idx", emotion.alias("emotion"), F.round(F.when(some, F.col("m.s")).otherwise(0.5), 6).alias("score"), sign.alias("sentiment"))


def emotion_summary(e: DataFrame) -> DataFrame:
    """emotion, n, average."""
    return e.groupBy("emotion").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("average"))


def modelled_emotions(t: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame] | None = None, longest: int = 512) -> DataFrame:
    """video_id, idx, emotion, score, sentiment from an outside model, or emotions() where there is none or it fails on a batch.

    model: from batches of video_id, idx, text (the first `longest` characters) to video_id, idx, emotion, score: the best
    class of each. score: of known classes above 0 for glad ones and below for sorry ones, else 0.
    """
    plain = emotions(t).select("video_id", "idx", "emotion", "score", "sentiment")
    if model is None:
        return plain
    src = t.filter(F.length(T.strip(F.col("text"))) >= 5).select("video_id", F.col("idx").cast("long").alias("idx"), F.substring("text", 1, longest).alias("text"))
    got = with_model(src, "video_id string, idx long, emotion string, score double", model, lambda b: b[["video_id", "idx"]].assign(emotion=None, score=None))
    sign = F.when(F.col("emotion").isin(lex.GLAD), 1).when(F.col("emotion").isin(lex.SORRY), -1).otherwise(0)
    named = got.filter("emotion is not null").select("video_id", "idx", "emotion", F.round(F.col("score") * sign, 6).alias("score"), F.when(sign > 0, "positive").when(sign < 0, "negative").otherwise("neutral").alias("sentiment"))
    return named.unionByName(plain.join(got.filter("emotion is null").select("video_id", "idx"), ["video_id", "idx"], "left_semi").withColumn("idx", F.col("idx").cast("long")))


def emotion_report(e: DataFrame) -> DataFrame:
    """video_id, dominant_emotion (of equal ones the first said), distribution (map), avg_sentiment_score, overall_sentiment, segments. Scores are signed by their sentiment."""
    sign = F.when(F.col("sentiment") == "negative", -F.abs("score")).when(F.col("sentiment") == "positive", F.abs("score")).otherwise(0.0)
    c = e.groupBy("video_id", "emotion").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.sum(sign).alias("s"))
    g = c.groupBy("video_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "emotion"))["emotion"].alias("dominant_emotion"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("emotion", "n")))).alias("distribution"), F.round(F.sum("s") / F.sum("n"), 6).alias("avg_sentiment_score"), F.sum("n").alias("segments"))
    a = F.col("avg_sentiment_score")
    return g.withColumn("overall_sentiment", F.when(a > 0.1, "positive").when(a < -0.1, "negative").otherwise("neutral"))


def analysis(turns: DataFrame, feel: bool = True) -> dict[str, DataFrame]:
    """profiles, segments, emotions, emotion_report and summary (video_id, total_speakers, total_duration, dominant_speaker) of timed turns."""
    p, e = full_profiles(turns), modelled_emotions(turns)
    total = turns.groupBy("video_id").agg(F.count_distinct("speaker_id").alias("total_speakers"), F.max("end").alias("total_duration"))
    out = {"profiles": p, "segments": turns, "summary": total.join(dominant(p).select("video_id", F.col("speaker_id").alias("dominant_speaker")), "video_id", "left")}
    return out | ({"emotions": e, "emotion_report": emotion_report(e)} if feel else {})


def silence_turns(videos: DataFrame, silences: DataFrame, shortest: float = 0.5, pause: float = 1.5) -> DataFrame:
    """video_id, idx, speaker_id, start, end: two speakers in turn, parted by the ends of silences (video_id, s) in videos (video_id, duration).

    Parts under `shortest` seconds go; the speaker changes where a part that stays follows one of over `pause` seconds,
    kept or not. A video without silences is one turn.
    """
    v = videos.select("video_id", F.coalesce(F.col("duration").cast("double"), F.lit(0.0)).alias("d"))
    b = v.select("video_id", F.lit(0).alias("k"), F.lit(0.0).alias("t")).union(silences.filter("s is not null").select("video_id", F.lit(1), "s")).union(v.select("video_id", F.lit(2), "d"))
    w = Window.partitionBy("video_id").orderBy("k", "t")
    p = b.select("video_id", (F.row_number().over(w) - 1).alias("idx"), F.col("t").alias("start"), F.lead("t").over(w).alias("end"), F.coalesce(F.col("t") - F.lag("t").over(w) > pause, F.lit(False)).cast("int").alias("turn"))
    n = F.sum("turn").over(Window.partitionBy("video_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return p.filter(F.col("end") - F.col("start") >= shortest).withColumn("n", n).select("video_id", "idx", F.format_string("SPEAKER_%02d", F.col("n") % 2).alias("speaker_id"), "start", "end")
