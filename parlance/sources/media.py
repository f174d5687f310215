"""Recordings as tables: speech recognition by an outside model, its replies, durations, and transcripts from captions or speech."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators.hooks import with_model
from parlance.sources.stores import captions

REPLY = "text string, language string, segments array<struct<start: double, end: double, text: string>>"


def speech_replies(audio: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """video_id, reply: the JSON replies of a speech model to batches of video_id, path; null where there is no model or it fails on a batch."""
    return with_model(audio.select("video_id", "path"), "video_id string, reply string", model, lambda b: b[["video_id"]].assign(reply=None))


def recognised(replies: DataFrame) -> DataFrame:
    """video_id, text, language, segments of JSON replies (video_id, reply). A missing text is empty, a missing language unknown; no segments are null."""
    r = replies.select("video_id", F.from_json("reply", REPLY).alias("r"))
    none = F.size(F.coalesce("r.segments", F.array().cast("array<struct<start: double, end: double, text: string>>"))) == 0
    full = F.transform("r.segments", lambda x: F.struct(F.coalesce(x["start"], F.lit(0.0)).alias("start"), F.coalesce(x["end"], F.lit(0.0)).alias("end"), F.coalesce(x["text"], F.lit("")).alias("text")))
    return r.select("video_id", F.coalesce("r.text", F.lit("")).alias("text"), F.coalesce("r.language", F.lit("unknown")).alias("language"), F.when(~none, full).alias("segments"))


def segment_rows(heard: DataFrame) -> DataFrame:
    """video_id, ord, start, end, text of recognised()'s segments."""
    return heard.select("video_id", F.posexplode("segments").alias("ord", "s")).select("video_id", "ord", "s.start", "s.end", "s.text")


def transcribed(videos: DataFrame, heard: DataFrame) -> DataFrame:
    """video_id, text, language, source (captions or whisper), segments: a video's captions where they have a text, else what was heard. videos: video_id, subtitles, automatic."""
    c = captions(videos).withColumnRenamed("text", "said").withColumnRenamed("language", "in")
    j = c.join(heard, "video_id", "left")
    own = F.length("said") > 0
    return j.select("video_id", F.when(own, F.col("said")).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.when(own, F.col("in")).otherwise(F.coalesce("language", F.lit("unknown"))).alias("language"), F.when(own, "captions").otherwise("whisper").alias("source"), F.when(~own, F.col("segments")).alias("segments"))


def durations(log: DataFrame, unknown: float | None = 0.0) -> DataFrame:
    """video_id, duration: the number that a media tool printed for each video (video_id, line), `unknown` where it printed none."""
    found = F.max(F.regexp_extract(F.coalesce("line", F.lit("")), r"^\s*(?:duration=)?(\d+(?:\.\d+)?)\s*$", 1).try_cast("double"))
    return log.groupBy("video_id").agg(F.coalesce(found, F.lit(unknown).cast("double")).alias("duration"))


def default_id(text: Column) -> Column:
    """A name for a transcript that has none: a digest of its beginning."""
    return F.substring(F.md5(F.substring(F.coalesce(text, F.lit("")), 1, 200)), 1, 12)


def default_duration(docs: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """video_id, duration: the end of the last segment, else 0.4 s a word of the text."""
    spoken = F.size(T.words(F.coalesce("text", F.lit("")))) * 4 / 10
    if segments is None:
        return docs.select("video_id", spoken.alias("duration"))
    last = segments.groupBy("video_id").agg(F.max("end").alias("last"))
    return docs.select("video_id", spoken.alias("spoken")).join(last, "video_id", "left").select("video_id", F.coalesce("last", "spoken").alias("duration"))
