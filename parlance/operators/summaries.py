"""Summaries of recordings: chapters with signals, executive summary, grades, and Markdown and JSON forms.

Lists are cut to their stated lengths before they are collected, so a row never holds more than a report shows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import segments, speech
from parlance.sources.scratch import kept, ready

# Fixed values of the reports: signs and weights.
PRIORITY_SIGNS = {"high": "🔴", "medium": "🟡", "low": "🟢"}
OTHER_SIGN = "⚪"
GRADES = [("A", 0.8), ("B", 0.6), ("C", 0.4), ("D", 0.2)]
WEIGHTS = {"chapter_coverage": 0.25, "type_diversity": 0.2, "avg_confidence": 0.2, "sentiment_coverage": 0.15, "avg_importance": 0.2}
KINDS = 9


def in_order(order: list, value: Column) -> Column:
    """The values of a group as an array by `order`; `value` may be null and is then left out."""
    return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*(x.alias(f"o{i}") for i, x in enumerate(order)), value.alias("v"))))), lambda x: x["v"])


def first_of(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each video."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("video_id").orderBy(*order))).filter(F.col("_n") <= n)


def joined(base: DataFrame, *parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "video_id", "left"), parts, base)


def enhanced_chapters(chaps: DataFrame, scenes: DataFrame, changes: DataFrame, *, within: float = 10.0, buffer: float = 2.0) -> DataFrame:
    """chaps with ends moved to scene changes, and scene_change_count, has_speaker_change, confidence, buffer_start, buffer_end.

    A chapter's start moves to the scene change nearest to it, its end likewise if that is behind the new start. The
    confidence goes by the length before. scenes and changes: video_id, s. Without either, chapters stay as they are.
    """
    ends = chaps.select("video_id", F.explode(F.array(F.struct((F.col("chapter_id") * 2).alias("id"), F.col("start_time").alias("t")), F.struct((F.col("chapter_id") * 2 + 1).alias("id"), F.col("end_time").alias("t")))).alias("e")).select("video_id", "e.*")
    near = segments.nearest(ends, scenes, within).groupBy("video_id", F.floor(F.col("id") / 2).cast("int").alias("chapter_id"))
    near = near.agg(F.max(F.when(F.col("id") % 2 == 0, F.col("at"))).alias("to_start"), F.max(F.when(F.col("id") % 2 == 1, F.col("at"))).alias("to_end"))
    c = chaps.join(near, ["video_id", "chapter_id"], "left").withColumn("a", F.coalesce("to_start", "start_time"))
    c = c.withColumn("b", F.when(F.col("to_end") > F.col("a"), F.col("to_end")).otherwise(F.col("end_time")))

    def inside(points: DataFrame, name: str) -> DataFrame:
        hit = c.select("video_id", "chapter_id", "a", "b").join(points.select("video_id", "s"), "video_id").filter(F.col("s").between(F.col("a"), F.col("b")))
        return hit.groupBy("video_id", "chapter_id").agg(F.count("*").alias(name))

    c = c.join(inside(scenes, "n_scenes"), ["video_id", "chapter_id"], "left").join(inside(changes, "n_changes"), ["video_id", "chapter_id"], "left")
    n, spoken = F.coalesce("n_scenes", F.lit(0)), F.coalesce("n_changes", F.lit(0)) > 0
    sure = 0.5 + F.when(n > 0, 0.2).otherwise(0.0) + F.when(spoken, 0.15).otherwise(0.0) + F.when(F.col("duration") >= 60, 0.1).when(F.col("duration") >= 30, 0.05).otherwise(0.0)
    return c.select(
        "video_id", "chapter_id", "title", F.col("a").alias("start_time"), F.col("b").alias("end_time"), (F.col("b") - F.col("a")).alias("duration"), "summary", "topic_ids",
        n.cast("long").alias("scene_change_count"), spoken.alias("has_speaker_change"), F.round(F.least(F.lit(1.0), sure), 6).alias("confidence"),
        F.greatest(F.lit(0.0), F.col("a") - buffer).alias("buffer_start"), (F.col("b") + buffer).alias("buffer_end"),
    )


def within_chapters(chaps: DataFrame, rows: DataFrame, at: str = "start") -> DataFrame:
    """rows with the chapter_id of each chapter that holds their time, both ends included: one at a border is in two."""
    span = chaps.select("video_id", "chapter_id", F.col("start_time").alias("_a"), F.col("end_time").alias("_b"))
    return rows.join(span, "video_id").filter(F.col(at).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def chapter_sentiment(chaps: DataFrame, arc: DataFrame) -> DataFrame:
    """video_id, chapter_id, sentiment_score, sentiment: mean of the windows that begin in a chapter, neutral up to 0.15 either way."""
    g = within_chapters(chaps, arc).groupBy("video_id", "chapter_id").agg(F.round(F.avg("score"), 6).alias("sentiment_score"))
    s = F.col("sentiment_score")
    return g.withColumn("sentiment", F.when(s > 0.15, "positive").when(s < -0.15, "negative").otherwise("neutral"))


def split_manifest(chaps: DataFrame, ending: str = "mp4") -> DataFrame:
    """video_id, chapter_id, title, buffer_start, buffer_end, file: what to cut each recording into. chaps: of enhanced_chapters()."""
    name = F.format_string(f"chapter_%02d_%s.{ending}", "chapter_id", T.file_name(F.col("title")))
    return chaps.select("video_id", "chapter_id", "title", "buffer_start", "buffer_end", name.alias("file"))


def chapter_topics(chaps: DataFrame, tops: DataFrame) -> DataFrame:
    """video_id, chapter_id, topic_ids: those of the chapter, or where it has none those of the topics that lie wholly within it."""
    own = chaps.select("video_id", "chapter_id", "start_time", "end_time", "topic_ids")
    t = tops.select("video_id", "topic_id", F.col("start_time").alias("_a"), F.col("end_time").alias("_b"))
    hit = own.join(t, "video_id").filter((F.col("_a") >= F.col("start_time")) & (F.col("_b") <= F.col("end_time")))
    got = hit.groupBy("video_id", "chapter_id").agg(F.array_sort(F.collect_list("topic_id")).alias("found"))
    ids = F.when(F.size(F.coalesce("topic_ids", F.array().cast("array<int>"))) > 0, F.col("topic_ids")).otherwise(F.coalesce("found", F.array().cast("array<int>")))
    return own.join(got, ["video_id", "chapter_id"], "left").select("video_id", "chapter_id", ids.alias("topic_ids"))


def chapter_slides(chaps: DataFrame, found: DataFrame, most: int = 5, clip: int = 200) -> DataFrame:
    """video_id, chapter_id, slide_texts: the first slides (video_id, timestamp, text) of each chapter."""
    s = within_chapters(chaps, found, "timestamp")
    s = s.withColumn("_n", F.row_number().over(Window.partitionBy("video_id", "chapter_id").orderBy("timestamp", "text"))).filter(F.col("_n") <= most)
    return s.groupBy("video_id", "chapter_id").agg(in_order([F.col("_n")], F.substring("text", 1, clip)).alias("slide_texts"))


def grades(videos: DataFrame, chaps: DataFrame, found: DataFrame, arc: DataFrame) -> DataFrame:
    """One row for each of videos (video_id, duration): counts, coverages, the five weighted parts' sum as score, and grade."""
    d = F.coalesce(F.col("duration").cast("double"), F.lit(0.0))
    j = joined(
        videos.select("video_id", d.alias("duration")),
        chaps.groupBy("video_id").agg(F.count("*").alias("chapter_count"), F.sum(F.col("end_time") - F.col("start_time")).alias("covered")),
        found.groupBy("video_id").agg(F.count("*").alias("insight_count"), F.count_distinct("type").alias("types"), F.avg("importance").alias("avg_importance"), F.avg("confidence").alias("avg_confidence")),
        arc.groupBy("video_id").agg(F.sum(F.col("end") - F.col("start")).alias("felt")),
    ).fillna(0)
    share = lambda x: F.when(F.col("duration") > 0, F.least(F.lit(1.0), F.col(x) / F.when(F.col("duration") > 0, F.col("duration")))).otherwise(0.0)
    j = j.withColumn("chapter_coverage", share("covered")).withColumn("sentiment_coverage", share("felt")).withColumn("type_diversity", F.col("types") / KINDS)
    j = j.withColumn("insight_density", F.col("insight_count") / F.greatest(F.col("duration") / 60, F.lit(1.0)))
    score = F.round(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 6)
    grade = reduce(lambda a, g: a.when(F.col("score") >= g[1], g[0]), GRADES[1:], F.when(F.col("score") >= GRADES[0][1], GRADES[0][0])).otherwise("F")
    r = lambda c: F.round(c, 6).alias(c)
    return j.withColumn("score", score).select("video_id", "chapter_count", "insight_count", r("chapter_coverage"), r("insight_density"), r("type_diversity"), r("sentiment_coverage"), r("avg_importance"), r("avg_confidence"), "score", grade.alias("grade"))


def insight_quality(docs: DataFrame, found: DataFrame, acts: DataFrame, arc: DataFrame) -> DataFrame:
    """video_id, quality: the mean of five parts of at most 1 (types, density, actions, windows, confidence); 0 for an empty text."""
    n = lambda df, name: df.groupBy("video_id").agg(F.count("*").alias(name))
    w = F.size(T.words(F.coalesce(F.col("text"), F.lit(""))))
    found = found.groupBy("video_id").agg(F.count("*").alias("n"), F.count_distinct("type").alias("types"), F.avg("confidence").alias("sure"))
    j = joined(docs.select("video_id", w.alias("words"), (F.length("text") > 0).alias("some")), found, n(acts, "acts"), n(arc, "felt")).fillna(0)
    dense = F.col("n") / F.greatest(F.col("words") / 100, F.lit(1.0))
    cap = lambda x, k: F.least(F.lit(1.0), F.col(x) / k)
    parts = cap("types", 5) + F.when(dense.between(0.5, 5), 1.0).when(dense > 0.1, 0.5).otherwise(0.0) + cap("acts", 3) + cap("felt", 5) + F.col("sure")
    return j.select("video_id", F.round(F.when(F.col("some"), F.least(F.lit(1.0), parts / 5)).otherwise(0.0), 6).alias("quality"))


def executive_summary(videos: DataFrame, chaps: DataFrame, found: DataFrame, acts: DataFrame, tone: DataFrame, most: int = 500) -> DataFrame:
    """video_id, executive_summary: title line, five chapters, three insights, three actions and the tone. videos: video_id, title; tone: video_id, label."""

    def bullets(df: DataFrame, n: int, head: str, body: Column, name: str, *order: Column) -> DataFrame:
        g = first_of(df, n, *order).groupBy("video_id").agg(in_order([F.col("_n")], F.concat(F.lit("• "), body)).alias("l"))
        return g.select("video_id", F.when(F.size("l") > 0, F.concat(F.lit(head + "\n"), F.array_join("l", "\n"))).alias(name))

    told = F.when(F.length("summary") > 0, F.concat("title", F.lit(": "), F.substring("summary", 1, 100)))
    j = joined(
        videos.select("video_id", "title"),
        chaps.groupBy("video_id").agg(F.count("*").alias("n")),
        bullets(chaps, 5, "Key sections:", told, "a", F.col("chapter_id")),
        bullets(found, 3, "Key takeaways:", F.substring("text", 1, 100), "b", F.desc("importance"), F.col("rank")),
        bullets(acts, 3, "Action items:", F.substring("text", 1, 80), "c", F.col("start"), F.col("text")),
        tone.select("video_id", F.concat(F.lit("Overall tone: "), F.replace("label", F.lit("_"), F.lit(" "))).alias("d")),
    )
    head = F.format_string('"%s" covers %d main sections.', F.coalesce("title", F.lit("")), F.coalesce("n", F.lit(0)))
    whole = F.concat_ws("\n\n", head, "a", "b", "c", F.coalesce("d", F.lit("Overall tone: neutral")))
    return j.select("video_id", whole.alias("x")).select("video_id", F.when(F.length("x") > most, F.concat(F.substring("x", 1, most - 3), F.lit("..."))).otherwise(F.col("x")).alias("executive_summary"))


def _words(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def _percent(x: str) -> Column:
    return F.format_string("%.0f%%", F.col(x) * 100)


def markdown(videos: DataFrame, brief: DataFrame, tone: DataFrame, graded: DataFrame, chaps: DataFrame, found: DataFrame, acts: DataFrame, said: DataFrame, arc: DataFrame | None = None, *, slides: DataFrame | None = None, timestamps: bool = True, sentiment: bool = True, action_items: bool = True, quotes: bool = True) -> DataFrame:
    """video_id, body: the report in Markdown; the flags leave sections out, and empty ones are left out. videos: video_id, title, duration."""

    def section(df: DataFrame, head: str, line: Column, name: str, *order: Column, n: int | None = None, wrap: str = "%s") -> DataFrame:
        rows = first_of(df, n, *order) if n else df.withColumn("_n", F.row_number().over(Window.partitionBy("video_id").orderBy(*order)))
        g = rows.groupBy("video_id").agg(F.array_join(in_order([F.col("_n")], line), "\n").alias("l"))
        return g.select("video_id", F.concat(F.lit(f"## {head}\n\n"), F.format_string(wrap, "l"), F.lit("\n")).alias(name))

    c = F.col
    at = lambda x: F.concat(F.lit("["), T.stamp(c(x)), F.lit("]"))
    points = within_chapters(chaps, found).withColumn("_k", F.row_number().over(Window.partitionBy("video_id", "chapter_id").orderBy("rank"))).filter("_k <= 5")
    points = points.groupBy("video_id", "chapter_id").agg(F.array_join(in_order([c("_k")], F.concat(F.lit("- "), F.substring("text", 1, 150))), "\n").alias("points"))
    full = chaps.join(points, ["video_id", "chapter_id"], "left")
    mood = F.lit(None).cast("string")
    if sentiment and arc is not None:
        full = full.join(chapter_sentiment(chaps, arc), ["video_id", "chapter_id"], "left")
        mood = F.when(c("sentiment") != "neutral", F.format_string("*Sentiment: %s (%+.2f)*\n", _words(c("sentiment")), "sentiment_score"))
    shown = F.lit(None).cast("string")
    if slides is not None:
        seen = chapter_slides(chaps, slides, 3, 100)
        seen = seen.select("video_id", "chapter_id", F.array_join(F.transform("slide_texts", lambda x: F.concat(F.lit("> "), x)), "\n").alias("shown"))
        full = full.join(seen, ["video_id", "chapter_id"], "left")
        shown = F.concat(F.lit("**Slides:**\n"), "shown", F.lit("\n"))
    chapter = F.concat_ws("\n", F.format_string("### %d. %s [%s]\n", c("chapter_id") + 1, "title", T.stamp(c("start_time"))), F.when(F.length("summary") > 0, F.concat(F.substring("summary", 1, 300), F.lit("\n"))), mood, F.concat(F.lit("**Key Points:**\n"), "points", F.lit("\n")), shown)
    sign = F.coalesce(F.create_map(*(F.lit(x) for kv in PRIORITY_SIGNS.items() for x in kv))[c("priority")], F.lit(OTHER_SIGN))
    parts = [brief, tone.select("video_id", "label"), graded, section(full, "Chapters", chapter, "p1", c("chapter_id"))]
    if timestamps:
        parts.append(section(chaps, "YouTube Chapters", F.concat_ws(" ", T.stamp(c("start_time")), "title"), "p2", c("chapter_id"), wrap="```\n%s\n```"))
    parts.append(section(found, "Key Insights", F.concat_ws(" ", F.lit("-"), F.concat(F.lit("["), F.upper("type"), F.lit("]")), at("start"), F.substring("text", 1, 200)), "p3", F.desc("importance"), c("rank"), n=15))
    if action_items:
        parts.append(section(acts, "Action Items", F.concat_ws(" ", F.lit("-"), sign, F.concat(F.lit("**["), F.upper("priority"), F.lit("]**")), F.substring("text", 1, 200)), "p4", c("start"), c("text")))
    if quotes:
        parts.append(section(said, "Notable Quotes", F.concat(F.lit('> "'), "text", F.lit('" '), at("start"), F.lit("\n")), "p5", F.desc("score"), c("idx"), n=10))
    if sentiment and arc is not None:
        parts.append(section(arc, "Sentiment Arc", F.concat_ws(" ", F.lit("-"), at("start"), _words(c("label")), F.format_string("(%+.2f)", "score")), "p6", c("idx")))
    j = joined(videos.select("video_id", F.coalesce("title", F.lit("")).alias("title"), "duration"), *parts)
    top = [F.concat(F.lit("# "), "title", F.lit("\n")), F.concat(F.lit("**Duration:** "), T.span(F.coalesce(c("duration").cast("double"), F.lit(0.0)))), F.format_string("**Quality Score:** %s (%s)", _percent("score"), "grade"), F.concat(F.lit("**Overall Sentiment:** "), _words(F.coalesce("label", F.lit("neutral"))), F.lit("\n"))]
    end = F.concat_ws("\n", F.lit("## Quality Report\n"), F.format_string("- **Overall Score:** %s (Grade: %s)", _percent("score"), "grade"), F.concat(F.lit("- **Chapter Coverage:** "), _percent("chapter_coverage")), F.format_string("- **Insight Density:** %.1f per minute", "insight_density"), F.concat(F.lit("- **Type Diversity:** "), _percent("type_diversity")), F.concat(F.lit("- **Sentiment Coverage:** "), _percent("sentiment_coverage")), F.lit(""))
    named = [x for x in ("p1", "p2", "p3", "p4", "p5", "p6") if x in j.columns]
    return j.select("video_id", F.concat_ws("\n", *top, F.concat(F.lit("## Executive Summary\n\n"), "executive_summary", F.lit("\n")), *named, end).alias("body"))


def as_json(videos: DataFrame, brief: DataFrame, tone: DataFrame, graded: DataFrame, lists: dict[str, DataFrame], *, pretty: bool = True) -> DataFrame:
    """video_id, body: all parts as one JSON object; each of lists is an array of its rows in the order of its columns behind video_id; missing ones are []."""
    report = graded.select("video_id", F.struct(*(c for c in graded.columns if c != "video_id")).alias("quality_report"))
    parts = [brief, tone.select("video_id", F.col("label").alias("overall_sentiment")), report]
    for name, df in lists.items():
        parts.append(df.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in df.columns if c != "video_id")))).alias(name)))
    j = joined(videos.select("video_id", "title", "duration"), *parts)
    cols = ["video_id", "title", "duration", "executive_summary", "overall_sentiment", *(F.coalesce(n, F.array()).alias(n) for n in lists), "quality_report"]
    return j.select("video_id", F.to_json(F.struct(*cols), {"pretty": "true" if pretty else "false"}).alias("body"))


def store_insights(found: DataFrame, path: str) -> DataFrame:
    """Replaces the stored insights of each video in found at `path` and leaves other videos' alone; returns the store.

    Dynamic overwrite swaps the buckets that the new rows fall in, so the kept rows of those buckets are written again
    with them. Buckets are 256 folders by a hash of video_id: folders don't grow with the videos.
    """
    spark = found.sparkSession
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(256)).cast("int").alias("bucket")
    new = found.select("*", bucket)
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # a store that isn't there yet; anything else goes on
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        touched = new.select("bucket").distinct()
        kept = old.join(touched, "bucket", "left_semi").join(new.select("video_id").distinct(), "video_id", "left_anti")
        ready(spark)
        new = new.unionByName(kept.select(*new.columns)).checkpoint()  # files are read before they are replaced
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path)


def index_entries(found: DataFrame, clip: int = 300) -> DataFrame:
    """Findings as the store keeps them: texts cut to `clip` characters."""
    return found.withColumn("text", F.substring("text", 1, clip))


def index_totals(store: DataFrame) -> DataFrame:
    """One row: total_videos, total_insights."""
    return store.agg(F.count_distinct("video_id").alias("total_videos"), F.count("*").alias("total_insights"))


def store_status(found: DataFrame, store: DataFrame) -> DataFrame:
    """video_id, insights_saved, total_videos_in_db: what a load of findings left in the store."""
    n = found.groupBy("video_id").agg(F.count("*").alias("insights_saved"))
    return n.crossJoin(F.broadcast(index_totals(store).select(F.col("total_videos").alias("total_videos_in_db"))))  # one row


def summarize(docs: DataFrame, scenes: DataFrame | None = None, changes: DataFrame | None = None, *, segs: DataFrame | None = None, slides: DataFrame | None = None, patterns: dict | None = None, positive: list | None = None, negative: list | None = None, most: int = 50, least: float = 0.3, shortest: float = 60.0, most_chapters: int = 15, below: float = 0.2) -> dict[str, DataFrame]:
    """All parts of the report on each of docs (video_id, title, text): topics, chapters, insights, actions, quotes, arc, tone, grades, quality, summary, markdown and json.

    scenes, changes: video_id, s; segs: recognised segments; slides: video_id, timestamp, text. Each is optional. What
    several parts read (sentences, chapters, insights, actions, arc) is written once, at the call.
    """
    once = kept
    none = lambda: docs.select("video_id", F.lit(0.0).alias("s")).limit(0)
    timed = once(speech.timed_sentences(docs) if segs is None else speech.timed_segments(segs, docs))
    length = timed.groupBy("video_id").agg(F.max("end").alias("duration"))
    videos = docs.select("video_id", F.coalesce("title", F.lit("")).alias("title")).join(length, "video_id", "left")
    ends = None if segs is None else segs.groupBy("video_id").agg(F.max("end").alias("end"))
    tops = segments.topics(docs, below=below, ends=ends)
    raw = once(segments.chapters(tops, shortest, most_chapters))
    chaps = enhanced_chapters(raw, scenes if scenes is not None else none(), changes if changes is not None else none())
    chaps = once(chaps)
    found = once(speech.findings(timed, patterns, least=least, most=most))
    acts = once(speech.actions(found, timed))
    arc = once(speech.sentiment_arc(timed, positive, negative))
    tone = speech.overall_sentiment(arc)
    graded = grades(videos, chaps, found, arc)
    brief = executive_summary(videos, chaps, found, acts, tone)
    said = speech.top_quotes(found).select("video_id", F.col("place").alias("idx"), "text", "start", F.col("importance").alias("score"))
    lists = {"chapters": chaps, "key_insights": found.select("video_id", "rank", "insight_id", "type", "text", "start", "end", "importance", "confidence"), "action_items": acts}
    return {
        "topics": tops, "chapters": chaps, "youtube": segments.chapter_list(raw), "insights": found, "actions": acts, "quotes": said, "arc": arc, "tone": tone, "grades": graded,
        "quality": insight_quality(docs, found, acts, arc), "summary": brief,
        "markdown": markdown(videos, brief, tone, graded, chaps, found, acts, said, arc, slides=slides), "json": as_json(videos, brief, tone, graded, lists),
    }
