"""Slides, turns, knowledge, reports and stores on small tables."""

import json

import numpy as np

from parlance.operators import graph, hooks, knowledge, segments, speakers, speech, summaries, visual
from parlance.sources import stores

TEXT = "Make sure to check the essential logs today. About 78% of users agree with it. Finally we are finished with the work. Ada Lovelace was here first, they say. " * 3


def parts(spark):
    docs = spark.createDataFrame([("v", TEXT), ("empty", None)], "video_id string, text string")
    timed = speech.timed_sentences(docs)
    found, arc = speech.insights(timed), speech.sentiment_arc(timed)
    chaps = spark.createDataFrame([("v", 0, "One", 0.0, 30.0, 30.0, "first", [0]), ("v", 1, "Two", 30.0, 90.0, 60.0, "", [1])], "video_id string, chapter_id int, title string, start_time double, end_time double, duration double, summary string, topic_ids array<int>")
    videos = spark.createDataFrame([("v", "Logs", 90.0), ("empty", None, None)], "video_id string, title string, duration double")
    return docs, timed, found, arc, chaps, videos


def test_slide_runs_compare_with_the_kept_one(spark):
    rows = [("v", 1.0, "a b c d", 0.8), ("v", 2.0, "a b c d", 0.9), ("v", 3.0, "a b c d", 0.85), ("v", 4.0, "x y", 0.5), ("v", 5.0, "", 0.5), ("v", 6.0, None, 0.5)]
    got = visual.distinct_slides(spark.createDataFrame(rows, "video_id string, timestamp double, text string, confidence double")).orderBy("slide").collect()
    assert [(r.timestamp, r.text) for r in got] == [(2.0, "a b c d"), (4.0, "x y"), (5.0, ""), (6.0, "")]


def test_logs_frames_and_words(spark):
    log = spark.createDataFrame([("v", "a pts_time:3.5 b"), ("v", "none"), ("v", None)], "video_id string, line string")
    assert [r.s for r in visual.times_in_log(log).collect()] == [3.5]
    v = spark.createDataFrame([("v", 20.0), ("w", 2000.0), ("z", 0.0)], "video_id string, duration double")
    assert {(r.video_id, r["count"]) for r in visual.frame_times(v).groupBy("video_id").count().collect()} == {("v", 4), ("w", 200)}
    w = spark.createDataFrame([("v", 1.0, 1, "world", 90.0), ("v", 1.0, 0, "hello", 80.0), ("v", 1.0, 2, "no", 40.0), ("v", 1.0, 3, " ", 99.0)], "video_id string, timestamp double, ord int, word string, conf double")
    assert [tuple(r)[2:] for r in visual.slides(w).collect()] == [("hello world", 0.85, "en")]


def test_frame_classes(spark):
    light = np.full((480, 640, 3), 255, np.uint8)
    light[::4] = 0
    rows = [("v", 1.0, 480, 640, 3, light.tobytes()), ("v", 2.0, 4, 4, 1, bytes(16)), ("v", 3.0, 4, 4, 1, None)]
    frames = spark.createDataFrame(rows, "video_id string, timestamp double, height int, width int, channels int, pixels binary")
    found = visual.diagrams(frames)
    assert [(r.timestamp, r.kind) for r in found.collect()] == [(1.0, visual.DENSE)]
    v = spark.createDataFrame([("v",), ("w",)], "video_id string")
    slide = spark.createDataFrame([("v", 0, 1.0, "x" * 120, 0.9)], "video_id string, slide int, timestamp double, text string, confidence double")
    scenes = spark.createDataFrame([("v", 3.0)], "video_id string, s double")
    got = {r.video_id: r.summary.split("\n") for r in visual.visual_summary(v, frames, slide, found, scenes).collect()}
    assert got["v"][0] == "Analyzed 3 frames from video." and len(got["v"]) == 5 and got["v"][2].endswith('x..."') and got["w"] == ["Analyzed 0 frames from video."]


def test_silence_turns(spark):
    v = spark.createDataFrame([("v", 12.0), ("w", 3.0)], "video_id string, duration double")
    s = spark.createDataFrame([("v", 2.0), ("v", 2.2), ("v", 5.0)], "video_id string, s double")
    got = speakers.silence_turns(v, s).orderBy("video_id", "idx").collect()
    assert [(r.speaker_id, r.start, r.end) for r in got] == [("SPEAKER_00", 0.0, 2.0), ("SPEAKER_00", 2.2, 5.0), ("SPEAKER_01", 5.0, 12.0), ("SPEAKER_00", 0.0, 3.0)]


def test_embedding_scores_against_brute_force(spark):
    text = " ".join(f"Word{i % 3} number {i} is standing here." for i in range(9))
    got = {r.idx: r.similarity for r in segments.embedding_scores(spark.createDataFrame([("v", text), ("e", None)], "video_id string, text string")).collect()}
    e = hooks.hashed([f"Word{i % 3} number {i} is standing here." for i in range(9)])
    assert set(got) == set(range(2, 7))
    for i, x in got.items():
        a, b = e[i - 2 : i].mean(0), e[i : i + 2].mean(0)
        assert abs(x - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-5


def test_models_fall_back(spark):
    def broken(pdf):
        raise RuntimeError

    df = spark.range(3)
    assert sorted(r.id for r in hooks.with_model(df, "id long", broken, lambda p: p + 1).collect()) == [1, 2, 3]


def test_replies(spark):
    rows = [("a", "T", '{"summary": "s", "key_concepts": [{"concept": "Dharma", "explanation": "law"}], "follow_up_topics": ["dharma", "Yoga"]}'), ("b", "T", "Key concepts:\n- One thing\n* " + "x" * 60 + "\nQuotes\n- said\nQuestions\n- why?\n- no mark"), ("c", None, None)]
    k = knowledge.parsed(spark.createDataFrame(rows, "video_id string, title string, reply string"))
    got = {r.video_id: r for r in k.collect()}
    assert got["a"].summary == "s" and got["a"].study_questions == knowledge.QUESTIONS and got["a"].key_quotes == []
    assert [c.concept for c in got["b"].key_concepts] == ["One thing", "x" * 50 + "..."] and got["b"].key_quotes == ["said"] and got["b"].study_questions[-1] == "why?"
    assert got["c"].summary == knowledge.UNTITLED_SUMMARY
    e = {r.name: r.frequency for r in knowledge.entities(k).filter("video_id = 'a'").collect()}
    assert e == {"Dharma": 1, "Yoga": 1}


def test_chapters_move_to_scenes(spark):
    *_, chaps, _ = parts(spark)
    points = lambda *xs: spark.createDataFrame([("v", x) for x in xs], "video_id string, s double")
    got = summaries.enhanced_chapters(chaps, points(25.0, 35.0, 95.0), points(50.0)).orderBy("chapter_id").collect()
    assert [(r.start_time, r.end_time, r.scene_change_count, r.has_speaker_change, r.confidence) for r in got] == [(0.0, 25.0, 1, False, 0.75), (25.0, 95.0, 3, True, 0.95)]
    assert got[0].buffer_start == 0.0 and got[1].buffer_end == 97.0


def test_reports(spark):
    docs, timed, found, arc, chaps, videos = parts(spark)
    acts, tone, said = speech.actions(found, timed), speech.overall_sentiment(arc), speech.quotes(timed)
    graded = summaries.grades(videos, chaps, found, arc)
    g = {r.video_id: r for r in graded.collect()}
    assert g["v"].chapter_coverage == 1.0 and g["v"].grade in "ABC" and g["empty"].grade == "F"
    q = {r.video_id: r.quality for r in summaries.insight_quality(docs, found, acts, arc).collect()}
    assert 0 < q["v"] <= 1 and q["empty"] == 0
    brief = summaries.executive_summary(videos, chaps, found, acts, tone)
    b = {r.video_id: r.executive_summary for r in brief.collect()}
    assert b["v"].startswith('"Logs" covers 2 main sections.\n\nKey sections:\n• One: first\n\nKey takeaways:\n• ') and len(b["v"]) <= 500 and "Two:" not in b["v"]
    body = {r.video_id: r.body for r in summaries.markdown(videos, brief, tone, graded, chaps, found, acts, said, arc).collect()}
    heads = [x for x in body["v"].split("\n") if x.startswith("## ")]
    assert heads[:4] == ["## Executive Summary", "## Chapters", "## YouTube Chapters", "## Key Insights"] and heads[-2:] == ["## Sentiment Arc", "## Quality Report"]
    assert "### 1. One [0:00]\n\nfirst\n" in body["v"] and "## Chapters" not in body["empty"]
    j = {r.video_id: json.loads(r.body) for r in summaries.as_json(videos, brief, tone, graded, {"chapters": chaps, "key_insights": found}).collect()}
    assert [c["title"] for c in j["v"]["chapters"]] == ["One", "Two"] and j["empty"]["chapters"] == [] and j["v"]["quality_report"]["grade"] == g["v"].grade


def test_slides_in_chapters(spark):
    *_, chaps, _ = parts(spark)
    s = spark.createDataFrame([("v", 30.0, "at the border"), ("v", 40.0, "x" * 300)], "video_id string, timestamp double, text string")
    got = {r.chapter_id: [len(x) for x in r.slide_texts] for r in summaries.chapter_slides(chaps, s).collect()}
    assert got == {0: [13], 1: [13, 200]}


def test_stores(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    c = spark.createDataFrame([("1", "a"), ("2", "b")], "chunk_id string, chunk string")
    path = str(tmp_path / "chunks")
    stores.add_chunks(c, path)
    stores.add_chunks(c, path)
    assert stores.load(spark, path).count() == 2
    assert not stores.clear(spark, path) and stores.clear(spark, path, True) and not stores.exists(spark, path)
    e = spark.createDataFrame([("v", "e1", "A", "concept", 1)], "video_id string, entity_id string, name string, entity_type string, frequency long")
    assert stores.load_graph(spark, str(tmp_path / "g")) is None
    stores.save_graph(str(tmp_path / "g"), e, e.select(F_("entity_id"), F_("entity_id", "b")), e)
    assert stores.load_graph(spark, str(tmp_path / "g"))[0].count() == 1
    s = graph.statistics(e, e, e.limit(0)).first()
    assert (s.entities, s.concepts, s.terms, s.relationships, s.cross_references, s.entities_per_video) == (1, 1, 0, 1, 0, 1.0)
    store = str(tmp_path / "insights")
    two = spark.createDataFrame([("v", "x"), ("w", "y")], "video_id string, text string")
    summaries.store_insights(two, store)
    got = summaries.store_insights(spark.createDataFrame([("v", "new"), ("v", "more")], "video_id string, text string"), store)
    assert sorted((r.video_id, r.text) for r in got.collect()) == [("v", "more"), ("v", "new"), ("w", "y")]


def F_(name, alias=None):
    from pyspark.sql import functions as F

    return F.col(name).alias(alias or name)


def test_captions(spark):
    rows = [("a", {"hi": [("नमस्ते", None)]}, {"en": [(None, "hello"), ("there", "x")]}), ("b", {}, {}), ("c", {"fr": [("salut", None)]}, None)]
    df = spark.createDataFrame(rows, "video_id string, subtitles map<string,array<struct<data:string,text:string>>>, automatic map<string,array<struct<data:string,text:string>>>")
    assert {r.video_id: (r.text, r.language) for r in stores.captions(df).collect()} == {"a": ("hello there", "en"), "b": ("", "unknown"), "c": ("salut", "fr")}
