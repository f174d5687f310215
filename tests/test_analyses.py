"""Findings, retrieval, graphs, requests and media on small texts written for these tests."""

import collections
import datetime
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import parlance
from parlance import config
from parlance.operators import graph, knowledge, multimodal, retrieval, segments, speakers, speech, summaries, vectors, visual
from parlance.plans import reports
from parlance.sources import media, stores
from parlance.streaming import access, limits


def docs(spark, *texts, **more):
    return spark.createDataFrame([(f"v{i}", t) for i, t in enumerate(texts)], "video_id string, text string")


def test_findings_are_numbered_before_they_meet(spark):
    timed = speech.timed_sentences(docs(spark, reports.FIXTURE["x-twice"], reports.FIXTURE["x-talk"], ""))
    rows = speech.findings(timed, backreference=False).orderBy("video_id", "rank").collect()
    assert not [r for r in rows if r.video_id == "v2"]
    by = {r.insight_id: r for r in rows}
    assert all(i.split("-")[1] == r.video_id for i, r in by.items()) and len(by) == len(rows)
    rep = by["REP-v0-0001"]
    # Of equally frequent phrases the shorter comes first, and longer ones that contain it are passed over.
    assert rep.text == "the elegant engine" and rep.context == "Repeated 3 times across the video" and rep.importance == 0.7 and rep.tags == ["repetition", "emphasis"]
    assert {r.type for r in rows if r.insight_id.startswith("QUO")} == {"quote"}
    assert [r.importance for r in rows if r.video_id == "v1"] == sorted((r.importance for r in rows if r.video_id == "v1"), reverse=True)
    tagged = next(r for r in rows if "API logs" in r.text)
    assert set(tagged.tags) >= {"API", "infrastructure"}
    assert speech.highlights(speech.findings(timed), 1).count() == 2
    turns = spark.createDataFrame([("v1", "A", 0, 0.0, 5.0), ("v1", "B", 1, 5.0, 999.0)], "video_id string, speaker_id string, idx int, start double, end double")
    got = {(r.video_id, r.start): r.speaker_id for r in speech.with_speakers(speech.findings(timed), turns).collect()}
    assert all(w is None if v == "v0" else w == ("A" if s <= 5 else "B") for (v, s), w in got.items())


def test_segments_give_the_times(spark):
    seg = spark.createDataFrame([("v0", 0, 1.5, 4.0, " First part. "), ("v0", 1, 4.0, 6.0, " "), ("v0", 2, 6.0, 9.0, "Second part"), ("v1", 0, 0.0, 1.0, None)], "video_id string, ord int, start double, end double, text string")
    d = docs(spark, "never read", "Read in full here. And so is this one.")
    rows = [(r.video_id, r.idx, r.sentence, r.start, r.end, r.total) for r in speech.timed_segments(seg, d).orderBy("video_id", "idx").collect()]
    assert rows[:2] == [("v0", 0, "First part.", 1.5, 4.0, 2), ("v0", 1, "Second part", 6.0, 9.0, 2)]
    assert [r[2] for r in rows[2:]] == ["Read in full here.", "And so is this one."]


def test_long_clocks_add_up(spark):
    text = "One two three four. " * 1000 + "The end of all."
    rows = speech.timed_sentences(docs(spark, text)).orderBy("idx").collect()
    assert [r.start for r in rows] == [round(i * 1.6, 1) for i in range(1001)] and rows[-1].end == 1601.6


def test_topics_take_their_share_of_the_time(spark):
    d = docs(spark, " ".join(["Green apples ripen slowly."] * 6 + ["Diesel engines burn fuel."] * 6))
    ends = spark.createDataFrame([("v0", 120.0)], "video_id string, end double")
    rows = segments.topics(d, ends=ends).orderBy("topic_id").collect()
    assert rows[0].start_time == 0.0 and rows[-1].end_time == 120.0 and len(rows) > 1
    assert all(r.start_time == r.start_index * 10.0 for r in rows)


def test_chapters_join_the_shortest_neighbours(spark):
    rows = [("v", i, f"t{i}", f"s{i}", "x" * (i + 1), [f"k{i}"], float(sum(d[:i])), float(sum(d[: i + 1]))) for d in [[70, 61, 200, 65, 62, 90]] for i in range(6)]
    tops = spark.createDataFrame(rows, "video_id string, topic_id int, title string, summary string, text string, keywords array<string>, start_time double, end_time double")
    got = segments.chapters(tops, most=3).orderBy("chapter_id").collect()
    # 65 + 62 first, then 70 + 61, then those 127 with 90.
    assert [r.topic_ids for r in got] == [[0, 1], [2], [3, 4, 5]] and [r.title for r in got] == ["t1", "t2", "t5"]
    assert segments.chapters(tops, most=1).collect()[0].topic_ids == [0, 1, 2, 3, 4, 5]


def test_chunks_keep_whole_parts():
    text = "First paragraph here.\n\nSecond one, with commas, and more words than fit into one chunk of this size; truly.\n\nThird."
    got = retrieval.chunked(text, 40, 10)
    assert all(len(c) <= 40 for c in got) and got[0] == "First paragraph here." and got[-1] == "Third."
    assert retrieval.chunked("x" * 95, 40, 10) == ["x" * 40, "x" * 40, "x" * 35]
    assert retrieval.chunked(None) == retrieval.chunked("  \n\n ") == []
    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choice(["word", " ", ". ", "\n", "\n\n", "।", "x" * 30]) for _ in range(rng.randrange(80)))
        c = retrieval.chunked(t, 50, 15)
        at = 0
        for x in c:  # every chunk stands in the text, in order, and nothing but white space is left out
            assert len(x) <= 50 and t.find(x, max(0, at - 50)) >= 0
            at = t.find(x, max(0, at - 50)) + len(x)
        assert set("".join(t.split())) <= set("".join(c))


def test_chunk_store(spark, tmp_path):
    d = docs(spark, "Some words to keep. " * 40, "", None).withColumn("title", F.lit("T"))
    path = str(tmp_path / "store")
    n = {r.video_id: r.chunks for r in stores.add_videos(d, path).collect()}
    assert n.keys() == {"v0"} and {r.video_id: r.chunks for r in stores.add_videos(d, path).collect()} == n
    q = spark.createDataFrame([(1, "some words to keep"), (2, "zzz qqq")], "query_id long, question string")
    ans, src = retrieval.query_knowledge(q, stores.load(spark, path).withColumn("timestamp", F.lit(1.0)), k=2)
    a = {r.query_id: r for r in ans.collect()}
    assert a[1].answer.startswith("[Source 1] ") and a[1].confidence == "high" and a[2].confidence == "low" and a[1].chunks_found == 2
    assert {(r.title, r.timestamp) for r in src.collect()} == {("T", 1.0)}


def test_answers_tell_failures(spark):
    q = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "none")], "query_id long, question string")
    hits = spark.createDataFrame([(1, 1, "text", 0.9), (2, 1, "text", 0.9)], "query_id long, rank int, chunk string, score double")

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        if "bad" in batch["prompt"].iloc[0]:
            raise ValueError("no such luck")
        return batch[["query_id"]].assign(answer=" fine ")

    got = retrieval.answers(q, hits, model)
    a = {r.query_id: r for r in got.collect()}
    assert (a[1].answer, a[1].confidence, a[1].error) == ("fine", "high", None)
    assert (a[2].confidence, a[2].error) == ("error", "no such luck") and a[3].answer == retrieval.NOTHING and a[3].confidence == "low"
    assert tuple(retrieval.batch_report(got).first()) == (3, 2, 1)


@pytest.mark.parametrize("held", [1 << 22, 0])
def test_batched_similarity(spark, held, monkeypatch):
    """held=0 deals vectors and queries to groups."""
    monkeypatch.setattr(vectors, "HELD", held)
    rng = random.Random(2)
    v = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(60)] + [(99, None), (98, [0.0] * 4)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in vectors.similar_batch(df, df.filter("vec_id < 20 or vec_id > 97").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 3, block=7).collect():
        got[r.query_id].append((-r.score, r.vec_id))
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5), 6) + 0.0 if a and b and any(a) and any(b) else 0.0
    assert got.keys() == {*range(20), 98, 99}
    for i, best in got.items():
        want = sorted((-cos(dict(v)[i], b), j) for j, b in v)[:3]
        assert sorted(best) == want


def test_related_topics_and_context(spark):
    q = spark.createDataFrame([(1, "the engines")], "query_id long, question string")
    hits = spark.createDataFrame(
        [(1, 1, 0.9, "a", "Talk: of ages!", "Grace Hopper met Engines and Ada Lovelace. Mary Shelley."), (1, 2, 0.8, "b", "Short", "Grace Hopper again")],
        "query_id long, rank int, score double, video_id string, title string, chunk string",
    )
    rows = [(r.topic, r.relevance_score, r.video_count) for r in retrieval.related_topics(hits, q).orderBy("place").collect()]
    assert rows == [("Talk of ages", 0.9, 1), ("Grace Hopper", 0.9, 2), ("Ada Lovelace", 0.9, 1)]
    assert retrieval.context(hits).first().context.split("\n\n")[1] == "[Source 2] Grace Hopper again"


def test_relationships_and_graph(spark):
    d = docs(spark, "Ada Lovelace met Grace Hopper. Grace Hopper left? Ada Lovelace and Grace Hopper wrote", "Grace Hopper and Ada Lovelace again")
    ents = graph.entities(d, ordered=True)
    rel = graph.relationships(d, ents)
    ids = {r.name: r.entity_id for r in ents.collect()}
    rows = {(r.source_id, r.target_id): (r.weight, r.context, r.source_video) for r in rel.collect()}
    a, g = ids["Ada Lovelace"], ids["Grace Hopper"]
    assert rows == {(a, g): (2.0, "Ada Lovelace met Grace Hopper", "v0"), (g, a): (1.0, "Grace Hopper and Ada Lovelace again", "v1")}
    refs = graph.cross_references(ents)
    one = graph.build_graph(ents, rel, refs)
    two = graph.build_graph(ents, rel, refs, one)
    assert two.mentions.count() == one.mentions.count() and two.references.count() == one.references.count()
    assert {r.weight for r in two.relations.collect()} == {4.0, 2.0}
    got = graph.query(one, name="hopper", depth=1)
    assert {r.name for r in got["entities"].collect()} == {"Grace Hopper"} and [r.node for r in got["nodes"].collect()] == [a]
    assert got["relationships"].count() == 2 and got["cross_references"].count() == 1
    assert graph.query(one, name="nobody")["relationships"].count() == 0
    assert {r.name: r.connections for r in graph.named_degrees(rel, ents).collect()} == {"Ada Lovelace": 2, "Grace Hopper": 2}


def test_concepts_explain_terms_and_extractors_unite(spark):
    reply = json.dumps({"key_concepts": [{"concept": "Self", "explanation": "The atman within"}, {"concept": "Other", "explanation": "none"}], "sanskrit_terms": [{"term": "आत्मन्", "meaning": "soul", "transliteration": "Atman"}, {"term": "x", "meaning": "", "transliteration": ""}]})
    known = knowledge.parsed(spark.createDataFrame([("v0", "t", reply)], "video_id string, title string, reply string"))
    ner = graph.recognised(docs(spark, "text"), lambda b: pd.DataFrame({"video_id": b["video_id"], "name": " Self ", "label": "ORG"}))
    ents = graph.united(knowledge.entities(known), ner)
    rows = {r.name: r for r in ents.collect()}
    assert rows["Self"].frequency == 2 and rows["Self"].description == "The atman within" and rows["Self"].entity_type == "concept"
    rel = graph.relationships(docs(spark, ""), ents, known).filter("relation_type = 'explains'").collect()
    assert [(r.source_id, r.target_id, r.weight, r.context) for r in rel] == [(rows["Self"].entity_id, rows["आत्मन्"].entity_id, 2.0, "Self relates to आत्मन्")]
    assert graph.recognised(docs(spark, "text")).count() == 0
    body = knowledge.markdown(spark.createDataFrame([("v0", "T", "en", "captions", None, "u")], "video_id string, title string, language string, source string, duration double, url string"), known).first().body
    assert body.startswith("# T\n\n**Video ID:** v0") and "### Self\n\nThe atman within\n\n" in body and "- **आत्मन्** (Atman): soul\n" in body and "## Key Quotes" not in body


def requests(n, seed):
    rng, t0 = random.Random(seed), datetime.datetime(2024, 1, 1)
    rows, at = [], 0.0
    for i in range(n):
        at += 900 if rng.random() < 0.01 else rng.choice([0.2, 0.5, 2, 5])
        rows.append((i, t0 + datetime.timedelta(seconds=at), rng.choice(["POST", "POST", "OPTIONS"]), rng.choice(["/query", "/ingest", "/health"]), f"ip{rng.randrange(3)}", rng.choice([None, None, "a", "p", "bad"]), rng.choice([None, True, False]), rng.choice([200, 200, 500])))
    return rows


def test_requests_in_order(spark):
    """Against one pass over all requests, as a single server would see them."""
    rows = requests(800, 5)
    keys = access.api_keys(spark, "a:alpha, p:pro,broken, q:r:gold", alpha="z")
    tiers = {r.api_key: r.tier for r in keys.collect()}
    assert tiers == {"a": "alpha", "p": "pro", "q:r": "alpha", "z": "alpha"}
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, method string, path string, ip string, api_key string, captcha boolean, status int").repartition(4)
    got = {r.event_id: (r.outcome, r.status, r.tier) for r in access.classified(df, keys, secret=True).collect()}
    fails, until, buckets, want = collections.defaultdict(list), {}, {}, {}
    for i, ts, method, path, ip, key, captcha, status in rows:
        now = ts.timestamp()
        if ip in until and now >= until[ip]:
            del until[ip]
            fails[ip] = []
        tier = tiers.get(key, "anonymous")
        guarded, failed = tier == "anonymous" and path in access.GUARDED, False
        if path == "/health" or method == "OPTIONS":
            want[i] = ("exempt", status, tier)
        elif ip in until:
            want[i] = ("blocked", 403, tier)
        elif key and key not in tiers:
            want[i], failed = ("invalid_key", 401, tier), True
        elif guarded and captcha is None:
            want[i] = ("captcha_required", 403, tier)
        elif guarded and captcha is False:
            want[i], failed = ("captcha_failed", 403, tier), True
        else:
            most = {"anonymous": 3, "alpha": 10, "pro": 100}[tier]
            tokens, last = buckets.get(key or ip, (most, now))
            tokens = min(most, tokens + (now - last) / 3600 * most)
            ok = tokens >= 1
            buckets[key or ip] = (tokens - ok, now)
            want[i], failed = (("ok", status, tier), status >= 400) if ok else (("rate_limited", 429, tier), True)
        if failed:
            if not fails[ip] or now - fails[ip][0] > 300:
                fails[ip] = []
            fails[ip].append(now)
            if len(fails[ip]) >= 10:
                until[ip] = now + 600
    assert got == want and {x[0] for x in want.values()} >= {"ok", "invalid_key", "rate_limited", "captcha_required", "captcha_failed", "exempt", "blocked"}


def test_who_asks(spark):
    rows = [({"x-forwarded-for": " 1.1.1.1 , 2.2.2.2"}, {}, "h"), ({"x-real-ip": "3.3.3.3 ", "authorization": "Bearer  k1 "}, {}, "h"), ({"authorization": "APIKEY k2"}, {}, None), ({"x-api-key": " k3"}, {"api_key": "no"}, "h"), ({}, {"api_key": "k4"}, "h"), ({"authorization": "Basic x"}, {}, "h")]
    df = spark.createDataFrame(rows, "headers map<string, string>, asked map<string, string>, host string")
    got = df.select(access.client_ip(F.col("headers"), F.col("host")).alias("ip"), access.api_key(F.col("headers"), F.col("asked")).alias("k")).collect()
    assert [(r.ip, r.k) for r in got] == [("1.1.1.1", None), ("3.3.3.3", "k1"), ("unknown", "k2"), ("h", "k3"), ("h", "k4"), ("h", None)]
    one = spark.createDataFrame([(True, 0.9), (True, 0.1), (False, 0.9), (None, None)], "s boolean, x double")
    assert [r.p for r in one.select(access.captcha_passes(F.col("s"), F.col("x")).alias("p")).collect()] == [True, False, False, True]


def test_buckets_over_a_stream(spark, tmp_path):
    """Batches of files in order give what one batch gives; state of idle users goes."""
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(u, i * 10 + u, t0 + datetime.timedelta(minutes=7 * i + u)) for i in range(30) for u in range(3)]
    schema = "user_id long, event_id long, ts timestamp"
    whole = {(r.event_id, r.allowed, r.retry_after) for r in limits.rate_limit(spark.createDataFrame(rows, schema), 2).collect()}
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], schema).coalesce(1).write.mode("append").parquet(src)
    q = limits.rate_limit_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), 2).writeStream.format("memory").queryName("passed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_id, r.allowed, r.retry_after) for r in spark.table("passed").collect()} == whole


def test_media(spark):
    r = media.recognised(spark.createDataFrame([("a", '{"text": "hi", "segments": [{"start": 1.0, "text": "x"}]}'), ("b", '{"segments": []}'), ("c", None)], "video_id string, reply string"))
    rows = {x.video_id: x for x in r.collect()}
    assert [tuple(s) for s in rows["a"].segments] == [(1.0, 0.0, "x")] and rows["a"].language == "unknown" and rows["b"].segments is None and rows["c"].text == ""
    assert [(x.ord, x.text) for x in media.segment_rows(r).collect()] == [(0, "x")]
    assert media.speech_replies(spark.createDataFrame([("a", "p")], "video_id string, path string")).first().reply is None
    entry = "array<struct<data: string, text: string>>"
    v = spark.createDataFrame([("a", {}, {}), ("b", {"en": [("said", None)]}, {})], f"video_id string, subtitles map<string, {entry}>, automatic map<string, {entry}>")
    got = {x.video_id: (x.text, x.language, x.source) for x in media.transcribed(v, r).collect()}
    assert got == {"a": ("hi", "unknown", "whisper"), "b": ("said", "en", "captions")}
    log = spark.createDataFrame([("a", "duration=12.5"), ("a", "noise"), ("b", "no number")], "video_id string, line string")
    assert {x.video_id: x.duration for x in media.durations(log).collect()} == {"a": 12.5, "b": 0.0}


def test_settings(spark):
    assert config.settings(env={"PARLANCE_CHUNK_SIZE": "80"}).chunk_size == 80
    with pytest.raises(ValueError):
        config.settings(env={}).checked()
    spark.conf.set("spark.parlance.frame_interval", "2.5")
    try:
        assert config.settings(spark, env={"PARLANCE_FRAME_INTERVAL": "9"}).frame_interval == 2.5
    finally:
        spark.conf.unset("spark.parlance.frame_interval")


def test_whole_reports(spark):
    d = docs(spark, reports.FIXTURE["x-talk"] * 4, "", reports.FIXTURE["x-gita"]).withColumn("title", F.lit("T"))
    slides = spark.createDataFrame([("v0", 1.0, "A slide")], "video_id string, timestamp double, text string")
    out = summaries.summarize(d, slides=slides)
    body = {r.video_id: r.body for r in out["markdown"].collect()}
    assert "**Slides:**\n> A slide" in body["v0"] and "## Notable Quotes" in body["v0"] and "## Action Items" in body["v0"] and "Slides" not in body["v2"]
    j = {r.video_id: json.loads(r.body) for r in out["json"].collect()}
    assert j["v0"]["action_items"][0]["action_id"].startswith("ACT-") and j["v1"]["key_insights"] == []
    turns = speakers.timed_turns(spark.createDataFrame([("v0", "A", 0, "I am so happy and grateful"), ("v0", "B", 1, "war and fury")], "video_id string, speaker_id string, idx int, text string"))
    voices = speakers.analysis(turns)
    assert voices["emotion_report"].first().dominant_emotion == "joy" and {r.speaker_id: r.sample_texts for r in voices["profiles"].collect()}["B"] == ["war and fury"]
    modelled = speakers.modelled_emotions(turns, lambda b: b[["video_id", "idx"]].assign(emotion="fear", score=0.5)).collect()
    assert {(r.emotion, r.score, r.sentiment) for r in modelled} == {("fear", -0.5, "negative")}
    ents = graph.entities(d, ordered=True)
    m = multimodal.merged(d, voices=voices, topics=out["topics"], chapters=out["chapters"], mentions=ents, edges=graph.relationships(d, ents), references=graph.cross_references(ents))
    b = {r.video_id: json.loads(r.body) for r in m.collect()}
    assert b["v0"]["speakers"]["total_speakers"] == 2 and len(b["v2"]["knowledge_graph"]["key_entities"]) > 1 and "speakers" not in b["v1"]
    lone = speakers.lone_speaker(d, spark.createDataFrame([("v0", 0, 0.0, 4.0, "hello")], "video_id string, ord int, start double, end double, text string")).collect()
    assert {r.video_id: (r.duration, r.segments, r.sample_texts) for r in lone} == {"v0": (4.0, 1, ["hello"]), "v1": (0.0, 0, []), "v2": (0.0, 0, [])}


def test_words_on_frames(spark):
    w = spark.createDataFrame([("v", 0.0, 0, "edge", 40.0), ("v", 0.0, 1, "sure", 90.0)], "video_id string, timestamp double, ord int, word string, conf double")
    assert [visual.slides(w, inclusive=x).first().text for x in (False, True)] == ["sure", "edge sure"]


def test_graph_grows_by_batches(spark, tmp_path):
    path = str(tmp_path / "graph")

    def extract(d):
        e = graph.entities(d, ordered=True)
        return e, graph.relationships(d, e), graph.cross_references(e)

    for d in (docs(spark, "Ada Lovelace met Grace Hopper."), docs(spark, "Ada Lovelace met Grace Hopper.", "Ada Lovelace met Grace Hopper once.")):
        multimodal.updated(d, path, extract)
    mentions, relations, references = stores.load_graph(spark, path)
    assert mentions.count() == 4 and references.count() == 1


def test_package_names():
    for name in parlance.__all__:
        assert callable(getattr(parlance, name))
    with pytest.raises(AttributeError):
        parlance.nothing  # noqa: B018
