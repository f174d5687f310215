"""Queries over whole analyses: findings, topics, graphs, retrieval, requests. With the same in SQL.

Operators' default patterns find little in the tables' invented prose, so the `default_` queries also read the fixture
texts below: they are rows beside those of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance import lexicons as lex
from parlance.operators import graph, knowledge, multimodal, retrieval, segments, speakers, speech, summaries, vectors, visual
from parlance.plans import catalog as c
from parlance.sources import media
from parlance.sources.scratch import kept
from parlance.sources.tables import table, transcripts, turns
from parlance.streaming import access

FIXTURE = {
    "x-talk": "Importantly, you should note that Grace Hopper wrote the first compiler. Make sure to check the API logs on the server today. "
    "According to Ada Lovelace, 78%of users agree with the cloud plan. What if the cache is slow? Simply put, latency is defined as waiting time. "
    "In conclusion, the bottom line is that great tools win. Now let's move on to security. Always believe in the power of change as if it never ends. "
    'He said "never give up on every truth" and left. Never skip the tests. Great excellent work and a terrible failure. A happy success without any bug.',
    "x-gita": "The Bhagavad Gita and the Rig Veda are read by Swami Vivekananda in the morning. आत्मा और ब्रह्म एक हैं। Swami Vivekananda speaks of devotion and peace. "
    "The Bhagavad Gita is read once more by Swami Vivekananda in the evening. Love and wisdom bring peace to the guru. Fear and anger lead to war and grief.",
    "x-twice": "We love the elegant engine of tomorrow today. Remember to test the elegant engine of tomorrow well. The elegant engine of tomorrow is done. "
    "Don't forget the plan we made. Don't forget the plan we made. Ensure it costs US$5 million in total.",
    "x-none": "",
}


def _docs(s, d) -> DataFrame:
    more = s.createDataFrame([(k, v, "en", "fixture") for k, v in FIXTURE.items()], "video_id string, text string, language string, source string")
    return transcripts(s, d).unionByName(more)


def _timed(s, d):
    return speech.timed_sentences(_docs(s, d))


def _findings(s, d):
    return speech.findings(c._timed(s, d), c.PATTERNS, strong=c.STRONG, backreference=False)


def findings(s, d):
    return _findings(s, d).select("video_id", "rank", "insight_id", "type", "start", "end", "importance", "confidence", F.md5("text").alias("text_md5"))


def default_findings(s, d):
    found = speech.findings(_timed(s, d), backreference=False)
    return found.select("video_id", "rank", "insight_id", "type", "importance", "confidence", F.md5("context").alias("context_md5"), F.array_join(F.array_sort("tags"), ",").alias("tags"))


def default_quotes(s, d):
    return speech.quotes(_timed(s, d), backreference=False).select("video_id", "idx", "score", "text")


def default_arc(s, d):
    return speech.sentiment_arc(_timed(s, d))


def default_entities(s, d):
    return graph.entities(_docs(s, d))


def default_emotions(s, d):
    said = _timed(s, d).select("video_id", F.lit("A").alias("speaker_id"), "idx", "start", "end", F.col("sentence").alias("text"))
    return speakers.emotions(said)


def action_items(s, d):
    timed = _timed(s, d)
    return speech.actions(speech.insights(timed), timed).select("video_id", "action_id", "text", "priority", "start", "confidence")


def reel_statistics(s, d):
    timed = _timed(s, d)
    return speech.reel_stats(timed.groupBy("video_id").agg(F.max("end").alias("duration")), speech.insights(timed), speech.actions(speech.insights(timed), timed))


def insight_type_counts(s, d):
    return speech.type_counts(speech.insights(c._timed(s, d), c.PATTERNS))


def sentiment_distribution(s, d):
    return speech.tone_counts(c.sentiment_arc(s, d))


def default_topics(s, d):
    return segments.topics(transcripts(s, d)).withColumn("keywords", F.array_join("keywords", " "))


def topic_durations(s, d):
    return segments.average_duration(segments.topics(transcripts(s, d)))


def default_chapters(s, d):
    return segments.chapters(segments.topics(transcripts(s, d))).withColumn("topic_ids", F.array_join(F.transform("topic_ids", lambda x: x.cast("string")), ","))


def chapter_topics(s, d):
    none = F.array().cast("array<int>")
    out = summaries.chapter_topics(c._minutes(s, d).withColumn("topic_ids", none), segments.topics(transcripts(s, d)))
    return out.withColumn("topic_ids", F.array_join(F.transform("topic_ids", lambda x: x.cast("string")), ","))


def split_manifest(s, d):
    chaps = summaries.enhanced_chapters(c._minutes(s, d), c._timed(s, d).filter("idx % 4 = 1").select("video_id", F.col("start").alias("s")), c._timed(s, d).limit(0).select("video_id", F.col("start").alias("s")))
    return summaries.split_manifest(chaps)


def chapter_slides(s, d):
    shown = turns(s, d).select("video_id", (F.col("idx") * 5.0).alias("timestamp"), "text")
    return summaries.chapter_slides(c._minutes(s, d), shown).select("video_id", "chapter_id", F.md5(F.array_join("slide_texts", "|")).alias("slides_md5"), F.size("slide_texts").alias("n"))


def index_statistics(s, d):
    return summaries.index_totals(summaries.index_entries(speech.insights(c._timed(s, d), c.PATTERNS)))


def default_ids(s, d):
    return transcripts(s, d).select("video_id", media.default_id(F.col("text")).alias("default_id"))


def default_durations(s, d):
    said = turns(s, d).select("video_id", (F.col("idx") * 2.0 + 1.5).alias("end"))
    return media.default_duration(transcripts(s, d), said)


def caption_choice(s, d):
    entry = F.array(F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("data"), F.coalesce("text", F.lit("")).alias("text")))
    v = table(s, d, "documents").select("doc_id", "lang", "source", "text", entry.alias("e"))
    v = v.select(F.col("doc_id").cast("string").alias("video_id"), F.map_filter(F.create_map("lang", "e"), lambda k, _: F.col("doc_id") % 2 == 0).alias("subtitles"), F.map_filter(F.create_map(F.lit("hi"), "e", F.lit("xx"), "e"), lambda k, _: F.col("doc_id") % 4 < 3).alias("automatic"))
    return media.captions(v).select("video_id", F.md5("text").alias("text_md5"), "language")


def speaker_samples(s, d):
    return speakers.full_profiles(c._turns(s, d)).select("video_id", "speaker_id", "rank", F.md5(F.array_join("sample_texts", "|")).alias("samples_md5"), F.size("sample_texts").alias("n"))


def emotion_reports(s, d):
    r = speakers.emotion_report(c.emotions(s, d))
    return r.select("video_id", "dominant_emotion", "avg_sentiment_score", "overall_sentiment", "segments")


def default_slide_runs(s, d):
    t = turns(s, d).select("video_id", F.col("idx").cast("double").alias("timestamp"), "text", (F.length(F.coalesce("text", F.lit(""))) % 10 / F.lit(10.0)).alias("confidence"))
    return visual.distinct_slides(t).select("video_id", "slide", "timestamp", "confidence")


# ---------------------------------------------------------------- graph


def _ordered(s, d):
    return graph.entities(transcripts(s, d), name=c.NAME, ordered=True)


def relationships(s, d):
    r = graph.relationships(transcripts(s, d), _ordered(s, d))
    return r.select("source_id", "target_id", "relation_type", "weight", F.md5("context").alias("context_md5"), "source_video")


def entity_nodes(s, d):
    n = graph.entity_nodes(c._entities(s, d))
    return n.select("entity_id", "name", "entity_type", "frequency", F.md5(F.array_join("source_videos", ",")).alias("videos_md5"), F.size("source_videos").alias("n_videos"))


def connected_entities(s, d):
    return graph.named_degrees(graph.relationships(transcripts(s, d), _ordered(s, d)), c._entities(s, d))


def _graph(s, d) -> graph.Graph:
    return graph.build_graph(c._entities(s, d), graph.relationships(transcripts(s, d), _ordered(s, d)), c.cross_references(s, d))


def graph_matches(s, d):
    return graph.query(_graph(s, d), name="ra", kind="concept")["entities"]


def graph_relations(s, d):
    return graph.query(_graph(s, d), name="ra", depth=1)["relationships"].select("source_id", "target_id", "relation_type", "weight")


def graph_references(s, d):
    return graph.query(_graph(s, d), name="ra")["cross_references"].select("ref_id", "similarity")


def key_entities(s, d):
    return multimodal.key_entities(c._entities(s, d))


# ---------------------------------------------------------------- retrieval


def _hits(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", F.col("doc_id").cast("string").alias("video_id"))
    return c.vector_topk_batch(s, d).join(docs, "vec_id").withColumn("chunk", F.col("text")).withColumn("title", F.concat(F.lit("Talk of "), "source", F.lit("!"))).drop("text")


def _questions(s, d):
    return table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("What about "), "label", F.lit("?")).alias("question"))


def rag_context(s, d):
    return retrieval.prompt(retrieval.context(_hits(s, d)), _questions(s, d)).select("query_id", F.regexp_extract("prompt", r"(?s)CONTEXT:\n(.*)\n\nQUESTION: ", 1).alias("x")).select("query_id", F.md5("x").alias("context_md5"))


def rag_sources(s, d):
    return retrieval.sources(_hits(s, d)).select("query_id", "rank", "video_id", "title", F.md5("chunk_text").alias("text_md5"), "similarity_score", "chunk_index")


def rag_answers(s, d):
    return retrieval.answers(_questions(s, d), _hits(s, d)).select("query_id", "question", F.md5("answer").alias("answer_md5"), "confidence", "chunks_found", "avg_similarity")


def rag_batch_report(s, d):
    return retrieval.batch_report(retrieval.answers(_questions(s, d), _hits(s, d)))


def related_topics(s, d):
    return retrieval.related_topics(_hits(s, d), _questions(s, d))


def chunks_recursive(s, d):
    return retrieval.chunk_transcripts(transcripts(s, d)).select("video_id", "chunk_index", "chunk_id", F.md5("chunk").alias("chunk_md5"), "text_length")


# ---------------------------------------------------------------- requests and reports


def _requests(s, d):
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    path = F.when(F.col("event_id") % 11 == 0, "/health").when(F.col("event_id") % 7 == 0, "/ingest").otherwise("/query")
    key = F.when(F.col("user_id") % 4 == 1, "k-alpha").when(F.col("user_id") % 4 == 2, F.concat(F.lit("k-"), F.col("user_id") % 8)).when(F.col("event_id") % 13 == 0, "k-wrong")
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return e.select("event_id", "ts", F.when(F.col("event_id") % 17 == 0, "OPTIONS").otherwise("POST").alias("method"), path.alias("path"), F.concat(F.lit("10.0."), F.col("user_id")).alias("ip"), key.alias("api_key"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 5 < 4).alias("captcha"), status.alias("status"))


def request_outcomes(s, d):
    return access.classified(_requests(s, d), access.api_keys(s, "k-2:pro,k-6:gold", "k-alpha"), secret=True)


def request_buckets(s, d):
    r = _requests(s, d)
    return r.select("event_id", access.bucket(F.col("api_key"), F.col("ip")).alias("bucket"))


def summarize(s, d):
    docs = transcripts(s, d).withColumn("title", F.concat(F.lit("Talk "), "video_id"))
    return summaries.summarize(docs, patterns=c.PATTERNS, positive=c.POSITIVE, negative=c.NEGATIVE)["json"]


def multimodal_report(s, d):
    # What several parts read is written once; the edges, whose plan shuffles texts, before there is more on the disk.
    docs, voices = transcripts(s, d), speakers.analysis(c._turns(s, d))
    ents = kept(_ordered(s, d))
    edges = kept(graph.relationships(docs, ents).select("source_video"))
    tops = kept(segments.topics(docs).withColumn("size", F.length("text")).drop("text"))
    return multimodal.merged(docs, voices=voices, topics=tops, chapters=segments.chapters(tops), mentions=ents.drop("ord"), edges=edges, references=graph.best_references(ents))


def knowledge_markdown(s, d):
    docs = transcripts(s, d)
    videos = docs.select("video_id", F.concat(F.lit("Talk "), "video_id").alias("title"), "language", "source", F.lit(None).cast("double").alias("duration"), F.lit("").alias("url"))
    return knowledge.markdown(videos, knowledge.extractive(docs))


QUERIES = [
    findings, default_findings, default_quotes, default_arc, default_entities, default_emotions, action_items, reel_statistics, insight_type_counts, sentiment_distribution, default_topics, topic_durations, default_chapters,
    chapter_topics, split_manifest, chapter_slides, index_statistics, default_ids, default_durations, caption_choice, speaker_samples, emotion_reports, default_slide_runs, relationships, entity_nodes, connected_entities,
    graph_matches, graph_relations, graph_references, key_entities, rag_context, rag_sources, rag_answers, rag_batch_report, related_topics, chunks_recursive, request_outcomes, request_buckets, summarize,
    multimodal_report, knowledge_markdown,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
