"""One query for each operator over the driver's tables, and the same in SQL.

The tables' prose is invented, so lexicons and patterns are parameters here: words and signs that it does hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import lexicons as lex
from parlance.functions import text as T
from parlance.operators import graph, segments, speakers, speech, summaries, vectors, visual
from parlance.sources.scratch import ready
from parlance.sources.tables import table, transcripts, turns
from parlance.streaming import limits

POSITIVE, NEGATIVE = ["the", "les", "der", "una"], ["that", "des", "die", "los"]
PATTERNS = {"emphasis": [r"\bidiot\b", r"\bmoron\b"], "question": [r"!$"], "statistic": [r"\d+"], "conclusion": [r"\blicense\b", r"\blicensed\b"]}
STRONG = ["the", "la"]
NAME = r"([A-Z][a-z]+\s[a-z]+)"
EMOTIONS = {"joy": ["the", "les"], "anger": ["ung", "des"], "wonder": ["ing", "que"]}


def sentence_split(s, d):
    return speech.sentence_split(transcripts(s, d))


def keyword_topk(s, d):
    return speech.keywords(transcripts(s, d))


def timed_sentences(s, d):
    return speech.timed_sentences(transcripts(s, d)).select("video_id", "idx", "start", "end", "total")


def _timed(s, d):
    return speech.timed_sentences(transcripts(s, d))


def sentiment_arc(s, d):
    return speech.sentiment_arc(_timed(s, d), POSITIVE, NEGATIVE)


def overall_sentiment(s, d):
    return speech.overall_sentiment(sentiment_arc(s, d))


def ngram_repetition(s, d):
    return speech.phrases(_timed(s, d)).drop("first_pos")


def repeated_phrases(s, d):
    return speech.repeated(speech.phrases(_timed(s, d))).select("video_id", F.array_join("phrases", "|").alias("phrases"))


def insight_topk(s, d):
    return speech.insights(_timed(s, d), PATTERNS).select("video_id", "idx", "type", "importance", "confidence", "rank", F.md5("context").alias("context_md5"))


def insight_search(s, d):
    return speech.search(speech.insights(_timed(s, d), PATTERNS), query="license", least=0.5, limit=50).select("video_id", "idx", "type", "importance")


def quotes(s, d):
    return speech.quotes(_timed(s, d), backreference=False, strong=STRONG).select("video_id", "idx", "score")


def topic_boundary_scores(s, d):
    return segments.boundary_scores(transcripts(s, d))


def topics(s, d):
    return segments.topics(transcripts(s, d), below=0.03).withColumn("keywords", F.array_join("keywords", " "))


def chapters(s, d):
    return segments.chapters(segments.topics(transcripts(s, d), below=0.03)).withColumn("topic_ids", F.array_join(F.transform("topic_ids", lambda x: x.cast("string")), ","))


def _chapter_text(fmt):
    def q(s, d):
        return segments.chapter_list(segments.chapters(segments.topics(transcripts(s, d), below=0.03)), fmt)

    return q


def time_formats(s, d):
    t = table(s, d, "events").select("event_id", (F.col("event_id") * 7.321).alias("x"))
    return t.select("event_id", T.stamp(F.col("x")).alias("stamp"), T.clock(F.col("event_id") * 1.5, ",").alias("srt"), T.clock(F.col("event_id") * 1.5, ".").alias("vtt"), T.span(F.col("x")).alias("span"))


def nearest_signal(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    e = e.withColumn("t", F.col("us") / 1e6)
    return segments.nearest(e.filter("event_type = 'purchase'").select("video_id", "id", "t"), e.filter("event_type = 'click'").select("video_id", F.col("t").alias("s")), within=100_000.0)


def chunks_fixed(s, d):
    return vectors.chunks(transcripts(s, d)).select("video_id", "chunk_index", "chunk_id", F.md5("chunk").alias("chunk_md5"), "text_length")


def language_by_script(s, d):
    return transcripts(s, d).select("video_id", T.script_language(F.col("text")).alias("script"))


def store_stats(s, d):
    t = transcripts(s, d)
    return t.agg(F.count("*").alias("total"), F.count_distinct("video_id").alias("videos"), F.count_distinct("language").alias("languages"), F.count_distinct("source").alias("sources"))


def _vectors(s, d):
    return table(s, d, "embeddings")


def _query(s, d):
    """One row: the query is a join's side, not a value of the plan."""
    return _vectors(s, d).filter("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("q"))


def vector_topk(s, d):
    return vectors.similar(_vectors(s, d), _query(s, d), 5)


def vector_filtered(s, d):
    return vectors.similar(_vectors(s, d), _query(s, d), 5, {"label": 3})


def vector_topk_batch(s, d):
    v = _vectors(s, d)
    return vectors.similar_batch(v, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


def retrieval_confidence(s, d):
    return vectors.confidence(vector_topk_batch(s, d).filter("rank > 1"))


def metadata_search(s, d):
    return vectors.by_metadata(vectors.chunks(transcripts(s, d), keep=["language", "source"]), {"language": "en", "source": "src1"}).select("video_id", "chunk_index", "language", "source", "text_length")


def _entities(s, d):
    return graph.entities(transcripts(s, d), name=NAME)


def entities(s, d):
    return _entities(s, d)


def entity_merge(s, d):
    return graph.merged(_entities(s, d))


def _edges(s, d):
    return graph.cooccurrences(transcripts(s, d), _entities(s, d))


def cooccurrence_edges(s, d):
    return _edges(s, d)


def degree_topk(s, d):
    return graph.degrees(_edges(s, d))


def cross_references(s, d):
    return graph.cross_references(_entities(s, d))


def graph_bfs(s, d):
    e = _edges(s, d).filter("weight >= 2")
    start = e.groupBy().agg(F.min("source_id").alias("node"))
    return graph.reach(e, start, 2)


def _turns(s, d):
    return speakers.timed_turns(turns(s, d))


def speaker_profiles(s, d):
    return speakers.profiles(_turns(s, d))


def dominant_speaker(s, d):
    return speakers.dominant(speakers.profiles(_turns(s, d)))


def speaker_at_time(s, d):
    t = _turns(s, d)
    points = t.select("video_id", F.round((F.col("start") + F.col("end")) / 2, 3).alias("at")).distinct()
    return speakers.speaker_at(points, t)


def align_text(s, d):
    t = _turns(s, d)
    spans = t.select("video_id", F.col("idx").alias("id"), (F.col("start") + 0.5).alias("a"), (F.col("end") + 0.5).alias("b"))
    return speakers.aligned(spans, t).select("video_id", "id", F.md5("text").alias("text_md5"), "turns")


def emotions(s, d):
    return speakers.emotions(_turns(s, d), EMOTIONS, ["joy", "wonder"])


def emotion_summary(s, d):
    return speakers.emotion_summary(emotions(s, d))


def _requests(s, d):
    return table(s, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))


def rate_limit(s, d):
    return limits.rate_limit(_requests(s, d))


def abuse_block(s, d):
    return limits.abuse(_requests(s, d), window=864_000.0, most=3, block=864_000.0)


def slide_runs(s, d):
    t = turns(s, d).select("video_id", F.col("idx").cast("double").alias("timestamp"), "text", (F.length(F.coalesce("text", F.lit(""))) % 10 / F.lit(10.0)).alias("confidence"))
    return visual.distinct_slides(t, 0.2).select("video_id", "slide", "timestamp", "confidence")


def _lengths(s, d):
    return _timed(s, d).groupBy("video_id").agg(F.max("end").alias("duration"))


def frame_times(s, d):
    return visual.frame_times(_lengths(s, d), 2.0, 50)


def silence_turns(s, d):
    t = _turns(s, d)
    return speakers.silence_turns(t.groupBy("video_id").agg(F.max("end").alias("duration")), t.filter("idx % 3 = 0").select("video_id", F.col("end").alias("s")))


def embedding_boundaries(s, d):
    return segments.boundaries(segments.embedding_scores(transcripts(s, d))).withColumn("starts", F.array_join(F.transform("starts", lambda x: x.cast("string")), ","))


def graph_statistics(s, d):
    return graph.statistics(_entities(s, d), _edges(s, d), cross_references(s, d))


def _minutes(s, d):
    """Chapters of a minute, so that SQL can state what goes on from there."""
    t = _timed(s, d).withColumn("chapter_id", F.floor(F.col("start") / 60).cast("int"))
    g = t.groupBy("video_id", "chapter_id").agg(F.min("start").alias("start_time"), F.max("end").alias("end_time"), F.min(F.struct("idx", "sentence"))["sentence"].alias("summary"))
    return g.select("video_id", "chapter_id", F.concat(F.lit("Part "), F.col("chapter_id") + 1).alias("title"), "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "summary", F.array("chapter_id").alias("topic_ids"))


def chapter_signals(s, d):
    t = _timed(s, d)
    points = lambda at: t.filter(at).select("video_id", F.col("start").alias("s"))
    return summaries.enhanced_chapters(_minutes(s, d), points("idx % 4 = 1"), points("idx % 7 = 3")).drop("summary", "topic_ids")


def chapter_sentiment(s, d):
    return summaries.chapter_sentiment(_minutes(s, d), sentiment_arc(s, d))


def chapter_insights(s, d):
    return summaries.within_chapters(_minutes(s, d), speech.insights(_timed(s, d), PATTERNS)).select("video_id", "chapter_id", "idx", "type")


def _videos(s, d):
    return transcripts(s, d).select("video_id", F.concat(F.lit("Talk "), "video_id").alias("title")).join(_lengths(s, d), "video_id", "left")


def _grades(s, d):
    return summaries.grades(_videos(s, d), _minutes(s, d), speech.insights(_timed(s, d), PATTERNS), sentiment_arc(s, d))


def summary_grades(s, d):
    return _grades(s, d)


def _actions(s, d):
    return speech.insights(_timed(s, d), PATTERNS).filter("type = 'conclusion'").select("video_id", "text", F.lit("medium").alias("priority"), "start", "confidence")


def insight_quality(s, d):
    return summaries.insight_quality(transcripts(s, d), speech.insights(_timed(s, d), PATTERNS), _actions(s, d), sentiment_arc(s, d))


def executive_summary(s, d):
    return summaries.executive_summary(_videos(s, d), _minutes(s, d), speech.insights(_timed(s, d), PATTERNS), _actions(s, d), overall_sentiment(s, d))


def _kept(df: DataFrame) -> DataFrame:
    """Checkpointed: a report reads it many times."""
    ready(df.sparkSession)
    return df.checkpoint()


def _report(s, d):
    timed = _kept(_timed(s, d))
    videos = transcripts(s, d).select("video_id", F.concat(F.lit("Talk "), "video_id").alias("title")).join(timed.groupBy("video_id").agg(F.max("end").alias("duration")), "video_id", "left")
    found, arc, chaps = _kept(speech.insights(timed, PATTERNS)), _kept(speech.sentiment_arc(timed, POSITIVE, NEGATIVE)), _kept(segments.chapters(segments.topics(transcripts(s, d))))
    acts, tone = speech.actions(found, timed), speech.overall_sentiment(arc)
    brief, graded = summaries.executive_summary(videos, chaps, found, acts, tone), summaries.grades(videos, chaps, found, arc)
    return timed, videos, found, arc, chaps, acts, tone, brief, graded


def summary_markdown(s, d):
    timed, videos, found, arc, chaps, acts, tone, brief, graded = _report(s, d)
    return summaries.markdown(videos, brief, tone, graded, chaps, found, acts, speech.quotes(timed, backreference=False, strong=STRONG), arc)


def summary_json(s, d):
    _, videos, found, _, chaps, acts, tone, brief, graded = _report(s, d)
    return summaries.as_json(videos, brief, tone, graded, {"chapters": chaps, "key_insights": found.select("video_id", "rank", "type", "text", "start", "end", "importance", "confidence"), "action_items": acts})


QUERIES = [
    sentence_split, keyword_topk, timed_sentences, sentiment_arc, overall_sentiment, ngram_repetition, repeated_phrases, insight_topk, insight_search, quotes, topic_boundary_scores,
    topics, chapters, time_formats, nearest_signal, chunks_fixed, language_by_script, store_stats, vector_topk, vector_filtered, vector_topk_batch, retrieval_confidence, metadata_search, entities, entity_merge, cooccurrence_edges,
    degree_topk, cross_references, graph_bfs, speaker_profiles, dominant_speaker, speaker_at_time, align_text, emotions, emotion_summary, rate_limit, abuse_block,
    slide_runs, frame_times, silence_turns, embedding_boundaries, graph_statistics, chapter_signals, chapter_sentiment, chapter_insights, summary_grades, insight_quality, executive_summary, summary_markdown, summary_json,
]


def queries() -> dict:
    from parlance.plans import reports

    out = {f.__name__: f for f in QUERIES} | reports.queries()
    return out | {f"chapters_{fmt}": _chapter_text(fmt) for fmt in ("youtube", "srt", "vtt", "ffmpeg")}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return keyword_topk(spark, d)


# ---------------------------------------------------------------- SQL


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _in(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
LONG = lambda x: f"list_filter(list_transform({x}, lambda y: {STRIP('y')}), lambda y: length(y) > 10)"
WORDS = lambda x: rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda y: y <> '')"
DOC = rf"""
v AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, text, lang, source, coalesce(text, '') AS t FROM documents),
v1 AS (SELECT *, {LONG(r"string_split(regexp_replace(t, '([.!?।॥])\s+', '\1' || chr(1), 'g'), chr(1))")} AS s1 FROM v),
v2 AS (SELECT *, CASE WHEN len(s1) <= 1 AND length(t) > 100 THEN {LONG("string_split(t, chr(10))")} ELSE s1 END AS s2, {WORDS("t")} AS ws FROM v1),
sl AS (SELECT *, CASE WHEN len(s2) <= 1 AND length(t) > 200 THEN list_transform(range(0, len(ws), 30), lambda i: array_to_string(ws[i + 1:i + 30], ' ')) ELSE s2 END AS s FROM v2),
tl AS (SELECT video_id, CASE WHEN len(s1) = 0 AND {STRIP("t")} <> '' THEN [{STRIP("t")}] ELSE s1 END AS s FROM v1),
tu AS (SELECT video_id, len(s) AS total, CAST(unnest(range(len(s))) AS INTEGER) AS idx, unnest(s) AS sentence FROM tl),
td AS (SELECT *, greatest(1.0::DOUBLE, len({WORDS("sentence")}) * 0.4::DOUBLE) AS d FROM tu),
te AS (SELECT *, sum(d) OVER (PARTITION BY video_id ORDER BY idx) AS e FROM td),
ti AS (SELECT video_id, idx, sentence, round(e - d, 3) AS start, round(e, 3) AS "end", total FROM te)"""
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]{{{},}}')"
def arc(positive: list, negative: list) -> str:
    return f""",
aw AS (SELECT video_id, idx, start, last("end") OVER w AS "end", array_to_string(array_agg(sentence) OVER w, ' ') AS x FROM ti WINDOW w AS (PARTITION BY video_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
ad AS (SELECT *, list_distinct({TOK.format("x", 1)}) AS w FROM aw WHERE idx % 2 = 0),
ac AS (SELECT *, len(list_intersect(w, {_list(positive)})) AS p, len(list_intersect(w, {_list(negative)})) AS n FROM ad),
ar AS (SELECT video_id, idx, start, "end", round(CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n)::DOUBLE / (p + n) END, 6) AS score FROM ac)"""


ARC = arc(POSITIVE, NEGATIVE)
LABEL = "CASE WHEN {0} > {1} THEN 'very_positive' WHEN {0} > {2} THEN 'positive' WHEN {0} < -{1} THEN 'very_negative' WHEN {0} < -{2} THEN 'negative' ELSE 'neutral' END"
PHRASES = f""",
pw AS (SELECT video_id, idx, {WORDS("lower(sentence)")} AS w FROM ti),
pn AS (SELECT video_id, idx, w, unnest([3, 4, 5, 6]) AS n FROM pw),
pg AS (SELECT video_id, idx, w[i:i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM pn WHERE len(w) >= n)),
ph AS (SELECT video_id, array_to_string(g, ' ') AS phrase, count(*) AS n, min(idx) AS first_idx FROM pg
       WHERE len(list_filter(g, lambda x: list_contains({_list(lex.PHRASE_STOP_WORDS)}, x))) * 10 <= len(g) * 6 GROUP BY ALL HAVING count(*) >= 2)"""


def _insights(patterns: dict | None = None) -> str:
    parts = []
    for i, (k, ps) in enumerate((patterns or PATTERNS).items()):
        hits = " + ".join("CAST(regexp_matches(sentence, '(?i)" + p.replace("'", "''") + "') AS INTEGER)" for p in ps)
        parts.append(f"SELECT *, {i} AS ord, '{k}' AS type, {hits} AS hits, {lex.TYPE_WEIGHTS[k]}::DOUBLE AS weight FROM ib")
    return rf""",
ix AS (SELECT *, idx::DOUBLE / greatest(total - 1, 1) AS rel, len({WORDS("sentence")}) AS n,
       substring(concat_ws(' ', lag(sentence) OVER w, '[...]', lead(sentence) OVER w), 1, 300) AS context FROM ti WINDOW w AS (PARTITION BY video_id ORDER BY idx)),
ib AS (SELECT *, CASE WHEN rel < 0.15 OR rel > 0.85 THEN 0.15::DOUBLE WHEN rel < 0.3 OR rel > 0.7 THEN 0.05::DOUBLE ELSE 0::DOUBLE END + CASE WHEN n BETWEEN 8 AND 25 THEN 0.1::DOUBLE ELSE 0 END
       + CASE WHEN regexp_matches(sentence, '\d') THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(sentence, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+') THEN 0.05::DOUBLE ELSE 0 END AS bonus FROM ix),
ik AS ({" UNION ALL ".join(parts)}),
im AS (SELECT *, round(least(1.0, weight + bonus), 6) AS importance FROM ik WHERE hits > 0),
il AS (SELECT *, row_number() OVER (PARTITION BY video_id, substring(lower(sentence), 1, 80) ORDER BY idx, ord) AS fst FROM im WHERE importance >= 0.3),
ir AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY importance DESC, idx, ord) AS INTEGER) AS rank FROM il WHERE fst = 1),
ii AS (SELECT video_id, idx, ord, type, sentence, start, importance, round(least(1.0, 0.5::DOUBLE + 0.15::DOUBLE * hits), 6) AS confidence, rank, context, md5(context) AS context_md5 FROM ir WHERE rank <= 50)"""


TOP = lambda x: f"""list_transform(list_sort(list_transform(list_distinct({x}), lambda w: {{'n': -len(list_filter({x}, lambda y: y = w)), 'at': list_position({x}, w), 'w': w}}))[1:15], lambda z: z.w)"""
def ent(name: str) -> str:
    """Letters beyond ASCII are part of words for Spark's word borders, but not for RE2's: there they stand as _."""
    return rf""",
en AS (SELECT video_id, regexp_extract_all(regexp_replace(t, '[À-ÖØ-öø-ɏ]', '_', 'g'), '{name}', 1) AS a, list_concat({", ".join(f"regexp_extract_all(t, '(?i){p}', 1)" for p in lex.SCRIPTURES)}) AS b, list_distinct(regexp_extract_all(t, '[ऀ-ॿ]{{3,}}')) AS c FROM v),
eu AS (SELECT video_id, unnest(a) AS name, 'concept' AS entity_type, unnest(range(len(a))) AS ord FROM en UNION ALL SELECT video_id, unnest(b), 'text', 100000000 + unnest(range(len(b))) FROM en
       UNION ALL SELECT video_id, unnest(c), 'term', 200000000 + unnest(range(len(c))) FROM en),
ef AS (SELECT *, substring(md5(entity_type || ':' || lower({STRIP("name")})), 1, 12) AS entity_id FROM eu
       WHERE entity_type <> 'concept' OR (length(name) > 5 AND split_part(name, ' ', 1) NOT IN {_in(lex.COMMON_FIRST_WORDS)})),
ee AS (SELECT video_id, entity_id, arg_min(name, ord) AS name, arg_min(entity_type, ord) AS entity_type, count(*) AS frequency, min(ord) AS ord FROM ef GROUP BY ALL)"""


ENT = ent(NAME)
EDGE = """,
gs AS (SELECT video_id, CAST(unnest(range(len(s))) AS INTEGER) AS idx, lower(unnest(s)) AS low FROM sl),
gm AS (SELECT DISTINCT gs.video_id, idx, entity_id FROM gs JOIN ee ON gs.video_id = ee.video_id AND contains(low, lower(name))),
ge AS (SELECT a.entity_id AS source_id, b.entity_id AS target_id, count(*) AS weight FROM gm a JOIN gm b ON a.video_id = b.video_id AND a.idx = b.idx AND a.entity_id < b.entity_id GROUP BY ALL)"""
TURN = rf"""
c AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, role AS speaker_id, turn AS idx, text, greatest(1.0::DOUBLE, len({WORDS("coalesce(text, '')")}) * 0.4::DOUBLE) AS d FROM conversations),
ce AS (SELECT *, sum(d) OVER (PARTITION BY video_id ORDER BY idx) AS e FROM c),
tt AS (SELECT video_id, speaker_id, idx, text, round(e - d, 3) AS start, round(e, 3) AS "end" FROM ce),
pa AS (SELECT video_id, speaker_id, round(sum("end" - start), 3) AS duration, count(*) AS segments FROM tt GROUP BY ALL),
pr AS (SELECT video_id, speaker_id, duration, segments, round(duration / segments, 3) AS average, round(duration / greatest(sum(duration) OVER (PARTITION BY video_id), 1.0), 3) AS ratio,
       CAST(row_number() OVER (PARTITION BY video_id ORDER BY duration DESC, speaker_id) AS INTEGER) AS rank FROM pa)"""
def emotion(lexicon: dict, bright: list, source: str = "tt") -> str:
    each = ", ".join(f"{{'s': ({' + '.join(f'''CAST(contains(lower(text), '{w}') AS INTEGER)''' for w in dict.fromkeys(ws))})::DOUBLE / n, 'o': {-i}, 'e': '{k}'}}" for i, (k, ws) in enumerate(lexicon.items()))
    return rf""",
mn AS (SELECT *, greatest(len({WORDS("lower(text)")}), 1) AS n FROM {source} WHERE length({STRIP("text")}) >= 5),
mm AS (SELECT video_id, idx, list_sort([{each}], 'DESC')[1] AS m FROM mn),
em AS (SELECT video_id, idx, CASE WHEN m.s > 0 THEN m.e ELSE 'neutral' END AS emotion, round(CASE WHEN m.s > 0 THEN m.s ELSE 0.5 END, 6) AS score,
       CASE WHEN m.s = 0 THEN 'neutral' WHEN m.e IN {_in(bright)} THEN 'positive' ELSE 'negative' END AS sentiment FROM mm)"""


EMOTION = emotion(EMOTIONS, ["joy", "wonder"])
MINUTES = """,
cp AS (SELECT video_id, CAST(floor(start / 60) AS INTEGER) AS chapter_id, min(start) AS start_time, max("end") AS end_time, arg_min(sentence, idx) AS summary FROM ti GROUP BY ALL)"""
PARTS = """,
vl AS (SELECT v.video_id, v.t, coalesce(max("end"), 0) AS duration FROM v LEFT JOIN ti ON v.video_id = ti.video_id GROUP BY ALL),
pc AS (SELECT video_id, count(*) AS chapter_count, sum(end_time - start_time) AS covered FROM cp GROUP BY 1),
pi AS (SELECT video_id, count(*) AS n, count(DISTINCT type) AS types, avg(importance) AS imp, avg(confidence) AS conf, count(*) FILTER (type = 'conclusion') AS acts FROM ii GROUP BY 1),
pf AS (SELECT video_id, count(*) AS windows, sum("end" - start) AS felt FROM ar GROUP BY 1),
pp AS (SELECT vl.video_id, t, duration, coalesce(chapter_count, 0) AS chapter_count, coalesce(n, 0) AS n, coalesce(types, 0) AS types, coalesce(imp, 0) AS imp, coalesce(conf, 0) AS conf, coalesce(acts, 0) AS acts, coalesce(windows, 0) AS windows,
       CASE WHEN duration > 0 THEN least(1.0, coalesce(covered, 0) / duration) ELSE 0 END AS cover, CASE WHEN duration > 0 THEN least(1.0, coalesce(felt, 0) / duration) ELSE 0 END AS feel
       FROM vl LEFT JOIN pc ON pc.video_id = vl.video_id LEFT JOIN pi ON pi.video_id = vl.video_id LEFT JOIN pf ON pf.video_id = vl.video_id)"""
COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
HMS = "lpad(CAST(({0}) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({0}) % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({0}) % 60000 // 1000 AS VARCHAR), 2, '0') || '{1}' || lpad(CAST(({0}) % 1000 AS VARCHAR), 3, '0')"


def oracle_sql() -> dict[str, str]:
    from parlance.plans import oracles

    return _sql() | oracles.sql()


def _sql() -> dict[str, str]:
    w = lambda body, sel: f"WITH {body} {sel}"
    r = lambda body, sel: f"WITH RECURSIVE {body} {sel}"
    x = "CAST(floor(event_id * 7.321::DOUBLE) AS BIGINT)"
    return {
        "sentence_split": w(DOC, "SELECT video_id, CAST(unnest(range(len(s))) AS INTEGER) AS idx, unnest(s) AS sentence FROM sl"),
        "keyword_topk": w(
            DOC,
            f""", k AS (SELECT video_id, unnest(k) AS token, unnest(range(len(k))) AS pos FROM (SELECT video_id, {TOK.format("t", 3)} AS k FROM v)),
            c AS (SELECT video_id, token, count(*) AS n, min(pos) AS f FROM k WHERE token NOT IN {_in(lex.STOP_WORDS)} GROUP BY ALL),
            q AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY n DESC, f) AS INTEGER) AS rank FROM c) SELECT video_id, rank, token, n FROM q WHERE rank <= 15""",
        ),
        "timed_sentences": w(DOC, 'SELECT video_id, idx, start, "end", total FROM ti'),
        "sentiment_arc": w(DOC + ARC, f'SELECT video_id, idx, start, "end", score, {LABEL.format("score", 0.5, 0.15)} AS label FROM ar'),
        "overall_sentiment": w(DOC + ARC, f", o AS (SELECT video_id, round(avg(score), 6) AS score, count(*) AS windows FROM ar GROUP BY 1) SELECT *, {LABEL.format('score', 0.3, 0.1)} AS label FROM o"),
        "ngram_repetition": w(DOC + PHRASES, "SELECT * FROM ph"),
        "insight_topk": w(DOC + _insights(), "SELECT video_id, idx, type, importance, confidence, rank, context_md5 FROM ii"),
        "insight_search": w(DOC + _insights(), "SELECT video_id, idx, type, importance FROM ii WHERE contains(lower(sentence), 'license') AND importance >= 0.5 ORDER BY importance DESC, video_id, idx LIMIT 50"),
        "quotes": w(
            DOC,
            rf""", q AS (SELECT *, round(CASE WHEN regexp_matches(sentence, '(?i)\b(?:this|that|these|those|it)\s+(?:is|was|are|were)\b') THEN 0::DOUBLE ELSE 0.1::DOUBLE END
            + CASE WHEN len(list_intersect({WORDS("lower(sentence)")}, {_list(STRONG)})) > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(sentence, '(?i)\b(?:like\s+a|as\s+if|just\s+as)\b') THEN 0.15::DOUBLE ELSE 0 END
            + CASE WHEN length(sentence) < 80 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN contains(sentence, '"') OR contains(sentence, '«') THEN 0.3::DOUBLE ELSE 0 END, 6) AS score FROM ti WHERE length(sentence) BETWEEN 30 AND 200)
            SELECT video_id, idx, score FROM q WHERE score >= 0.3""",
        ),
        "topic_boundary_scores": w(
            DOC,
            f""", b0 AS (SELECT video_id, s, CAST(unnest(range(3, len(s))) AS INTEGER) AS idx FROM sl WHERE len(s) > 3),
            b1 AS (SELECT video_id, idx, list_filter({TOK.format("array_to_string(s[idx - 2:idx], ' ')", 3)}, lambda q: NOT list_contains({_list(lex.STOP_WORDS)}, q)) AS a,
                   list_filter({TOK.format("array_to_string(s[idx + 1:idx + 3], ' ')", 3)}, lambda q: NOT list_contains({_list(lex.STOP_WORDS)}, q)) AS b FROM b0),
            b2 AS (SELECT video_id, idx, {TOP("a")} AS a, {TOP("b")} AS b FROM b1 WHERE len(a) > 0 AND len(b) > 0)
            SELECT video_id, idx, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM b2""",
        ),
        "time_formats": f"""SELECT event_id, CASE WHEN {x} >= 3600 THEN ({x} // 3600) || ':' || lpad(CAST({x} % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST({x} // 60 AS VARCHAR) END || ':' || lpad(CAST({x} % 60 AS VARCHAR), 2, '0') AS stamp,
            {HMS.format("event_id * 1500", ",")} AS srt, {HMS.format("event_id * 1500", ".")} AS vtt,
            CASE WHEN {x} >= 3600 THEN ({x} // 3600) || 'h ' || ({x} % 3600 // 60) || 'm ' WHEN {x} >= 60 THEN ({x} // 60) || 'm ' ELSE '' END || ({x} % 60) || 's' AS span FROM events""",
        "nearest_signal": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS id, epoch_us(ts) / 1e6 AS t, event_type FROM events),
            p AS (SELECT * FROM e WHERE event_type = 'purchase'), k AS (SELECT * FROM e WHERE event_type = 'click'),
            m AS (SELECT p.video_id, p.id, k.t AS s, row_number() OVER (PARTITION BY p.video_id, p.id ORDER BY round(abs(p.t - k.t), 6), k.t) AS n FROM p JOIN k ON p.video_id = k.video_id AND abs(p.t - k.t) <= 100000)
            SELECT p.video_id, p.id, p.t, m.s AS "at" FROM p LEFT JOIN m ON p.video_id = m.video_id AND p.id = m.id AND m.n = 1""",
        "chunks_fixed": w(
            DOC,
            """, h AS (SELECT video_id, text, unnest(range(0, length(text), 425)) AS a FROM v WHERE length(text) > 0), g AS (SELECT video_id, CAST(a // 425 AS INTEGER) AS chunk_index, substring(text, a + 1, 500) AS chunk FROM h)
            SELECT video_id, chunk_index, md5(video_id || ':' || chunk_index) AS chunk_id, md5(chunk) AS chunk_md5, CAST(length(chunk) AS INTEGER) AS text_length FROM g""",
        ),
        "language_by_script": w(DOC, ", n AS (SELECT video_id, len(regexp_extract_all(t, '[ऀ-ॿ]')) AS d, len(regexp_extract_all(t, '[a-zA-Z]')) AS a FROM v) SELECT video_id, CASE WHEN d + a = 0 THEN 'unknown' WHEN d * 2 > d + a THEN 'hi' ELSE 'en' END AS script FROM n"),
        "store_stats": "SELECT count(*) AS total, count(DISTINCT doc_id) AS videos, count(DISTINCT lang) AS languages, count(DISTINCT source) AS sources FROM documents",
        "vector_topk": f"SELECT a.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY score DESC, a.vec_id LIMIT 5",
        "vector_filtered": f"SELECT a.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.label = 3 ORDER BY score DESC, a.vec_id LIMIT 5",
        "vector_topk_batch": f"WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5",
        "retrieval_confidence": f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, {COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
            g AS (SELECT query_id, count(*) AS chunks_found, round(avg(score), 6) AS avg_similarity FROM k WHERE rank BETWEEN 2 AND 5 GROUP BY 1)
            SELECT *, CASE WHEN avg_similarity < 0.5 THEN 'low' WHEN avg_similarity < 0.7 THEN 'medium' ELSE 'high' END AS confidence FROM g""",
        "metadata_search": w(
            DOC,
            """, h AS (SELECT video_id, text, lang, source, unnest(range(0, length(text), 425)) AS a FROM v WHERE length(text) > 0 AND lang = 'en' AND source = 'src1')
            SELECT video_id, CAST(a // 425 AS INTEGER) AS chunk_index, lang AS language, source, CAST(length(substring(text, a + 1, 500)) AS INTEGER) AS text_length FROM h ORDER BY video_id, chunk_index LIMIT 20""",
        ),
        "entities": w(DOC + ENT, "SELECT video_id, entity_id, name, entity_type, frequency FROM ee"),
        "entity_merge": w(DOC + ENT, "SELECT entity_id, arg_min(name, video_id) AS name, arg_min(entity_type, video_id) AS entity_type, CAST(sum(frequency) AS BIGINT) AS frequency, count(*) AS videos FROM ee GROUP BY 1"),
        "cooccurrence_edges": w(DOC + ENT + EDGE, "SELECT * FROM ge"),
        "degree_topk": w(DOC + ENT + EDGE, "SELECT node, count(*) AS degree FROM (SELECT source_id AS node FROM ge UNION ALL SELECT target_id FROM ge) GROUP BY 1 ORDER BY degree DESC, node LIMIT 10"),
        "cross_references": w(
            DOC + ENT,
            """, n AS (SELECT video_id, count(*) AS n FROM ee GROUP BY 1), p AS (SELECT a.video_id AS source_video, b.video_id AS target_video, count(*) AS shared FROM ee a JOIN ee b ON a.entity_id = b.entity_id AND a.video_id < b.video_id GROUP BY ALL HAVING count(*) >= 2),
            q AS (SELECT source_video, target_video, shared, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS similarity FROM p JOIN n x ON x.video_id = source_video JOIN n y ON y.video_id = target_video)
            SELECT 'xref-' || substring(md5(source_video || ':' || target_video), 1, 10) AS ref_id, source_video, target_video, shared, similarity,
            CASE WHEN similarity > 0.7 THEN 'concept_continuation' WHEN shared > 5 THEN 'topic_overlap' ELSE 'entity_shared' END AS ref_type FROM q WHERE similarity >= 0.3""",
        ),
        "graph_bfs": r(
            DOC + ENT + EDGE,
            """, g2 AS (SELECT * FROM ge WHERE weight >= 2), bi AS (SELECT source_id AS a, target_id AS b FROM g2 UNION SELECT target_id, source_id FROM g2),
            f0 AS (SELECT min(source_id) AS node FROM g2), f1 AS (SELECT DISTINCT b AS node FROM bi JOIN f0 ON a = f0.node WHERE b NOT IN (SELECT node FROM f0)),
            f2 AS (SELECT DISTINCT b AS node FROM bi JOIN f1 ON a = f1.node WHERE b NOT IN (SELECT node FROM f0 UNION SELECT node FROM f1))
            SELECT node, 0 AS depth FROM f0 UNION ALL SELECT node, 1 FROM f1 UNION ALL SELECT node, 2 FROM f2""",
        ),
        "speaker_profiles": w(TURN, "SELECT video_id, speaker_id, duration, segments, average, ratio, rank FROM pr"),
        "dominant_speaker": w(TURN, "SELECT video_id, speaker_id, duration FROM pr WHERE rank = 1"),
        "speaker_at_time": w(TURN, ', q AS (SELECT DISTINCT video_id, round((start + "end") / 2, 3) AS "at" FROM tt), m AS (SELECT q.video_id, q.at, arg_min(speaker_id, idx) AS speaker_id FROM q JOIN tt ON q.video_id = tt.video_id AND q.at BETWEEN start AND "end" GROUP BY ALL) SELECT q.video_id, q.at, m.speaker_id FROM q LEFT JOIN m ON q.video_id = m.video_id AND q.at = m.at'),
        "align_text": w(TURN, ', q AS (SELECT video_id, idx AS id, start + 0.5 AS a, "end" + 0.5 AS b FROM tt) SELECT q.video_id, id, md5(string_agg(text, \' \' ORDER BY idx)) AS text_md5, CAST(count(*) AS INTEGER) AS turns FROM q JOIN tt ON q.video_id = tt.video_id AND start < b AND "end" > a GROUP BY 1, 2'),
        "emotions": w(TURN + EMOTION, "SELECT * FROM em"),
        "slide_runs": r(
            rf"""s AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn::DOUBLE AS timestamp, (length(coalesce(text, '')) % 10) / 10::DOUBLE AS confidence, list_distinct({WORDS("lower(coalesce(text, ''))")}) AS w,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations),
            k AS (SELECT *, 0 AS slide FROM s WHERE i = 1 UNION ALL
                  SELECT video_id, CASE WHEN far OR c2 > c1 THEN t2 ELSE t1 END, CASE WHEN far OR c2 > c1 THEN c2 ELSE c1 END, CASE WHEN far OR c2 > c1 THEN w2 ELSE w1 END, i, CASE WHEN far THEN slide + 1 ELSE slide END
                  FROM (SELECT s.video_id, s.i, k.slide, k.timestamp AS t1, s.timestamp AS t2, k.confidence AS c1, s.confidence AS c2, k.w AS w1, s.w AS w2,
                        CASE WHEN len(k.w) = 0 OR len(s.w) = 0 THEN 0 ELSE len(list_intersect(k.w, s.w))::DOUBLE / len(list_distinct(list_concat(k.w, s.w))) END < 0.2 AS far
                        FROM k JOIN s ON s.video_id = k.video_id AND s.i = k.i + 1))""",
            "SELECT video_id, slide, arg_max(timestamp, i) AS timestamp, arg_max(confidence, i) AS confidence FROM k GROUP BY 1, 2",
        ),
        "frame_times": w(
            DOC,
            """, l AS (SELECT video_id, max("end") AS d FROM ti GROUP BY 1), m AS (SELECT video_id, d, CASE WHEN d / 2 > 50 THEN d / 50 ELSE 2::DOUBLE END AS step FROM l),
            n AS (SELECT video_id, step, unnest(range(CAST(least(ceil(d / step), 50) AS BIGINT))) AS frame FROM m) SELECT video_id, CAST(frame AS INTEGER) AS frame, round(frame * step, 6) AS timestamp FROM n""",
        ),
        "silence_turns": w(
            TURN,
            """, b AS (SELECT DISTINCT video_id, 0 AS k, 0::DOUBLE AS t FROM tt UNION ALL SELECT video_id, 1, "end" FROM tt WHERE idx % 3 = 0 UNION ALL SELECT video_id, 2, max("end") FROM tt GROUP BY 1),
            p AS (SELECT video_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, t AS start, lead(t) OVER w AS "end", CASE WHEN t - lag(t) OVER w > 1.5 THEN 1 ELSE 0 END AS turn FROM b WINDOW w AS (PARTITION BY video_id ORDER BY k, t))
            SELECT video_id, idx, 'SPEAKER_0' || (sum(turn) OVER (PARTITION BY video_id ORDER BY idx) % 2)::BIGINT AS speaker_id, start, "end" FROM p WHERE "end" - start >= 0.5""",
        ),
        "graph_statistics": w(
            DOC + ENT + EDGE,
            """, n AS (SELECT video_id, count(*) AS n FROM ee GROUP BY 1), p AS (SELECT a.video_id AS x, b.video_id AS y, count(*) AS shared FROM ee a JOIN ee b ON a.entity_id = b.entity_id AND a.video_id < b.video_id GROUP BY ALL HAVING count(*) >= 2),
            c AS (SELECT count(*) AS n FROM p JOIN n i ON i.video_id = x JOIN n j ON j.video_id = y WHERE round(shared::DOUBLE / (i.n + j.n - shared), 6) >= 0.3), k AS (SELECT entity_type, entity_id, video_id FROM ee)
            SELECT count(DISTINCT entity_id) AS entities, count(DISTINCT video_id) AS videos, count(DISTINCT entity_id) FILTER (entity_type = 'concept') AS concepts, count(DISTINCT entity_id) FILTER (entity_type = 'term') AS terms,
            count(DISTINCT entity_id) FILTER (entity_type = 'text') AS texts, (SELECT count(*) FROM ge) AS relationships, (SELECT n FROM c) AS cross_references, round(count(DISTINCT entity_id) / greatest(count(DISTINCT video_id), 1), 6) AS entities_per_video FROM k""",
        ),
        "chapter_signals": w(
            DOC + MINUTES,
            """, sc AS (SELECT video_id, start AS s FROM ti WHERE idx % 4 = 1), sp AS (SELECT video_id, start AS s FROM ti WHERE idx % 7 = 3),
            na AS (SELECT cp.video_id, chapter_id, s, row_number() OVER (PARTITION BY cp.video_id, chapter_id ORDER BY round(abs(start_time - s), 6), s) AS n FROM cp JOIN sc ON cp.video_id = sc.video_id AND abs(start_time - s) <= 10),
            nb AS (SELECT cp.video_id, chapter_id, s, row_number() OVER (PARTITION BY cp.video_id, chapter_id ORDER BY round(abs(end_time - s), 6), s) AS n FROM cp JOIN sc ON cp.video_id = sc.video_id AND abs(end_time - s) <= 10),
            m AS (SELECT cp.*, coalesce(na.s, start_time) AS a, nb.s AS z FROM cp LEFT JOIN na ON na.video_id = cp.video_id AND na.chapter_id = cp.chapter_id AND na.n = 1 LEFT JOIN nb ON nb.video_id = cp.video_id AND nb.chapter_id = cp.chapter_id AND nb.n = 1),
            q AS (SELECT *, CASE WHEN z > a THEN z ELSE end_time END AS b FROM m),
            x AS (SELECT q.video_id, chapter_id, count(*) AS n FROM q JOIN sc ON q.video_id = sc.video_id AND s BETWEEN a AND b GROUP BY 1, 2), y AS (SELECT q.video_id, chapter_id, count(*) AS n FROM q JOIN sp ON q.video_id = sp.video_id AND s BETWEEN a AND b GROUP BY 1, 2)
            SELECT q.video_id, q.chapter_id, 'Part ' || (q.chapter_id + 1) AS title, a AS start_time, b AS end_time, b - a AS duration, coalesce(x.n, 0) AS scene_change_count, y.n IS NOT NULL AS has_speaker_change,
            round(least(1.0, 0.5::DOUBLE + CASE WHEN x.n > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN y.n > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN end_time - start_time >= 60 THEN 0.1::DOUBLE WHEN end_time - start_time >= 30 THEN 0.05::DOUBLE ELSE 0 END), 6) AS confidence,
            greatest(0.0, a - 2) AS buffer_start, b + 2 AS buffer_end FROM q LEFT JOIN x ON x.video_id = q.video_id AND x.chapter_id = q.chapter_id LEFT JOIN y ON y.video_id = q.video_id AND y.chapter_id = q.chapter_id""",
        ),
        "chapter_sentiment": w(DOC + ARC + MINUTES, """, g AS (SELECT cp.video_id, chapter_id, round(avg(score), 6) AS sentiment_score FROM cp JOIN ar ON ar.video_id = cp.video_id AND ar.start BETWEEN start_time AND end_time GROUP BY 1, 2)
            SELECT *, CASE WHEN sentiment_score > 0.15 THEN 'positive' WHEN sentiment_score < -0.15 THEN 'negative' ELSE 'neutral' END AS sentiment FROM g"""),
        "chapter_insights": w(DOC + _insights() + MINUTES, "SELECT cp.video_id, chapter_id, ii.idx, type FROM cp JOIN ti ON ti.video_id = cp.video_id AND ti.start BETWEEN start_time AND end_time JOIN ii ON ii.video_id = ti.video_id AND ii.idx = ti.idx"),
        "summary_grades": w(
            DOC + ARC + _insights() + MINUTES + PARTS,
            """, sg AS (SELECT *, round(0.25::DOUBLE * cover + 0.2::DOUBLE * (types / 9) + 0.2::DOUBLE * conf + 0.15::DOUBLE * feel + 0.2::DOUBLE * imp, 6) AS score FROM pp)
            SELECT video_id, chapter_count, n AS insight_count, round(cover, 6) AS chapter_coverage, round(n / greatest(duration / 60, 1.0), 6) AS insight_density, round(types / 9, 6) AS type_diversity, round(feel, 6) AS sentiment_coverage,
            round(imp, 6) AS avg_importance, round(conf, 6) AS avg_confidence, score, CASE WHEN score >= 0.8 THEN 'A' WHEN score >= 0.6 THEN 'B' WHEN score >= 0.4 THEN 'C' WHEN score >= 0.2 THEN 'D' ELSE 'F' END AS grade FROM sg""",
        ),
        "insight_quality": w(
            DOC + ARC + _insights() + MINUTES + PARTS,
            f""", iq AS (SELECT *, n / greatest(len({WORDS("t")}) / 100, 1.0) AS dense FROM pp)
            SELECT video_id, round(CASE WHEN t = '' THEN 0 ELSE least(1.0, (least(1.0, types / 5) + CASE WHEN dense BETWEEN 0.5 AND 5 THEN 1.0 WHEN dense > 0.1 THEN 0.5 ELSE 0 END + least(1.0, acts / 3) + least(1.0, windows / 5) + conf) / 5) END, 6) AS quality FROM iq""",
        ),
        "executive_summary": w(
            DOC + ARC + _insights() + MINUTES,
            f""", o AS (SELECT video_id, round(avg(score), 6) AS score FROM ar GROUP BY 1),
            a AS (SELECT video_id, count(*) AS n, string_agg('• Part ' || (chapter_id + 1) || ': ' || substring(summary, 1, 100), chr(10) ORDER BY chapter_id) FILTER (k <= 5) AS x FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY chapter_id) AS k FROM cp) GROUP BY 1),
            b AS (SELECT video_id, string_agg('• ' || substring(sentence, 1, 100), chr(10) ORDER BY rank) AS x FROM ii WHERE rank <= 3 GROUP BY 1),
            c AS (SELECT video_id, string_agg('• ' || substring(sentence, 1, 80), chr(10) ORDER BY k) AS x FROM (SELECT ii.*, row_number() OVER (PARTITION BY ii.video_id ORDER BY ti.start, ii.sentence) AS k FROM ii JOIN ti ON ti.video_id = ii.video_id AND ti.idx = ii.idx WHERE type = 'conclusion') WHERE k <= 3 GROUP BY 1),
            e AS (SELECT v.video_id, '"Talk ' || v.video_id || '" covers ' || coalesce(a.n, 0) || ' main sections.' || coalesce(chr(10) || chr(10) || 'Key sections:' || chr(10) || a.x, '') || coalesce(chr(10) || chr(10) || 'Key takeaways:' || chr(10) || b.x, '')
                  || coalesce(chr(10) || chr(10) || 'Action items:' || chr(10) || c.x, '') || chr(10) || chr(10) || 'Overall tone: ' || CASE WHEN o.score IS NULL THEN 'neutral' ELSE replace({LABEL.format("o.score", 0.3, 0.1)}, '_', ' ') END AS x
                  FROM v LEFT JOIN a ON a.video_id = v.video_id LEFT JOIN b ON b.video_id = v.video_id LEFT JOIN c ON c.video_id = v.video_id LEFT JOIN o ON o.video_id = v.video_id)
            SELECT video_id, CASE WHEN length(x) > 500 THEN substring(x, 1, 497) || '...' ELSE x END AS executive_summary FROM e""",
        ),
        "emotion_summary": w(TURN + EMOTION, "SELECT emotion, count(*) AS n, round(avg(score), 5) AS average FROM em GROUP BY 1"),
    }
