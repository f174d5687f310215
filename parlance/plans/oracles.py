"""SQL for the queries of reports.py, and for those of catalog.py that need folds or recursion."""

from __future__ import annotations

from parlance import lexicons as lex
from parlance.operators import graph
from parlance.plans import catalog as c
from parlance.plans.reports import FIXTURE
from parlance.sources.media import default_id  # noqa: F401  (the digest stated below is this one)


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


V = "v AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, text, lang, source, coalesce(text, '') AS t FROM documents)"
ALSO = "v AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, text, lang, source, coalesce(text, '') AS t FROM documents UNION ALL SELECT video_id, text, 'en', 'fixture', text FROM (VALUES " + ", ".join(f"({_quote(k)}, {_quote(v)})" for k, v in FIXTURE.items()) + ") AS f(video_id, text))"
#: Texts of the table and of the fixture.
BOTH = c.DOC.replace(V, ALSO)
QUOTES = lambda strong, where="ti": rf""",
qs AS (SELECT *, round(CASE WHEN regexp_matches(sentence, '(?i){lex.POINTING}') THEN 0::DOUBLE ELSE 0.1::DOUBLE END
            + CASE WHEN len(list_intersect({c.WORDS("lower(sentence)")}, {c._list(strong)})) > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(sentence, '(?i){lex.SIMILE}') THEN 0.15::DOUBLE ELSE 0 END
            + CASE WHEN length(sentence) < 80 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN contains(sentence, '"') OR contains(sentence, '«') THEN 0.3::DOUBLE ELSE 0 END, 6) AS score FROM {where} WHERE length(sentence) BETWEEN 30 AND 200),
qo AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS num FROM qs WHERE score >= 0.3)"""  # noqa: E731
#: Phrases by count, then by where they were said first, shorter ones before longer; those that contain another are passed over.
REPEATED = """,
rl AS (SELECT video_id, list({'n': -n, 'i': first_idx, 'k': len(string_split(phrase, ' ')), 'p': pos, 'x': phrase} ORDER BY -n, first_idx, len(string_split(phrase, ' ')), pos, phrase) AS l FROM pq GROUP BY 1),
ro AS (SELECT video_id, list_reduce(l, lambda a, y: CASE WHEN len(a) >= 10 OR len(list_filter(a, lambda z: contains(z.x, y.x) OR contains(y.x, z.x))) > 0 THEN a ELSE list_append(a, y) END, []) AS l FROM rl)"""
PHRASES = c.PHRASES.replace("""pg AS (SELECT video_id, idx, w[i:i + n - 1] AS g FROM""", """pg AS (SELECT video_id, idx, i, w[i:i + n - 1] AS g FROM""").replace(
    "ph AS (SELECT video_id, array_to_string(g, ' ') AS phrase, count(*) AS n, min(idx) AS first_idx FROM pg", "pq AS (SELECT video_id, array_to_string(g, ' ') AS phrase, count(*) AS n, min(idx) AS first_idx, arg_min(i, idx::BIGINT * 1000000000 + i) AS pos FROM pg"
).replace("GROUP BY ALL HAVING", "GROUP BY video_id, phrase HAVING")


def tags(text: str, kind: str) -> str:
    more = " ".join(f"|| CASE WHEN regexp_matches({text}, '(?i){p}') THEN ['{t}'] ELSE [] END" for t, p in lex.TAGS.items())
    all_ = f"[{kind}] || list_transform(regexp_extract_all({text}, '(?i){lex.ACRONYMS}'), lambda y: upper(y)) {more}"
    return f"list_transform(range(1, least(10, len(u)) + 1), lambda i: u[i]) AS tags FROM (SELECT *, list_filter(u0, lambda y, i: list_position(u0, y) = i) AS u FROM (SELECT *, {all_} AS u0 FROM"


def findings(strong: list[str]) -> str:
    return (
        QUOTES(strong)
        + PHRASES
        + REPEATED
        + f""",
rr AS (SELECT video_id, unnest(l) AS y, unnest(range(len(l))) AS ord FROM ro),
fa AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx, ord) AS num FROM im WHERE importance >= 0.3),
fb AS (SELECT video_id, 0 AS src, idx, ord, 'INS-' || substring(video_id, 1, 8) || '-' || lpad(CAST(num AS VARCHAR), 4, '0') AS insight_id, type, sentence AS text, start, "end", importance, round(least(1.0, 0.5::DOUBLE + 0.15::DOUBLE * hits), 6) AS confidence, context, {tags("sentence", "type")} fa))),
fc AS (SELECT video_id, 1 AS src, idx, 0 AS ord, 'QUO-' || substring(video_id, 1, 8) || '-' || lpad(CAST(num AS VARCHAR), 4, '0') AS insight_id, 'quote' AS type, sentence AS text, start, "end", round(least(1.0, score + 0.1::DOUBLE), 6) AS importance, least(1.0::DOUBLE, score) AS confidence, '' AS context, ['quote', 'highlight'] AS tags FROM qo),
fd AS (SELECT rr.video_id, 2 AS src, 0 AS idx, CAST(ord AS INTEGER) AS ord, 'REP-' || substring(rr.video_id, 1, 8) || '-' || lpad(CAST(ord + 1 AS VARCHAR), 4, '0') AS insight_id, 'emphasis' AS type, y.x AS text, start, "end",
       round(least(1.0, 0.4::DOUBLE - 0.1::DOUBLE * y.n), 6) AS importance, 0.7::DOUBLE AS confidence, 'Repeated ' || (-y.n) || ' times across the video' AS context, ['repetition', 'emphasis'] AS tags FROM rr JOIN ti ON ti.video_id = rr.video_id AND ti.idx = y.i),
fe AS (SELECT * FROM fb UNION ALL SELECT * FROM fc UNION ALL SELECT * FROM fd),
ff AS (SELECT *, row_number() OVER (PARTITION BY video_id, substring(lower(text), 1, 80) ORDER BY src, idx, ord) AS fst FROM fe),
fg AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY importance DESC, src, idx, ord) AS INTEGER) AS rank FROM ff WHERE fst = 1)"""
    )


ACTIONS = rf""",
aa AS (SELECT video_id, sentence AS text, CASE WHEN importance > 0.7 THEN 'high' WHEN importance > 0.4 THEN 'medium' ELSE 'low' END AS priority, start, confidence, 0 AS src, rank AS ord FROM ii WHERE type = 'action_item'
       UNION ALL SELECT video_id, sentence, 'medium', start, 0.6::DOUBLE, 1, idx FROM ti WHERE regexp_matches(sentence, {_quote(lex.IMPERATIVE)})),
ab AS (SELECT *, 'ACT-' || lpad(CAST(row_number() OVER (PARTITION BY video_id ORDER BY src, ord) AS VARCHAR), 4, '0') AS action_id, row_number() OVER (PARTITION BY video_id, substring(lower(text), 1, 60) ORDER BY src, ord) AS k FROM aa),
ac2 AS (SELECT video_id, action_id, text, priority, start, confidence FROM ab WHERE k = 1)"""
#: Keyword overlap of windows of three sentences, boundaries by a fold, topics from boundary to boundary.
TOPICS = lambda below: rf""",
kt AS (SELECT video_id, s, t, list_transform(s, lambda x: list_filter({c.TOK.format("x", 3)}, lambda q: NOT list_contains({c._list(lex.STOP_WORDS)}, q))) AS tok FROM sl),
kw AS (SELECT video_id, i, flatten(tok[i:i + 2]) AS k FROM (SELECT video_id, tok, unnest(range(1, len(tok) + 1)) AS i FROM kt)),
kr AS (SELECT video_id, i, {c.TOP("k")} AS k FROM kw WHERE len(k) > 0),
ks AS (SELECT b.video_id, b.i - 1 AS idx FROM kr a JOIN kr b ON a.video_id = b.video_id AND b.i = a.i + 3 WHERE round(len(list_intersect(a.k, b.k))::DOUBLE / len(list_distinct(list_concat(a.k, b.k))), 6) < {below}),
kb AS (SELECT video_id, list_reduce(list(CAST(idx AS INTEGER) ORDER BY idx), lambda a, y: CASE WHEN y - a[-1] >= 3 THEN list_append(a, y) ELSE a END, [CAST(0 AS INTEGER)])[1:20] AS starts FROM ks GROUP BY 1),
kc AS (SELECT kt.video_id, s, t, tok, CASE WHEN len(s) < 3 OR starts IS NULL THEN [CAST(0 AS INTEGER)] ELSE starts END AS starts FROM kt LEFT JOIN kb ON kb.video_id = kt.video_id WHERE len(s) > 0),
kd AS (SELECT *, CAST(unnest(range(len(starts))) AS INTEGER) AS topic_id FROM kc),
ke AS (SELECT *, starts[topic_id + 1] AS start_index, CAST(coalesce(starts[topic_id + 2], len(s)) AS INTEGER) AS end_index FROM kd),
kf AS (SELECT *, s[start_index + 1:end_index] AS part, flatten(tok[start_index + 1:end_index]) AS k FROM ke),
kg AS (SELECT *, ({c.TOP("k")})[1:10] AS keywords, array_to_string(part[1:3], ' ') AS head FROM kf),
tp AS (SELECT video_id, topic_id, CASE WHEN len(s) < 3 THEN 'Main Content' WHEN length(part[1]) <= 60 THEN regexp_replace(part[1], '\.+$', '') WHEN len(keywords) > 0 THEN array_to_string(list_transform(keywords[1:4], lambda x: replace(upper(x[1]), 'ẞ', 'Ss') || x[2:]), ' — ')
       ELSE array_to_string({c.WORDS("part[1]")}[1:8], ' ') || '...' END AS title,
       CASE WHEN len(s) < 3 THEN CASE WHEN length(t) > 300 THEN substring(t, 1, 300) || '...' ELSE t END WHEN length(head) > 400 THEN substring(head, 1, 397) || '...' ELSE head END AS summary,
       CASE WHEN len(s) < 3 THEN 0::DOUBLE ELSE start_index * 3.0::DOUBLE END AS start_time, CASE WHEN len(s) < 3 THEN 0::DOUBLE ELSE end_index * 3.0::DOUBLE END AS end_time, start_index, end_index,
       CASE WHEN len(s) < 3 THEN t ELSE array_to_string(part, ' ') END AS text, keywords, CASE WHEN len(s) < 3 THEN 1.0::DOUBLE WHEN len(part) >= 5 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM kg)"""  # noqa: E731
#: Topics joined in order, then the shortest neighbours until there are fifteen at most. A group: first and last topic, length, size and title of its longest.
CHAPTERS = """,
cj AS (SELECT b.video_id, b.topic_id, len(list_intersect(a.keywords, b.keywords))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.keywords, b.keywords)))) > 0.6 AS alike FROM tp a JOIN tp b ON a.video_id = b.video_id AND b.topic_id = a.topic_id + 1),
cl AS (SELECT tp.video_id, list({'i': tp.topic_id, 'd': end_time - start_time, 'alike': coalesce(alike, false)} ORDER BY tp.topic_id) AS l FROM tp LEFT JOIN cj ON cj.video_id = tp.video_id AND cj.topic_id = tp.topic_id GROUP BY 1),
cf AS (SELECT video_id, list_reduce(list_transform(l, lambda x: [{'a': x.i, 'z': x.i, 'd': x.d, 'alike': x.alike}]), lambda g, x: CASE WHEN g[-1].d < 60 OR x[1].alike THEN list_append(g[1:len(g) - 1], {'a': g[-1].a, 'z': x[1].z, 'd': g[-1].d + x[1].d, 'alike': g[-1].alike}) ELSE list_append(g, x[1]) END) AS g FROM cl),
cm AS (SELECT video_id, g FROM cf UNION ALL SELECT video_id, list_append(g[1:i - 1], {'a': g[i].a, 'z': g[i + 1].z, 'd': g[i].d + g[i + 1].d, 'alike': false}) || g[i + 2:] FROM (
       SELECT video_id, g, list_sort(list_transform(range(1, len(g)), lambda i: {'d': g[i].d + g[i + 1].d, 'i': i}))[1].i AS i FROM cm WHERE len(g) > 15)),
cn AS (SELECT video_id, unnest(g) AS x, unnest(range(len(g))) AS chapter_id FROM cm WHERE len(g) <= 15),
ch AS (SELECT cn.video_id, CAST(chapter_id AS INTEGER) AS chapter_id, arg_min(title, {'n': -length(text), 'i': topic_id}) AS title, min(start_time) AS start_time, max(end_time) AS end_time, max(end_time) - min(start_time) AS duration,
       substring(coalesce(string_agg(summary, ' ' ORDER BY topic_id) FILTER (summary <> ''), ''), 1, 500) AS summary, string_agg(CAST(topic_id AS VARCHAR), ',' ORDER BY topic_id) AS topic_ids
       FROM cn JOIN tp ON tp.video_id = cn.video_id AND topic_id BETWEEN x.a AND x.z GROUP BY 1, 2)"""
RELATIONS = rf""",
ns AS (SELECT video_id, text, unnest(range(len(p))) AS idx, unnest(p) AS sentence FROM (SELECT video_id, text, string_split(regexp_replace(t, '[.!?।॥]\s+', chr(1), 'g'), chr(1)) AS p FROM v)),
nm AS (SELECT video_id, lower(name) AS low, arg_max(entity_id, ord) AS entity_id, min(ord) AS place FROM ee GROUP BY 1, 2),
nh AS (SELECT ns.video_id, idx, substring(sentence, 1, 200) AS context, entity_id, place FROM ns JOIN nm ON nm.video_id = ns.video_id AND contains(lower(sentence), low)),
np AS (SELECT a.entity_id AS source_id, b.entity_id AS target_id, a.video_id, a.idx, a.context FROM nh a JOIN nh b ON a.video_id = b.video_id AND a.idx = b.idx AND a.place < b.place AND a.entity_id <> b.entity_id),
nr AS (SELECT source_id, target_id, 'related_to' AS relation_type, count(*)::DOUBLE AS weight, arg_min(context, {{'v': video_id, 'i': idx, 'c': context}}) AS context, min(video_id) AS source_video FROM np GROUP BY 1, 2)"""
REFERENCES = """,
xn AS (SELECT video_id, count(*) AS n FROM ee GROUP BY 1), xp AS (SELECT a.video_id AS x, b.video_id AS y, count(*) AS shared FROM ee a JOIN ee b ON a.entity_id = b.entity_id AND a.video_id < b.video_id GROUP BY ALL HAVING count(*) >= 2),
xr AS (SELECT 'xref-' || substring(md5(x || ':' || y), 1, 10) AS ref_id, x, y, round(shared::DOUBLE / (i.n + j.n - shared), 6) AS similarity FROM xp JOIN xn i ON i.video_id = x JOIN xn j ON j.video_id = y)"""
MATCH = "mx AS (SELECT entity_id, arg_min(name, video_id) AS name, arg_min(entity_type, video_id) AS entity_type FROM ee WHERE contains(lower(name), 'ra') {} GROUP BY 1)"
HITS = f"""h0 AS (SELECT b.vec_id AS query_id, a.vec_id, {c.COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0),
h1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM h0),
hi AS (SELECT query_id, rank, score, CAST(doc_id AS VARCHAR) AS video_id, 'Talk of ' || source || '!' AS title, text AS chunk FROM h1 JOIN documents ON doc_id = vec_id WHERE rank <= 5),
hq AS (SELECT vec_id AS query_id, 'What about ' || label || '?' AS question FROM embeddings WHERE vec_id % 20 = 0),
hc AS (SELECT query_id, string_agg('[Source ' || rank || '] ' || coalesce(chunk, ''), chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n, round(avg(score), 6) AS average FROM hi GROUP BY 1)"""
BUCKET = """SELECT *, CASE WHEN k IS NOT NULL THEN 'key:' || substring(sha256(k), 1, 12) ELSE 'ip:10.0.' || user_id END AS bucket
FROM (SELECT *, CASE WHEN user_id % 4 = 1 THEN 'k-alpha' WHEN user_id % 4 = 2 THEN 'k-' || (user_id % 8) WHEN event_id % 13 = 0 THEN 'k-wrong' END AS k FROM events)"""
#: The i-th event of every user, one round of the recursion each.
ROUNDS = "e AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


def sql() -> dict[str, str]:
    w = lambda body, sel: f"WITH RECURSIVE {body} {sel}"
    default = c._insights(lex.PATTERNS)
    dark = [k for k in lex.EMOTIONS if k not in lex.BRIGHT]
    assert dark == lex.DARK
    stamp = "CASE WHEN {0} >= 3600 THEN ({0} // 3600) || ':' || lpad(CAST({0} % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST({0} // 60 AS VARCHAR) END || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')".format
    ms = "CAST(floor({} * 1000) AS BIGINT)".format
    low = c.DOC + TOPICS(0.03) + CHAPTERS
    topic = "video_id, topic_id, title, summary, start_time, end_time, start_index, end_index, text, array_to_string(keywords, ' ') AS keywords, confidence"
    chapter = "video_id, chapter_id, title, start_time, end_time, duration, summary, topic_ids"
    found = "SELECT video_id, rank, insight_id, type, start, \"end\", importance, confidence, md5(text) AS text_md5 FROM fg WHERE rank <= 50"
    return {
        "repeated_phrases": w(c.DOC + PHRASES + REPEATED, "SELECT video_id, array_to_string(list_transform(l, lambda z: z.x), '|') AS phrases FROM ro"),
        "findings": w(c.DOC + c._insights() + findings(c.STRONG), found),
        "default_findings": w(BOTH + default + findings(lex.STRONG_WORDS), "SELECT video_id, rank, insight_id, type, importance, confidence, md5(context) AS context_md5, array_to_string(list_sort(tags), ',') AS tags FROM fg WHERE rank <= 50"),
        "default_quotes": w(BOTH + QUOTES(lex.STRONG_WORDS), "SELECT video_id, idx, score, sentence AS text FROM qo"),
        "default_arc": w(BOTH + c.arc(lex.POSITIVE, lex.NEGATIVE), f'SELECT video_id, idx, start, "end", score, {c.LABEL.format("score", 0.5, 0.15)} AS label FROM ar'),
        "default_entities": w(BOTH + c.ent(graph.NAME), "SELECT video_id, entity_id, name, entity_type, frequency FROM ee"),
        "default_emotions": w(BOTH + ", tt AS (SELECT video_id, idx, sentence AS text FROM ti)" + c.emotion(lex.EMOTIONS, lex.BRIGHT), "SELECT * FROM em"),
        "action_items": w(BOTH + default + ACTIONS, "SELECT * FROM ac2"),
        "reel_statistics": w(BOTH + default + ACTIONS, """, l AS (SELECT video_id, max("end") AS d FROM ti GROUP BY 1), f AS (SELECT video_id, count(*) AS n, round(avg(importance), 6) AS m FROM ii GROUP BY 1), a AS (SELECT video_id, count(*) AS n FROM ac2 GROUP BY 1)
            SELECT l.video_id, coalesce(f.n, 0) AS total_insights, coalesce(a.n, 0) AS total_action_items, round(least(20, coalesce(f.n, 0)) / greatest(d / 60, 1.0), 6) AS highlight_density, coalesce(m, 0) AS avg_importance
            FROM l LEFT JOIN f ON f.video_id = l.video_id LEFT JOIN a ON a.video_id = l.video_id"""),
        "insight_type_counts": w(c.DOC + c._insights(), "SELECT video_id, type, count(*) AS n FROM ii GROUP BY 1, 2"),
        "sentiment_distribution": w(c.DOC + c.ARC, f"SELECT video_id, {c.LABEL.format('score', 0.5, 0.15)} AS label, count(*) AS n FROM ar GROUP BY 1, 2"),
        "topics": w(c.DOC + TOPICS(0.03), f"SELECT {topic} FROM tp"),
        "default_topics": w(c.DOC + TOPICS(0.2), f"SELECT {topic} FROM tp"),
        "topic_durations": w(c.DOC + TOPICS(0.2), "SELECT video_id, round(coalesce(avg(end_time - start_time) FILTER (end_time > start_time), 0), 6) AS average FROM tp GROUP BY 1"),
        "chapters": w(low, f"SELECT {chapter} FROM ch"),
        "default_chapters": w(c.DOC + TOPICS(0.2) + CHAPTERS, f"SELECT {chapter} FROM ch"),
        "chapters_youtube": w(low, f"SELECT video_id, string_agg({stamp('CAST(floor(start_time) AS BIGINT)')} || ' ' || title, chr(10) ORDER BY chapter_id) AS body FROM ch GROUP BY 1"),
        "chapters_srt": w(low, f"SELECT video_id, string_agg((chapter_id + 1) || chr(10) || {c.HMS.format(ms('start_time'), ',')} || ' --> ' || {c.HMS.format(ms('end_time'), ',')} || chr(10) || title || chr(10), chr(10) ORDER BY chapter_id) AS body FROM ch GROUP BY 1"),
        "chapters_vtt": w(low, f"SELECT video_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({c.HMS.format(ms('start_time'), '.')} || ' --> ' || {c.HMS.format(ms('end_time'), '.')} || chr(10) || title || chr(10), chr(10) ORDER BY chapter_id) AS body FROM ch GROUP BY 1"),
        "chapters_ffmpeg": w(low, f"SELECT video_id, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || {ms('start_time')} || chr(10) || 'END=' || {ms('end_time')} || chr(10) || 'title=' || title, chr(10) ORDER BY chapter_id) AS body FROM ch GROUP BY 1"),
        "chapter_topics": w(c.DOC + c.MINUTES + TOPICS(0.2), """SELECT cp.video_id, chapter_id, coalesce(string_agg(CAST(topic_id AS VARCHAR), ',' ORDER BY topic_id), '') AS topic_ids
            FROM cp LEFT JOIN tp ON tp.video_id = cp.video_id AND tp.start_time >= cp.start_time AND tp.end_time <= cp.end_time GROUP BY 1, 2"""),
        "split_manifest": c._sql()["chapter_signals"].replace("sp AS (SELECT video_id, start AS s FROM ti WHERE idx % 7 = 3)", "sp AS (SELECT video_id, start AS s FROM ti WHERE false)").split("SELECT q.video_id, q.chapter_id, 'Part '")[0]
        + """SELECT q.video_id, q.chapter_id, 'Part ' || (q.chapter_id + 1) AS title, greatest(0.0, a - 2) AS buffer_start, b + 2 AS buffer_end, 'chapter_' || lpad(CAST(q.chapter_id AS VARCHAR), CAST(greatest(2, length(CAST(q.chapter_id AS VARCHAR))) AS INTEGER), '0') || '_Part_' || (q.chapter_id + 1) || '.mp4' AS file FROM q""",
        "chapter_slides": w(c.DOC + c.MINUTES, """, sh AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn * 5.0::DOUBLE AS sec, text FROM conversations),
            k AS (SELECT cp.video_id, chapter_id, text, row_number() OVER (PARTITION BY cp.video_id, chapter_id ORDER BY sec, text) AS n FROM cp JOIN sh ON sh.video_id = cp.video_id AND sec BETWEEN start_time AND end_time)
            SELECT video_id, chapter_id, md5(string_agg(substring(text, 1, 200), '|' ORDER BY n)) AS slides_md5, CAST(count(*) AS INTEGER) AS n FROM k WHERE n <= 5 GROUP BY 1, 2"""),
        "index_statistics": w(c.DOC + c._insights(), "SELECT count(DISTINCT video_id) AS total_videos, count(*) AS total_insights FROM ii"),
        "default_ids": w(V, "SELECT video_id, substring(md5(substring(t, 1, 200)), 1, 12) AS default_id FROM v"),
        "default_durations": w(V, f""", l AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, max(turn * 2.0::DOUBLE + 1.5) AS d FROM conversations GROUP BY 1) SELECT v.video_id, coalesce(d, len({c.WORDS("t")}) * 4 / 10::DOUBLE) AS duration FROM v LEFT JOIN l ON l.video_id = v.video_id"""),
        "caption_choice": """WITH m AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 AND source IS NOT NULL THEN source ELSE coalesce(text, '') END AS x, doc_id % 2 = 0 AS own, doc_id % 4 < 3 AS auto FROM documents)
            SELECT CAST(doc_id AS VARCHAR) AS video_id, md5(CASE WHEN own OR auto THEN x ELSE '' END) AS text_md5,
            CASE WHEN own AND lang = 'en' THEN 'en' WHEN auto OR (own AND lang = 'hi') THEN 'hi' WHEN own AND x <> '' THEN lang ELSE 'unknown' END AS language FROM m""",
        "speaker_samples": w(c.TURN, """, sm AS (SELECT video_id, speaker_id, text, row_number() OVER (PARTITION BY video_id, speaker_id ORDER BY idx) AS n FROM tt WHERE length(text) > 0),
            st AS (SELECT video_id, speaker_id, string_agg(substring(text, 1, 200), '|' ORDER BY n) AS x, count(*) AS n FROM sm WHERE n <= 5 GROUP BY 1, 2)
            SELECT pr.video_id, pr.speaker_id, rank, md5(coalesce(x, '')) AS samples_md5, CAST(coalesce(n, 0) AS INTEGER) AS n FROM pr LEFT JOIN st ON st.video_id = pr.video_id AND st.speaker_id IS NOT DISTINCT FROM pr.speaker_id"""),
        "emotion_reports": w(c.TURN + c.EMOTION, """, eg AS (SELECT video_id, emotion, count(*) AS n, min(idx) AS f, sum(CASE sentiment WHEN 'negative' THEN -abs(score) WHEN 'positive' THEN abs(score) ELSE 0 END) AS s FROM em GROUP BY 1, 2),
            er AS (SELECT video_id, arg_min(emotion, {'n': -n, 'f': f, 'e': emotion}) AS dominant_emotion, round(sum(s) / sum(n), 6) AS avg_sentiment_score, CAST(sum(n) AS BIGINT) AS segments FROM eg GROUP BY 1)
            SELECT *, CASE WHEN avg_sentiment_score > 0.1 THEN 'positive' WHEN avg_sentiment_score < -0.1 THEN 'negative' ELSE 'neutral' END AS overall_sentiment FROM er"""),
        "default_slide_runs": c._sql()["slide_runs"].replace("END < 0.2 AS far", "END < 0.85 AS far"),
        "relationships": w(c.DOC + c.ENT + RELATIONS, "SELECT source_id, target_id, relation_type, weight, md5(context) AS context_md5, source_video FROM nr"),
        "entity_nodes": w(c.DOC + c.ENT, "SELECT entity_id, arg_min(name, video_id) AS name, arg_min(entity_type, video_id) AS entity_type, CAST(sum(frequency) AS BIGINT) AS frequency, md5(string_agg(video_id, ',' ORDER BY video_id)) AS videos_md5, CAST(count(*) AS INTEGER) AS n_videos FROM ee GROUP BY 1"),
        "connected_entities": w(c.DOC + c.ENT + RELATIONS, """, dg AS (SELECT node, count(*) AS n FROM (SELECT source_id AS node FROM nr UNION ALL SELECT target_id FROM nr) GROUP BY 1 ORDER BY n DESC, node LIMIT 10)
            SELECT entity_id, arg_min(name, video_id) AS name, arg_min(entity_type, video_id) AS entity_type, max(n) AS connections FROM dg JOIN ee ON entity_id = node GROUP BY 1"""),
        "graph_matches": w(c.DOC + c.ENT + ", " + MATCH.format("AND entity_type = 'concept'"), "SELECT * FROM mx"),
        "graph_relations": w(c.DOC + c.ENT + RELATIONS + ", " + MATCH.format(""), "SELECT source_id, target_id, relation_type, weight FROM nr WHERE source_id IN (SELECT entity_id FROM mx) OR target_id IN (SELECT entity_id FROM mx) ORDER BY weight DESC, source_id, target_id LIMIT 50"),
        "graph_references": w(c.DOC + c.ENT + REFERENCES + ", " + MATCH.format(""), """, mv AS (SELECT DISTINCT video_id FROM ee WHERE entity_id IN (SELECT entity_id FROM mx))
            SELECT ref_id, similarity FROM xr WHERE similarity >= 0.3 AND (x IN (SELECT video_id FROM mv) OR y IN (SELECT video_id FROM mv)) ORDER BY similarity DESC, ref_id LIMIT 20"""),
        "key_entities": w(c.DOC + c.ENT, ", k AS (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frequency DESC, name, entity_id) AS INTEGER) AS place FROM ee) SELECT video_id, place, name, entity_type, frequency FROM k WHERE place <= 15"),
        "rag_context": w(HITS, "SELECT query_id, md5(context) AS context_md5 FROM hc"),
        "rag_sources": w(HITS, "SELECT query_id, rank, video_id, title, md5(CASE WHEN length(chunk) > 500 THEN substring(chunk, 1, 500) || '...' ELSE chunk END) AS text_md5, score AS similarity_score, rank - 1 AS chunk_index FROM hi"),
        "rag_answers": w(HITS, """SELECT hq.query_id, question, md5(coalesce(context, 'No relevant passage was found. Ask in other words, or check that the recording is in the store.')) AS answer_md5,
            CASE WHEN n IS NULL OR average < 0.5 THEN 'low' WHEN average < 0.7 THEN 'medium' ELSE 'high' END AS confidence, coalesce(n, 0) AS chunks_found, coalesce(average, 0) AS avg_similarity FROM hq LEFT JOIN hc ON hc.query_id = hq.query_id"""),
        "rag_batch_report": w(HITS, "SELECT count(*) AS total, count(*) AS successful, CAST(0 AS BIGINT) AS failed FROM hq"),
        "related_topics": w(HITS, r""", rt AS (SELECT hi.query_id, rank, score, video_id, trim(regexp_replace(title, '[^\p{L}\p{M}\p{N}_\s]', '', 'g')) AS clean, list_filter(regexp_extract_all(chunk, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')[1:3], lambda y: length(y) > 5 AND NOT contains(lower(question), lower(y))) AS ps FROM hi JOIN hq ON hq.query_id = hi.query_id),
            ru AS (SELECT *, CASE WHEN length(clean) > 10 THEN [clean] ELSE [] END || ps AS all_ FROM rt), rv AS (SELECT query_id, rank, score, video_id, unnest(all_) AS topic, unnest(range(len(all_))) AS pos FROM ru),
            rg AS (SELECT query_id, topic, max(score) AS relevance_score, count(DISTINCT video_id) AS video_count, min({'r': rank, 'p': pos}) AS f FROM rv GROUP BY 1, 2),
            rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, f) AS INTEGER) AS place FROM rg) SELECT query_id, place, topic, relevance_score, video_count FROM rk WHERE place <= 5"""),
        "request_buckets": f"SELECT event_id, bucket FROM ({BUCKET})",
        "rate_limit": w(ROUNDS, """, b AS (SELECT user_id, event_id, ts, now, i, 9::DOUBLE AS tokens, true AS allowed, CAST(0 AS BIGINT) AS retry_after FROM e WHERE i = 1 UNION ALL
            SELECT user_id, event_id, ts, now, i, CASE WHEN x >= 1 THEN x - 1 ELSE x END, x >= 1, CASE WHEN x >= 1 THEN 0 ELSE CAST(floor((1 - x) / 10 * 3600) AS BIGINT) + 1 END
            FROM (SELECT e.*, least(10::DOUBLE, tokens + greatest(0::DOUBLE, e.now - b.now) / 3600::DOUBLE * 10) AS x FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1))
            SELECT user_id, event_id, ts, allowed, retry_after FROM b"""),
        "abuse_block": w(ROUNDS, """, z AS (SELECT user_id, CAST(0 AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, false AS failed, false AS blocked, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, 0::DOUBLE AS f, 0::DOUBLE AS until FROM e GROUP BY 1),
            a AS (SELECT * FROM z UNION ALL SELECT user_id, event_id, ts, failed, until1 > 0, i, n2, f2, CASE WHEN counts AND n2 >= 3 THEN now + 864000 ELSE until1 END FROM (
              SELECT *, CASE WHEN counts THEN CASE WHEN n1 = 0 OR now - f > 864000 THEN 1 ELSE n1 + 1 END ELSE n1 END AS n2, CASE WHEN counts AND (n1 = 0 OR now - f > 864000) THEN now ELSE f END AS f2 FROM (
                SELECT *, failed AND until1 = 0 AS counts FROM (SELECT e.user_id, e.event_id, e.ts, e.failed, e.now, e.i, a.f, CASE WHEN a.until > 0 AND e.now >= a.until THEN 0 ELSE a.n END AS n1, CASE WHEN a.until > 0 AND e.now >= a.until THEN 0 ELSE a.until END AS until1
                  FROM a JOIN e ON e.user_id = a.user_id AND e.i = a.i + 1))))
            SELECT user_id, event_id, ts, failed, blocked FROM a WHERE i > 0"""),
    }
